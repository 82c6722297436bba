"""Catalogue analytics on Spark: harvest, score, compare and date open data catalogues."""

__version__ = "0.1.0"
