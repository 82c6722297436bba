"""Ratios of a change row, node ids and small column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def change_ratios(added: Column, deleted: Column, updated: Column, static: Column, union_size: Column) -> dict[str, Column]:
    return {
        "dyratio": safe_ratio(added + deleted + updated, union_size),
        "adddelratio": safe_ratio(added - deleted, added + deleted),
        "addratio": safe_ratio(added, union_size),
        "delratio": safe_ratio(deleted, union_size),
        "updatedratio": safe_ratio(updated, union_size),
        "staticratio": safe_ratio(static, union_size),
    }


def node_id(*parts: Column) -> Column:
    """Deterministic blank node: the hash of everything that identifies it."""
    return F.concat(F.lit("_:"), F.sha1(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def angle(iri: Column) -> Column:
    return F.concat(F.lit("<"), iri, F.lit(">"))


def content_hash(raw: Column) -> Column:
    """md5 of a JSON document that does not depend on key order or blanks.

    A VARIANT keeps the fields of an object sorted, so its text is canonical.
    """
    return F.md5(F.to_json(F.try_parse_json(raw)))


def flat_row(*frames: tuple[str, DataFrame]) -> list[Column]:
    """All columns of several aliased frames, the first of equal names wins."""
    seen: dict[str, Column] = {}
    for alias, df in frames:
        for name in df.columns:
            seen.setdefault(name, F.col(f"{alias}.`{name}`").alias(name))
    return list(seen.values())


def resource_filter(
    format: str | None = None,
    max_size: int | None = None,
    strict_size: bool = False,
    valid: bool | None = None,
) -> Column:
    """Predicate on resources; strict_size asks for a known size above zero."""
    tests = [F.lit(True)]
    if format is not None:
        tests.append(F.col("format") == format)
    if max_size is not None and strict_size:
        tests.append((F.col("size") > 0) & (F.col("size") <= max_size))
    elif max_size is not None:
        tests.append((F.col("size") <= max_size) | F.col("size").isNull())
    if valid is not None:
        tests.append(F.col("valid") == valid)
    return reduce(lambda a, b: a & b, tests)
