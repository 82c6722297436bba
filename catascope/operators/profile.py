"""Profiles of tables given as cells (file, row, col, value), and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.functions.cells import cell_label, cell_type
from catascope.functions.ratios import node_id
from catascope.session import staged
from catascope.sources.csvfiles import csv_fields, csv_heads, tasks_for

# Local names of the column types.
TYPE_NAMES = {"number": "number", "datetime": "datetime", "binary": "binary", "any": "anyAtomicType"}


def cells(table: DataFrame, columns: list[str], file: str, row: Column) -> DataFrame:
    """A table as cells; text of every column, row given by a key of the table."""
    pairs = [F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns]
    return table.select(F.lit(file).alias("file"), row.alias("row"), F.inline(F.array(*pairs)))


def column_profile(cell_rows: DataFrame) -> DataFrame:
    """Cells and filled cells per column."""
    full = F.coalesce(F.col("value") != "", F.lit(False))
    return cell_rows.groupBy("file", "col").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(full).alias("filled"),
        (F.count_if(full) / F.count(F.lit(1))).alias("completeness"),
    )


def table_profile(table: DataFrame, columns: list[str], file: str) -> DataFrame:
    """Rows, columns, cell completeness and mean row completeness of a table."""
    full = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False)).cast("int")
    per_row = sum((full(c) for c in columns[1:]), full(columns[0]))
    n = len(columns)
    return table.groupBy().agg(
        F.lit(file).alias("file"),
        F.count(F.lit(1)).alias("rows"),
        F.lit(n).alias("columns"),
        (F.sum(per_row) / (F.count(F.lit(1)) * n)).alias("cell_completeness"),
        F.avg(per_row / n).alias("row_completeness"),
    )


def column_type(cell_rows: DataFrame) -> DataFrame:
    """number, datetime, binary (two values of one token each) or any; empty cells do not count.

    Cells collapse to distinct values per column before anything is compared.
    """
    label = cell_label(F.col("value"))
    values = cell_rows.groupBy("file", "col", "value").agg(F.count(F.lit(1)).alias("n"))
    values = values.withColumn("label", label).where(F.col("label") != "empty")
    c = values.groupBy("file", "col").agg(
        F.bool_and(F.col("label") == "number").alias("numbers"),
        F.bool_and(F.col("label") == "datetime").alias("datetimes"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.bool_and(~F.col("value").contains(" ")).alias("single"),
    )
    kind = (
        F.when(F.col("numbers"), TYPE_NAMES["number"])
        .when(F.col("datetimes"), TYPE_NAMES["datetime"])
        .when((F.col("distinct_values") == 2) & F.col("single"), TYPE_NAMES["binary"])
        .otherwise(TYPE_NAMES["any"])
    )
    return c.select("file", "col", kind.alias("datatype"))


def label_counts(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.groupBy("file", "col", cell_label(F.col("value")).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def char_dist(cell_rows: DataFrame) -> DataFrame:
    """Number of every character per column, over the whole values."""
    chars = cell_rows.select("file", "col", F.explode(F.split("value", "")).alias("char"))
    return chars.where(F.col("char") != "").groupBy("file", "col", "char").agg(F.count(F.lit(1)).alias("count"))


def length_dist(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.where(F.col("value").isNotNull()).groupBy("file", "col", F.length("value").alias("length")).agg(
        F.count(F.lit(1)).alias("count")
    )


def token_dist(cell_rows: DataFrame) -> DataFrame:
    """Number of cells by their number of tokens, four and more together."""
    n = F.size(F.split("value", " "))
    label = F.when(n >= 4, "4+").otherwise(n.cast("string"))
    return cell_rows.where(F.col("value").isNotNull()).groupBy("file", "col", label.alias("tokens")).agg(
        F.count(F.lit(1)).alias("count")
    )


def common_type(cell_rows: DataFrame) -> DataFrame:
    """Most common cell type of every column; the first by name wins a tie."""
    counted = cell_rows.groupBy("file", "col", cell_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("file", "col").agg(
        F.min_by("type", F.struct((-F.col("n")).alias("n"), F.col("type"))).alias("type"),
        F.max("n").alias("count"),
    )


def csvw(records: DataFrame, media: str = "text/csv") -> DataFrame:
    """Dialect and typed columns of CSV files (`csvfiles.csv_records`), one row per column.

    Delimiter, names and header come from the first record, types from all records.
    """
    head = staged(csv_heads(records), "csv-heads")
    told = records.groupBy("file").agg(F.count_if("comment").alias("comment_lines"))
    body = records.where("not comment").join(head.select("file", F.col("row").alias("head"), "header"), "file")
    body = body.where(~(F.col("header") & (F.col("row") == F.col("head"))))
    cells_ = body.select("file", F.posexplode(csv_fields(F.col("value"), F.col("delimiter"))).alias("pos", "value"))
    cells_ = cells_.select("file", F.col("pos").cast("string").alias("col"), "value").repartition(tasks_for(head), "file", "col", "value")
    types = column_type(cells_)
    named = head.join(told, "file").select("file", "size", "encoding", "delimiter", "header", "comment_lines", F.posexplode("fields").alias("pos", "value")).withColumn(
        "name", F.when(F.col("header"), F.col("value")).otherwise(F.concat(F.lit("col"), (F.col("pos") + 1).cast("string")))
    )
    typed = types.select("file", F.col("col").cast("int").alias("pos"), "datatype")
    return named.join(typed, ["file", "pos"], "left").select(
        F.col("file").alias("url"), F.lit(media).alias("media_type"), F.col("size").alias("byte_size"), "encoding",
        "delimiter", "header", F.col("header").cast("int").alias("header_rows"), "comment_lines", "pos", "name",
        F.coalesce("datatype", F.lit(TYPE_NAMES["any"])).alias("datatype"),
    )


CSVW = "http://www.w3.org/ns/csvw#"


def csvw_triples(description: DataFrame, snapshot: int) -> DataFrame:
    """The description as triples: table, dialect, schema and columns."""
    from catascope.operators.mapping import DCAT
    from catascope.operators.triples import TRIPLE, _t

    sn = F.lit(snapshot)
    url = F.col("url")
    table, dialect = node_id(url, sn), node_id(url, sn, F.lit("dialect"))
    schema, column = node_id(url, sn, F.lit("tableSchema")), node_id(url, sn, F.lit("column"), F.col("pos"))
    of_table = [
        _t(table, CSVW + "url", url, "uri"),
        _t(table, DCAT + "mediaType", F.col("media_type")),
        _t(table, DCAT + "byteSize", F.col("byte_size").cast("string")),
        _t(table, CSVW + "dialect", dialect, "bnode"),
        _t(dialect, CSVW + "encoding", F.col("encoding")),
        _t(dialect, CSVW + "delimiter", F.col("delimiter")),
        _t(dialect, CSVW + "skipBlankRows", F.when(F.col("comment_lines") > 0, F.col("comment_lines")).cast("string")),
        _t(dialect, CSVW + "header", F.col("header").cast("string")),
        _t(dialect, CSVW + "headerRowCount", F.col("header_rows").cast("string")),
        _t(table, CSVW + "tableSchema", schema, "bnode"),
    ]
    of_column = [
        _t(schema, CSVW + "column", column, "bnode"),
        _t(column, CSVW + "name", F.col("name")),
        _t(column, CSVW + "datatype", F.concat(F.lit("http://www.w3.org/2001/XMLSchema#"), F.col("datatype")), "uri"),
    ]
    none = F.array().cast(TRIPLE)
    rows = F.concat(F.when(F.col("pos") == 0, F.array(*of_table).cast(TRIPLE)).otherwise(none), F.array(*of_column).cast(TRIPLE))
    return description.select(F.inline(F.filter(rows, lambda t: t["o"].isNotNull())))
