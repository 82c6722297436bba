"""CSV files as they are: encoding, delimiter and records, with one file read by many tasks.

A line's quotes decide whether the next line belongs to the same record, so every line is a change of
the state "inside quotes". Changes are put together per block of a file, then over its blocks, and so
each block knows the state it begins with without having read the blocks before.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catascope.functions.cells import cell_label
from catascope.session import ship, staged

# Delimiters a file is tried with.
DELIMITERS = [",", ";", "\t", "|"]
#: What Windows-1252 has in the places of the control characters of ISO 8859-1.
CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0))
WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
UNUSED = "".join(c for c, w in zip(CONTROLS, WINDOWS) if c == w)
#: Bytes of files whose lines or cells one task takes behind an exchange, about.
TASK_BYTES = 4 << 20
#: A file in which every so many bytes one is zero or more holds UTF-16.
ZEROS = 5


def _raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of bytes, in the order of (block, id) within a file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value",
    )


def _latin(value: Column) -> Column:
    return F.decode(value.cast("binary"), "ISO-8859-1")


def csv_encodings(raw: DataFrame) -> DataFrame:
    """(file, encoding): by a byte-order mark, else by zero bytes, else the first of UTF-8, Windows-1252
    and ISO 8859-1 that all lines are valid in."""
    zeros = F.octet_length("value") - F.octet_length(F.replace("value", F.lit("\0"), F.lit("")))
    other, latin = ~F.is_valid_utf8("value"), _latin(F.col("value"))
    stats = raw.groupBy("file").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.sum(zeros).alias("zeros"),
        F.bool_or(other).alias("other"),
        F.bool_or(other & latin.rlike(f"[{CONTROLS}]")).alias("controls"),
        F.bool_or(other & latin.rlike(f"[{UNUSED}]")).alias("unused"),
        F.min(F.struct("block", "id", F.hex(F.substring(F.col("value").cast("binary"), 1, 3)).alias("head"))).alias("first"),
    )
    head = F.col("first.head")
    wide = F.col("zeros") * ZEROS >= F.col("bytes")
    return stats.select(
        "file",
        F.when(head == "EFBBBF", "UTF-8")
        .when(head.startswith("FFFE"), "UTF-16LE")
        .when(head.startswith("FEFF"), "UTF-16BE")
        .when(wide, F.when(head.startswith("00"), "UTF-16BE").otherwise("UTF-16LE"))
        .when(~F.col("other"), "UTF-8")
        .when(F.col("controls") & ~F.col("unused"), "Windows-1252")
        .otherwise("ISO-8859-1")
        .alias("encoding"),
    )


@F.arrow_udf(T.StringType())
def _wide_text(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Bytes of UTF-16 to text; what is no character becomes a replacement mark."""
    for contents, encodings in columns:
        yield pa.array([c.as_py().decode(e.as_py(), "replace") for c, e in zip(contents, encodings)], pa.string())


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, encoding, block, id, value): all lines of the files as text.

    Files in one byte per letter and in UTF-8 are read in blocks; one in UTF-16, where a line end is not
    a byte, is read by one task.
    """
    raw = _raw(spark, path)
    kinds = staged(csv_encodings(raw), "encodings")
    wide = F.col("encoding").startswith("UTF-16")
    text = (
        F.when(F.col("encoding") == "Windows-1252", F.translate(_latin(F.col("value")), CONTROLS, WINDOWS))
        .when(F.col("encoding") == "ISO-8859-1", _latin(F.col("value")))
        .otherwise(F.col("value"))
    )
    mark = (F.col("block") == 0) & F.col("value").startswith("﻿")
    out = raw.join(kinds.where(~wide), "file").select("file", "size", "encoding", "block", "id", text.alias("value"))
    names = [unquote(r["file"]) for r in kinds.where(wide).select("file").collect()]  # given to the reader, like any path
    if names:
        files = spark.read.format("binaryFile").load(names).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), "content")
        files = files.join(kinds.where(wide), "file").withColumn("text", _wide_text("content", "encoding"))
        files = files.select("file", "size", "encoding", F.lit(0).cast("bigint").alias("block"), F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("id", "value"))
        out = out.unionByName(files)
    return out.withColumn("value", F.when(mark, F.substr("value", F.lit(2))).otherwise(F.col("value")))


def _count_of(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def csv_delimiter(head: Column) -> Column:
    """The candidate that occurs most in a first line outside of quotes, the earlier one if two do."""
    bare = F.regexp_replace(head, '"[^"]*"', "")
    counts = [F.struct(_count_of(bare, d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    return F.array_max(F.array(*counts))["d"]


def _pieces(text: Column, delimiter: Column) -> Column:
    return F.split(text, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1)


def _next(inside: Column, piece: Column) -> Column:
    """Whether the place behind a piece between delimiters is inside quotes (1), from that before it.

    A quote opens a field at its beginning only; inside, a doubled quote closes and opens again.
    """
    turns = _count_of(piece, '"') % 2
    return F.when(inside == 1, (inside + turns) % 2).when(piece.startswith('"'), turns).otherwise(F.lit(0))


def _ends(start: int) -> Column:
    """The state behind a line that begins in a given state; a comment leaves the state as it is."""
    value = F.col("value")
    fold = F.aggregate(_pieces(value, F.col("delimiter")), F.lit(start), _next)
    quoted = F.when(value.contains('"'), fold).otherwise(F.lit(start))
    return quoted if start else F.when(value.startswith("#"), F.lit(0)).otherwise(quoted)


def tasks_for(files: DataFrame) -> int:
    """Tasks for what the files (file, size) hold, in proportion to their bytes: coalesced ones grow with the input."""
    size = files.agg(F.sum("size")).first()[0] or 0
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, encoding, delimiter, row, comment, value): the records of every file, numbered from 0.

    A record ends at a line end outside of quotes; line ends inside become line feeds. Comments are
    lines that begin with # outside of quotes; empty records are left out. In a file whose last quote
    is never closed every line is a record.
    """
    lines = csv_lines(spark, path)
    told = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    heads = told.groupBy("file").agg(F.min(F.struct("block", "id", "size", csv_delimiter(F.col("value")).alias("delimiter"))).alias("h"))
    heads = staged(heads.select("file", "h.size", "h.delimiter"), "heads")
    rows = lines.join(heads.drop("size"), "file").repartition(tasks_for(heads), "file", "block")

    # a line fixes the state, turns it round or leaves it
    out_, in_ = _ends(0), _ends(1)
    rows = rows.withColumns({"out": out_, "in": in_})
    rows = rows.withColumns({"fix": F.when(F.col("out") == F.col("in"), F.col("out")), "turn": (F.col("out") > F.col("in")).cast("int")}).drop("out", "in")
    here = W.partitionBy("file", "block").orderBy("id")
    last = lambda w: F.last(F.when(F.col("fix").isNotNull(), F.struct("fix", "turns")), ignorenulls=True).over(w)
    rows = rows.withColumn("turns", F.sum("turn").over(here)).withColumn("last", last(here.rowsBetween(W.unboundedPreceding, 0)))
    # after: the state behind the line, or null and whether it is turned against that of the block's beginning
    rows = rows.withColumns({"after": (F.col("last.fix") + F.col("turns") - F.col("last.turns")) % 2, "turned": F.col("turns") % 2})
    rows = rows.withColumns({"before": F.lag("after").over(here), "turned_before": F.coalesce(F.lag("turned").over(here), F.lit(0))})
    starts = lambda h: F.sum((F.coalesce("before", (F.col("turned_before") + h) % 2) == 0).cast("int")).over(here)
    rows = rows.withColumns({"n0": starts(0), "n1": starts(1), "n": F.row_number().over(here)})
    rows = staged(rows.drop("fix", "turn", "turns", "last"), "csv-lines")

    blocks = rows.groupBy("file", "block").agg(F.max(F.struct("id", "after", "turned", "n0", "n1", "n")).alias("e")).select("file", "block", "e.*")
    of_file = W.partitionBy("file").orderBy("block")
    earlier = of_file.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns({"fix": F.col("after"), "turn": F.when(F.col("after").isNull(), F.col("turned")).otherwise(0)})
    blocks = blocks.withColumn("turns", F.sum("turn").over(of_file))
    blocks = blocks.withColumns({"far": last(earlier), "so_far": F.coalesce(F.sum("turn").over(earlier), F.lit(0))})
    blocks = blocks.withColumn("start", F.coalesce(F.col("far.fix") + F.col("so_far") - F.col("far.turns"), F.col("so_far")) % 2)
    end = F.coalesce("after", (F.col("start") + F.col("turned")) % 2)
    whole = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.withColumn("open", F.last(end).over(whole) == 1)
    count = F.when(F.col("open"), F.col("n")).when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))
    blocks = blocks.withColumn("rows", F.coalesce(F.sum(count).over(earlier), F.lit(0)))
    blocks = staged(blocks.select("file", "block", "start", "open", "rows"), "csv-blocks")

    rows = rows.join(blocks, ["file", "block"])
    state = lambda fixed, turned: F.when(F.col("open"), 0).otherwise(F.coalesce(fixed, (F.col("start") + F.col(turned)) % 2))
    nr = F.when(F.col("open"), F.col("n")).when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1"))
    rows = rows.withColumns({"first": state("before", "turned_before") == 0, "last": state("after", "turned") == 0, "row": (F.col("rows") + nr - 1).cast("bigint")})
    keys = ["file", "size", "encoding", "delimiter", "row"]
    single = rows.where("first and last").select(*keys, "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    longer = rows.where("not (first and last)").groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))
    out = single.unionByName(longer).where(F.trim("value") != "")
    return out.withColumn("comment", F.col("value").startswith("#"))


def csv_fields(text: Column, delimiter: Column) -> Column:
    """The fields of a record, without quotes around them; a doubled quote inside is one."""
    plain = lambda v: F.when(
        v.startswith('"'), F.replace(F.substr(v, F.lit(2), F.greatest(F.length(v) - 1 - v.substr(F.lit(2), F.length(v)).endswith('"').cast("int"), F.lit(0))), F.lit('""'), F.lit('"'))
    ).otherwise(v)
    # the state before every piece, then fields from each piece that begins outside of quotes to the next
    begin = F.struct(F.lit("").alias("marks"), F.lit(0).alias("inside"))
    step = lambda a, p: F.struct(F.concat(a["marks"], a["inside"].cast("string")).alias("marks"), _next(a["inside"], p).alias("inside"))
    parts = F.struct(_pieces(text, delimiter).alias("pieces"), F.aggregate(_pieces(text, delimiter), begin, step)["marks"].alias("marks"))

    def starts(x: Column) -> Column:
        every = F.sequence(F.lit(1), F.size(x["pieces"]))
        return F.struct(x["pieces"].alias("pieces"), F.filter(every, lambda i: F.substr(x["marks"], i, F.lit(1)) == "0").alias("at"))

    def fields(x: Column) -> Column:
        after = lambda k: F.coalesce(F.get(x["at"], k + 1), F.size(x["pieces"]) + 1)
        return F.transform(x["at"], lambda i, k: plain(F.call_function("array_join", F.slice(x["pieces"], i, after(k) - i), delimiter)))

    quoted = F.transform(F.transform(F.array(parts), starts), fields)[0]
    return F.when(text.contains('"'), quoted).otherwise(_pieces(text, delimiter))


def names_columns(values: Column) -> Column:
    """A first record is a header if no value in it is a number or a date."""
    return ~F.exists(values, lambda v: cell_label(v).isin("number", "datetime"))


def csv_heads(records: DataFrame) -> DataFrame:
    """(file, size, encoding, delimiter, row, fields, header): the first record of each file that is no comment."""
    first = records.where("not comment").groupBy("file").agg(F.min("row").alias("row"))
    heads = records.join(first, ["file", "row"]).withColumn("fields", csv_fields(F.col("value"), F.col("delimiter")))
    return heads.select("file", "size", "encoding", "delimiter", "row", "fields", names_columns(F.col("fields")).alias("header"))


def csv_comments(records: DataFrame) -> DataFrame:
    """(file, row, text): lines of description, which become comments of the distribution."""
    return records.where("comment").select("file", "row", F.trim(F.substr("value", F.lit(2))).alias("text"))


def normalise_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as (file, row, header, value, modifications): comma delimited, UTF-8, without comment
    lines, with a header. row numbers the records of a file; a header that had to be made is row -1.

    A record with fewer fields than the first is filled up; one with more keeps them.
    """
    records = staged(csv_records(spark, path), "csv-records")
    told = records.groupBy("file").agg(F.bool_or("comment").alias("comments"))
    heads = csv_heads(records).join(told, "file").withColumnRenamed("row", "head")
    change = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    modifications = F.concat(
        change(F.col("encoding") != "UTF-8", "Utf8Encoding"), change(F.col("comments"), "DropCommentLines"),
        change(F.col("delimiter") != ",", "DefaultDelimiter"), change(~F.col("header"), "GenericHeader"),
    )
    heads = heads.select("file", "head", "header", F.size("fields").alias("width"), modifications.alias("modifications"))
    heads = staged(heads, "csv-heads")
    names = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("col"), i.cast("string")))
    made = heads.where("not header").select(
        "file", F.lit(-1).cast("bigint").alias("row"), F.lit(True).alias("header"), F.array_join(names, ",").alias("value"), "modifications"
    )
    quoted = lambda v: F.when(v.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    rows = records.where("not comment").join(heads, "file").withColumn("fields", csv_fields(F.col("value"), F.col("delimiter")))
    fill = F.array_repeat(F.lit(""), F.greatest(F.col("width") - F.size("fields"), F.lit(0)))
    value = F.array_join(F.transform(F.concat("fields", fill), quoted), ",")
    return made.unionByName(rows.select("file", "row", (F.col("header") & (F.col("row") == F.col("head"))).alias("header"), value.alias("value"), "modifications"))


ship(__name__)
