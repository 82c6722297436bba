"""Removal of byte strings that occur twice, by a hash-compared suffix sort.

Sorting every suffix of the corpus would move many times the corpus. Two equal strings of LENGTH
bytes contain the same run of GRAM bytes with the least hash at the same place, so only suffixes
around such runs that occur more than once are sorted, run by run: suffixes that start equally far
before equal runs are merge-sorted, and one comparison finds the common extension by binary search
over prefix polynomial hashes. Neighbours that agree over LENGTH bytes are verified byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catascope.llm.common import bounded_batches, n_bytes, ship, stored, text_key

LENGTH = 400
GRAM = 128
#: Starts of strings before a run that contain it: 0 to REACH bytes before.
REACH = LENGTH - GRAM
FRAME = REACH + LENGTH
#: Distinct surroundings of one run that are sorted together; more are dealt by longer runs.
TOGETHER = 1024
#: Parts of a run's string starts, if it has more; a round is several jobs, however little they have to do.
PARTS = 8
CHUNK = 1 << 20
PLACE = (1 << 21) - 1

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, up: np.ndarray, down: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, from prefix polynomial hashes modulo 2^64."""
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=prefix[1:])
    return mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(data) - GRAM + 1])


def least_places(hashes: np.ndarray) -> np.ndarray:
    """For each string start, the place of the least hash (the first of equal ones) in the string."""
    width = REACH + 1
    n = len(hashes) - width + 1
    full = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(hashes)] = (hashes & ~np.uint64(PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(PLACE)).astype(np.int64)


def runs_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the runs, their hashes, and the first and last string start that each one stands for."""
    data, n = np.frombuffer(text, np.uint8), len(text) - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    size = min(len(data), CHUNK + LENGTH)
    up, down, values = powers(BASE, size), powers(INVERSE, size), byte_values()
    found = []
    for at in range(0, n, CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        hashes = gram_hashes(part, up, down, values)
        owner = least_places(hashes)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.concatenate((first[1:] - 1, [len(owner) - 1]))
        found.append((owner[first] + at, hashes[owner[first]], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found))


@F.arrow_udf(T.ArrayType(T.LongType()))
def run_hashes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        out = [runs_of((t or "").encode())[1].view(np.int64) for t in column.to_pylist()]
        ends = np.cumsum([0, *map(len, out)])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int64)))


SURROUNDINGS = "gram long, surrounding binary, key binary, place long, copies long, low int, high int, frame binary"


def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, grams, copies) to the surroundings of each run whose hash occurs again.

    low to high are the string starts inside the frame that the run stands for.
    """
    schema = pa.schema([("gram", pa.int64()), ("surrounding", pa.binary()), ("key", pa.binary()), ("place", pa.int64()), ("copies", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("frame", pa.binary())])
    for batch in batches:
        for key, text, grams, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "grams", "copies"))):
            data = text.encode()
            place, gram, first, last = runs_of(data)
            wanted = np.isin(gram.view(np.int64), np.array(grams, dtype=np.int64))
            rows = []
            for p, g, a, b in zip(place[wanted].tolist(), gram[wanted].view(np.int64).tolist(), first[wanted].tolist(), last[wanted].tolist()):
                start = p - REACH
                # only bytes of the strings it stands for: equal strings then have equal surroundings more often
                frame = b"\0" * (a - start) + data[a : b + LENGTH]
                frame += b"\0" * (FRAME - len(frame))
                low, high = a - start, b - start
                mark = xxhash.xxh3_128_digest(frame + bytes([low // 256, low % 256, high // 256, high % 256]))
                rows.append((g, mark, key, p, copies, low, high, frame))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Suffixes:
    """String starts in frames, in classes (run, place in the frame) whose members can be equal."""

    def __init__(self, frames: np.ndarray, run: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.frames = frames
        self.prefix = np.zeros((len(frames), FRAME + 1), dtype=np.uint64)
        np.cumsum(byte_values()[frames] * powers(BASE, FRAME), axis=1, out=self.prefix[:, 1:])
        count = high - low + 1
        row = np.repeat(np.arange(len(frames)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        order = np.lexsort((row, at, run[row]))
        self.row, self.at = row[order], at[order]
        group = run[self.row] * (REACH + 1) + self.at
        self.start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        self.size = np.diff(np.concatenate((self.start, [len(group)])))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, up to LENGTH, by binary search."""
        a, b, at = self.row[x], self.row[y], self.at[x]
        from_a, from_b = self.prefix[a, at], self.prefix[b, at]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH, np.int64)
        while np.any(low < high):
            mid = (low + high + 1) // 2
            same = self.prefix[a, at + mid] - from_a == self.prefix[b, at + mid] - from_b
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def below(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x is below y."""
        n = self.common(x, y)
        end = np.minimum(self.at[x] + n, FRAME - 1)
        less = self.frames[self.row[x], end] < self.frames[self.row[y], end]
        return np.where(n == LENGTH, or_equal, less)

    def sorted(self) -> np.ndarray:
        """The suffixes in order within each class: bottom-up mergesort of all classes at once.

        A suffix finds its place in a merge by binary search in the run beside its own.
        """
        order = np.arange(len(self.row))
        start, size = np.repeat(self.start, self.size), np.repeat(self.size, self.size)
        width = 1
        while width < self.size.max(initial=0):
            live = np.flatnonzero(size > width)
            begin, n, slot = start[live], size[live], live - start[live]
            block = slot // width
            low = np.minimum((block ^ 1) * width, n)
            left, right = low.copy(), np.minimum(low + width, n)
            after = block % 2 == 1  # equal suffixes of the left run stay in front
            open_ = np.flatnonzero(left < right)
            while len(open_):
                mid = (left[open_] + right[open_]) // 2
                goes = self.below(order[begin[open_] + mid], order[live[open_]], after[open_])
                left[open_] = np.where(goes, mid + 1, left[open_])
                right[open_] = np.where(goes, right[open_], mid)
                open_ = open_[left[open_] < right[open_]]
            target = begin + (block // 2) * 2 * width + (slot - block * width) + (left - low)
            order[target] = order[live]
            width *= 2
        return order

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted suffixes and the number of each one's set of equal strings."""
        order = self.sorted()
        inside = np.ones(len(order), bool)
        inside[self.start] = False
        pairs = np.flatnonzero(inside)
        same = np.zeros(len(order), bool)
        for k in range(0, len(pairs), 1 << 14):
            p = pairs[k : k + (1 << 14)]
            p = p[self.common(order[p - 1], order[p]) == LENGTH]
            bytes_ = self.at[order[p]][:, None] + np.arange(LENGTH)
            equal = (self.frames[self.row[order[p - 1]][:, None], bytes_] == self.frames[self.row[order[p]][:, None], bytes_]).all(1)
            if not equal.all():
                return self.by_bytes()
            same[p] = True
        return order, np.cumsum(~same) - 1

    def by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes, for the case that two different strings have one."""
        strings = {}
        number = np.array([strings.setdefault((a, self.frames[r, a : a + LENGTH].tobytes()), len(strings)) for r, a in zip(self.row.tolist(), self.at.tolist())], dtype=np.int64)
        group = np.repeat(np.arange(len(self.start)), self.size)
        order = np.lexsort((number, group))
        both = group[order] * (len(strings) + 1) + number[order]
        return order, np.cumsum(np.concatenate(([True], both[1:] != both[:-1]))) - 1


FOUND = "surrounding binary, low int, high int"


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct surroundings (run, surrounding, copies, low, high, frame), sorted by run, to the string starts in them that occur again."""
    schema = pa.schema([("surrounding", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        name, mark, copies, low, high, frame = zip(*rows)
        frames = np.frombuffer(b"".join(frame), np.uint8).reshape(-1, FRAME)
        run = np.cumsum([False, *(a != b for a, b in zip(name[1:], name))])
        found = Suffixes(frames, run, np.array(low), np.array(high))
        order, number = found.classes()
        row, at = found.row[order], found.at[order]
        again = np.flatnonzero(np.bincount(number, np.array(copies, dtype=np.float64)[row])[number] > 1)
        back = again[np.lexsort((at[again], row[again]))]
        r, a = row[back], at[back]
        cut = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (a[1:] != a[:-1] + 1)))) if len(r) else r
        ends = np.concatenate((cut[1:] - 1, [len(r) - 1])) if len(r) else r
        columns = [mark[i] for i in r[cut].tolist()], a[cut].tolist(), a[ends].tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if len(held) >= TOGETHER and held[-1][0] != r[0]:
                yield solved(held)
                held = []
            held.append(r)
    if held:
        yield solved(held)


KINDS = "run binary, surrounding binary, copies long, low int, high int, frame binary, first int, last int, whole binary"


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings (run, surrounding, copies, low, high, frame, first, last) to those of PARTS parts of their starts.

    The strings that start from `first` to `last` all hold the bytes from the last start to the end
    of the first string, so equal ones agree there: these bytes make a longer run. What none of the
    part's strings holds is blanked, and surroundings that differ there only become one.
    """
    schema = pa.schema([("run", pa.binary()), ("surrounding", pa.binary()), ("copies", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("frame", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("whole", pa.binary())])
    for batch in batches:
        rows = []
        for run, mark, copies, low, high, frame, first, last in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            width = -(-(last - first + 1) // PARTS)
            for a in range(first, last + 1, width):
                b = min(a + width - 1, last)
                x, y = max(low, a), min(high, b)
                if x > y:
                    continue
                longer = xxhash.xxh3_128_digest(run + bytes([a // 256, a % 256]) + frame[b : a + LENGTH])
                part = b"\0" * x + frame[x : y + LENGTH] + b"\0" * (FRAME - y - LENGTH)
                own = xxhash.xxh3_128_digest(longer + part + bytes([x // 256, x % 256, y // 256, y % 256]))
                rows.append((longer, own, copies, x, y, part, a, b, mark))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


CUT = T.StructType(
    [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
)


@F.arrow_udf(CUT)
def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text without its spans."""
    kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for texts, spans in columns:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            data, gone = text.encode(), merged([(s["start"], s["end"]) for s in own])
            ends = [0, *(b for _, b in gone)]
            kept = b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(data)]))
            out.append({"n_removed": len(data) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
        yield pa.array(out, kind)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text) of each text with a run that occurs again, and (key, start, end) of what repeats.

    key is the SHA-256 of a text; texts that occur several times are looked at once and count as often.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    marks = stored(rows.where(F.octet_length("text") >= LENGTH).select("doc_id", "key", run_hashes(F.col("text")).alias("grams")), "runs")
    grams = marks.select("key", F.explode("grams").alias("gram"))
    often = stored(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "repeated-runs")
    hits = grams.join(often, "gram", "left_semi").groupBy("key").agg(F.collect_set("gram").alias("grams"))
    texts = marks.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    hits = stored(hits.join(texts, "key"), "texts-with-runs").withColumnRenamed("key", "hit_key")
    same = (rows["key"] == hits["hit_key"]) & rows["doc_id"].eqNullSafe(hits["first_id"])
    texts = stored(rows.join(hits, same).select("key", "text", "grams", "copies"), "texts")
    frames = stored(texts.mapInArrow(framed, SURROUNDINGS), "frames")

    of_run = ["run", "surrounding", "low", "high", "first", "last"]
    one = F.sum("copies").alias("copies"), F.first("frame").alias("frame")
    kinds = frames.withColumns({"run": F.to_binary(F.hex("gram"), F.lit("hex")), "first": F.lit(0), "last": F.lit(REACH)}).groupBy(*of_run).agg(*one)
    # surroundings, what they are parts of, and what is found in them, per level
    names, settled = None, []
    while True:
        kinds = stored(kinds, "surroundings")
        sizes = stored(kinds.groupBy("run").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("copies > 1"), "run-sizes")
        few = kinds.join(sizes.where(F.col("n") <= TOGETHER).select("run"), "run", "left_semi")
        few = few.select("run", "surrounding", "copies", "low", "high", "frame").repartition("run").sortWithinPartitions("run")
        found = few.mapInArrow(compared, FOUND)
        if names is not None:
            found = found.join(names, "surrounding").select(F.col("whole").alias("surrounding"), "low", "high")
        settled.append(stored(found, "settled"))
        many = sizes.where(F.col("n") > TOGETHER).select("run")
        if many.isEmpty():
            break
        # one start at a time at the end, whose surroundings are all one: a start is cut off in three rounds at most
        parts = kinds.join(many, "run", "left_semi").select("run", "surrounding", "copies", "low", "high", "frame", "first", "last")
        parts = stored(parts.mapInArrow(parted, KINDS), "parted")
        step = parts.select("surrounding", "whole").distinct()
        if names is not None:
            step = step.join(names.toDF("whole", "outer"), "whole").select("surrounding", F.col("outer").alias("whole"))
        names = stored(step.distinct(), "parts")
        kinds = parts.groupBy(*of_run).agg(*one)
    settled = reduce(DataFrame.unionByName, settled)
    places = frames.select("surrounding", "key", "place").join(settled, "surrounding")
    start = F.col("place") - REACH
    spans = places.select("key", (start + F.col("low")).alias("start"), (start + F.col("high") + LENGTH).alias("end"))
    return texts.select("key", "text"), spans


def without_repeats(docs: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256, kept (bytes) for each text that loses bytes."""
    texts, spans = repeated_spans(docs)
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    out = texts.join(spans, "key").select("key", cut(F.col("text"), F.col("spans")).alias("c")).select("key", "c.*")
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of documents.

    Every byte covered by a string of LENGTH bytes that also starts anywhere else goes, in the same
    document too; strings are those of the input. Null counts as empty; texts under LENGTH bytes stay
    whole; copies and repeated rows of longer texts go whole. An empty table gives no rows; other
    columns are not read.
    """
    out = without_repeats(docs).drop("kept")
    out = stored(out.dropDuplicates(["key"]), "cut-texts")
    rows = docs.select("doc_id", n_bytes(F.col("text")).alias("n_bytes"), text_key(F.col("text")).alias("key"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(out, "key", "left").select(
        "doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("key"))).alias("kept_sha256")
    )


#: Every string of 400 bytes by its digest, over hexadecimal texts; runs of starts that touch are spans.
ORACLE = """
with t as (
  select row_number() over () as no, doc_id, hex(encode(coalesce(text, ''))) as x from documents
), s as (
  select no, unnest(range(0, len(x) // 2 - 399)) as pos, x from t where len(x) >= 800
), k as (
  select no, pos, md5(substring(x, 2 * pos + 1, 800)) as string from s
), again as (
  select no, pos from k qualify count(*) over (partition by string) > 1
), cuts as (
  select no, pos, case when pos - lag(pos) over (partition by no order by pos) <= 400 then 0 else 1 end as first from again
), runs as (
  select no, run, min(pos) as a, max(pos) + 400 as b from (select *, sum(first) over (partition by no order by pos) as run from cuts) c group by no, run
), gaps as (
  select no, run, a, b, coalesce(lag(b) over (partition by no order by a), 0) as before from runs
), kept as (
  select no, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' order by a) || substring(any_value(x), 2 * max(b) + 1) as y,
    sum(b - a) as n_removed, count(*) as n_spans
  from gaps join t using (no) group by no
)
select doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(y, x))) as kept_sha256
from t left join kept using (no)
"""

ship(__name__)
