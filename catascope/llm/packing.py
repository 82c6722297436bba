"""Mixture-controlled packing: deficit round-robin over source queues fills windows of equal size.

Every source is a queue of tokens. A clock runs from the first token to the last; at time t a
source with `rate` has given round(rate * t) tokens. The clock is cut into slices of about SLICE
tokens, so that a slice is a group of known size whatever the sources, and the deficits with which
its round-robin begins follow from the clock alone: the part of a token that the source is behind.
Inside a slice each window adds a source's share to its deficit, takes whole tokens for it and
carries the rest on. Windows go on across slices: a slice knows how many tokens came before it.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catascope.llm.common import bounded_batches, running_start, ship, stored

WINDOW = 4096
#: Tokens of a slice, about.
SLICE = 1 << 18
#: The id behind every document.
END = 2
VOCABULARY = "word_bpe_49k.json"
#: Encoded texts that a worker remembers as new, the bytes that one has at most, and letters of texts that are encoded together.
REMEMBERED, LONG, AT_ONCE = 1 << 19, 64, 1 << 20


#: Letters and digits of Latin-1 as the vocabulary's pattern has them, on text in lower case.
LETTER, DIGIT, SPACE = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb" \t-\r\x85\xa0"
#: The pattern that the vocabulary cuts texts with; words, which are most, are tried first.
UNIT = re.compile(rb"[" + LETTER + rb"]+|'(?:s|t|re|ve|m|ll|d)|[" + DIGIT + rb"]|[^" + SPACE + LETTER + DIGIT + rb"]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else 32 if 9 <= c <= 13 or c in (0x85, 0xA0) else c for c in range(256))
WORD = re.compile(rb"[" + LETTER + rb"]+")
#: What neither a letter, a digit nor a space is, written as a dot; letters and digits as an a.
KIND = bytes(32 if c == 32 else 97 if re.match(rb"[" + LETTER + DIGIT + rb"]", bytes([c])) else 46 for c in range(256))
#: The letters that the vocabulary writes bytes of UTF-8 in, where they are not the bytes' own.
WRITTEN = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class Known(dict):
    """Encoded texts. One that is not here is taken from those known before, or made."""

    def __init__(self, make: Callable[[bytes], bytes], before: dict[bytes, bytes]):
        self.make, self.before = make, before

    def __missing__(self, key: bytes) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= LONG:
            self[key] = ids
        return ids

    def lately(self) -> Known:
        """Itself, or once it is large a new one that knows what this one has."""
        if len(self) <= REMEMBERED:
            return self
        self.before = {}
        return Known(self.make, self)


class Encoder:
    """Ids of texts by a vocabulary file of the tokenizers library, as bytes of little-endian unsigned integers.

    The vocabulary puts texts into lower case, cuts them by a pattern and drops white space, and no
    token reaches across a cut. So a text's ids are those of what lies between its white space, one after
    the other, and theirs are those of their units. Each is encoded once: words by the library's model, as
    the letters that the vocabulary writes their bytes in, other units by the whole library. Texts with
    letters beyond Latin-1, or with what may be a special token, are not cut further, and many of their
    parts are encoded in one call.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(str(path or public_tokenizers.path(VOCABULARY)))
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.pack, self.tokens = struct.Struct("<" + "HI"[self.kind.itemsize // 4]).pack, self.library.model.tokenize
        self.units, self.others = Known(self.unit, {}), Known(self.other, {})

    @staticmethod
    def of_task(path: str | None) -> Encoder:
        """The encoder of this worker process, which serves one task after the other."""
        held = sys.__dict__.setdefault("_catascope_encoders", {})
        if path not in held:
            held[path] = Encoder(path)
        return held[path]

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; texts are taken together until they have AT_ONCE letters."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from self.some(held)
                held, size = [], 0
        yield from self.some(held)

    def some(self, texts: list[str]) -> list[bytes]:
        self.units, self.others = self.units.lately(), self.others.lately()
        units, out, later = self.units.__getitem__, [], []
        for text in texts:
            try:
                if "<|" in text:
                    raise UnicodeError
                data = text.encode("latin-1").translate(LOWER) + b" "
                if b".. " not in data.translate(KIND):  # commas and full stops before spaces are units of their own
                    data = data.replace(b", ", b" , ").replace(b". ", b" . ")
                out.append(b"".join(map(units, data.split())))
            except UnicodeError:
                later.append((len(out), text.encode().split()))
                out.append(b"")
        known = self.others
        new = {key for _, keys in later for key in keys if key not in known and key not in known.before}
        made = {}
        self.learn(made, list(new), "utf-8")
        known.update((key, ids) for key, ids in made.items() if len(key) <= LONG)
        for i, keys in later:
            out[i] = b"".join([made[key] if key in made else known[key] for key in keys])
        return out

    def unit(self, key: bytes) -> bytes:
        """The ids of a unit, or of several without white space between them."""
        if key.isalpha():
            word = key.decode("latin-1")
        elif len(units := UNIT.findall(key)) > 1:
            return b"".join(map(self.units.__getitem__, units))
        elif WORD.fullmatch(key):
            word = key.decode("latin-1").encode().decode("latin-1").translate(WRITTEN)
        else:
            return self.other(key, "latin-1")
        pack = self.pack
        return b"".join([pack(t.id) for t in self.tokens(word)])

    def other(self, key: bytes, code: str = "utf-8") -> bytes:
        """The ids of a text by the whole library."""
        made = {}
        self.learn(made, [key], code)
        return made[key]

    def learn(self, known: dict[bytes, bytes], new: list[bytes], code: str) -> None:
        found = self.library.encode_batch_fast([w.decode(code) for w in new], add_special_tokens=False)
        known.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(new, found))


def encoded(path: str | None, schema: pa.Schema):
    """Rows (doc_id, source, text) to (doc_id, queue, part, before, n, ids): tokens, and their place in the part's queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encoder = TaskContext.get().partitionId(), defaultdict(int), Encoder.of_task(path)
        end = np.array([END], encoder.kind).tobytes()
        for batch in batches:
            doc, queue, text = batch.columns
            starts, lengths, ids = [], [], []
            for q, own in zip(queue.to_pylist(), encoder.many(text.to_pylist())):
                own += end
                ids.append(own)
                lengths.append(len(own) // encoder.kind.itemsize)
                starts.append(before[q])
                before[q] += lengths[-1]
            width = [encoder.kind.itemsize] * len(ids)
            columns = [doc, queue, pa.array([part] * len(ids)), pa.array(starts), pa.array(lengths), pa.array(width), pa.array(ids)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


class Clock:
    """Slices of the time in which all queues are emptied.

    `ends` are pairs (time, tokens of all sources so far) at the moments when a source with a set
    share runs out, in order of time; between two of them the tokens come at an even rate.
    """

    def __init__(self, ends: list[tuple[float, int]], size: int = SLICE):
        self.time, self.first, self.step, self.pace = [], [], [], []
        t0 = n0 = slices = 0
        for t, n in ends:
            if t <= t0:
                continue
            k = max(1, round((n - n0) / size))
            self.time.append(t0)
            self.first.append(slices)
            self.step.append((t - t0) / k)
            self.pace.append((n - n0) / (t - t0))
            slices += k
            t0, n0 = t, n
        self.slices, self.end = slices, t0

    def at(self, v: int) -> float:
        """The time at which slice v begins."""
        if v >= self.slices:
            return self.end
        i = bisect.bisect_right(self.first, v) - 1
        return self.time[i] + (v - self.first[i]) * self.step[i]

    def given(self, v: int, rate: float, total: int) -> int:
        """Tokens that a source has given when slice v begins."""
        return total if v >= self.slices else min(total, int(rate * self.at(v) + 0.5))

    def holding(self, place: int, rate: float, total: int) -> int:
        """The slice with the source's token at `place`."""
        low, high = 0, self.slices - 1
        guess = self.near(place / rate)
        if self.given(guess, rate, total) <= place:
            low = guess
            if place < self.given(guess + 1, rate, total):
                return guess
        else:
            high = guess - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.given(mid, rate, total) <= place else (low, mid - 1)
        return low

    def near(self, t: float) -> int:
        i = max(0, bisect.bisect_right(self.time, t) - 1)
        return min(self.slices - 1, self.first[i] + int((t - self.time[i]) / self.step[i]))

    def share(self, v: int) -> float:
        """Tokens of all sources per unit of time in slice v."""
        return self.pace[bisect.bisect_right(self.first, v) - 1]


def sliced(clock: Clock, schema: pa.Schema):
    """Rows (base + before = place in the queue, rate, total, n, ...) to their parts per slice; ids are cut along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            place, rate, total, n = (batch.column(names.index(c)).to_pylist() for c in ("place", "rate", "total", "n"))
            row, cells = [], defaultdict(list)
            ids = batch.column(names.index("ids")).to_pylist() if "ids" in names else None
            width = batch.column(names.index("width")).to_pylist() if ids else None
            for i in range(batch.num_rows):
                at, stop = place[i], place[i] + n[i]
                v = clock.holding(at, rate[i], total[i])
                while at < stop:
                    upto = min(stop, clock.given(v + 1, rate[i], total[i]))
                    if upto > at:
                        row.append(i)
                        start = at - place[i]
                        cells["slice"].append(v)
                        cells["at"].append(at)
                        cells["start"].append(start)
                        cells["length"].append(upto - at)
                        if ids:
                            cells["ids"].append(ids[i][width[i] * start : width[i] * (upto - place[i])])
                        at = upto
                    v += 1
            take = pa.array(row, pa.int64())
            columns = [pa.array(cells[f.name], f.type) if f.name in cells or not row else batch.column(names.index(f.name)).take(take) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def shared_out(room: int, deficit: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Whole tokens per queue that fill the room: the deficits rounded down, then one each by size of the rest."""
    take = np.clip(np.floor(deficit).astype(np.int64), 0, left)
    while miss := room - int(take.sum()):
        rest = deficit - take
        if miss > 0:
            can = np.flatnonzero(take < left)
            take[can[np.argsort(-rest[can], kind="stable")[:miss]]] += 1
        else:
            can = np.flatnonzero(take > 0)
            take[can[np.argsort(rest[can], kind="stable")[:-miss]]] -= 1
    return take


def bounds(first: int, stop: int, total: int, window: int) -> list[tuple[int, int, int]]:
    """(first token, sequence, its first token) of the sequences that the tokens from first to stop touch.

    The tokens beyond the last full window make sequences of falling powers of two.
    """
    full = total - total % window
    out = [(max(first, w * window), w, w * window) for w in range(first // window, -(-min(stop, full) // window))]
    at, seq, rest = full, full // window, total - full
    while rest:
        size = 1 << (rest.bit_length() - 1)
        if at < stop and at + size > first:
            out.append((max(first, at), seq, at))
        at, seq, rest = at + size, seq + 1, rest - size
    return out


def dealt(clock: Clock, total: int, window: int, schema: pa.Schema):
    """The queues' parts in a slice to pieces of sequences."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("queue", "ascending"), ("at", "ascending")])
        col = {c: rows.column(c).to_pylist() for c in ("queue", "slice", "base", "rate", "at", "start", "length", "width", "ids")}
        first = [i for i in range(rows.num_rows) if i == 0 or col["queue"][i] != col["queue"][i - 1]]
        v, base = col["slice"][0], col["base"][0]
        rate = np.array([col["rate"][i] for i in first])
        left = np.add.reduceat(np.array(col["length"]), first)
        deficit = rate * clock.at(v) - np.array([col["at"][i] for i in first])
        share = rate / clock.share(v)
        stop = base + int(left.sum())
        data = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(col["ids"], col["width"])]
        at, used = list(first), [0] * len(first)  # the row that each queue has come to, and what of it is used
        take_row, out = [], {c: [] for c in ("start", "length", "sequence_id", "offset", "ids")}
        places = bounds(base, stop, total, window)
        for (begin, seq, origin), end in zip(places, [p[0] for p in places[1:]] + [stop]):
            deficit += (end - begin) * share
            take = shared_out(end - begin, deficit, left)
            deficit -= take
            left -= take
            rank = begin
            for q in np.flatnonzero(take).tolist():
                want = int(take[q])
                while want:
                    i, done = at[q], used[q]
                    some = min(want, col["length"][i] - done)
                    take_row.append(i)
                    out["start"].append(col["start"][i] + done)
                    out["length"].append(some)
                    out["sequence_id"].append(seq)
                    out["offset"].append(rank - origin)
                    out["ids"].append(data[i][4 * done : 4 * (done + some)])
                    rank, want = rank + some, want - some
                    at[q], used[q] = (i + 1, 0) if done + some == col["length"][i] else (i, done + some)
        index = pa.array(take_row, pa.int64())
        columns = {"doc_id": rows.column("doc_id").take(index), "doc_tokens": rows.column("n").take(index), "queue": rows.column("queue").take(index)}
        made = [pa.array(out[f.name], f.type) if f.name in out else columns[f.name].combine_chunks() for f in schema]
        return pa.Table.from_arrays(made, schema=schema)

    return run


def finishes(sums: DataFrame, weights: dict[str | None, float] | None) -> tuple[dict[str, float], list[tuple[float, int]]]:
    """Rates of the sources with a set share, the pace of the others, and when queues run out.

    Only sums over named sources and over all the others come to the driver.
    """
    weights = {queue_name(s): w for s, w in (weights or {}).items() if w > 0}
    named = F.when(F.col("queue").isin(list(weights)), F.col("queue")) if weights else F.lit(None).cast("string")
    totals = {r["queue"]: int(r["n"]) for r in sums.groupBy(named.alias("queue")).agg(F.sum("total").alias("n")).collect()}
    others, own = totals.pop(None, 0), {q: w for q, w in weights.items() if q in totals}
    # the others give their tokens in one unit of time, each at its natural rate
    share = sum(own.values())
    if own and others and share >= 1:
        raise ValueError("set shares leave nothing for the other sources")
    pace = others / (1 - share) if others else float(sum(totals.values()))
    rates = {q: w * pace if others else w / share * pace for q, w in own.items()}
    ends = sorted({totals[q] / r for q, r in rates.items()} | ({1.0} if others else set()))
    so_far = lambda t: others * min(1.0, t) + sum(min(totals[q], r * t) for q, r in rates.items())
    return rates, [(t, round(so_far(t))) for t in ends]


def queue_name(source: str | None) -> str:
    return "-" if source is None else "=" + source


def packed(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    weights: dict[str | None, float] | None = None,
    slice_tokens: int = SLICE,
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, source, sequence_id, offset, ids) of all documents' tokens.

    Every token, and the END behind each document, lies in one piece; ids are little-endian unsigned
    32-bit integers. Sequences are numbered from 0 and have `window` tokens, but for those at the end:
    what is left makes sequences of falling powers of two, so nothing is padded. Without `weights`
    every sequence has the sources in proportion to their tokens, to within about a token each;
    `weights` sets the shares of named sources (None: without source) as long as they last, and the
    others share the rest in proportion. A null source is a source of its own. Null and empty texts
    are END alone. Rows are packed one by one, repeated and null ids too; equal rows are packed alike.
    An empty table gives no rows; other columns are not read. Sequences follow the order of the rows
    in the table's partitions. `vocabulary` is a file that every executor can open; None names the
    installed one, wherever it lies there.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    queue = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source"))
    rows = docs.select("doc_id", queue.alias("queue"), "text")
    id_type = docs.schema["doc_id"].dataType
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("queue", T.StringType())])
    for c in ("part", "before", "n"):
        schema = schema.add(c, long)
    schema = schema.add("width", T.IntegerType()).add("ids", T.BinaryType())
    rows = stored(rows.mapInArrow(encoded(vocabulary, arrow(schema)), schema), "encoded")

    parts = stored(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")), "parts")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("queue").agg(F.sum("n").alias("total"))
    rates, ends = finishes(sums, weights)
    if not ends:
        return spark.createDataFrame([], pieces_schema(id_type))
    clock, total = Clock(ends, slice_tokens), ends[-1][1]
    set_rate = F.coalesce(*[F.when(F.col("queue") == q, F.lit(r)) for q, r in rates.items()], F.col("total").cast("double"))
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    base = stored(base.join(sums.withColumn("rate", set_rate), "queue"), "queues")
    rows = rows.join(base, ["queue", "part"]).withColumn("place", F.col("base") + F.col("before")).drop("base", "before", "part")

    lengths = T.StructType().add("slice", long).add("length", long)
    lengths = rows.select("place", "rate", "total", "n").mapInArrow(sliced(clock, arrow(lengths)), lengths)
    lengths = lengths.groupBy("slice").agg(F.sum("length").alias("length"))
    base = stored(running_start(lengths, [], ["slice"], "length", "base", F.shiftright("slice", 12)).select("slice", "base"), "slices")

    cut = T.StructType([T.StructField("doc_id", id_type), T.StructField("queue", T.StringType())])
    for c in ("n", "slice", "at", "start", "length"):
        cut = cut.add(c, long)
    cut = cut.add("rate", T.DoubleType()).add("width", T.IntegerType()).add("ids", T.BinaryType())
    chunks = rows.mapInArrow(sliced(clock, arrow(cut)), cut).join(base, "slice")
    out = pieces_schema(id_type)
    return chunks.groupBy("slice").applyInArrow(dealt(clock, total, window, arrow(out, source="queue")), renamed(out, "queue")).select(
        "doc_id", "start", "length", "doc_tokens", F.when(F.col("queue") != "-", F.substr("queue", F.lit(2))).alias("source"), "sequence_id", "offset", "ids"
    )


def pieces_schema(id_type: T.DataType) -> T.StructType:
    out = T.StructType([T.StructField("doc_id", id_type)])
    for c in ("start", "length", "doc_tokens"):
        out = out.add(c, T.LongType())
    return out.add("source", T.StringType()).add("sequence_id", T.LongType()).add("offset", T.LongType()).add("ids", T.BinaryType())


def renamed(schema: T.StructType, source: str) -> T.StructType:
    return T.StructType([T.StructField(source if f.name == "source" else f.name, f.dataType) for f in schema])


def arrow(schema: T.StructType, source: str = "source") -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(renamed(schema, source), prefers_large_types=False)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, ids): the sequences, with the documents of their pieces in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    joined = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.select("sequence_id", "length", F.col("parts.doc_id").alias("doc_ids"), joined.alias("ids"))


def piece_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: a checksum of each piece's ids instead of the ids."""
    rows = packed(docs)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


ship(__name__)
