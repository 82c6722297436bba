"""Spelling variants: words one edit apart, by search schemes on a bidirectional FM-index.

If two words are one edit apart, one half of the first is in the second as it is: the edit lies in
the other half. So a word is matched by either half exactly and then extended across the other half
with one error. Words that can match share that half, and the vocabulary is dealt by halves into
indexes of bounded size; halves that very many words share are dealt over several indexes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catascope.llm.common import bounded_batches, ship, stored

LEAST_POINTS = 7
LEAST_COUNT = 2
RATIO = 10
EVERY = 31
#: Code points of the words of one index, about; a word is never cut.
POINTS = 1 << 17
#: Bytes of a table of symbol counts; for longer texts only every so many places are in it.
TABLE_BYTES = 1 << 26
#: Words that a task counts before it gives their counts out, and queries that are searched at once.
HELD, AT_ONCE = 200_000, 4096

#: Runs of letters in Latin-1: A-Z become lower case, other letters stay, all else is a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, with only A-Z in lower case."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def misspelt(run: str, doc_id: object, every: int) -> str:
    """The run, without one of its letters if the checksum of document and run is a multiple of `every`."""
    if every:
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % every == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
    return run


def counted(every: int, least_points: int):
    """Rows (doc_id, text) to partial counts (word, n)."""

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(runs(text)).items():
                    if len(word) >= least_points:
                        held[misspelt(word.decode("latin-1"), doc_id, every)] += n
                if len(held) >= HELD:
                    yield batch_of(held)
                    held = Counter()
        if held:
            yield batch_of(held)

    return run


def vocabulary(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the runs of letters in the texts, some of them with a letter lost, and how often they occur."""
    bounded_batches(docs.sparkSession)
    words = docs.select("doc_id", "text").mapInArrow(counted(every, least_points), "word string, n long")
    words = words.where(F.length("word") >= least_points).groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= least_count)


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a text in order, by doubling the length that is compared."""
    rank, width = text.astype(np.int64), 1
    while True:
        key = rank * (rank.max() + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        new = np.empty(len(text), np.int64)
        new[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        if new[order[-1]] == len(text) - 1 or width >= len(text):
            return order
        rank, width = new, 2 * width


class Ranks:
    """How often each symbol occurs before a place of the last column of the sorted rotations."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = rotations(text)
        self.last = text[self.order - 1]
        n = len(text)
        self.step = -(-n * symbols * 4 // TABLE_BYTES)
        places = np.arange(n, dtype=np.int64) // self.step + 1
        self.table = np.zeros((n // self.step + 2, symbols), np.int32)
        np.add.at(self.table, (places, self.last), 1)
        np.cumsum(self.table, axis=0, out=self.table)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]))

    def between(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places between the last one in the table and `at`: numbers of rows, symbols there."""
        begin = at // self.step * self.step
        for d in range(self.step - 1):
            rows = np.flatnonzero(begin + d < at)
            yield rows, self.last[begin[rows] + d]

    def all(self, at: np.ndarray) -> np.ndarray:
        out = self.table[at // self.step]
        for rows, symbol in self.between(at):
            out[rows, symbol] += 1
        return out

    def of(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = self.table[at // self.step, symbol].astype(np.int64)
        for rows, found in self.between(at):
            out[rows] += found == symbol[rows]
        return out


class Index:
    """A bidirectional FM-index of words, each between delimiters (symbol 0).

    A state is the interval of suffix ranks of a string in the text (low) and of the reversed
    string in the reversed text (back), which have the same size.
    """

    def __init__(self, words: list[str]):
        points = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), np.uint32)
        self.points = np.unique(points)
        self.symbols = len(self.points) + 1  # the last one stands for all that are not in the text
        self.text = np.searchsorted(self.points, points)
        self.start = np.flatnonzero(self.text[:-1] == 0)  # delimiter before each word

    @cached_property
    def forward(self) -> Ranks:
        return Ranks(self.text, self.symbols)

    @cached_property
    def backward(self) -> Ranks:
        return Ranks(self.text[::-1], self.symbols)

    def right(self, symbol, low, back, size):
        """The states with a symbol behind their strings."""
        before, upto = self.backward.all(back), self.backward.all(back + size)
        count, rows = upto - before, np.arange(len(symbol))
        smaller = np.cumsum(count, axis=1)[rows, symbol] - count[rows, symbol]
        return low + smaller, self.backward.first[symbol] + before[rows, symbol], count[rows, symbol].astype(np.int64)

    def halves(self, words: list[str], prefix: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each word what is matched exactly, and what is then extended with one error, in the order of matching."""
        exact, rest = [], []
        for w in words:
            own, h = np.frombuffer(w.encode("utf-32-le"), np.uint32), len(w) // 2
            s = np.searchsorted(self.points, own)
            s[self.points[np.minimum(s, len(self.points) - 1)] != own] = self.symbols - 1
            exact.append(np.concatenate(([0], s[:h])) if prefix else np.concatenate((s[h:], [0])))
            rest.append(np.concatenate((s[h:], [0])) if prefix else np.concatenate((s[:h][::-1], [0])))
        return exact, rest

    def near(self, words: list[str], prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): words of the index one edit away from given ones, with the same first or second half."""
        exact, rest = self.halves(words, prefix)
        q = np.arange(len(words))
        low, back, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), len(self.text))
        pattern, length = padded(exact)
        for j in range(pattern.shape[1]):
            on = np.flatnonzero((j < length[q]) & (size > 0))
            low[on], back[on], size[on] = self.right(pattern[q[on], j], low[on], back[on], size[on])
        # the first half is extended to the right, the second one to the left
        ranks, at = (self.backward, back) if prefix else (self.forward, low)
        return self.extended(ranks, *padded(rest), q[size > 0], at[size > 0], size[size > 0], prefix)

    def extended(self, ranks: Ranks, pattern, length, q, at, size, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words reached from states (query, rank, size) by the rest of the pattern with exactly one error."""
        found, wrong = [], (np.empty(0, np.int64),) * 4  # states with an error: query, place, rank, size
        for j in range(pattern.shape[1] + 1):
            # states without an error are all at place j
            live = np.flatnonzero(j < length[q])
            q, at, size = q[live], at[live], size[live]
            before = ranks.all(at)
            count = ranks.all(at + size) - before
            want = pattern[q, j] if j < pattern.shape[1] else q
            rows, symbol = np.nonzero(count[:, 1:])
            symbol += 1
            state = q[rows], ranks.first[symbol] + before[rows, symbol], count[rows, symbol].astype(np.int64)
            inserted = state[0], np.full(len(rows), j), *state[1:]
            other = (symbol != want[rows]) & (want[rows] > 0)
            replaced = state[0][other], np.full(other.sum(), j + 1), state[1][other], state[2][other]
            inside = want > 0
            deleted = q[inside], np.full(inside.sum(), j + 1), at[inside], size[inside]
            own = np.arange(len(q))
            next_size = count[own, want].astype(np.int64) if len(q) else size
            goes = inside & (next_size > 0)
            at, size, q = (ranks.first[want] + before[own, want])[goes], next_size[goes], q[goes]
            # states with an error go on exactly, one symbol a round
            wrong = self.stepped(ranks, pattern, length, wrong, found)
            wrong = tuple(np.concatenate(x) for x in zip(wrong, inserted, replaced, deleted))
        while len(wrong[0]):
            wrong = self.stepped(ranks, pattern, length, wrong, found)
        query, rank = (np.concatenate(x) for x in zip(*found)) if found else (q[:0], q[:0])
        place = ranks.order[rank]
        # in the reversed text a match begins with the delimiter behind the word
        number = np.searchsorted(self.start, len(self.text) - 1 - place) - 1 if prefix else np.searchsorted(self.start, place)
        pairs = np.unique(query * len(self.start) + number)
        return pairs // len(self.start), pairs % len(self.start)

    @staticmethod
    def stepped(ranks: Ranks, pattern, length, states, found):
        q, j, at, size = states
        symbol = pattern[q, j]
        low = ranks.of(symbol, at)
        size = ranks.of(symbol, at + size) - low
        on = np.flatnonzero(size > 0)
        q, j, at, size = q[on], j[on] + 1, (ranks.first[symbol] + low)[on], size[on]
        done = j == length[q]
        found.append((q[done], at[done]))
        return q[~done], j[~done], at[~done], size[~done]


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), length.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = np.concatenate(rows) if rows else 0
    return out, length


def searched(points: int):
    """Rows (side, half, salt, unindexed, word, n, asks), sorted by the first four, to pairs (word, near, near_n).

    An index takes whole groups of (side, half, salt); rows that only ask come after those of the
    index and are searched as they come, so a half that very many words share is never held whole.
    """

    def found(index: Index, words: dict[str, int], asks: list[str], side: str) -> Iterator[pa.RecordBatch]:
        names, queries = list(words), sorted(asks, key=len)
        start = 0
        while start < len(queries):
            stop = start + 1
            while stop < min(len(queries), start + AT_ONCE) and (stop + 1 - start) * len(queries[stop]) <= points:
                stop += 1
            part = queries[start:stop]
            q, hits = index.near(part, side == "prefix")
            near = [names[i] for i in hits.tolist()]
            columns = [pa.array([part[i] for i in q.tolist()], pa.string()), pa.array(near, pa.string()), pa.array([words[w] for w in near], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "near", "near_n"])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, asks, size, key, index = {}, [], 0, None, None
        for batch in batches:
            for side, half, salt, unindexed, word, n, ask in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and (side != key[0] or (size >= points and (side, half, salt) != key)):
                    yield from found(index or Index(list(words)), words, asks, key[0])
                    words, asks, size, index = {}, [], 0, None
                key = side, half, salt
                if not unindexed and word not in words:
                    words[word] = n
                    size += len(word) + 1
                    index = None
                if ask:
                    asks.append(word)
                if unindexed and len(asks) >= AT_ONCE and words:
                    index = index or Index(list(words))
                    yield from found(index, words, asks, side)
                    asks = []
        if words:
            yield from found(index or Index(list(words)), words, asks, key[0])

    return run


def halves() -> Column:
    """(side, half, asks): the halves that words up to one point shorter or longer would share with this one."""
    n = F.length("word")
    first = F.array_distinct(F.transform(F.array(n - 1, n, n + 1), lambda m: F.floor(m / 2)))
    second = F.array_distinct(F.transform(F.array(n - 1, n, n + 1), lambda m: F.ceil(m / 2)))
    prefix = F.transform(first, lambda h: F.struct(F.lit("prefix").alias("side"), F.substr("word", F.lit(1), h.cast("int")).alias("half"), (h == F.floor(n / 2)).alias("asks")))
    suffix = F.transform(second, lambda h: F.struct(F.lit("suffix").alias("side"), F.right("word", h.cast("int")).alias("half"), (h == F.ceil(n / 2)).alias("asks")))
    return F.concat(prefix, suffix)


def near_words(words: DataFrame, points: int = POINTS) -> DataFrame:
    """(word, near, near_n): for each of the distinct words (word, n) those exactly one edit away.

    An edit inserts, deletes or replaces one code point. Pairs come in both directions.
    """
    words = stored(words.select("word", "n"), "words")
    rows = words.select("word", "n", F.explode(halves()).alias("h")).select("h.side", "h.half", "word", "n", "h.asks")
    sums = stored(rows.groupBy("side", "half").agg(F.sum(F.length("word") + 1).alias("points")), "halves")
    tasks = max(1, (sums.agg(F.sum("points")).first()[0] or 0) // (2 * points))
    hot = sums.where(F.col("points") > points).select("side", "half", F.ceil(F.col("points") / points).cast("int").alias("salts"))
    rows = rows.join(stored(hot, "hot-halves"), ["side", "half"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    # a word is in one index of a half and asks all of them
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int"))
    visits = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array("own"))
    rows = rows.withColumn("salt", F.explode(visits))
    rows = rows.select("side", "half", "salt", (F.col("salt") != F.col("own")).alias("unindexed"), "word", "n", "asks")
    rows = rows.repartition(int(tasks), "side", "half", "salt").sortWithinPartitions("side", "half", "salt", "unindexed")
    pairs = rows.mapInArrow(searched(points), "word string, near string, near_n long")
    return pairs.repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def variants(words: DataFrame, ratio: int = RATIO, points: int = POINTS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the distinct words (word, n).

    form is the near word that occurs most often (ties: the first in code-point order) if it occurs
    at least `ratio` times as often, else null; root is what forms lead to, the word itself without
    one. An empty table gives no rows.
    """
    words = stored(words, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    pairs = near_words(words, points).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(pairs, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    rows = stored(rows, "forms")
    # a form occurs `ratio` times as often: chains are short, and a round doubles the steps taken
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = stored(roots, "roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next")
        joined = stored(joined, "roots")
        roots = joined.select("word", "root")
        if not joined.where("next is not null").limit(1).count():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The contract's columns, for the words of all documents.

    Words are the distinct results of at least 7 code points that occur twice or more. Null and empty
    texts have none; a row without doc_id counts as one with an empty id; every row counts, repeated
    ones too; an empty table gives no rows; other columns are not read.
    """
    return variants(vocabulary(docs))


#: Checksums byte by byte; neighbours by the words with one letter left out, at one place or as a word.
ORACLE = """
with recursive tab as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), found as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), runs as (
  select doc_id, run, count(*) as n, hex(encode(concat(coalesce(cast(doc_id as varchar), ''), ':', run))) as x from found where length(run) >= 7 group by all
), sums as (
  select run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: cast('0x' || x[2 * i + 1 : 2 * i + 2] as bigint))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from runs, tab
), words as (
  select word, sum(n) as n from (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from sums) x
  where length(word) >= 7 group by word having sum(n) >= 2
), less as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as v from (select word, n, unnest(range(length(word))) as i from words) x
), pairs as (
  select a.word, b.word as near, b.n as near_n from less a join less b on a.v = b.v and a.i = b.i and a.word <> b.word
  union select w.word, l.word, l.n from words w join less l on w.word = l.v
  union select l.word, w.word, w.n from words w join less l on w.word = l.v
), best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by word
), forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * w.n then near end as form, case when near_n >= 10 * w.n then near_n end as form_n from words w left join best using (word)
), steps as (
  select word, coalesce(form, word) as root, 1 as step from forms
  union all select s.word, f.form, step + 1 from steps s join forms f on f.word = s.root where f.form is not null
)
select f.word, form, arg_max(root, step) as root, cast(n as bigint) as n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n
from forms f join steps s on s.word = f.word group by all
"""

ship(__name__)
