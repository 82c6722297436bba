"""Phrase collocations by dynamic itemset counting.

The words are dealt to shards, which are scanned one after the other in a cycle. Single words are
counted from the first scan on. As soon as both of a longer phrase's subphrases (all words but the
last, all but the first) have reached the threshold, it is counted too, from the next scan on, until
it has seen every shard once. So lengths interleave, and no phrase waits for shorter ones to end.

What has reached the threshold is known to the scans by a map of bounded size: a place per hash of a
phrase says after which scan the first phrase there did. The scans count by hashes alone, in buckets of
hashes whose number grows with the words; hashes that phrases share make counts larger, never smaller.
So no frequent phrase is missed, and one more scan counts the phrases that can be frequent exactly, each
phrase itself its key.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catascope.llm.common import bounded_batches, ship, stored
from catascope.session import scratch

LEAST = 100
LONGEST = 5
FIRST = 2000
SHARDS = 2
#: Places of the map, one byte each, and of the map of phrases that are counted exactly, one bit each.
PLACES, CHOSEN = 1 << 22, 1 << 26
#: Words of the corpus per bucket of hashes, and hashes that a task holds before it hands them on.
BUCKET, HELD = 1 << 19, 1 << 21
#: Words of one lang that a task counts together by their letters, about.
TOGETHER = 1 << 20
#: Words of a block, about; a document is never cut.
BLOCK = 1 << 19
#: Candidates that one task ranks: so many times the number wanted.
RANKED = 50

#: Marks between pieces are dots, which no word can contain; A-Z become lower case; tabs are spaces.
MARKS = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
MARK = -1
TURN = np.uint64(0x9E3779B97F4A7C15)


def marked_words(text: str | None) -> list[bytes]:
    """The words of a text, with a dot between pieces and at the end."""
    return (text or "").encode().translate(MARKS).replace(b".", b" . ").split(b" ")


def blocks(limit: int):
    """Rows (lang, text) to blocks (lang, words, ids, n): distinct words, the text as their numbers with MARK between pieces, its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            ids = [np.concatenate(x).astype("<i4") for x in held.values()]
            columns = [list(held), [list(numbers[lang])[2:] for lang in held], [x.tobytes() for x in ids], [int((x >= 0).sum()) for x in ids]]
            types = pa.string(), pa.list_(pa.binary()), pa.binary(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["lang", "words", "ids", "n"])

        def fresh():
            own = defaultdict(itertools.count(-2).__next__)
            own[b""], own[b"."]  # -2: nothing, -1: the mark
            return own

        held, numbers, size = defaultdict(list), defaultdict(fresh), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = marked_words(text)
                ids = np.fromiter(map(numbers[lang].__getitem__, words), np.int32, len(words))
                ids = np.append(ids[ids > -2], np.int32(MARK))
                held[lang].append(ids[np.concatenate(([True], (ids[1:] >= 0) | (ids[:-1] >= 0)))])
                size += len(ids)
                if size >= limit:
                    yield done()
                    held, numbers, size = defaultdict(list), defaultdict(fresh), 0
        if held:
            yield done()

    return run


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the words, and one for MARK at the end."""
    return np.array([xxhash.xxh64_intdigest(w) for w in words] + [0], np.uint64)


def phrase_hashes(lang: str, word: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length, from 0, the hashes of the phrases that begin at each place; `word` has the hash of the word there."""
    out = [np.full(len(word) + 1, np.uint64(xxhash.xxh64_intdigest(lang.encode())))]
    for m in range(min(longest, len(word))):
        out.append(grown(out[-1][: len(word) - m], word[m:]))
    return out


def grown(shorter: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    out = (shorter ^ word) * TURN
    return out ^ out >> np.uint64(29)


def same_phrases(ids: np.ndarray, places: np.ndarray, hashes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different phrase of m words that begins at one of the places, and its count."""
    _, first, which, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    first = places[first]
    if all(np.array_equal(ids[places + k], ids[first[which] + k]) for k in range(m)):
        return first, count
    rows = ids[places[:, None] + np.arange(m)]  # two phrases with one hash
    _, first, count = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return places[first], count


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes in order, each with the sum of its counts."""
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[first], np.add.reduceat(counts[order], first)


COUNTS = "bucket long, began int, longest boolean, hashes binary, counts binary"


def scanned(step: int, shards: int, longest: int, buckets: int, since):
    """Blocks of one shard to the counts of the phrases that are counted in this scan, by buckets of hashes.

    `since` is the map: the scan after which something at the place had reached the threshold, or 0.
    A bucket is a range of the upper halves of hashes, and holds the lower halves.
    """
    starts = np.array([-(-(k << 32) // buckets) << 32 for k in range(buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = since.value, defaultdict(list)
        size = np.uint64(len(known) - 1)

        def done() -> Iterator[pa.RecordBatch]:
            for (began, last), own in held.items():
                hashes, counts = summed(*zip(*own))
                cut = [*np.searchsorted(hashes, starts).tolist(), len(hashes)]
                some = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                low, counts = hashes.astype("<u4"), counts.astype("<u8")
                columns = [pa.array(some, pa.int64()), pa.array([began] * len(some), pa.int32()), pa.array([last] * len(some), pa.bool_())]
                columns += [pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()) for x in (low, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "began", "longest", "hashes", "counts"])
            held.clear()

        n = 0
        for batch in batches:
            for lang, words, ids in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "ids"))):
                ids = np.frombuffer(ids, "<i4")
                own = word_hashes(words)
                if step <= shards and words:
                    held[0, longest == 1].append((phrase_hashes(lang, own[:-1], 1)[1], np.bincount(ids[ids >= 0], minlength=len(words))))
                    n += len(words)
                # a phrase of m words begins after m - 1 scans at least
                own = own[ids]
                hashes = phrase_hashes(lang, own, min(longest, step) - 1)
                word = whole = ids != MARK
                for m in range(2, min(longest, step, len(ids)) + 1):
                    whole = whole[:-1] & word[m - 1 :]
                    reached = known[(hashes[m - 1] & size).astype(np.int64)]
                    began = np.maximum(np.maximum(reached[:-1], reached[1:]), m - 1)
                    places = np.flatnonzero(whole & (reached[:-1] > 0) & (reached[1:] > 0) & (began < step) & (step - shards <= began.astype(np.int64)))
                    if not len(places):
                        continue
                    found, began = grown(hashes[m - 1][places], own[places + m - 1]), began[places]
                    for b in range(max(0, step - shards), step):
                        some, count = np.unique(found[began == b], return_counts=True)
                        if len(some):
                            held[b, m == longest].append((some, count))
                            n += len(some)
                if n >= HELD:
                    for key, parts in held.items():
                        held[key] = [summed(*zip(*parts))]
                    n = sum(len(x) for parts in held.values() for x, _ in parts)
                if n >= HELD * 3 // 4:
                    yield from done()
                    n = 0
        yield from done()

    return run


def merged(step: int, shards: int, least: int):
    """Counts of a bucket to one row; what has been counted in every shard leaves but for what is in `often`, which has reached the threshold."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        hashes, counts = summed(column("hashes", "<u4"), column("counts", "<u8"))
        began = table.column("began")[0].as_py()
        open_ = began + shards > step
        row = {"bucket": table.column("bucket")[0].as_py(), "began": began, "longest": table.column("longest")[0].as_py()}
        row |= {"hashes": hashes.tobytes() if open_ else b"", "counts": counts.tobytes() if open_ else b""}
        row["often"] = hashes[counts >= least].astype(np.int64)
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table({c: pa.array([v], k) for (c, v), k in zip(row.items(), kinds)})

    return run


def exactly(longest: int, chosen):
    """Blocks to the counts (lang, phrase, words, n, hash) of phrases whose bits, and those of all phrases inside, are set.

    Blocks of one lang are counted together, up to TOGETHER words.
    """

    def counted(lang: str, words: list[bytes], ids: np.ndarray, size: np.uint64, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashes, whole = phrase_hashes(lang, word_hashes(words)[ids], longest), ids != MARK
        for m in range(1, min(longest, len(ids)) + 1):
            # marks are in no phrase of one word, and a phrase has no more occurrences than those inside
            whole = whole if m == 1 else whole[:-1] & whole[1:]
            places = np.flatnonzero(whole)
            at = (hashes[m][places] & size).astype(np.int64)
            places = places[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
            whole = np.zeros(len(whole), bool)
            whole[places] = True
            if not len(places):
                break
            first, count = same_phrases(ids, places, hashes[m][places], m)
            texts = [b" ".join([words[i] for i in p]).decode() for p in ids[first[:, None] + np.arange(m)].tolist()]
            columns = [pa.array([lang] * len(first), pa.string()), pa.array(texts, pa.string()), pa.array(np.full(len(first), m, np.int32)), pa.array(count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes[m][first])], ["lang", "phrase", "words", "n", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = chosen.value
        size = np.uint64(8 * len(bits) - 1)
        held, numbers = defaultdict(list), defaultdict(dict)

        def done(lang: str) -> Iterator[pa.RecordBatch]:
            yield from counted(lang, list(numbers.pop(lang)), np.concatenate(held.pop(lang)), size, bits)

        for batch in batches:
            for lang, words, ids in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "ids"))):
                own = numbers[lang]
                number = np.array([own.setdefault(w, len(own)) for w in words] + [MARK], np.int32)
                held[lang].append(number[np.frombuffer(ids, "<i4")])
                if sum(map(len, held[lang])) >= TOGETHER:
                    yield from done(lang)
        for lang in list(held):
            yield from done(lang)

    return run


TOLD = "lang string, bucket long, phrases array<string>, words array<int>, counts array<long>"


def in_buckets(buckets: int, counted):
    """What `counted` gives, with the counts of a lang and a bucket of hashes in one row, as often as a task has HELD / 4 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = defaultdict(list), 0

        def done() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                rows = pa.Table.from_batches(own).combine_chunks()
                bucket = (rows["hash"].to_numpy() >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                rows = rows.take(pa.array(np.argsort(bucket, kind="stable"))).combine_chunks()
                some, first = np.unique(np.sort(bucket), return_index=True)
                ends = pa.array(np.append(first, len(bucket)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in ("phrase", "words", "n")]
                lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "phrases", "words", "counts"])
            held.clear()

        for batch in counted(batches):
            held[batch.column(0)[0].as_py()].append(batch)
            n += batch.num_rows
            if n >= HELD // 4:
                yield from done()
                n = 0
        yield from done()

    return run


def put_together(least: int):
    """Counts of a lang and bucket to rows (lang, phrase, words, n) of what occurs often enough."""

    def run(table: pa.Table) -> pa.Table:
        names = ["phrase", "words", "n"]
        lists = [table.column(c).combine_chunks() for c in ("phrases", "words", "counts")]
        lists = [x if isinstance(x, pa.Array) else x.chunk(0) for x in lists]
        rows = pa.table([x.flatten() for x in lists], names).group_by(names[:2]).aggregate([("n", "sum")])
        rows = rows.filter(pc.greater_equal(rows["n_sum"], least))
        return pa.table([pa.array([table.column("lang")[0].as_py()] * len(rows), pa.string()), *(rows[c] for c in ("phrase", "words", "n_sum"))], ["lang", *names])

    return run


def phrase_counts(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, places: int = PLACES
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases that occur at least `least` times, and (lang, total) words of each lang.

    Counts are of contiguous occurrences inside pieces, overlapping ones too.
    """
    if places & (places - 1) or not 0 < shards * longest < 256:
        raise ValueError("the map has a power of two places, and a byte of it holds the number of a scan")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    rows = rows.mapInArrow(blocks(BLOCK), "lang string, words array<binary>, ids binary, n long")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("lang", "ids"), F.lit(shards)).cast("int"))
    path = scratch(spark, "blocks")
    rows.write.partitionBy("shard").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    totals = stored(rows.groupBy("lang").agg(F.sum("n").alias("total")), "words-by-lang")
    buckets = -(-(totals.agg(F.sum("total")).first()[0] or 1) // BUCKET)
    since, chosen, open_, step, last = np.zeros(places, np.uint8), np.zeros(CHOSEN, bool), None, 0, 0

    def places_of(often: DataFrame, size: int) -> np.ndarray:
        """The places of hashes in a map: never more than the map has."""
        hashes = often.select(F.explode("often").alias("hash"))
        return hashes.select(F.col("hash").bitwiseAND(size - 1).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()

    # what has a place that was set before begins after longest - 1 scans at the latest
    while step < (max(last, longest - 1) if last else 0) + shards:
        step += 1
        shard = rows.where(F.col("shard") == (step - 1) % shards).select("lang", "words", "ids")
        known = spark.sparkContext.broadcast(since)
        found = shard.mapInArrow(scanned(step, shards, longest, buckets, known), COUNTS)
        found = found.unionByName(open_) if open_ else found
        found = stored(found.groupBy("bucket", "began", "longest").applyInArrow(merged(step, shards, least), COUNTS + ", often array<long>"), "counts")
        known.unpersist()
        # phrases that have seen every shard leave: the frequent ones are results
        through = F.col("began") + shards <= step
        chosen[places_of(found.where(through), CHOSEN)] = True
        open_ = found.where(~through).drop("often")
        new = places_of(found.where(~F.col("longest")), places)
        new = new[since[new] == 0]
        if len(new):
            since = since.copy()
            since[new] = step
            last = step
    known = spark.sparkContext.broadcast(np.packbits(chosen, bitorder="little"))
    counts = rows.select("lang", "words", "ids").mapInArrow(in_buckets(buckets, exactly(longest, known)), TOLD)
    counts = counts.groupBy("lang", "bucket").applyInArrow(put_together(least), "lang string, phrase string, words int, n long")
    return stored(counts, "phrases"), totals


def part(first: Column | int, last: Column | int) -> Column:
    """The words of the phrase from number `first` to `last`, from 1."""
    words = F.split("phrase", " ", -1)
    return F.array_join(F.slice(words, first, F.lit(last) - F.lit(first) + 1), " ")


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of two words or more, by their weakest cut.

    Products are decimals of 38 digits: exact for counts of up to 17 digits.
    """
    rows = counts.where("words > 1").withColumnRenamed("n", "a")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    rows = rows.select("*", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words")).alias("right"))
    parts = counts.select("lang", "phrase", "n")
    rows = rows.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    rows = rows.join(totals.toDF("lang", "n"), "lang")
    wide = lambda c: F.col(c).cast("decimal(17,0)")
    rows = rows.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "below": wide("l") * wide("r")})
    rows = rows.withColumn("score", F.expr("above div below"))
    best = rows.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "words", "a", "n")).alias("best"))
    return best.select("lang", "phrase", "best.words", "best.a", "best.l", "best.r", "best.n", "best.score")


def outermost(rows: DataFrame) -> DataFrame:
    """Without phrases that a longer one has inside just as often.

    A phrase occurs at least as often as any that has it inside, so that the phrases of one word
    more decide.
    """
    inner = F.array(part(1, F.col("words") - 1), part(2, F.col("words")))
    longer = rows.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return rows.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")


def ranked(rows: DataFrame, first: int) -> DataFrame:
    """The best rows of each lang by score, count and phrase, with their rank; no task ranks more than a bounded number."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows, size = stored(rows, "candidates"), None
    while size is None or size > RANKED * first:
        size = rows.count()
        salts = -(-size // (RANKED * first))
        if salts > 1:
            here = Window.partitionBy("lang", "salt").orderBy(*order)
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
            rows = rows.withColumn("rank", F.row_number().over(here)).where(F.col("rank") <= first).drop("rank", "salt")
            rows, before = stored(rows, "candidates"), size
            size = rows.count()
            if size == before:  # very many langs with few phrases each
                break
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the contract's columns, for each lang its best phrases.

    Null texts count as empty, null langs as `und`; neither doc_id nor repeated rows matter, every
    row counts. Equal scores are ranked by count, then by phrase in byte order. An empty table gives
    no rows; other columns are not read.
    """
    rows = ranked(outermost(stored(scored(*phrase_counts(docs, least, longest, shards)), "scored")), first)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with pieces as materialized (
  select row_number() over () as no, lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as words from (
    select coalesce(lang, 'und') as lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents) p
), w as materialized (
  select no, lang, unnest(words) as w1, generate_subscripts(words, 1) as i from pieces
), w5 as materialized (
  select lang, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3, lead(w1, 3) over o as w4, lead(w1, 4) over o as w5 from w window o as (partition by no order by i)
), f as materialized (
  select lang, 1 as m, w1 as phrase, count(*) as f from w5 group by all
  union all select lang, 2, concat_ws(' ', w1, w2), count(*) from w5 where w2 is not null group by all having count(*) >= 100
  union all select lang, 3, concat_ws(' ', w1, w2, w3), count(*) from w5 where w3 is not null group by all having count(*) >= 100
  union all select lang, 4, concat_ws(' ', w1, w2, w3, w4), count(*) from w5 where w4 is not null group by all having count(*) >= 100
  union all select lang, 5, concat_ws(' ', w1, w2, w3, w4, w5), count(*) from w5 where w5 is not null group by all having count(*) >= 100
), total as materialized (
  select lang, cast(sum(f) as hugeint) as n from f where m = 1 group by lang
), c as materialized (
  select lang, m, phrase, string_split(phrase, ' ') as words, f as a from f where m > 1
), cuts as materialized (
  select lang, m, phrase, a, k, array_to_string(words[1 : k], ' ') as first, array_to_string(words[k + 1 : m], ' ') as rest
  from (select *, unnest(range(1, m)) as k from c) x
), scored as materialized (
  select cuts.lang, cuts.phrase, cuts.a, k, l.f as l, r.f as r, n, (cast(1000 as hugeint) * cuts.a * n) // (cast(l.f as hugeint) * r.f) as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = cuts.first join f r on r.lang = cuts.lang and r.phrase = cuts.rest join total on total.lang = cuts.lang
), best as materialized (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), parts as materialized (
  select lang, a, array_to_string(words[i : j], ' ') as phrase from (select *, unnest(range(i + 1, m + 1)) as j from (select *, unnest(range(1, m)) as i from c) x) y where j - i + 1 < m
), longer as materialized (
  select lang, phrase, max(a) as longer from parts group by all
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from (
  select b.lang, b.phrase, a, l, r, n, score, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase where longer is null or 100 * longer < 100 * a
) where rank <= 2000
"""

ship(__name__)
