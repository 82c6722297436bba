"""Benchmark decontamination: SimHash of item-sized windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catascope.llm.common import let, stored, text_key

WIDTH = 5
SIMILARITY = 0.8
#: Fingerprints of 64 bits in 8 blocks of 8. Two that differ in at most RADIUS bits have a block
#: that differs in at most RADIUS // 8 = 2 bits, so looking up every value within 2 bits of an
#: item's blocks finds all windows within the radius.
RADIUS = 23
BLOCKS = 8
MASKS = [m for m in range(256) if m.bit_count() <= RADIUS // BLOCKS]

NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shingles(text: Column, width: Column | int) -> Column:
    """Hashes of all runs of `width` words; an empty array if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width

    def hashed(ws: Column) -> Column:
        at = lambda w, i: F.xxhash64(width, w, *[F.when(width > k, F.get(ws, i + k)) for k in range(1, WIDTH)])
        return F.slice(F.transform(ws, at), 1, F.greatest(F.size(ws) - width + 1, F.lit(0)))

    return let(words(text), hashed)


def fingerprint(hashes: Column) -> Column:
    """A bit is set where over half of the shingles' hashes have it, repeats included."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
    bit = lambda b: F.when(ones(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(bit(b)))


def block(fp: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, i * 8).bitwiseAND(F.lit(255).cast("long")).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, weights being the numbers of repeats."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, width, hashes, n, fp for each different text. Items of fewer than five words are one shingle of their words."""
    items = benchmark.select("text").distinct()
    items = items.select(text_key(F.col("text")).alias("item"), "text", F.least(F.size(words(F.col("text"))), F.lit(WIDTH)).alias("width"))
    items = items.where("width > 0").dropDuplicates(["item"])
    items = items.select("item", "width", shingles(F.col("text"), F.col("width")).alias("hashes"))
    return items.withColumns({"n": F.size("hashes"), "fp": fingerprint(F.col("hashes"))})


def names_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id): the ids of each text."""
    return benchmark.select(text_key(F.col("text")).alias("item"), "item_id").distinct()


def shared_places(docs: DataFrame, items: DataFrame, widths: list[int]) -> DataFrame:
    """(key, first_id, width, total, place, hash): the places of texts whose shingle is in an item; one scan for all widths."""
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))

    def places(width: int) -> Column:
        at = lambda hs: F.transform(hs, lambda h, i: F.struct(F.lit(width).alias("width"), F.size(hs).alias("total"), i.alias("place"), h.alias("hash")))
        return let(shingles(F.col("text"), width), at)

    found = rows.select("key", "doc_id", F.inline(F.concat(*[places(w) for w in widths])))
    found = found.join(items.select("width", F.explode("hashes").alias("hash")).distinct(), ["width", "hash"], "left_semi")
    return found.groupBy("width", "key", "total", "place", "hash").agg(F.min("doc_id").alias("first_id"))


def windows(found: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(key, first_id, width, item, n, start, m): item-sized windows that can be similar enough to an item.

    A window of m shingles that is similar to an item of n shares at least (n + m) * s / (1 + s) of its
    places with it, and all but n * (1 - s) of the item's shingles. So it holds one of the item's
    rarest that are one more: only these say which texts may hold an item, whatever shingles are
    everywhere. In such a text a window is formed at each shared place that is followed by enough
    others. Moving a window right to the next shared place loses none, so the best window starts at
    one, or ends the text.
    """
    often = found.groupBy("width", "hash").agg(F.count("*").alias("often"))
    owners = items.select("item", "width", "n", F.explode("hashes").alias("hash")).groupBy("item", "width", "n", "hash").agg(F.count("*").alias("times"))
    owners = stored(owners.join(often, ["width", "hash"], "left").withColumn("often", F.coalesce("often", F.lit(0))), "owners")
    rarer = Window.partitionBy("item").orderBy("often", "hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("times").over(rarer), F.lit(0))
    rare = owners.withColumn("before", before).where(F.col("before") <= F.col("n") - F.ceil(F.col("n") * least - F.lit(1e-9)))
    held = stored(found.join(rare.select("width", "hash", "item"), ["width", "hash"]).select("key", "width", "item").distinct(), "held-items")
    near = held.join(owners.select("item", "n", "hash"), "item").join(found, ["key", "width", "hash"])
    near = near.withColumn("m", F.least("n", "total"))
    near = near.withColumn("need", F.ceil((F.col("n") + F.col("m")) * (least / (1 + least)) - F.lit(1e-9)).cast("int"))
    near = near.groupBy("key", "first_id", "width", "total", "item", "n", "m", "need").agg(F.sort_array(F.collect_list("place")).alias("at"))
    follows = lambda p, i: F.get("at", i + F.col("need") - 1) < p + F.col("m")
    starts = F.filter("at", lambda p, i: F.coalesce(follows(p, i), F.lit(False)))
    start = F.least(F.col("start"), F.col("total") - F.col("m"))
    near = near.where(F.size("at") >= F.col("need")).withColumn("start", F.explode(starts))
    return near.select("key", "first_id", "width", "item", "n", "m", start.alias("start")).distinct()


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(key, item, start, similarity): for each text and item (by SHA-256) the best window, the last one
    of equal ones.

    Contaminated means: some window of the item's size has weighted similarity `least` or more to
    the item on shingles of five words, and a fingerprint within the radius.
    """
    items = stored(items_of(benchmark), "items")
    widths = [r["width"] for r in items.select("width").distinct().collect()] or [WIDTH]  # 1 to 5
    found = stored(shared_places(docs, items, sorted(widths)), "shared-places")
    spans = stored(windows(found, items, least), "windows")
    own = ["key", "width", "start", "m"]
    cuts = spans.select(*own, "first_id").distinct().withColumnRenamed("key", "span_key")
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    same = (texts["key"] == cuts["span_key"]) & texts["doc_id"].eqNullSafe(cuts["first_id"])
    # windows grow with the documents: texts move once at every size, not only beyond a broadcast's limit
    cut = texts.join(cuts.hint("shuffle_merge"), same).select(
        *own, F.slice(shingles(F.col("text"), F.col("width")), F.col("start") + 1, F.col("m")).alias("own")
    )
    cut = stored(cut.dropDuplicates(own).withColumn("own_fp", fingerprint(F.col("own"))), "window-prints")
    # a window is looked up at the items whose places it was formed by, by the blocks of its fingerprint
    places = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    prints = spans.join(cut.select(*own, "own_fp"), own).select(*own, "item", "own_fp", places.alias("block"))
    prints = prints.withColumn("value", block(F.col("own_fp"), F.col("block")))
    value = block(F.col("fp"), F.col("block"))
    probes = items.select("item", "fp", places.alias("block"))
    probes = probes.withColumn("value", F.explode(F.transform(F.array(*map(F.lit, MASKS)), lambda m: value.bitwiseXOR(m))))
    pairs = prints.join(probes, ["item", "block", "value"]).where(F.bit_count(F.col("own_fp").bitwiseXOR(F.col("fp"))) <= radius)
    pairs = stored(pairs.select(*own, "item").distinct(), "close-windows")
    pairs = pairs.join(items.select("item", "hashes"), "item").join(cut.select(*own, "own"), own)
    pairs = pairs.withColumn("similarity", similarity(F.col("own"), F.col("hashes"))).where(F.col("similarity") >= least - 1e-9)
    return pairs.groupBy("key", "item").agg(F.max(F.struct("similarity", "start")).alias("best")).select("key", "item", "best.start", "best.similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start (in shingles), similarity: one row per document and item found in it.

    Null and empty texts and items match nothing. Copies and repeated rows each get their rows;
    rows without doc_id too. Items are looked for by text: of items with one id, or without one, the
    best match counts, and a text with several ids is found under each. Empty tables give no rows;
    other columns are not read.
    """
    found = stored(matches(docs, benchmark, least), "contaminated")
    best = found.join(names_of(benchmark), "item").groupBy("key", "item_id").agg(F.max(F.struct("similarity", "start")).alias("best"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"))
    return rows.join(best, "key").select("doc_id", "item_id", "best.start", "best.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents in which no item is found, with their columns.

    Null and empty texts, and so all of them where the benchmark is empty, are clean; copies and
    repeated rows go or stay together.
    """
    found = stored(matches(docs, benchmark, least).select("key").distinct(), "contaminated").toDF("__key")
    return docs.join(found.hint("shuffle_merge"), text_key(docs["text"]) == found["__key"], "left_anti")


#: Every window of every document that shares a shingle with an item, without fingerprints.
ORACLE = r"""
with di as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents
), ii as (
  select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark
), i as (
  select item_id, k, list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' ')) as b
  from (select *, least(5, len(ws)) as k from ii where len(ws) > 0) x
), d as (
  select doc_id, k, list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' ')) as a
  from di cross join (select distinct k from i) ks where len(ws) >= k
), pairs as (
  select distinct x.doc_id, y.item_id from (select doc_id, k, unnest(a) as s from d) x join (select item_id, k, unnest(b) as s from i) y on x.k = y.k and x.s = y.s
), spans as (
  select doc_id, item_id, b, least(len(a), len(b)) as m, a, unnest(range(0, len(a) - least(len(a), len(b)) + 1)) as start
  from pairs join i using (item_id) join d using (doc_id, k)
), shared as (
  select doc_id, item_id, start, m, len(b) as n,
    list_sum(list_transform(list_distinct(b), lambda x: least(len(list_filter(a[start + 1:start + m], lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) as common
  from spans
), scored as (
  select doc_id, item_id, start, common / (n + m - common) as similarity from shared
)
select doc_id, item_id, cast(max(start) as int) as start, similarity from scored
where similarity >= 0.8 - 1e-9
group by doc_id, item_id, similarity
qualify row_number() over (partition by doc_id, item_id order by similarity desc) = 1
"""
