"""SimHash near-dedup: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catascope.llm.common import bounded_batches, ship, stored

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints in one side of a tile pair.
TILE = 2048
#: Rows of small tile pairs that are compared in one go.
BATCH = 1 << 16

#: Similar texts: Jaccard similarity of their sets of five-word shingles.
WIDE = 5
SIMILARITY = 0.8
#: Bits of the parity map of a set: two per shingle or more, up to so many.
MAP_BITS = 64, 8192
#: A distance beyond all others: such pairs are not verified.
NEVER = (1 << 31) - 1
#: Least shingles per text, each by an order of its own. Two texts of similarity s have none in
#: common with probability (1 - s) ** LEAST: 3 in a million at 0.8.
LEAST = 8
#: Nearest fingerprints that the first round verifies per row of a tile; each next round 64 times as many.
NEAREST = 4


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included; fewer words are one run, none give none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    starts = at[: max(1, len(words) - width + 1)].tolist()
    ends = (at[min(width, len(words)) :] - 1).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in zip(starts, ends)), np.uint64, len(starts))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the hashes of the shingles. No words: zero."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        votes += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def wide_hashes(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of the five-word shingles, from the hashes of three-word ones.

    A run of five words is three runs of three, so their hashes together stand for it. A text of
    fewer words is one shingle.
    """
    odd = np.uint64(0x9E3779B97F4A7C15)
    if len(hashes) > 2:
        hashes = (hashes[:-2] * odd + hashes[1:-1]) * odd + hashes[2:]
    elif len(hashes) == 2:
        hashes = hashes[:1] * odd + hashes[1:]
    return np.unique(hashes)


def least_shingles(wide: np.ndarray) -> np.ndarray:
    """For each of LEAST orders the first of the five-word shingles."""
    mixed = wide ^ (wide >> np.uint64(31))
    turns = [np.uint64(xxhash.xxh64_intdigest(b"order", k) | 1) for k in range(LEAST)]
    return np.array([(mixed * t).min() for t in turns], np.uint64) if len(wide) else np.zeros(LEAST, np.uint64)


def parity_map(wide: np.ndarray) -> bytes:
    """Which of the places that hashes are dealt to have an odd number of them.

    Two maps of one size differ in at most as many places as their sets differ in shingles: what
    both sets have goes out in the exclusive-or.
    """
    bits = min(MAP_BITS[1], max(MAP_BITS[0], 1 << max(0, 2 * len(wide) - 1).bit_length()))
    at = ((wide * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) & np.uint64(bits - 1)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


@F.arrow_udf(T.StructType().add("fp", T.LongType()).add("least", T.ArrayType(T.LongType())).add("node", T.LongType()).add("n", T.LongType()).add("map", T.BinaryType()))
def sketches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each text the fingerprint; of its set of five-word shingles the least ones, a hash (node), the size and the parity map."""
    for column in texts:
        fps, least, nodes, sizes, maps = [], [], [], [], []
        for text in column.to_pylist():
            hashes = shingle_hashes(text, SHINGLE)
            wide = wide_hashes(hashes)
            fps.append(majority(hashes))
            least.append(least_shingles(wide).view(np.int64))
            nodes.append(np.uint64(xxhash.xxh64_intdigest(wide.tobytes(), SEED)))
            sizes.append(len(wide))
            maps.append(parity_map(wide))
        offsets = pa.array(np.arange(len(fps) + 1, dtype=np.int32) * LEAST)
        flat = pa.array(np.concatenate(least) if least else np.empty(0, np.int64))
        columns = [
            pa.array(fps, pa.int64()),
            pa.ListArray.from_arrays(offsets, flat),
            pa.array(np.array(nodes, np.uint64).view(np.int64)),
            pa.array(sizes, pa.int64()),
            pa.array(maps, pa.binary()),
        ]
        yield pa.StructArray.from_arrays(columns, ["fp", "least", "node", "n", "map"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The set of five-word shingles of each text, as sorted hashes."""
    for column in texts:
        yield pa.array([np.unique(shingle_hashes(t, WIDE)).view(np.int64) for t in column.to_pylist()], pa.list_(pa.int64()))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets; empty ones are equal."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


@F.arrow_udf(T.DoubleType())
def similarities(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in pairs:
        yield pa.array([jaccard(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(left, right)], pa.float64())


@F.arrow_udf(T.LongType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([fingerprint(t) for t in column.to_pylist()], pa.int64())


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that differ in at most `radius` bits, by exclusive-or and bit count."""
    found = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    return np.nonzero(found)


def forest(fps: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places of rows, that join what the rows of one tile pair link; rows of one root are joined already."""
    pop = np.bitwise_count(fps.view(np.uint64)).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    x, pop = fps[order].view(np.uint64), pop[order]
    label = np.unique(root[order], return_index=True, return_inverse=True)
    label = label[1][label[2]]
    begin, step = label.copy(), 1024
    for i in range(0, len(x), step):
        for j in range(i, len(x), step):
            p, q = pop[i : i + step], pop[j : j + step]
            if q.min() - p.max() > radius or p.min() - q.max() > radius:
                continue
            a, b = close_pairs(x[i : i + step], x[j : j + step], radius)
            a, b = a + i, b + j
            a, b = label[a], label[b]
            off = a != b
            if off.any():
                label = components(len(x), a[off], b[off])[label]
    far = np.flatnonzero(label != begin)
    return order[far], order[label[far]]


def near(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places of rows, within groups of few rows each, all groups at once; rows are sorted by group."""
    x, found = fps.view(np.uint64), []
    for d in range(1, len(x)):
        same = np.flatnonzero(group[d:] == group[:-d])
        if not len(same):
            break
        hit = same[np.bitwise_count(x[same] ^ x[same + d]) <= radius]
        found.append((hit + d, hit))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(z) for z in zip(*found))
    label = components(len(x), a, b)
    far = np.flatnonzero(label != np.arange(len(x)))
    return far, label[far]


class Merged:
    """What the links of a task have joined so far, so that only links that join more go on."""

    def __init__(self):
        self.node, self.label = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New links that join the same as these, at most one for each group that is joined to another."""
        new = np.setdiff1d(np.concatenate((src, dst)), self.node)
        node, label = np.concatenate((self.node, new)), np.concatenate((self.label, new))
        order = np.argsort(node, kind="stable")
        self.node, self.label = node[order], label[order]
        a, b = (self.label[np.searchsorted(self.node, x)] for x in (src, dst))
        ends = np.unique(np.concatenate((a, b)))
        to = ends[components(len(ends), np.searchsorted(ends, a), np.searchsorted(ends, b))]
        at = np.minimum(np.searchsorted(ends, self.label), max(0, len(ends) - 1))
        if len(ends):
            self.label = np.where(ends[at] == self.label, to[at], self.label)
        off = to != ends
        return ends[off], to[off]


def compared(radius: int):
    """Rows (tile, fp, root), sorted by tile, to links (src, dst) between roots that join what the fingerprints do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = Merged()

        def links(tile: np.ndarray, fp: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
            size = np.diff(cut)
            few = np.flatnonzero(np.repeat(size <= 64, size))
            a, b = near(fp[few], np.repeat(np.arange(len(size)), size)[few], radius)
            out = [(few[a], few[b])]
            for k in np.flatnonzero(size > 64):
                a, b = forest(fp[cut[k] : cut[k + 1]], root[cut[k] : cut[k + 1]], radius)
                out.append((a + cut[k], b + cut[k]))
            a, b = (root[np.concatenate(z)] for z in zip(*out))
            a, b = merged.add(a[a != b], b[a != b])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            last = np.searchsorted(held[0] == held[0][-1], True) if len(held[0]) else 0  # the last tile may go on
            if last >= BATCH:
                yield links(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield links(*held)

    return run


def keys(radius: int) -> Column:
    """(block, value) for every two of radius + 2 blocks of bits.

    Two fingerprints within the radius agree in at least two of the blocks, and a value of two
    blocks (25 bits at radius 3) is shared by few others even among billions.
    """
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    part = lambda i: F.shiftrightunsigned("fp", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1)
    two = lambda i, j: F.shiftleft(part(i), cuts[j + 1] - cuts[j]).bitwiseOR(part(j))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    return F.array(*[F.struct(F.lit(k).alias("block"), two(i, j).alias("value")) for k, (i, j) in enumerate(pairs)])


def tile_pairs(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(block, tile, fp): the fingerprints that one comparison needs together.

    Fingerprints with a key in common are one tile. Where these are more than `tile`, they are
    tiled by population count in bands of radius + 1, and only a band and its neighbour are paired:
    other counts differ beyond the radius. A band with more than `tile` fingerprints is salted into
    several tiles, each paired with the others.
    """
    rows = fps.select("fp", F.explode(keys(radius)).alias("at")).select("fp", "at.block", "at.value")
    return tiled(rows, "fp", F.floor(F.bit_count("fp") / (radius + 1)), tile)


def tiled(rows: DataFrame, node: str, band: Column, tile: int) -> DataFrame:
    """(block, tile, node) of rows (node, block, value); nodes to compare are in one band or in bands next to each other."""
    rows = rows.withColumn("band", band.cast("int"))
    hot = rows.groupBy("block", "value").count().where(F.col("count") > tile).select("block", "value")
    hot = stored(hot, "hot-keys")
    bands = rows.join(hot, ["block", "value"], "left_semi").groupBy("block", "value", "band").count()
    salts = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("count") / tile).cast("int"))))
    hot = stored(bands.groupBy("block", "value").agg(salts.alias("salts")), "hot-tiles")
    rows = rows.join(hot, ["block", "value"], "left")
    of = lambda band: F.coalesce(F.try_element_at("salts", band), F.lit(1))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(node), of(F.col("band"))).cast("int"))
    pair = lambda band, kind, s, t: F.xxhash64("block", "value", band, F.lit(kind), s, t)
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    band, salt = F.col("band"), F.col("salt")
    tiles = F.concat(
        each(of(band), lambda s: pair(band, 0, F.least(s, salt), F.greatest(s, salt))),
        each(of(band + 1), lambda s: pair(band, 1, salt, s)),
        each(of(band - 1), lambda s: pair(band - 1, 1, s, salt)),
    )
    tiles = F.when(F.col("salts").isNull(), F.array(F.xxhash64("block", "value"))).otherwise(tiles)
    return rows.select("block", F.explode(tiles).alias("tile"), node)


#: Keys whose tiles are compared one after the other: what the first ones join is not linked again.
PHASES = (lambda k: k == 0, lambda k: (k == 1) | (k == 2), lambda k: k > 2)


def joined(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(node, root): what distinct fingerprints reach by steps of at most `radius` bits, all that have a step.

    Tiles are compared in phases. Each gives links between the roots of those before, so that their
    number stays below that of the fingerprints, however many tiles a group is in.
    """
    tiles = stored(tile_pairs(fps, radius, tile), "tiles")
    roots = fps.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
    for phase in PHASES:
        rows = tiles.where(phase(F.col("block"))).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        rows = rows.select("tile", "fp", F.coalesce("root", "fp").alias("root"))
        open_ = rows.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("tile")
        rows = rows.join(open_, "tile", "left_semi")
        found = rows.repartition("tile").sortWithinPartitions("tile", "fp").mapInArrow(compared(radius), "src long, dst long")
        roots = rejoined(roots, reached(found))
    return roots


def rejoined(roots: DataFrame, new: DataFrame) -> DataFrame:
    """(node, root) after the roots have been joined as (node, root) in `new` says."""
    moved = roots.join(new.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stored(moved.unionByName(new.join(roots.select("node"), "node", "left_anti")), "roots")


def reached(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links reaches, by rounds of contraction.

    In a round every end of a link points to the smallest end beside it, and what it points to points on;
    then links are drawn between what their ends point to, each once. All is written to the shared
    folder; only whether links are left comes to the driver.
    A node with very many links is reduced on the map side, and the joins read files on both sides, so
    that they can be split.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    edges = stored(edges.where("src <> dst").select(low.alias("src"), high.alias("dst")).distinct(), "links")
    roots = edges.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)
    while not edges.isEmpty():
        end = lambda c: F.struct(F.col(c).alias("node"), F.col("src").alias("root"))
        step = edges.select(F.inline(F.array(end("src"), end("dst")))).groupBy("node").agg(F.min("root").alias("root"))
        step = stored(step, "steps")
        for _ in range(2):  # where the one that a node points to points
            on = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = stored(step.join(on, "root").select("node", F.col("next").alias("root")), "steps")
        roots = rejoined(roots, step)
        edges = edges.join(step.toDF("src", "a"), "src").join(step.toDF("dst", "b"), "dst").where("a <> b")
        edges = stored(edges.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links")
    return roots


def near_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """doc_id, probe, fp, component_id per row of documents.

    component_id is the smallest doc_id whose fingerprint is reachable by steps of at most
    `radius` bits. Null and empty texts have fingerprint zero and are linked like any other.
    Rows without doc_id take part; a component of such rows only has a null id. Repeated rows
    give repeated rows; an empty table gives none; other columns are not read. probe is a hash
    of the text, so that a row can be found again by (doc_id, probe).
    """
    if (width, text) != (SHINGLE, "text"):
        raise ValueError("fingerprints are defined on three words of the text")
    bounded_batches(docs.sparkSession)
    rows = stored(docs.select("doc_id", F.xxhash64("text").alias("probe"), fingerprints(F.col("text")).alias("fp")), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(first_row()), "distinct-fingerprints")
    return components_of(rows, fps, joined(fps.select("fp"), radius), "fp")


def components_of(rows: DataFrame, nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """doc_id, probe, node, component_id, staying of rows, by the roots of their nodes.

    `nodes` has the `first` of each node; staying is true for the doc_id and text of the first in
    the component, repeated rows of it included.
    """
    nodes = nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    nodes = stored(nodes, "rooted")
    least = stored(nodes.groupBy("root").agg(F.min("first").alias("stay")), "components")
    named = stored(nodes.join(least, "root").select(node, "stay"), "named")
    staying = F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("probe") == F.col("stay.probe"))
    return rows.join(named, node).select("doc_id", "probe", node, F.col("stay.doc_id").alias("component_id"), staying.alias("staying"))


def first_row() -> Column:
    """The row with the smallest doc_id and, of those, text; rows without doc_id come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "probe")).alias("first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that have a near duplicate with a smaller doc_id.

    Columns stay as they are. One row of each component stays: rows without doc_id go where there
    are ids, and else one text of the component stays; of rows that repeat the staying id and text
    one stays, and which one is left open if other columns differ.
    """
    return without_later(docs, near_groups(docs))


def without_later(docs: DataFrame, groups: DataFrame) -> DataFrame:
    # one row per doc_id and text: whether it goes, or stays and is repeated
    state = groups.groupBy("doc_id", "probe").agg(F.bool_and("staying").alias("stays"), F.count("*").alias("n"))
    state = stored(state.where("not stays or n > 1"), "near-copies")
    key = {"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull()}
    state = state.withColumns(key).withColumnRenamed("probe", "__probe").drop("doc_id", "n")
    out, repeated = (state.where(w).drop("stays") for w in ("not stays", "stays"))
    rows = docs.withColumns(key | {"__probe": F.xxhash64("text")})
    keys = ["__id", "__none", "__probe"]
    # copies grow with the documents: texts move once at every size, not only beyond a broadcast's limit
    rows = rows.join(out.hint("shuffle_merge"), keys, "left_anti")
    rows = rows.join(repeated.withColumn("__more", F.lit(True)).hint("shuffle_merge"), keys, "left")
    # the rows of a key are together; rows that are not repeated each get a number of their own
    rows = rows.withColumn("__row", F.when(F.col("__more"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates([*keys, "__row"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def bits_apart(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Bits in which each row's fingerprint differs from all others of a tile: first row, matrix."""
    for i in range(0, len(fp), 1024):
        yield i, np.bitwise_count(fp.view(np.uint64)[i : i + 1024, None] ^ fp.view(np.uint64)[None, :]).astype(np.int32)


def map_apart(similarity: float):
    """The least number of shingles in which sets differ, by their parity maps, where these leave a similarity open.

    Sets of n and m shingles that differ in d have a similarity of (n + m - d) / (n + m + d), so
    that d is bounded; no similar pair has more. Of two maps the larger one is folded.
    """
    share = (1 - similarity) / (1 + similarity) + 1e-9

    def run(node: np.ndarray, n: np.ndarray, maps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        width = np.array([len(m) for m in maps])
        levels = {}
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            own = np.frombuffer(b"".join(maps[rows]), np.uint64).reshape(len(rows), -1)
            levels[w] = rows, own
        n = n.astype(np.float64)
        step = max(1, min(1024, (1 << 21) // max(1, len(node))))
        for i in range(0, len(node), step):
            here = np.arange(i, min(len(node), i + step))
            far = np.full((len(here), len(node)), NEVER, np.int32)
            for w in np.unique(width[here]).tolist():
                mine = here[width[here] == w]
                x = levels[w][1][np.searchsorted(levels[w][0], mine)]
                for rows, y in levels.values():
                    p, q = n[mine], n[rows]
                    if min(p.max(), q.max()) < similarity * max(p.min(), q.min()) - 1e-6:
                        continue  # sizes rule all of them out
                    words = min(x.shape[1], y.shape[1])
                    a, b = folded(x, words), folded(y, words)
                    d = np.zeros((len(a), len(b)), np.int32)
                    for k in range(a.shape[1]):
                        d += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
                    d = np.maximum(d, np.abs(p[:, None] - q[None, :])).astype(np.int32)
                    far[np.ix_(mine - i, rows)] = np.where(d <= share * (p[:, None] + q[None, :]) + 1e-6, d, NEVER)
            yield i, far

    return run


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Smaller parity maps: places are the lower bits of hashes, so the parts of a map lie on each other."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def whole_tiles(rows_of, schema: list[str]):
    """Runs rows_of(tile columns) for every tile of rows that are sorted by tile; yields batches of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            tile = columns[0]
            cut = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
            out = [rows_of(*(c[cut[k] : cut[k + 1]] for c in columns[1:])) for k in np.flatnonzero(np.diff(cut) > 1)]
            none = [np.empty(0, bool if name == "later" else np.int64) for name in schema]
            parts = list(zip(*(x for x in out if x is not None))) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none[k], *parts[k]])) for k in range(len(schema))], schema)

        kept = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = new if kept is None else [np.concatenate(z) for z in zip(kept, new)]
            last = np.searchsorted(kept[0] == kept[0][-1], True) if len(kept[0]) else 0  # the last tile may go on
            if last >= BATCH // 8:
                yield done([c[:last] for c in kept])
                kept = [c[last:] for c in kept]
        if kept is not None and len(kept[0]):
            yield done(kept)

    return run


def neighbours(apart):
    """Rows (tile, node, ...), sorted by tile, to the nodes that `apart` leaves a pair open for."""

    def of_tile(node: np.ndarray, *more: np.ndarray):
        some = np.zeros(len(node), bool)
        for i, far in apart(node, *more):
            far[np.arange(len(far)), np.arange(i, i + len(far))] = NEVER
            some[i : i + len(far)] = (far < NEVER).any(1)
        return (node[some],)

    return whole_tiles(of_tile, ["node"])


def hubs(apart):
    """Rows (tile, node, root, ...), sorted by tile, to pairs (src, dst, later) of each tile's hub with nodes of other roots.

    The hub is the row that most pairs are open with: where a group of similar texts shares a tile,
    one pair for each of them joins it.
    """

    def of_tile(node: np.ndarray, root: np.ndarray, *more: np.ndarray):
        if root.min() == root.max():
            return None
        best, hub, row = 0, 0, None
        for i, far in apart(node, *more):
            far[np.arange(len(far)), np.arange(i, i + len(far))] = NEVER
            count = (far < NEVER).sum(1)
            if count.max() > best:
                k = int(count.argmax())
                best, hub, row = int(count[k]), i + k, far[k].copy()
        if row is None:
            return None
        to = np.flatnonzero((row < NEVER) & (root != root[hub]))
        own = np.full(len(to), node[hub])
        return np.minimum(node[to], own), np.maximum(node[to], own), np.zeros(len(to), bool)

    return whole_tiles(of_tile, ["src", "dst", "later"])


def nearest(radius: int, first: int, last: int, apart=bits_apart):
    """Rows (tile, node, root, ...), sorted by tile, to pairs (src, dst, later) of different roots to verify.

    A row's neighbours in a tile are ranked by distance, whatever their roots, so that rounds of
    rising ranks meet every pair up to `radius`. Ranks `first` to `last` are given out; a row with
    `later` only says that the tile has pairs of higher ranks.
    """

    def of_tile(node: np.ndarray, root: np.ndarray, *more: np.ndarray):
        if root.min() == root.max():
            return None
        src, dst, later = [], [], []
        for i, far in apart(node, *more):
            far[np.arange(len(far)), np.arange(i, i + len(far))] = NEVER
            order = np.argsort(far, axis=1, kind="stable")
            near = np.take_along_axis(far, order, 1) <= radius
            near &= root[order] != root[i : i + len(far), None]
            a, k = np.nonzero(near[:, first:last])
            a, b, rest = node[a + i], node[order[a, k + first]], int(near[:, last:].any())
            src += [np.minimum(a, b), np.zeros(rest, np.int64)]
            dst += [np.maximum(a, b), np.zeros(rest, np.int64)]
            later += [np.zeros(len(a), bool), np.ones(rest, bool)]
        return np.concatenate(src), np.concatenate(dst), np.concatenate(later)

    return whole_tiles(of_tile, ["src", "dst", "later"])


def similar_roots(docs: DataFrame, rows: DataFrame, known: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(node, root): what nodes reach by similar texts, and by `known` (node, root).

    Nodes with a least shingle in common share a tile. Pairs there are left out only where sizes
    and parity maps rule the similarity out. All others are verified on the whole sets: first each
    tile's hub with the others, then neighbours by rising ranks. What verified pairs already join is
    not verified again, and of the pairs between two roots the nearest one goes first.
    """
    own = [F.first(c).alias(c) for c in ("n", "map", "least")]  # alike for all texts of a node
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "probe")).alias("at"), *own)
    first = stored(first.select("node", "at.*", "n", "map", "least"), "similar-first")
    at = first.select("node", "n", F.posexplode("least").alias("block", "value"))
    # sizes of similar sets differ by a factor of at most 1 / similarity
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / (1e-6 - math.log(similarity)))
    tiles = stored(tiled(at, "node", band, tile).distinct(), "similar-tiles")
    shared = tiles.groupBy("tile").count().where("count > 1").select("tile")
    apart, sketch = map_apart(similarity), first.select("node", "n", "map")
    tiles = stored(tiles.join(shared, "tile", "left_semi").join(sketch, "node").select("block", "tile", "node", "n", "map"), "similar-tiles")
    dealt = tiles.select("tile", "node", "n", "map").repartition("tile").sortWithinPartitions("tile", "node")
    nodes = stored(dealt.mapInArrow(neighbours(apart), "node long").distinct(), "similar-nodes")
    tiles = stored(tiles.join(nodes, "node", "left_semi").select("block", "tile", "node", "n", "map"), "similar-tiles")
    first = first.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("first_id"), F.col("probe").alias("first_probe"))
    docs = docs.select("doc_id", "text")
    same = docs["doc_id"].eqNullSafe(first["first_id"]) & (F.xxhash64(docs["text"]) == first["first_probe"])
    # texts move once at every size, as in one_of_each
    sets = docs.join(first.hint("shuffle_merge"), same).select("node", "text").dropDuplicates(["node"])
    sets = stored(sets.select("node", shingle_sets("text").alias("shingles")), "similar-sets")

    def rooted(found: DataFrame, *names: str) -> DataFrame:
        for name in names:
            found = found.join(roots.toDF(name, f"{name}_root"), name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))
        return found

    def good(pairs: DataFrame) -> DataFrame:
        """Links between the roots of similar pairs (src, dst, src_root, dst_root)."""
        both = pairs.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")
        return both.where(similarities("a", "b") >= similarity - 1e-9).select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"))

    def verified(step: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The roots after one pair of a step for each two roots, and the other pairs (src, dst)."""
        pairs = stored(rooted(step.where("not later").select("src", "dst").distinct(), "src", "dst"), "similar-pairs")
        ends = F.least("src_root", "dst_root"), F.greatest("src_root", "dst_root")
        one = pairs.groupBy(ends[0].alias("low"), ends[1].alias("high")).agg(F.min(F.struct("src", "dst", "src_root", "dst_root")).alias("p"))
        now = rejoined(roots, reached(good(one.select("p.*"))))
        rest = stored(pairs.join(one.select("p.src", "p.dst"), ["src", "dst"], "left_anti").select("src", "dst"), "similar-pairs")
        return now, rest

    def dealt_rows(rows: DataFrame) -> DataFrame:
        rows = rooted(rows, "node").select("tile", "node", F.col("node_root").alias("root"), "n", "map")
        return rows.repartition("tile").sortWithinPartitions("tile", "node")

    def advance(rows: DataFrame, search) -> bool:
        nonlocal roots
        step = stored(dealt_rows(rows).mapInArrow(search, "src long, dst long, later boolean").distinct(), "similar-steps")
        roots, rest = verified(step)
        rest = rooted(rest, "src", "dst").where("src_root <> dst_root")
        roots = rejoined(roots, reached(good(rest)))
        return step.where("later").limit(1).count() > 0

    roots = known
    advance(tiles.where("block = 0"), hubs(apart))
    advance(tiles.where("block > 0"), hubs(apart))
    low, high = 0, NEAREST
    while advance(tiles, nearest(NEVER - 1, low, high, apart)):
        low, high = high, high * 64
    return roots


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """doc_id, probe, component_id per row of documents, for groups of similar texts.

    Two texts are linked if their fingerprints differ in at most RADIUS bits, or if their sets of
    five-word shingles have a similarity of `similarity` or more; a group is what links reach.
    Every different set of shingles is a node and is compared with others itself.
    Null and empty texts are equal; rows without doc_id take part; a group of such rows only has
    a null id. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("probe"), sketches(F.col("text")).alias("sketch"))
    rows = stored(rows.select("doc_id", "probe", "sketch.*"), "sketches")
    nodes = stored(rows.groupBy("node").agg(first_row()), "distinct-sets")
    return components_of(rows, nodes, similar_roots(docs, rows, close_roots(rows), similarity, tile), "node")


def close_roots(rows: DataFrame) -> DataFrame:
    """(node, root): what nodes reach by fingerprints of at most RADIUS bits apart, equal ones included."""
    pairs = stored(rows.select("node", "fp").distinct(), "fingerprints")
    steps = joined(pairs.select("fp").distinct()).withColumnRenamed("node", "fp")
    pairs = pairs.join(steps, "fp", "left").select("node", F.coalesce("root", "fp").alias("group"))
    # a node is a set of five-word shingles and has one fingerprint but for repeats, so a few groups at most
    named = stored(pairs.groupBy("group").agg(F.min("node").alias("name")), "named-groups")
    return reached(pairs.join(named, "group").select(F.col("node").alias("src"), F.col("name").alias("dst")))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """The documents without those that are in a group of similar texts with a smaller doc_id; else as one_of_each."""
    return without_later(docs, similar_groups(docs))


ship(__name__)
