import numpy as np
import pytest
import xxhash

from catascope.llm import simhash


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in keys}


def plain_shingles(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similar(rows):
    """Smallest ids reachable by links of at most 3 bits or of similarity 0.8 on five words, by all pairs."""
    texts = sorted({t or "" for _, t in rows})
    fps, sets = [plain_fingerprint(t) for t in texts], [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (fps[i] ^ fps[j]).bit_count() <= 3 or (5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    first = {}
    for i, t in rows:
        if i is not None:
            first[of[t or ""]] = min(i, first.get(of[t or ""], i))
    return sorted([(i, first.get(of[t or ""])) for i, t in rows], key=str)


def plain(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    first = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    return sorted([(i, f"{f:016x}", first.get(root[f])) for (i, _), f in zip(rows, fps)], key=str)


def test_query_equals_brute_force(documents, odd, none):
    for df in (documents, odd):
        got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
        assert got == plain([(r["doc_id"], r["text"]) for r in df.collect()])
    assert simhash.near_duplicates(none).count() == 0


@pytest.fixture(scope="module")
def crowd():
    """Fingerprints around few centres, so that many share blocks and population counts."""
    rng = np.random.default_rng(3)
    out = set(rng.integers(0, 1 << 63, 300).tolist())
    for c in rng.integers(0, 1 << 63, 3).tolist() + [0, (1 << 64) - 1]:
        for _ in range(400):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            out.add(x)
    return [x - (1 << 64) if x >> 63 else x for x in out]


@pytest.mark.parametrize("tile", [40, 2048])
def test_components_of_a_crowd(spark, crowd, tile):
    """With small tiles every hot block value is salted into many."""
    fps = spark.createDataFrame([(x,) for x in crowd], "fp long")
    got = {r["node"]: r["root"] for r in simhash.joined(fps, tile=tile).collect()}
    want = plain_components([x % (1 << 64) for x in crowd])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    same = lambda of: {frozenset(g) for g in groups(of).values()}

    def groups(of):
        out = {}
        for k, v in of.items():
            out.setdefault(v, []).append(k)
        return out

    assert same({x: got.get(x, x) for x in crowd}) == same({signed(k): signed(v) for k, v in want.items()})


def test_long_chain_of_links(spark):
    x, chain = 0, [0]
    for b in range(63):
        x |= 1 << b
        chain.append(x)
    got = simhash.joined(spark.createDataFrame([(c,) for c in chain], "fp long"))
    assert {r["root"] for r in got.collect()} == {0} and got.count() == 64


def test_one_of_each_keeps_columns_and_smallest(odd, none):
    out = simhash.one_of_each(odd)
    assert out.columns == odd.columns
    got = sorted((r["doc_id"] for r in out.collect()), key=str)
    want = [i for i, _, c in plain([(r["doc_id"], r["text"]) for r in odd.collect()]) if i == c]
    assert got == sorted(want, key=str)
    assert simhash.one_of_each(none).count() == 0


def edited(rng, words, share):
    out = list(words)
    for k in np.flatnonzero(rng.random(len(out)) < share):
        out[k] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies(spark):
    """Texts edited at every rate, a large group among them, and a passage that many texts share."""
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    passage, texts = draw(60), []
    for share in (0.002, 0.01, 0.02, 0.03, 0.05, 0.1):
        for _ in range(8):
            base = draw(int(rng.integers(20, 400)))
            texts += [" ".join(base)] + [edited(rng, base, share) for _ in range(3)]
    base = draw(300)
    texts += [edited(rng, base, 0.015) for _ in range(120)]
    texts += [" ".join(draw(int(rng.integers(5, 60))) + passage) for _ in range(60)]
    return [(i, t) for i, t in enumerate(rng.permutation(texts).tolist())]


@pytest.mark.parametrize("tile", [40, 2048])
def test_similar_groups_equal_all_pairs(spark, copies, tile):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.similar_groups(df, tile=tile).collect()]
    assert sorted(got, key=str) == plain_similar(copies)


def test_similar_groups_of_tables(documents, odd, none):
    for df in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = [(r["doc_id"], r["component_id"]) for r in simhash.similar_groups(df).collect()]
        assert sorted(got, key=str) == plain_similar(rows)
        assert simhash.one_of_similar(df).columns == df.columns
    assert simhash.one_of_similar(none).count() == 0


def test_every_pair_is_met_in_some_round():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    fp = np.unique(rng.integers(0, 1 << 6, 50)).astype(np.int64)
    columns = [pa.array(np.zeros(len(fp), np.int64)), pa.array(fp), pa.array(fp)]
    batch = pa.RecordBatch.from_arrays(columns, ["tile", "fp", "root"])
    seen, low, high = set(), 0, 1
    while True:
        rows = [r for out in simhash.nearest(2, low, high)(iter([batch])) for r in out.to_pylist()]
        seen |= {(r["src"], r["dst"]) for r in rows if not r["later"]}
        if not any(r["later"] for r in rows):
            break
        low, high = high, high * 8
    assert seen == {(a, b) for a in fp.tolist() for b in fp.tolist() if a < b and (a ^ b).bit_count() <= 2}


@pytest.fixture(scope="module")
def repeated(spark):
    """A line once in one copy and 30 to 60 times in the other: sets are alike, fingerprints are not."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(40):
        body = [f"u{k}x{i}" for i in range(int(rng.integers(100, 400)))]
        line = [f"l{k}x{i}" for i in range(12)]
        rows += [(2 * k, " ".join(body + line)), (2 * k + 1, " ".join(body + line * int(rng.integers(30, 61))))]
    return rows


def test_similar_groups_with_a_repeated_line(spark, repeated):
    far = [(plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() for (_, a), (_, b) in zip(repeated[::2], repeated[1::2])]
    assert sum(d > 18 for d in far) > 10
    df = spark.createDataFrame(repeated, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.similar_groups(df).collect()]
    assert sorted(got, key=str) == plain_similar(repeated)
    assert simhash.one_of_similar(df).count() == len(repeated) // 2


def test_parity_maps_rule_out_no_similar_pair():
    rng = np.random.default_rng(13)
    apart = simhash.map_apart(0.8)
    for n in (1, 5, 9, 30, 33, 400, 3000, 9000):
        base = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        sets = [np.unique(np.concatenate((base[: n - cut], base[n : n + more]))) for cut in {0, n // 20, n // 9, n // 5} for more in {0, n // 9, n // 8, n // 4}]
        maps = np.array([simhash.parity_map(x) for x in sets], object)
        (_, far), = apart(np.arange(len(sets)), np.array([len(x) for x in sets]), maps)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert far[i, j] < simhash.NEVER or simhash.jaccard(a, b) < 0.8
                assert far[i, j] == simhash.NEVER or far[i, j] <= len(np.setxor1d(a, b))


def test_texts_of_one_fingerprint_are_verified_themselves(spark):
    """The third text of each three is similar to the second, which has the first one's fingerprint, and not to the first."""
    rng, rows = np.random.default_rng(17), []
    while len(rows) < 12:
        base = [f"w{k}" for k in rng.integers(0, 1 << 30, 600)]
        second = base[:310] + ["other"] + base[311:]
        third = [f"new{i}" if i % 40 == 20 and i < 520 else w for i, w in enumerate(second)]
        texts = [" ".join(x) for x in (base, second, third)]
        fps = [simhash.fingerprint(x) % (1 << 64) for x in texts]
        if fps[0] == fps[1] and (fps[0] ^ fps[2]).bit_count() > 3:
            a, b, c = (plain_shingles(x) for x in texts)
            assert len(b & c) / len(b | c) >= 0.8 > len(a & c) / len(a | c)
            rows += [(len(rows) + k, x) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.similar_groups(df).collect()]
    assert sorted(got, key=str) == plain_similar(rows) and simhash.one_of_similar(df).count() == 4


def test_one_row_of_a_group_stays_without_ids_and_with_repeats(spark):
    words = [f"w{i}" for i in range(200)]
    copy = " ".join(words).replace("w100 ", "W100 ")
    rows = [(None, " ".join(words)), (None, copy), (None, copy), (3, "two words"), (3, "two words"), (None, "two words")]
    rows += [(7, "alone here"), (None, "one more text"), (None, "quite another text than that")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for f in (simhash.one_of_similar, simhash.one_of_each):
        got = [tuple(r) for r in f(df).collect()]
        assert len(got) == 5 and sum(i is None and "w1 w2" in t for i, t in got) == 1
        assert sorted(g for g in got if g[0]) == [(3, "two words"), (7, "alone here")]
