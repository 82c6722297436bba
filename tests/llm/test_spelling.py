import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from catascope.llm import spelling


def plain_vocabulary(rows, every=spelling.EVERY):
    found = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_near(words):
    by = defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[v].add(w)
    return {w: {x for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by[v] if one_edit(w, x)} for w in words}


def plain_variants(n):
    near, form = plain_near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def check(spark, n, **options):
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(df, **options).collect()]
    assert len(got) == len(n) and set(got) == plain_variants(n)


@pytest.mark.parametrize("points", [spelling.POINTS, 300, 40])
def test_variants_of_generated_words(spark, points):
    rng = random.Random(points)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 10)))
        words[w] = rng.choice([2, 30, 400, 5000, 60_000])
        for _ in range(6):
            i, c = rng.randrange(len(w) + 1), rng.choice("abcdÿ")
            v = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            if len(v) >= 7:
                words.setdefault(v, rng.choice([2, 3, 20, 300]))
    check(spark, words, points=points)


def test_halves_that_many_words_share(spark):
    rng = random.Random(5)
    words = {"prefixe" + "".join(rng.choice("xyz") for _ in range(rng.randint(6, 8))): rng.randint(2, 90) for _ in range(500)}
    words |= {"".join(rng.choice("xyz") for _ in range(rng.randint(6, 8))) + "suffixe": rng.randint(2, 90) for _ in range(500)}
    check(spark, words, points=500)


def test_index_finds_what_plain_search_finds():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(80)})
    index = spelling.Index(words)
    asks = words + ["", "zzz", "azb", "a" * 9]
    asks = [a for a in asks if len(a) > 1]
    both = defaultdict(set)
    for prefix in (True, False):
        for q, w in zip(*(x.tolist() for x in index.near(asks, prefix))):
            both[asks[q]].add(words[w])
    for a in asks:
        assert both[a] == {w for w in words if one_edit(a, w)}


def test_sparse_tables_count_alike(monkeypatch):
    text = np.random.default_rng(0).integers(0, 5, 1000)
    full = spelling.Ranks(text, 6)
    monkeypatch.setattr(spelling, "TABLE_BYTES", 2000)
    sparse = spelling.Ranks(text, 6)
    at = np.arange(1001)
    assert full.step == 1 < sparse.step and (full.all(at) == sparse.all(at)).all()
    symbol = np.arange(1001) % 6
    assert (full.of(symbol, at) == sparse.of(symbol, at)).all()


def test_documents(spark, documents, odd, none):
    for df in (documents, odd):
        n = plain_vocabulary([(r["doc_id"], r["text"]) for r in df.collect()])
        got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
        assert len(got) == len(n) and set(got) == plain_variants(n)
    assert spelling.spelling_variants(none).count() == 0


def test_every_text_counts_whatever_its_letters(spark):
    rows = [(i, t) for i, t in enumerate(["Ünderscored_UNDERSCORED", "x1unterschied2 ÀÈÌÒÙÝÿ×÷ß", None, "", "ŒUVRES œuvresœ Ωabcdefgh \u0085abcdefgh"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()}
    assert got == plain_vocabulary(rows)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(df, every=0).collect()} == plain_vocabulary(rows, 1 << 40)
