import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from catascope.llm import phrases


def plain(rows, least, longest=5, first=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + m])] += 1
    out = set()
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        found = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        longer = Counter()
        for p, c in found.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], c)
        kept = []
        for p, a in found.items():
            if 100 * longer[p] >= 100 * a:
                continue
            score, _, l, r = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:first], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n, -score))
    return out


def check(df, least, **options):
    want = plain([(r["lang"], r["text"]) for r in df.collect()], least, first=options.get("first", 2000))
    got = [tuple(r) for r in phrases.collocations(df, least=least, **options).collect()]
    assert len(got) == len(want) and set(got) == want
    return want


def test_documents(documents):
    assert len(check(documents.repartition(6), 20, shards=3)) > 50


def test_ranking_in_several_rounds(documents, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 2)
    check(documents, 10, first=5, shards=1)


def test_odd_and_empty(odd, none):
    check(odd, 1)
    assert phrases.collocations(none).count() == 0


def test_pieces_overlaps_and_letters(spark):
    rng = random.Random(2)
    words = ["aa", "AA", "ÄÄ", "ää", "x\x1fy", " ", "b", "it's", "-"]
    marks = [" ", "\t", "  ", ".", ", ", "\n", "\r\n", "\x0b", "\x0c", "!?", "\x85", " \t. "]
    rows = [(i, rng.choice(["en", None, "und", ""]), "".join(rng.choice(words) + rng.choice(marks[: 1 + i % 12]) for _ in range(60))) for i in range(120)]
    rows += [(200 + i, "en", "ho " * 50) for i in range(3)] + [(300, "en", None), (301, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(7)
    check(df, 3)


def test_full_map_and_small_blocks_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 500)
    got = {tuple(r) for r in phrases.phrase_counts(documents, 15, places=8)[0].collect()}
    monkeypatch.setattr(phrases, "BLOCK", 1 << 20)
    assert got == {tuple(r) for r in phrases.phrase_counts(documents, 15, shards=1)[0].collect()}


def test_phrases_with_one_hash_stay_apart():
    ids = np.array([0, 1, -1, 1, 0, -1, 0, 1], np.int32)
    places = np.array([0, 3, 6])
    first, count = phrases.same_phrases(ids, places, np.zeros(3, np.uint64), 2)
    assert sorted(zip([ids[p : p + 2].tolist() for p in first], count.tolist())) == [([0, 1], 2), ([1, 0], 1)]


def test_products_beyond_64_bits(spark):
    rows = [("en", "a", 1, 9 * 10**12), ("en", "b", 1, 7 * 10**12), ("en", "a b", 2, 6 * 10**12)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 3 * 10**16)], "lang string, total long")
    got = phrases.scored(counts, totals).first()
    assert got["score"] == 1000 * 6 * 10**12 * 3 * 10**16 // (63 * 10**24)


def test_scans_move_hashes_and_the_exact_scan_only_what_can_be_frequent(monkeypatch):
    texts = ["a b c d e f g " * 30, "x y " + " ".join(f"w{i}" for i in range(400))]
    blocks = list(phrases.blocks(100)(iter([pa.RecordBatch.from_pydict({"lang": ["en"] * 2, "text": texts})])))
    since = SimpleNamespace(value=np.ones(1 << 10, np.uint8))
    monkeypatch.setattr(phrases, "HELD", 50)
    out = list(phrases.scanned(2, 1, 5, 3, since)(iter(blocks)))
    assert out and not any(pa.types.is_string(f.type) for b in out for f in b.schema)
    assert sum(len(x) // 8 for b in out for x in b.column("counts").to_pylist()) >= 400
    # bits of "a", "b" and "a b", and of "b c" whose second word has none
    bits = np.zeros(1 << 26, bool)
    word = phrases.word_hashes([b"a", b"b", b"c"])[:3]
    one, two = phrases.phrase_hashes("en", word, 2)[1:]
    bits[(np.concatenate((one[:2], two)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    chosen = SimpleNamespace(value=np.packbits(bits, bitorder="little"))
    rows = [r for b in phrases.exactly(5, chosen)(iter(blocks)) for r in b.to_pylist()]
    assert sorted((r["phrase"], r["n"]) for r in rows) == [("a", 30), ("a b", 30), ("b", 30)]  # one row each over all blocks


def test_exact_counts_leave_a_task_as_one_row_per_bucket(monkeypatch):
    texts = [" ".join(f"w{i * k % 97}" for i in range(300)) for k in (1, 2, 5, 1)]
    blocks = list(phrases.blocks(100)(iter([pa.RecordBatch.from_pydict({"lang": ["en", "de", "en", "en"], "text": texts})])))
    exact = phrases.exactly(3, SimpleNamespace(value=np.full(1 << 10, 255, np.uint8)))
    rows = [r for b in exact(iter(blocks)) for r in b.to_pylist()]
    want = {(r["lang"], r["phrase"], r["words"], r["n"]) for r in rows}
    for held, parts in ((1 << 20, 1), (1, 2)):
        monkeypatch.setattr(phrases, "HELD", held)
        out = pa.Table.from_batches(list(phrases.in_buckets(4, exact)(iter(blocks)))).combine_chunks()
        assert len(out) <= 8 if parts == 1 else len(out) > 8
        got = []
        for lang in ("de", "en"):
            for k in range(4):
                own = out.filter((pc.field("lang") == lang) & (pc.field("bucket") == k))
                if len(own):
                    got += phrases.put_together(2)(own).to_pylist()
        assert len(got) == len({(r["lang"], r["phrase"]) for r in got}) > 100
        assert {(r["lang"], r["phrase"], r["words"], r["n"]) for r in got} == {w for w in want if w[3] >= 2}
