import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from catascope.llm import suffixes
from catascope.llm.suffixes import LENGTH


def plain(texts):
    """Every string of LENGTH bytes in a dictionary."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = [(i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]))]
    got = [tuple(r) for r in suffixes.deduplicated(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def random_text(rng, n):
    return "".join(rng.choice(list("abcdefghij klmnop\n"), n))


def test_documents_and_odd_rows(documents, odd, none):
    check(documents)
    check(odd.withColumn("text", odd["text"].substr(1, 30_000)))
    assert suffixes.deduplicated(none).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    passage, half = random_text(rng, 700), random_text(rng, 399)
    rows = []
    for i in range(120):
        text = random_text(rng, rng.integers(0, 900))
        if i % 3 == 0:  # a passage in a third of all texts, in full or cut around the limit
            a = int(rng.integers(0, 200))
            text += passage[a : a + int(rng.integers(395, 500))] + random_text(rng, 300)
        if i % 5 == 0:
            text += half
        if i % 7 == 0:
            text += "é" * 300 + "ab" * 500 + random_text(rng, 50)
        if i % 11 == 0:
            text += text[: len(text) // 2]
        rows.append((i, text))
    rows += [(1000 + i, rows[i * 2][1]) for i in range(20)]
    near = random_text(rng, 3000)
    for i in range(30):
        at = int(rng.integers(0, 2900))
        rows.append((2000 + i, near[:at] + str(i) + near[at + 2 :]))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_planted_repeats(planted):
    check(planted)


def test_run_with_many_surroundings_is_sorted_in_parts(planted, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 5)
    check(planted)


def test_starts_of_a_run_are_single_after_few_rounds():
    frame = bytes(97 + i * i % 23 for i in range(suffixes.FRAME))
    rows = [(b"r", b"s", 2, 0, suffixes.REACH, frame, 0, suffixes.REACH)]
    for _ in range(3):
        names = ("run", "surrounding", "copies", "low", "high", "frame", "first", "last")
        batch = pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))))
        found = [r for b in suffixes.parted(iter([batch])) for r in b.to_pylist()]
        assert len({r["run"] for r in found}) == len(found) <= suffixes.REACH + 1
        for r in found:  # of the strings nothing is lost, and nothing else stays
            a, b = r["low"], r["high"]
            assert r["frame"] == b"\0" * a + frame[a : b + LENGTH] + b"\0" * (suffixes.FRAME - b - LENGTH)
        rows = [tuple(r[n] for n in names) for r in found]
    assert sorted((r["first"], r["last"]) for r in found) == [(i, i) for i in range(suffixes.REACH + 1)]


def test_long_texts_are_hashed_in_chunks(spark, planted, monkeypatch):
    rng = np.random.default_rng(9)
    text = random_text(rng, 9000)
    got = suffixes.runs_of(text.encode())
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    cut = suffixes.runs_of(text.encode())
    assert set(zip(got[0], got[1])) == set(zip(cut[0], cut[1]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(cut[2], cut[3])])
    assert np.array_equal(covered, np.arange(len(text) - LENGTH + 1))


def test_sorted_suffixes_and_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    frames = rng.integers(97, 99, (40, suffixes.FRAME)).astype(np.uint8)
    frames[:, :380] = frames[0, :380]
    frames[5:9] = frames[4]
    low, high = np.full(40, 3), np.full(40, 9)
    own = suffixes.Suffixes(frames, np.repeat([0, 1], 20), low, high)
    strings = lambda o, order: [frames[o.row[i], o.at[i] : o.at[i] + LENGTH].tobytes() for i in order]
    order, number = own.classes()
    for a, n in zip(own.start, own.size):
        part = strings(own, order[a : a + n])
        assert part == sorted(part)
    by = own.by_bytes()
    sizes = lambda o, n: Counter((int(own.at[i]), int(own.row[i] // 20), strings(own, [i])[0], int(c)) for i, c in zip(o, np.bincount(n)[n]))
    assert sizes(order, number) == sizes(*by)
    # a hash that says equal for all strings: the bytes decide
    monkeypatch.setattr(suffixes, "byte_values", lambda: np.zeros(256, np.uint64))
    blind = suffixes.Suffixes(frames, np.repeat([0, 1], 20), low, high)
    assert sizes(*blind.classes()) == sizes(*by)
