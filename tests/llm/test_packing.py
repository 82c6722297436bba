from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catascope.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(public_tokenizers.path(packing.VOCABULARY)))


def test_words_give_the_ids_of_the_whole_text(library, documents):
    encoder = packing.Encoder(None)
    texts = [r["text"] for r in documents.collect()] + [
        None,
        "",
        " \t\n ",
        "a<|endoftext|>b <|startoftext|> x<|endoftext|>",
        "Σ ΑΣ ΟΔΟΣ. ÉTÉ été ́x naïve word\u0085next　wide  y \x1ca\x1db",
        "it's we'll I'd don't 's 't3a1,,..!! 12345 ½ ٣",
        "日本語 テキスト 🙂🙂 \U0001f468‍\U0001f469‍\U0001f467 नमस्ते",
        "x" * 30_000 + " " + "ab1" * 5_000,
    ]
    wanted = [library.encode(text or "", add_special_tokens=False).ids for text in texts]
    for _ in range(2):  # the second time the words are known
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.many(texts)] == wanted


def test_forgotten_words_and_every_letter_of_latin_1(library, monkeypatch):
    letters = [chr(i) for i in range(256)]
    texts = ["".join(letters), " ".join(letters), "a".join(letters), *[f"x{c}y {c}{c} '{c}s{c}" for c in letters], "It'S DON'T O'RE " + "'" * 3 + "ll"]
    wanted = [library.encode(text, add_special_tokens=False).ids for text in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr(packing, "AT_ONCE", 20)
    assert [np.frombuffer(x, "<u2").tolist() for x in packing.Encoder(None).many(texts)] == wanted


def test_words_go_to_the_model_and_are_looked_up_once(library, monkeypatch):
    encoder, asked, lookups = packing.Encoder(None), [], Counter()
    monkeypatch.setattr(packing.Known, "__missing__", lambda known, key, own=packing.Known.__missing__: (lookups.update([key]), own(known, key))[1])
    encoder.learn = lambda known, new, code, own=encoder.learn: (asked.extend(new), own(known, new, code))
    texts = ["Été, the été. ÿþß ª º µ", "the été , ¼ it's", "the " * 50]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not [w for w in asked if packing.WORD.fullmatch(w)]  # only other units take the whole library
    assert set(lookups.values()) == {1} and b"the" in lookups and b"\xe9t\xe9" in lookups


def test_known_texts_are_not_cut_by_the_pattern_again(library, monkeypatch):
    encoder, cut, own = packing.Encoder(None), [], packing.UNIT
    monkeypatch.setattr(packing, "UNIT", SimpleNamespace(findall=lambda data: (cut.append(data), own.findall(data))[1]))
    texts = ["One, two. it's 3d, (four).  five?! six ,. seven.\n", "a.. b, c.,", "x" * 100 + ", y"]
    for text in texts:
        wanted = library.encode(text, add_special_tokens=False).ids
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.many([text])] == [wanted]
    cut.clear()
    list(encoder.many([*texts, "two, one. two."]))
    assert not [data for data in cut if len(data) <= packing.LONG]
    assert len(b"".join(cut)) < 250  # long ones are cut anew, and nothing else


def pieces_of(df, library, **options):
    """Checks that the pieces are the documents and the sequences are full; returns (sequence -> source -> tokens, sizes)."""
    window = options.get("window", packing.WINDOW)
    rows = packing.packed(df, **options).collect()
    want = Counter((r["doc_id"], r["source"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids + [packing.END])) for r in df.collect())
    parts, sequences, mix = defaultdict(list), defaultdict(list), defaultdict(Counter)
    for r in rows:
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        assert len(ids) == r["length"] > 0
        parts[r["doc_id"], r["source"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        mix[r["sequence_id"]][r["source"]] += r["length"]
    docs = defaultdict(list)
    for (doc, source, ids), n in want.items():
        docs[doc, source, len(ids)] += [ids] * n
    assert docs.keys() == parts.keys()
    for key, texts in docs.items():  # rows alike but for the text are told apart by their ids
        assert Counter(i for t in texts for i in t) == Counter(i for _, ids in parts[key] for i in ids)
        if len(texts) == 1:
            at = 0
            for start, ids in sorted(parts[key]):
                assert start == at and texts[0][start : start + len(ids)] == ids
                at += len(ids)
    sizes = []
    for s in range(len(sequences)):
        at = 0
        for offset, length in sorted(sequences[s]):
            assert offset == at
            at += length
        sizes.append(at)
    total = sum(len(k[2]) * n for k, n in want.items())
    assert sizes[: total // window] == [window] * (total // window)
    tail = sizes[total // window :]
    assert sum(tail) == total % window and all(n & (n - 1) == 0 for n in tail) and len(set(tail)) == len(tail)
    return mix, sizes, rows


def shares(df, library):
    out = Counter()
    for r in df.collect():
        out[r["source"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    return out


@pytest.mark.parametrize("slice_tokens", [packing.SLICE, 10_000, 3_000])
def test_every_window_has_the_proportions(documents, library, slice_tokens):
    mix, sizes, _ = pieces_of(documents, library, slice_tokens=slice_tokens)
    own = shares(documents, library)
    total = sum(own.values())
    for s, n in enumerate(sizes):
        if n == packing.WINDOW:
            assert all(abs(mix[s][k] - n * own[k] / total) < 2.5 for k in own)


def test_set_shares_hold_as_long_as_the_source_lasts(documents, library):
    own = shares(documents, library)
    weights = {"src0": 0.4, "src1": 0.2}
    mix, sizes, _ = pieces_of(documents, library, weights=weights, window=1024, slice_tokens=5_000)
    used = Counter()
    for s, n in enumerate(sizes):
        for source, w in weights.items():
            if n == 1024 and used["src0"] + 1024 < own["src0"] and used["src1"] + 1024 < own["src1"]:
                assert abs(mix[s][source] - w * n) < 2.5
        used.update(mix[s])
    assert used == own
    with pytest.raises(ValueError):
        packing.packed(documents, weights={"src0": 1.0})
    pieces_of(documents.where("source in ('src0', 'src1')"), library, weights=weights, window=1024)


def test_odd_rows(odd, none, library, spark):
    pieces_of(odd, library, window=64, slice_tokens=1_000)
    assert packing.packed(none).count() == 0 and packing.piece_digests(none).columns[0] == "doc_id"
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    rows = packing.packed(one).collect()
    assert [(r["length"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in rows] == [(1, 1, 0, 0)]


def test_many_sources_and_one_with_most(spark, library):
    rows = [(i, f"text number {i} " * (1 + i % 7), f"s{i}" if i % 3 else "hot") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    own = shares(df, library)
    mix, sizes, _ = pieces_of(df, library, window=512, slice_tokens=2_000)
    for s, n in enumerate(sizes):
        if n == 512:
            assert abs(mix[s]["hot"] - n * own["hot"] / sum(own.values())) < 70  # half a token of each of 400 sources, by its share


def test_sequences_are_their_pieces(documents):
    pieces = packing.packed(documents)
    for r in packing.sequences(pieces).collect():
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= packing.WINDOW and r["doc_ids"]


def test_digests(documents):
    import zlib

    want = Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in packing.packed(documents).collect())
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.piece_digests(documents).collect()) == want
