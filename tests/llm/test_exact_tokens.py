import hashlib
from collections import defaultdict

import duckdb
import sentencepiece

from catascope.llm import exact, queries, tokens


def test_exact_groups_equal_sql(spark, documents, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = sorted(map(tuple, exact.exact_groups(documents).collect()))
    assert got == sorted(con.execute(exact.ORACLE).fetchall())


def test_exact_groups_of_odd_rows(odd, none):
    got = [tuple(r) for r in exact.exact_groups(odd).collect()]
    groups = defaultdict(list)
    for r in odd.collect():
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")].append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact.exact_groups(none).count() == 0


def test_levels_and_runs_do_not_change_groups(spark, odd):
    rows = exact.digests(odd.repartition(7))
    few, many = (exact.merged_runs(rows, runs, fan).drop("probe") for runs, fan in ((1, 2), (50, 3)))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_only_ascii_letters_change(spark):
    rows = [(i, t) for i, t in enumerate(["É", "é", "İ", "i", "I", "AÉ", "aÉ", "ß", "ẞ"])]
    got = {r["doc_id"]: r["group_size"] for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1, 8: 1}


def test_token_counts_are_those_of_whole_texts(spark, documents, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    for df in (documents, odd):
        got = sorted((tuple(r) for r in tokens.token_counts(df, queries.vocabulary()).collect()), key=str)
        want = []
        for r in df.collect():
            n = len(library.encode(r["text"] or ""))
            want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 4096))
        assert got == sorted(want, key=str)
    assert tokens.token_counts(none, queries.vocabulary()).count() == 0


def test_parts_add_up():
    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    texts = [
        "a  b   c " * 50 + " ", "▁ ▁x ▁▁ y" * 40, "<s> </s> <unk> " * 30, "\n \n  \t x" * 60, " " * 300, "日本 語　テキスト " * 40,
        "no_space" * 100, "é" * 99 + " " + "😀 " * 50, " lead", "trail ", "x   y\r\n" * 40,
    ]
    for text in texts:
        for size in (1, 5, 17, 64):
            cut = tokens.parts(text, size)
            assert sum(len(library.encode(p)) for p in cut) == len(library.encode(text)), (text[:20], size)
    assert [len(p) for _, p in tokens.batches(["a b"] * 10 + [None], 6)] == [2, 2, 2, 2, 2, 1]


def test_vocabulary_has_no_mark_after_another_character():
    library = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary())
    assert not any("▁" in library.id_to_piece(i).lstrip("▁") for i in range(library.get_piece_size()))
