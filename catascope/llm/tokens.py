"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catascope.llm.common import bounded_batches, n_bytes, ship

#: A batch holds parts of about so many bytes; longer texts are split into parts of so many characters.
BATCH_BYTES = 1 << 18
PART_CHARS = 1 << 14
LIMIT = 4096

#: A word starts here. No piece of the vocabulary has a space mark after another character, so no
#: merge crosses this place, and the mark that the library puts before a part stands for the space.
WORD_START = re.compile("(?<=[^ ▁]) (?=.)", re.DOTALL)


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Parts whose token counts add up to that of the text. A stretch without a safe place stays whole."""
    out, start = [], 0
    while len(text) - start > size and (m := WORD_START.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.end()
    out.append(text[start:])
    return out


def batches(texts: list[str | None], size: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Parts with the numbers of their texts, dealt into batches of about equal numbers of bytes."""
    rows, held, done = [], [], 0
    for i, text in enumerate(texts):
        for part in parts(text or ""):
            rows.append(i)
            held.append(part)
            done += len(part) if part.isascii() else len(part.encode())
            if done >= size:
                yield rows, held
                rows, held, done = [], [], 0
    if held:
        yield rows, held


def counter(model: str):
    """A column function: the number of tokens of each text by the vocabulary file `model`."""

    @F.arrow_udf("long")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for column in columns:
            total = np.zeros(len(column), dtype=np.int64)
            for rows, held in batches(column.to_pylist()):
                lengths = [len(ids) for ids in library.encode(held, num_threads=1)]
                np.add.at(total, rows, lengths)
            yield pa.array(total)

    return count


def token_counts(docs: DataFrame, model: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row.

    Counts are those of the whole text, without begin and end tokens. Null and empty texts have
    0 bytes and 0 tokens. Every row gives one row, repeated ones too; an empty table gives none;
    other columns are not read. `model` is a sentencepiece file that every executor can open.
    """
    bounded_batches(docs.sparkSession)
    counted: Column = counter(model)(F.col(text))
    rows = docs.select("doc_id", n_bytes(F.col(text)).alias("n_bytes"), counted.alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


ship(__name__)
