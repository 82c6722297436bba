"""The operators' queries by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catascope.llm import decontamination, exact, language, mixing, packing, phrases, sharding, simhash, spelling, suffixes, tokens, toxicity, warc
from catascope.llm.common import table

#: Where the vocabulary of the token counts lies; None: the installed public file.
VOCABULARY: str | None = None


def vocabulary() -> str:
    if VOCABULARY:
        return VOCABULARY
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.identified(language.of_documents(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "language", F.round("probability", 6).alias("probability"), F.col("accepted").alias("kept"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.identified(language.of_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")))
    return rows.select("page_id", "language", F.round("probability", 6).alias("probability"), "accepted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.dealt(mixing.mixed(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "shard", "place")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignment(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_warc,
        op3_language_id,
        page_languages,
        op4_suffix_dedup,
        op5_decontamination,
        op6_toxicity,
        op7_simhash,
        op8_mixture,
        op9_shards,
        op10_exact_dedup,
        op11_packing,
        op12_spelling_variants,
        op13_collocations,
    )
}

SQL: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op4_suffix_dedup": suffixes.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op10_exact_dedup": exact.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_collocations": phrases.ORACLE,
}
