"""Language identification by Bayesian fusion of text, declared language, address and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catascope.llm.common import bounded_batches, ship, stored

#: Labelled texts per language that the text model is fitted on, in expectation (drawn by hash).
FIT_ROWS = 1500
#: The text model has this many hashed three-byte features per language.
FEATURES = 1 << 15
#: Neighbouring features are not independent: a text counts as so many independent ones at most.
EVIDENCE = 60.0
SMOOTHING = 0.5
#: A declaration or an address suffix names the right language with this probability.
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.7
#: Pseudo-counts with which a host follows its domain, and a domain the whole corpus.
HOST_PRIOR = 20.0
DOMAIN_PRIOR = 50.0
#: Prior share of texts in none of the languages.
UNKNOWN_SHARE = 0.01
#: Documents are rejected if their best language is less likely than this.
ACCEPT = 0.5

#: Second-level names below country suffixes that anybody can register under.
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "or", "ne", "go", "gob", "gouv", "nom", "asso")

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Languages of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en"}


def codes(text: str | None) -> np.ndarray:
    """Hashed three-byte features of the whole text: lower-cased letters, everything else one space."""
    kept = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    data = np.frombuffer(f" {kept} ".encode(), np.uint8).astype(np.uint32) if kept else ()
    if len(data) < 3:
        return np.empty(0, np.int64)
    x = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    return (x >> np.uint32(32 - 15)).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("n", T.IntegerType())])))
def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("feature", pa.int32()), ("n", pa.int32())]))
    for column in texts:
        out = []
        for text in column.to_pylist():
            f, n = np.unique(codes(text), return_counts=True)
            out.append([{"feature": int(a), "n": int(b)} for a, b in zip(f, n)])
        yield pa.array(out, kind)


def fitted(labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (features x languages) from (text, lang).

    Fitted on about `rows` texts of each language, drawn by a hash of the text. The table that
    comes to the driver has FEATURES entries per language. The last column is for texts in no
    language: features of all languages are equally likely there.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where("text is not null and lang is not null")
    counts = labelled.groupBy("lang").count().collect()  # a row per column of the model
    if not counts:
        return [], np.zeros((FEATURES, 1), dtype=np.float32)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], rows / r["count"])])
    draw = F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.select("text", "lang").where(draw < F.try_element_at(share, F.col("lang")))
    found = sample.select("lang", F.explode(features(F.col("text"))).alias("f"))
    found = found.groupBy("lang", "f.feature").agg(F.sum("f.n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((FEATURES, len(langs) + 1), SMOOTHING)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[own["feature"], i] += own["n"]
    table[:, -1] = 1.0
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def text_scorer(table: np.ndarray):
    """A column function: tempered log-likelihood of each text per language and for none."""

    @F.arrow_udf("array<double>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            out = []
            for text in column.to_pylist():
                found = codes(text)
                if not len(found):
                    out.append([0.0] * table.shape[1])
                    continue
                total = np.zeros(table.shape[1])
                for k in range(0, len(found), 1 << 16):
                    total += table[found[k : k + (1 << 16)]].sum(0, dtype=np.float64)
                out.append((total * min(1.0, EVIDENCE / len(found))).tolist())
            yield pa.array(out, pa.list_(pa.float64()))

    return score.asNondeterministic()  # else a filter on the scores computes them a second time


def normal(logs: Column) -> Column:
    """Probabilities from log-weights."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def named(code: Column, langs: list[str], right: float) -> Column:
    """Log-likelihood per language of evidence that names `code`; no or an unlisted code says nothing."""
    wrong = (1.0 - right) / max(1, len(langs))
    rows = [F.when(code == lang, F.log(F.lit(right))).otherwise(F.log(F.lit(wrong))) for lang in langs]
    known = code.isin(langs) if langs else F.lit(False)
    flat = [F.lit(0.0)] * (len(langs) + 1)
    return F.when(F.coalesce(known, F.lit(False)), F.array(*rows, F.log(F.lit(wrong)))).otherwise(F.array(*flat))


def primary(code: Column) -> Column:
    """en of en-GB."""
    return F.lower(F.regexp_extract(F.coalesce(code, F.lit("")), r"^\s*([A-Za-z]{2,3})", 1))


def added(*logs: Column) -> Column:
    out = logs[0]
    for x in logs[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def priors(scored: DataFrame, n: int) -> DataFrame:
    """(__domain, __host, __prior): shares per host, drawn to its domain's, and these to the corpus's.

    Shares are sums of the texts' own probabilities, by grouped aggregation: a host that holds a
    third of all rows is one row per task before anything moves.
    """
    sums = [F.sum(F.col("__p")[i]).alias(f"p{i}") for i in range(n)]
    hosts = scored.groupBy("__domain", "__host").agg(*sums)
    hosts = stored(hosts, "host-counts")
    domains = hosts.groupBy("__domain").agg(*[F.sum(f"p{i}").alias(f"d{i}") for i in range(n)])
    whole = domains.agg(*[F.sum(f"d{i}").alias(f"w{i}") for i in range(n)]).first()
    total = sum(w or 0.0 for w in whole) or 1.0
    share = [((w or 0.0) + 1.0 / n) / (total + 1.0) for w in whole]
    known = sum(share[:-1]) or 1.0
    share = [s / known * (1 - UNKNOWN_SHARE) for s in share[:-1]] + [UNKNOWN_SHARE]
    size = lambda c: sum((F.col(f"{c}{i}") for i in range(1, n)), F.col(f"{c}0"))
    of_domain = [(F.col(f"d{i}") + DOMAIN_PRIOR * share[i]) / (size("d") + DOMAIN_PRIOR) for i in range(n)]
    domains = stored(domains.select(F.col("__domain").alias("domain"), *[c.alias(f"q{i}") for i, c in enumerate(of_domain)]), "domain-shares")
    both = hosts.join(domains, hosts["__domain"].eqNullSafe(domains["domain"]))
    of_host = [(F.col(f"p{i}") + HOST_PRIOR * F.col(f"q{i}")) / (size("p") + HOST_PRIOR) for i in range(n)]
    return stored(both.select("__domain", "__host", F.array(*[F.log(c) for c in of_host]).alias("__prior")), "host-priors")


FOUND = ("language", "probability", "accepted")


def judged(rows: DataFrame, model: tuple[list[str], np.ndarray], text: Column, declared: Column, suffix: Column, domain: Column, host: Column) -> DataFrame:
    """The rows with __language, __probability and __accepted.

    The posterior is proportional to the host's prior times the likelihoods of the text, of the
    declared language and of the address suffix. Missing evidence counts for nothing; a text without
    letters is rejected as unknown. Rows without host share a prior.
    """
    bounded_batches(rows.sparkSession)
    langs, table = model
    names = langs + [UNKNOWN]
    scored = rows.withColumns({"__host": host, "__domain": domain, "__log": text_scorer(table)(text), "__declared": primary(declared), "__suffix": F.lower(suffix)})
    letters = F.exists("__log", lambda x: x != 0)
    counted = scored.where(letters).select("__domain", "__host", normal(F.col("__log")).alias("__p"))
    prior = priors(counted, len(names)).toDF("__d", "__h", "__prior")
    same = scored["__domain"].eqNullSafe(prior["__d"]) & scored["__host"].eqNullSafe(prior["__h"])
    country = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    logs = added(
        F.col("__log"),
        F.coalesce("__prior", F.array(*[F.lit(0.0)] * len(names))),
        named(F.col("__declared"), langs, DECLARED_RIGHT),
        named(F.coalesce(F.try_element_at(country, F.col("__suffix")), F.col("__suffix")), langs, SUFFIX_RIGHT),
    )
    out = scored.join(prior, same, "left").withColumn("__post", normal(logs))
    top = F.array_max("__post")
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("__post", top).cast("int"))
    unknown = ~letters | (best == UNKNOWN)
    return out.select(
        *[rows[c] for c in rows.columns],
        F.when(unknown, F.lit(UNKNOWN)).otherwise(best).alias("__language"),
        F.when(letters, top).otherwise(F.lit(0.0)).alias("__probability"),
        (~unknown & (top >= ACCEPT)).alias("__accepted"),
    )


def identified(rows: DataFrame) -> DataFrame:
    """language, probability and accepted instead of the private names; columns named so are replaced."""
    return rows.drop(*FOUND).withColumnsRenamed({f"__{c}": c for c in FOUND})


def of_documents(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """judged() for documents: the column lang is the declared language, the source the host.

    The text model is fitted on the declared languages. Null texts count as empty and are rejected;
    repeated rows get equal results; an empty table, or one without any declared language, has only
    unknown ones.
    """
    none = F.lit(None).cast("string")
    return judged(docs, fitted(docs if labelled is None else labelled), docs["text"], docs["lang"], none, none, docs["source"])


def of_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """judged() for web pages (page_id, url, html): markup language, address suffix, host and domain.

    The domain is what is registered: one label before the suffix, or before a public second-level
    name of a country. Null addresses share a prior, null and empty pages are rejected as unknown; of
    equally likely languages the first by name is taken; repeated rows get equal results, and an empty
    table gives none.
    """
    found = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    html = F.coalesce(pages["html"], F.lit(""))
    visible = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", " ")
    host = F.lower(found(pages["url"], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"))
    domain = found(host, rf"([^.]+\.(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]|[^.]+))$")
    return judged(pages, fitted(labelled), visible, found(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)"""), found(host, r"\.([^.]+)$"), domain, host)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents in a known language, with their columns; null, empty and letterless texts go, repeated rows alike."""
    return of_documents(docs).where("__accepted").select(*[f"`{c}`" for c in docs.columns])


ship(__name__)
