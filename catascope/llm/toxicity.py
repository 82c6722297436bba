"""Toxicity: boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catascope.llm.common import bounded_batches, ship, stored

#: Labelled documents that the model is fitted on, in expectation (drawn by a hash of doc_id).
FIT_ROWS = 20_000
#: Entries of the learned lexicon, words and word beginnings together.
LEXICON = 5_000
BEGINNING = 5
LEAST_TEXTS = 3
LEAST_ODDS = 1.5
THRESHOLD = 0.3
TREES = 20
DEPTH = 4
SEED = 11

#: Second-person words of the four languages.
SECOND_PERSON = {"you", "your", "yours", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros"}
#: Characters that stand for letters.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\s]+")
EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
INNER = re.compile(r"[^\w]+|_+")
STRETCH = re.compile(r"(\w)\1{2,}")
NAMES = [
    "word_density", "word_hits", "word_kinds", "word_odds", "top_odds", "start_density", "start_hits", "near_you", "you_density",
    "capitals", "shouted", "exclaimed", "punctuation", "stretched", "disguised", "disguised_hits", "log_words",
]


def tokens(text: str | None) -> list[str]:
    return [w for w in (EDGES.sub("", raw) for raw in WORD.findall((text or "").lower())) if w]


def described(text: str | None, odds: dict[str, float], starts: dict[str, float]) -> list[float]:
    """The features of a whole text in the order of NAMES; an empty text has zeros."""
    text = text or ""
    words = tokens(text)
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    you, hits, seen, total, top, begun, near, disguised, unmasked = 0, 0, set(), 0.0, 0.0, 0, 0, 0, 0
    last_you, last_hit, stretched = -9, -9, 0
    for i, w in enumerate(words):
        found = odds.get(w)
        if not w.isalpha():
            plain = INNER.sub("", w.translate(LOOKALIKE))
            if plain != w and any(c.isalpha() for c in w) and (not w.isalnum() or any(c.isdigit() for c in w)):
                disguised += 1
                if found is None and plain in odds:
                    found = odds[plain]
                    unmasked += 1
        if STRETCH.search(w):
            stretched += 1
            plain = STRETCH.sub(r"\1", w)
            if found is None and plain in odds:
                found = odds[plain]
                unmasked += 1
        if found is not None:
            hits += 1
            seen.add(w)
            total += found
            top = max(top, found)
            near += i - last_you <= 3
            last_hit = i
        elif w[:BEGINNING] in starts:
            begun += 1
        if w in SECOND_PERSON:
            you += 1
            last_you = i
            near += i - last_hit <= 3
    letters = sum(map(str.isalpha, text)) or 1
    raw = text.split()
    return [
        hits / n, float(hits), float(len(seen)), total, top, begun / n, float(begun), float(near), you / n,
        sum(map(str.isupper, text)) / letters, sum(w.isupper() and len(w) > 1 for w in raw) / n,
        (text.count("!") + text.count("?")) / n, sum(not c.isalnum() and not c.isspace() for c in text) / len(text),
        stretched / n, disguised / n, float(unmasked), math.log1p(n),
    ]


def describer(odds: dict[str, float], starts: dict[str, float]):
    @F.arrow_udf("array<double>")
    def describe(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([described(t, odds, starts) for t in column.to_pylist()], pa.list_(pa.float64()))

    return describe


@F.arrow_udf(T.ArrayType(T.StringType()))
def vocabulary(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct words (=word) and beginnings (^word) of each text."""
    for column in texts:
        out = []
        for text in column.to_pylist():
            words = set(tokens(text))
            out.append([f"={w}" for w in words] + [f"^{s}" for s in {w[:BEGINNING] for w in words if len(w) >= BEGINNING}])
        yield pa.array(out, pa.list_(pa.string()))


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of words and beginnings that mark toxic texts, from (text, toxic)."""
    sizes = rows.agg(F.sum("toxic").alias("a"), F.count("*").alias("b")).first()
    a, b = sizes["a"] or 0, (sizes["b"] or 0) - (sizes["a"] or 0)
    found = rows.select("toxic", F.explode(vocabulary(F.col("text"))).alias("entry")).groupBy("entry")
    found = found.agg(F.sum("toxic").alias("x"), F.count("*").alias("n")).where(F.col("x") >= LEAST_TEXTS)
    odds = F.log((F.col("x") + 0.5) / (a + 1)) - F.log((F.col("n") - F.col("x") + 0.5) / (b + 1))
    found = found.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    best = found.orderBy((F.col("odds") * F.sqrt("x")).desc(), "entry").limit(LEXICON).collect()
    pick = lambda mark: {r["entry"][1:]: r["odds"] for r in best if r["entry"][0] == mark}
    return pick("="), pick("^")


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def draw(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 30)) / float(1 << 30)


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic, part) of about `rows` labelled documents outside the held-out fold.

    The same hash bounds both sides of the join, so only texts that can be drawn are moved. part
    is in [0, 1) and tells which step of the fit a row serves.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    drawn = draw(F.col("doc_id")) < share
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & drawn)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(1000)) / 1000.0
    return texts.join(known.where(drawn), "doc_id").select("doc_id", "text", "toxic", part.alias("part"))


def scored(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted per row of documents.

    The fit uses three disjoint parts of the sample: the lexicon, the trees on features with that
    lexicon, and the calibration of the trees' output. Only the text is an input of a score. Null
    texts count as empty and get a score; repeated rows get equal ones; rows without doc_id are
    scored and not held out. Without labels of both kinds every score is the share of toxic labels
    (0 if there are none). An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    fit = stored(sample(docs, labels, rows), "toxicity-sample").coalesce(4)
    words, learn, calibrate = fit.where("part < 0.4"), fit.where("part >= 0.4 and part < 0.8"), fit.where("part >= 0.8")
    kinds = [p.agg(F.min("toxic"), F.max("toxic"), F.avg("toxic")).first() for p in (words, learn, calibrate)]
    if any(k[0] is None or k[0] == k[1] for k in kinds):
        mean = fit.agg(F.avg("toxic")).first()[0] or 0.0
        score = F.lit(mean)
        return base.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
    describe = describer(*lexicon(words))
    vector = array_to_vector(describe(F.col("text"))).alias("features")
    trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=SEED)
    model = trees.fit(stored(learn.select("toxic", vector), "toxicity-features").coalesce(2))
    likely = vector_to_array("probability")[1]
    curve = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="calibrated")
    held = model.transform(calibrate.select("toxic", vector)).select("toxic", likely.alias("raw"))
    curve = curve.fit(held)
    out = curve.transform(model.transform(base.select("doc_id", "held_out", vector)).select("doc_id", "held_out", likely.alias("raw")))
    # calibration has steps; a little of the trees' output keeps the order inside one
    score = F.least(F.greatest(0.99 * F.col("calibrated") + 0.01 * F.col("raw"), F.lit(0.0)), F.lit(1.0))
    out = out.select("doc_id", "held_out", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


ship(__name__)
