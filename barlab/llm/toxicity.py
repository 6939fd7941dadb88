"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features say that a hashed character n-gram occurs at least once, twice or three times. Documents that hold a feature are
counted by class over the training rows; r = log((pos + a) / (P + 2a)) - log((neg + a) / (N + 2a)). Those whose ratio stands clear of its sampling error are kept, a
document's feature value is the ratio itself, and logistic regression with a ridge penalty weighs them. Its gradients are summed
in the tasks: the weights go out, one sum comes back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import BATCH_ROWS, hold_out, map_rows, written

GRAMS = (3, 4, 5, 6, 7)
HASH_BITS = 19
#: A feature is an n-gram bucket and one of these least numbers of occurrences.
LEVELS = (1, 2, 3)
#: Bound of the labelled sample that the classifier is fitted on.
MAX_LABELLED = 8_000
MIN_Z = 3.0
SMOOTH = 1.0
RIDGE = 2e-4
#: The fit ends when a step gains less than this share of the loss, or after so many steps.
TOLERANCE, STEPS = 1e-6, 300
THRESHOLD = 0.3
FOLDS, HELD_FOLD = 4, 2
WIDTH = len(LEVELS) << HASH_BITS
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """Hashed n-grams (repeats included) of the lower-cased text with every run of white space as one space."""
    flat = " " + " ".join((text or "").lower().split()) + " "
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + codes[k : len(codes) - n + 1 + k]) * _MIX
            h ^= h >> np.uint64(29)
        out.append((h * _MIX) >> np.uint64(64 - HASH_BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def features(buckets: np.ndarray) -> np.ndarray:
    """Distinct features of a document: bucket + level << HASH_BITS."""
    at, n = np.unique(buckets, return_counts=True)
    return np.concatenate([at[n >= least] + (k << HASH_BITS) for k, least in enumerate(LEVELS)])


@dataclass
class Model:
    """Weight of each feature (ratio times coefficient), 0 where it is not kept, and the intercept."""

    weights: np.ndarray
    used: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = grams(text)
        at = features(at[self.used[at]])
        z = float(self.weights[at].sum()) + self.bias
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Training labels: rows outside the held-out fold, one per doc_id, at most ``most`` of them by hash order."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna()
    rows = rows.filter(~hold_out(F.col("doc_id"), FOLDS, HELD_FOLD)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def training_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(label, text, times): every different text of a sampled document once, with the number of its rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label", "text").agg(F.count("*").alias("times")).drop("doc_id")


def ratios(train: DataFrame) -> DataFrame:
    """(feature, pos, neg): training documents of each class that hold the feature."""

    def count(batches):
        pos, neg = np.zeros(WIDTH, np.int64), np.zeros(WIDTH, np.int64)
        for b in batches:
            for text, label, times in zip(*(b[c].to_pylist() for c in ("text", "label", "times")), strict=True):
                (pos if label else neg)[features(grams(text))] += times
        at = np.flatnonzero(pos + neg)
        yield {"feature": at, "pos": pos[at], "neg": neg[at]}

    return map_rows(train, count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def regression(rows: DataFrame, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from rows (label, times, held: columns of ``ratio``); the intercept is not penalised."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    shared = rows.sparkSession.sparkContext.broadcast(ratio)
    vector = F.udf(lambda held: Vectors.sparse(len(shared.value), held, shared.value[held]), VectorUDT())
    data = rows.select(F.when(F.col("label") != 0, 1.0).otherwise(0.0).alias("label"), F.col("times").cast("double").alias("times"), vector("held").alias("features"))
    model = LogisticRegression(regParam=RIDGE, elasticNetParam=0.0, standardization=False, weightCol="times", maxIter=STEPS, tol=TOLERANCE, aggregationDepth=2).fit(data)
    return model.coefficients.toArray(), float(model.intercept)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on a bounded, hash-ordered sample of labelled documents.

    Rows stay with the executors, however many share a doc_id: the driver gets the labels' ids, the ratios of the features
    that are clear of their error (at most one for each hash bucket and level) and sums of gradients.
    Without two classes the model is the base rate (0.5 without labels).
    """
    sample = labelled_sample(labels, max_labelled).collect()
    spark = docs.sparkSession
    known = spark.createDataFrame([(r["doc_id"], r["label"]) for r in sample], "doc_id long, label int")
    train = written(training_rows(docs, known))
    totals = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.sum("times").alias("n")).collect()}
    p, n = sum(v for k, v in totals.items() if k), totals.get(0, 0)
    weights, unused = np.zeros(WIDTH), np.zeros(1 << HASH_BITS, bool)
    if not p or not n:
        rate = (p + 0.5) / (p + n + 1)
        return Model(weights, unused, float(np.log(rate / (1 - rate))))
    a = F.lit(SMOOTH)
    r = F.log((F.col("pos") + a) / F.lit(p + 2 * SMOOTH)) - F.log((F.col("neg") + a) / F.lit(n + 2 * SMOOTH))
    counted = ratios(train).withColumn("r", r).withColumn("z", F.abs("r") / F.sqrt(1 / (F.col("pos") + a) + 1 / (F.col("neg") + a)))
    chosen = counted.filter(F.col("z") >= MIN_Z).select("feature", "r").toPandas().sort_values("feature")
    if chosen.empty:
        return Model(weights, unused, float(np.log(p / n)))
    kept, ratio = chosen["feature"].to_numpy(), chosen["r"].to_numpy()
    column = np.full(WIDTH, -1, np.int32)
    column[kept] = np.arange(len(kept), dtype=np.int32)
    shared = spark.sparkContext.broadcast(column)

    def held(batches):
        for b in batches:
            found = [np.unique(c[c >= 0]) for c in (shared.value[features(grams(t))] for t in b["text"].to_pylist())]
            yield {"label": b["label"], "times": b["times"], "held": found}

    rows = written(map_rows(train, held, "label int, times long, held array<int>"))
    w, bias = regression(rows, ratio)
    weights[kept] = w * ratio
    return Model(weights, (weights.reshape(len(LEVELS), -1) != 0).any(axis=0), bias)


def scorer(docs: DataFrame, model: Model) -> Column:
    """Score of the text column, as an Arrow-batched column of ``docs``."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return score(F.col("text").cast("string"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more. All columns stay; see ``classify`` for odd rows."""
    return docs.filter(scorer(docs, fit(docs, labels)) < THRESHOLD)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document from its whole text.

    Only doc_id and text of ``docs`` and doc_id and toxic of ``labels`` are read, so extra columns never clash. Null and
    empty texts are scored like a text without features. Labels with nulls are left out; several labels of a document
    count as their greatest. Repeated documents get equal scores. Empty documents give an empty table. Very long texts
    are scored whole: a repeated n-gram counts once.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs, fit(docs, labels)).alias("score"))
    return out.select("doc_id", hold_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
