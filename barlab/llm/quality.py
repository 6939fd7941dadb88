"""Quality classifier: ridge regression over random Fourier features of document statistics, calibrated isotonically.

The features cos(xW + b) with Gaussian W approximate a Gaussian kernel over the standardised statistics. Each partition
sums its share of the normal equations, so the fit uses every labelled row and only sums of a fixed size travel. The
sums are kept by fold: each fold is scored by the model of the others, and isotonic regression over these scores gives
the calibration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import hold_out, map_rows
from barlab.session import checkpoint

FEATURES = 128
BANDWIDTH = 3.0
RIDGE = 1e-2
SEED = 11
CV = 5
#: Raw scores are counted in steps of this size between LOW and HIGH before the isotonic fit.
STEP, LOW, HIGH = 0.002, -1.0, 2.0
THRESHOLD = 0.3
FOLDS, HELD_FOLD = 5, 0

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_SYMBOLS = [ord(c) for c in "#*$%&|<>{}[]=+_~^\\/@"]
_ENDS = [ord(c) for c in ".,;:"]
STATS = 16


def statistics(text: str | None) -> list[float]:
    """Numbers that describe the form of a text; a null text counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(raw, minlength=256)
    size, letters = max(1, len(raw)), max(1, int(count[_LETTER].sum()))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    lengths = np.array([len(w) for w in words], np.float64) if words else np.zeros(1)
    same = sum(map(str.__eq__, words[1:], words[:-1]))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()),
        float(count[65:91].sum()) / letters, float(count[48:58].sum()) / size, float(count[_SYMBOLS].sum()) / size, float(count[124]) / n,
        float(count[33] + count[63]) / n, float(count[_ENDS].sum()) / n, float(count[32] + count[9] + count[10] + count[13]) / size,
        len(set(words)) / n, len(set(words)) / n**0.7, same / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    grid: np.ndarray
    level: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(fourier(x, self.mean, self.scale) @ self.coef, self.grid, self.level), 0.0, 1.0)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, 1.0 / BANDWIDTH, (STATS, FEATURES))
    b = rng.uniform(0.0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -6.0, 6.0)
    return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing sequence nearest to ``value``."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of every document."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"].to_pylist(), "x": [statistics(t) for t in b["text"].to_pylist()]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, x array<double>")


def matrix(batch) -> np.ndarray:
    return np.asarray(batch["x"].flatten()).reshape(-1, STATS)


def fit(described: DataFrame, labels: DataFrame) -> Model:
    """Fit on every labelled row outside the held-out fold. Without two classes the score is the base rate (0.5 without labels)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
    known = known.filter(~hold_out(F.col("doc_id"), FOLDS, HELD_FOLD)).groupBy("doc_id").agg(F.max("label").alias("label"))
    train = checkpoint(described.join(known, "doc_id").select("x", (F.col("label") > 0).cast("double").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(CV)).cast("int").alias("fold")))
    moments = train.agg(F.count("*").alias("n"), F.coalesce(F.avg("y"), F.lit(0.5)).alias("rate"), *[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(STATS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()[0]
    zero, one = np.zeros(STATS), np.ones(STATS)
    if moments["rate"] in (0.0, 1.0) or moments["n"] < 10:
        level = np.full(2, (moments["rate"] * moments["n"] + 0.5) / (moments["n"] + 1))
        return Model(zero, one, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), level)
    mean = np.array([moments[f"m{k}"] for k in range(STATS)])
    scale = np.array([moments[f"s{k}"] or 1.0 for k in range(STATS)])
    width = FEATURES + 2  # the last column holds the label
    upper = np.triu_indices(width)

    def normal(batches):
        sums = np.zeros((CV, width, width))
        for b in batches:
            z, fold = np.hstack([fourier(matrix(b), mean, scale), np.asarray(b["y"])[:, None]]), np.asarray(b["fold"])
            for f in range(CV):
                own = z[fold == f]
                sums[f] += own.T @ own
        yield {"k": np.repeat(np.arange(CV), len(upper[0])) * width * width + np.tile(upper[0] * width + upper[1], CV), "v": np.concatenate([s[upper] for s in sums])}

    grams = np.zeros((CV, width, width))
    for r in map_rows(train, normal, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        f, i, j = r["k"] // (width * width), r["k"] // width % width, r["k"] % width
        grams[f, i, j] = grams[f, j, i] = r["v"]

    def solve(g: np.ndarray) -> np.ndarray:
        n = g[-2, -2]  # the constant's square sum counts the rows
        penalty = np.diag(np.append(np.full(FEATURES, RIDGE * n / FEATURES), 0.0))
        return np.linalg.solve(g[:-1, :-1] + penalty + 1e-9 * np.eye(width - 1), g[:-1, -1])

    whole = grams.sum(axis=0)
    apart = np.stack([solve(whole - g if (whole - g)[-2, -2] > 0 else whole) for g in grams])

    def judge(batches):
        for b in batches:
            raw = (fourier(matrix(b), mean, scale) * apart[np.asarray(b["fold"])]).sum(axis=1)
            yield {"step": np.round(np.clip(raw, LOW, HIGH) / STEP).astype(np.int32), "y": np.asarray(b["y"])}

    steps = map_rows(train, judge, "step int, y double").groupBy("step").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("step").collect()
    grid = np.array([r["step"] for r in steps]) * STEP
    return Model(mean, scale, solve(whole), grid, isotonic(np.array([r["y"] for r in steps]), np.array([float(r["n"]) for r in steps])))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document from its whole text.

    Only doc_id and text of ``docs`` and doc_id and quality of ``labels`` are read, so extra columns never clash. Null and
    empty texts are scored by their (zero) statistics. Labels with nulls are left out; several labels of a document count
    as their greatest. Repeated documents get equal scores; empty documents give an empty table; statistics of very long
    texts take one pass.
    """
    described = checkpoint(describe(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit(described, labels))

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"].to_pylist(), "score": shared.value.score(matrix(b))}

    out = map_rows(described, run, "doc_id long, score double")
    return out.select("doc_id", hold_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
