"""Similar pairs of return series: correlation and active-set overlap over common timestamps.

The candidate table is cut into tiles of bounded size. Every tile pair meets in one task, where
matrix products give all sums of the pairwise-complete statistics at once; only pairs that pass a
threshold leave the task. A tile holds at most ``tile`` series and a series at most one row per
calendar period, so memory per task is bounded whatever the number of candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = 1e-12
SCHEMA = "left_id string, right_id string, n_obs bigint, corr double, jaccard double"


def similar_pairs(
    returns: DataFrame,
    min_corr: float = 0.98,
    min_jaccard: float = 0.90,
    min_share: float = 0.5,
    min_obs: int = 10,
    tile: int = 512,
    candidate: str = "candidate_id",
    value: str = "strategy_return",
    exposure: str | None = None,
) -> DataFrame:
    """Pairs (left < right) with |corr| >= min_corr or Jaccard of active rows >= min_jaccard.

    A correlation needs max(min_obs, min_share * distinct timestamps) common rows.
    """
    size = returns.agg(F.count_distinct(candidate).alias("n"), F.count_distinct("ts").alias("t")).head()
    if not size["n"]:
        return returns.sparkSession.createDataFrame([], SCHEMA)
    tiles = max(1, -(-size["n"] // tile))
    need = max(min_obs, int(size["t"] * min_share))
    series = returns.groupBy(candidate).agg(
        F.array_sort(F.collect_list(F.struct("ts", F.col(value).alias("v"), F.col(exposure or value).alias("e")))).alias("s")
    )
    placed = series.select(
        F.col(candidate).cast("string").alias("id"),
        F.pmod(F.xxhash64(candidate), F.lit(tiles)).cast("int").alias("tile"),
        F.transform("s", lambda x: F.unix_date(F.to_date(x["ts"]))).alias("d"),
        F.col("s.v").alias("v"),
        F.col("s.e").alias("e"),
    )
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        "*", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj")
    )

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        return _edges(pdf, min_corr, min_jaccard, need)

    return spread.groupBy("ti", "tj").applyInPandas(meet, SCHEMA)


def _matrix(pdf: pd.DataFrame, days: np.ndarray, col: str) -> np.ndarray:
    out = np.full((len(pdf), len(days)), np.nan)
    for i, (d, v) in enumerate(zip(pdf["d"], pdf[col])):
        out[i, np.searchsorted(days, d)] = np.asarray(v, dtype=float)
    return out


def _edges(pdf: pd.DataFrame, min_corr: float, min_jaccard: float, need: int) -> pd.DataFrame:
    ti, tj = pdf["ti"].iloc[0], pdf["tj"].iloc[0]
    days = np.unique(np.concatenate([np.asarray(d) for d in pdf["d"]]))
    a, b = pdf[pdf["tile"] == ti], pdf[pdf["tile"] == tj]
    va, vb = _matrix(a, days, "v"), _matrix(b, days, "v")
    ma, mb = ~np.isnan(va), ~np.isnan(vb)
    # centring on each series' own mean keeps the sums well conditioned
    xa = np.where(ma, va - np.nanmean(va, axis=1, keepdims=True), 0.0)
    xb = np.where(mb, vb - np.nanmean(vb, axis=1, keepdims=True), 0.0)
    fa, fb = ma.astype(float), mb.astype(float)
    n = fa @ fb.T
    sx, sy = xa @ fb.T, fa @ xb.T
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = xa @ xb.T - sx * sy / n
        va2 = (xa * xa) @ fb.T - sx * sx / n
        vb2 = fa @ (xb * xb).T - sy * sy / n
        corr = cov / np.sqrt(va2 * vb2)
    ea, eb = _matrix(a, days, "e"), _matrix(b, days, "e")
    aa, ab = (np.abs(np.nan_to_num(ea)) > ACTIVE).astype(float), (np.abs(np.nan_to_num(eb)) > ACTIVE).astype(float)
    both = aa @ ab.T
    union = aa.sum(1)[:, None] + ab.sum(1)[None, :] - both
    jac = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
    ok = ((np.abs(corr) >= min_corr) & (n >= need)) | (jac >= min_jaccard)
    ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
    i, j = np.nonzero(ok)
    left, right = ids_a[i], ids_b[j]
    keep = left < right if ti == tj else left != right
    i, j, left, right = i[keep], j[keep], left[keep], right[keep]
    swap = left > right
    lo, hi = np.where(swap, right, left), np.where(swap, left, right)
    c = corr[i, j]
    return pd.DataFrame(
        {"left_id": lo, "right_id": hi, "n_obs": n[i, j].astype("int64"), "corr": c, "jaccard": jac[i, j]}
    )
