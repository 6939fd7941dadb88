"""Leaderboard fixture over orders: one row per order, every metric a fixed function of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.plans import inputs as I

# name: (multiplier, modulus, divisor, offset); value = (order key * multiplier % modulus) / divisor + offset
METRICS = {
    "train_calmar": (3, 97, 12.0, -0.5), "validation_calmar": (7, 89, 14.0, -0.5), "train_cagr": (11, 53, 200.0, -0.02),
    "validation_cagr": (13, 47, 220.0, -0.02), "train_mdd": (5, 61, -150.0, -0.001), "validation_mdd": (17, 59, -140.0, -0.001),
    "trades_per_year": (19, 140, 1.0, 0.0), "long_fraction": (23, 101, 100.0, 0.0), "train_sharpe": (29, 43, 18.0, -0.2),
    "validation_sharpe": (31, 41, 17.0, -0.2), "average_abs_exposure": (37, 50, 50.0, 0.0), "exposure_turnover": (41, 20, 40.0, 0.0),
    "train_min_year_return": (53, 31, 100.0, -0.1), "validation_min_year_return": (57, 33, 100.0, -0.12), "train_down_min_return": (59, 29, 100.0, -0.1),
    "elapsed_seconds": (61, 3600, 1.0, 60.0), "first_seen_minute": (67, 800, 1.0, 0.0), "train_block_min_calmar": (71, 30, 20.0, -0.5),
    "validation_block_min_calmar": (73, 31, 20.0, -0.5), "excess_pvalue": (79, 100, 100.0, 0.0), "bootstrap_calmar_p05": (83, 60, 20.0, -1.5),
    "complexity_penalty": (89, 10, 20.0, 0.0), "repeated_failure_penalty": (97, 7, 10.0, 0.0),
}
COUNTS = {
    "validation_negative_years": (1, 3, 0), "feature_count": (1, 8, 1), "train_years_positive": (43, 15, 0), "validation_years_positive": (47, 13, 0),
    "train_down_years_ge_5pct": (3, 4, 0), "validation_down_years_ge_5pct": (2, 3, 0), "train_blocks_positive": (5, 7, 0), "validation_blocks_positive": (6, 7, 0),
    "walkforward_passes": (1, 5, 0), "robust_passes": (7, 15, 0), "train_years_total": (1, 1, 14), "validation_years_total": (1, 1, 12),
    "train_down_years_total": (1, 1, 3), "validation_down_years_total": (1, 1, 2),
}
FLAGS = {"locked_opened": (11, 0), "accepted": (4, 1), "stage_failed": (13, 0)}


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cols = [((k * a % m) / d + o).alias(n) for n, (a, m, d, o) in METRICS.items()]
    cols += [(k * a % m + o).alias(n) for n, (a, m, o) in COUNTS.items()]
    cols += [(k % m == v).alias(n) for n, (m, v) in FLAGS.items()]
    return I.table(spark, sf_dir, "orders").select(
        k.alias("row_id"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("method"), (k % 16).alias("stage"), (k % 3 + 1).alias("wave"),
        F.col("o_totalprice").alias("score"), *cols,
    )


BOARD = ["board AS (SELECT o_orderkey AS row_id, o_custkey AS candidate_id, o_orderpriority AS method, o_orderkey % 16 AS stage, o_orderkey % 3 + 1 AS wave, o_totalprice AS score, "
    + ", ".join(f"(o_orderkey * {a} % {m}) / {d}e0 + {o}e0 AS {n}" for n, (a, m, d, o) in METRICS.items()) + ", "
    + ", ".join(f"o_orderkey * {a} % {m} + {o} AS {n}" for n, (a, m, o) in COUNTS.items()) + ", "
    + ", ".join(f"o_orderkey % {m} = {v} AS {n}" for n, (m, v) in FLAGS.items()) + " FROM orders)"]
