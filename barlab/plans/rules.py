"""Rule-level facts: how many features a rule uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Features per rule; spec-list rules count their specs.
FIXED_COUNTS = {
    "ma_crossover": 2, "momentum_threshold": 1, "mean_reversion": 2, "rsi_reversion": 1, "breakout": 2, "volatility_momentum": 2,
    "linear_score": 4, "feature_threshold": 1, "feature_zscore": 1,
}
SPEC_COLUMNS = ("feature_specs", "long_specs", "short_specs", "risk_on_specs", "stress_specs")


def feature_count(df: DataFrame) -> Column:
    n = F.lit(0)
    for c in SPEC_COLUMNS:
        if c in df.columns:
            n = n + F.size(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda s: s != ""))
    out = None
    for rule, k in FIXED_COUNTS.items():
        out = F.when(F.col("rule") == rule, k) if out is None else out.when(F.col("rule") == rule, k)
    return out.otherwise(F.greatest(n, F.lit(1)))
