"""Signals from bars: single-rule columns over ordered series.

Every builder adds an integer ``signal`` column; unknown inputs give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions import rolling as R


def on(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def ma_crossover(df: DataFrame, fast: int, slow: int, by=("symbol",)) -> DataFrame:
    if fast >= slow:
        raise ValueError("fast window must be shorter than slow window")
    return df.withColumn("signal", on(R.mean("close", fast, by=by) > R.mean("close", slow, by=by)))


def momentum(df: DataFrame, n: int, threshold: float, by=("symbol",)) -> DataFrame:
    return df.withColumn("signal", on(R.pct_change("close", n, by) > threshold))


def mean_reversion(df: DataFrame, n: int, entry: float, leave: float, by=("symbol",)) -> DataFrame:
    """In at z <= -entry, out at z >= leave."""
    z = df.withColumn("_z", R.zscore("close", n, by=by))
    return z.withColumn("signal", R.hysteresis(F.col("_z") <= -entry, F.col("_z") >= leave, by)).drop("_z")


def rsi(df: DataFrame, n: int, by=("symbol",)) -> DataFrame:
    """Index from plain rolling means of gains and losses; no losses gives NULL."""
    move = R.diff("close", 1, by)
    x = df.withColumn("_d", move)
    x = x.withColumns({
        "_u": F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))),
        "_l": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))),
    })
    value = 100.0 - 100.0 / (1.0 + R.ratio(R.mean("_u", n, by=by), R.mean("_l", n, by=by)))
    return x.withColumn("rsi", value).drop("_d", "_u", "_l")


def rsi_reversion(df: DataFrame, n: int, buy: float, sell: float, by=("symbol",)) -> DataFrame:
    return rsi(df, n, by).withColumn("signal", R.hysteresis(F.col("rsi") <= buy, F.col("rsi") >= sell, by)).drop("rsi")


def breakout(df: DataFrame, enter_n: int, exit_n: int, by=("symbol",)) -> DataFrame:
    """In above the previous ``enter_n`` highest close, out below the previous ``exit_n`` lowest."""
    x = df.withColumn("_p", R.lag("close", 1, by))
    x = x.withColumns({"_hi": R.high("_p", enter_n, by=by), "_lo": R.low("_p", exit_n, by=by)})
    latch = R.hysteresis(F.col("close") > F.col("_hi"), F.col("close") < F.col("_lo"), by)
    return x.withColumn("signal", latch).drop("_p", "_hi", "_lo")


def volatility_momentum(df: DataFrame, mom_n: int, vol_n: int, q: float, by=("symbol",)) -> DataFrame:
    """Rising and calmer than the rolling 252-row quantile of its own volatility."""
    x = df.withColumn("_r", R.pct_change("close", 1, by))
    x = x.withColumn("_v", R.std("_r", vol_n, by=by))
    calm = F.col("_v") < R.quantile("_v", 252, q, vol_n, by=by)
    return x.withColumn("signal", on((R.pct_change("close", mom_n, by) > 0) & calm)).drop("_r", "_v")


def linear_score(df: DataFrame, fast: int, slow: int, risk: int, threshold: float, by=("symbol",)) -> DataFrame:
    """Sum of standardised fast and slow returns, minus volatility, plus drawdown."""
    x = df.withColumns({
        "_r": R.pct_change("close", 1, by), "_f": R.pct_change("close", fast, by), "_s": R.pct_change("close", slow, by),
        "_d": R.drawdown("close", risk, by=by),
    })
    x = x.withColumn("_v", R.std("_r", risk, by=by))
    z = {k: R.zscore(k, 252, 63, by=by) for k in ("_f", "_s", "_v", "_d")}
    score = z["_f"] + z["_s"] - z["_v"] + z["_d"]
    return x.withColumn("score", score).withColumn("signal", on(F.col("score") > threshold)).drop("_r", "_f", "_s", "_v", "_d")


def feature_threshold(df: DataFrame, feature: str, threshold: float) -> DataFrame:
    return df.withColumn("signal", on(F.col(feature) > threshold))


def feature_zscore(df: DataFrame, feature: str, n: int, threshold: float, by=("symbol",)) -> DataFrame:
    return df.withColumn("signal", on(R.zscore(feature, n, max(20, n // 4), by=by) > threshold))


def long_short(long_vote: Column, short_vote: Column, flat: int = 0) -> Column:
    """+1 on a long vote, -1 on a short vote without a long one, otherwise ``flat``."""
    return F.when(long_vote, 1).when(short_vote & ~F.coalesce(long_vote, F.lit(False)), -1).otherwise(flat)


def regime_asset(risk_on: Column, stress: Column, risk: Column, safe: Column, stressed: Column) -> Column:
    return F.when(stress, stressed).when(risk_on, risk).otherwise(safe)


def score_to_position(score: Column, direction: Column, threshold: Column) -> Column:
    return F.when(score * direction >= threshold, 1.0).otherwise(-1.0)


def long_fraction(df: DataFrame, signal: str, by=("symbol",)) -> DataFrame:
    """Share of bars whose previous signal was long; the first bar counts as long."""
    x = df.withColumn("_p", F.coalesce(R.lag(signal, 1, by), F.lit(1)))
    return x.groupBy(*by).agg(F.avg((F.col("_p") > 0).cast("double")).alias("long_fraction"))
