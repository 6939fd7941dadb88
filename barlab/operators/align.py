"""Alignment of observation tables onto a trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import rolling as R


def dedupe_mean(obs: DataFrame, keys=("ts",), values=("value",)) -> DataFrame:
    """Average duplicate timestamps (partial aggregation before the shuffle)."""
    return obs.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def align_ffill(calendar: DataFrame, obs: DataFrame, values, by=("symbol",), on=("ts",)) -> DataFrame:
    """Left-join on the exact timestamp, then carry the last value forward.

    Observations dated off the calendar are dropped, not carried to the next row.
    """
    joined = calendar.join(obs, list(on), "left")
    return joined.withColumns({v: R.forward_fill(v, by) for v in values})


def asof_bucket(calendar: DataFrame, obs: DataFrame, values, by=("symbol",)) -> DataFrame:
    """True as-of: latest observation at or before each calendar row, via one merged and sorted pass."""
    marks = calendar.select(*by, "ts", F.lit(1).alias("_cal"))
    feed = obs.select(*by, "ts", F.lit(0).alias("_cal"), *values)
    both = marks.unionByName(feed, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("ts", "_cal").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
        .where("_cal = 1")
        .drop("_cal")
    )


def business_day_shift(ts, n: int):
    """Date ``n`` business days later, n = 1 or 5, weekends rolling onto the following week."""
    d = F.to_date(ts)
    dow = F.weekday(d)
    if n == 1:
        step = F.when(dow == 4, 3).when(dow == 5, 2).otherwise(1)
    elif n == 5:
        step = F.when(dow == 5, 6).when(dow == 6, 5).otherwise(7)
    else:
        raise ValueError("publication lags are 1 or 5 business days")
    return F.date_add(d, step.cast("int"))


def publication_lag(obs: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    return obs.withColumn(ts, business_day_shift(F.col(ts), n))


def benchmark_ratio(bars: DataFrame, symbol: str, by: str = "symbol") -> DataFrame:
    """close / benchmark close on the same date."""
    base = bars.where(F.col(by) == symbol).select("ts", F.col("close").alias("base_close"))
    return bars.join(base, "ts").withColumn("ratio", R.ratio("close", "base_close"))


def keep_known_features(specs: DataFrame, features: DataFrame) -> DataFrame:
    """Semi-join on feature names."""
    return specs.join(features.select("feature").distinct(), "feature", "left_semi")
