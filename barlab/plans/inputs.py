"""Market-style tables derived from the driver's star schema, and the same tables as SQL texts.

Every builder aggregates the raw table to a daily grain first (map-side combine on symbol and day), so
a symbol that holds a third of all raw rows shuffles only one partial row per map task and day.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions import rolling as R
from barlab.session import checkpoint

BENCHMARK = "N"
UNIT = 997.31  # price unit; an uneven divisor keeps averages off rounding ties
TRAIN_END = "1998-12-31"
VALIDATION_START = "1999-01-01"
VALIDATION_END = "2000-12-31"
LOCKED_START = "2001-01-01"


_SCOPES: list[dict[str, DataFrame]] = []


@contextmanager
def sharing():
    """Within the block, derived base tables are materialised once and reused by every branch of a query.

    They are daily or weekly aggregates - tiny beside the raw tables - so a query that needs them in
    many places scans and shuffles the raw data once. The files live in the checkpoint folder.
    """
    _SCOPES.append({})
    try:
        yield
    finally:
        _SCOPES.pop()


def shared(key: str, build: Callable[[], DataFrame]) -> DataFrame:
    if not _SCOPES:
        return build()
    memo = _SCOPES[-1]
    if key not in memo:
        memo[key] = checkpoint(build())
    return memo[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, close): daily mean unit price, smoothed over 20 rows.

    Sums run over integer hundredths, so the result does not depend on the order of addition.
    """
    return shared(f"bars:{sf_dir}", lambda: _bars(spark, sf_dir))


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("ts"))
        .agg(F.expr("sum(cast(round(l_extendedprice * 100) as bigint)) * 100 div count(1)").alias("px4"))
    )
    w = R.frame(20)
    close = F.sum("px4").over(w).cast("double") / (F.count("px4").over(w) * 10000).cast("double") / UNIT
    return daily.select("symbol", "ts", close.alias("close"))


BARS = [
    """day_px AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts,
         (SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) * 100) // COUNT(*) AS px4
  FROM lineitem GROUP BY 1, 2)""",
    f"""bars AS (
  SELECT symbol, ts, CAST(SUM(px4) OVER w AS DOUBLE) / CAST(COUNT(*) OVER w * 10000 AS DOUBLE) / {UNIT} AS close
  FROM day_px WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
]

ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) straight from unit prices."""
    return shared(f"raw_bars:{sf_dir}", lambda: _raw_bars(spark, sf_dir))


def _raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct(*ROW_KEY)
    px = F.col("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("ts"))
        .agg(
            F.min(key).getField("l_extendedprice").alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max(key).getField("l_extendedprice").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


RAW_BARS = [
    f"""raw_bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts,
         arg_min(l_extendedprice, ({', '.join(ROW_KEY)})) AS open,
         MAX(l_extendedprice) AS high, MIN(l_extendedprice) AS low,
         arg_max(l_extendedprice, ({', '.join(ROW_KEY)})) AS close,
         SUM(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""
]


def returns(b: DataFrame) -> DataFrame:
    return b.withColumn("r", R.pct_change("close"))


RETS = ["""rets AS (
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars)"""]


def benchmark(b: DataFrame) -> DataFrame:
    return b.where(F.col("symbol") == BENCHMARK).select("ts", F.col("close").alias("base_close"))


def macro_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, value): monthly order totals in whole cents, dated on the first of the month."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.trunc("o_orderdate", "month").alias("ts"))
        .agg((F.expr("sum(cast(round(o_totalprice * 100) as bigint))") / 100.0).alias("value"))
    )


MACRO = ["""macro AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
         CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value
  FROM orders GROUP BY 1)"""]


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, priority, value): daily mean order total per priority, a stand-in for rate-like series."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("series"))
        .agg((F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div count(1)") / 9999991.0).alias("value"))
    )


ORDERS_DAILY = ["""orders_daily AS (
  SELECT CAST(o_orderdate AS DATE) AS ts, o_orderpriority AS series,
         CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) // COUNT(*) AS DOUBLE) / 9999991.0 AS value
  FROM orders GROUP BY 1, 2)"""]
