"""Small strategy fixtures over bars: candidates, positions and return series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions import rolling as R
from barlab.plans import inputs as I

# (fast, slow) windows of the moving-average strategies used to make return series.
PAIRS = ((5, 20), (5, 21), (10, 30), (10, 60), (20, 60), (20, 120))


def on_series(candidates: DataFrame, bars: DataFrame, salts: int = 8) -> DataFrame:
    """Evaluate every candidate on the rows of its own symbol.

    Candidates spread over ``salts`` buckets by id and the (daily, calendar-bounded) bars repeat per
    bucket, so a symbol named by a third of all candidates does not land in one task.
    """
    c = candidates.withColumn("_salt", F.pmod(F.xxhash64("candidate_id"), F.lit(salts)).cast("int"))
    b = bars.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return c.join(b, ["symbol", "_salt"]).drop("_salt")


def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, symbol, threshold): one threshold rule per symbol and discount level."""
    return (
        I.table(spark, sf_dir, "lineitem")
        .select(F.col("l_returnflag").alias("symbol"), F.col("l_discount"))
        .distinct()
        .select(
            F.concat("symbol", F.lit("_"), F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("candidate_id"),
            "symbol",
            ((F.round(F.col("l_discount") * 100) - 5) / 300.0 + 0.0001).alias("threshold"),
        )
    )


CAND_SQL = ["""candidates AS (
  SELECT DISTINCT l_returnflag || '_' || CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS candidate_id,
         l_returnflag AS symbol, (round(l_discount * 100) - 5) / 300.0 + 0.0001 AS threshold FROM lineitem)"""]


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, symbol, ts, exposure): +1 / -1 by fast over slow average, known one bar earlier."""
    b = I.bars(spark, sf_dir)
    sma = {n: R.mean("close", n) for n in sorted({n for p in PAIRS for n in p})}
    wide = b.withColumns({f"_m{n}": c for n, c in sma.items()})
    items = F.array(*[
        F.struct(F.lit(f"{a}_{z}").alias("rule"), (F.col(f"_m{a}") > F.col(f"_m{z}")).alias("up")) for a, z in PAIRS
    ])
    long = wide.select("symbol", "ts", F.inline(items))
    side = F.when(F.col("up"), 1.0).when(~F.col("up"), -1.0)
    by = ("symbol", "rule")
    return long.select(
        F.concat_ws("_", "symbol", "rule").alias("candidate_id"), "symbol", "ts", "rule",
        F.coalesce(R.lag(side, 1, by), F.lit(0.0)).alias("exposure"),
    )


POS_SQL = [
    "sma_wide AS (SELECT symbol, ts, " + ", ".join(
        f"CASE WHEN COUNT(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} "
        f"THEN AVG(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS m{n}"
        for n in sorted({n for p in PAIRS for n in p})) + " FROM bars)",
    "sides AS (" + " UNION ALL ".join(
        f"SELECT symbol, ts, '{a}_{z}' AS rule, CASE WHEN m{a} > m{z} THEN 1.0 WHEN m{a} <= m{z} THEN -1.0 END AS side FROM sma_wide"
        for a, z in PAIRS) + ")",
    """positions AS (SELECT symbol || '_' || rule AS candidate_id, symbol, ts, rule,
         CAST(coalesce(lag(side) OVER (PARTITION BY symbol, rule ORDER BY ts), 0) AS DOUBLE) AS exposure FROM sides)""",
]


def positions_to_returns(pos: DataFrame, returns: DataFrame) -> DataFrame:
    """Exposure times the return of the held symbol; missing returns count as zero."""
    return pos.join(returns, ["symbol", "ts"], "left").withColumn(
        "strategy_return", F.col("exposure") * F.coalesce("r", F.lit(0.0))
    )


def strategy_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = I.returns(I.bars(spark, sf_dir)).select("symbol", "ts", "r")
    return positions_to_returns(positions(spark, sf_dir), r)


SRET_SQL = ["""sret AS (SELECT p.*, r.r, p.exposure * coalesce(r.r, 0) AS strategy_return
  FROM positions AS p LEFT JOIN rets AS r ON r.symbol = p.symbol AND r.ts = p.ts)"""]


def selected_asset_return(pick: DataFrame, asset_returns: DataFrame) -> DataFrame:
    """Look up the return of the asset named in each row; no wide columns needed."""
    r = asset_returns.select("ts", F.col("asset").alias("traded_asset"), F.col("r").alias("asset_return"))
    return pick.join(r, ["ts", "traded_asset"], "left").withColumn("asset_return", F.coalesce("asset_return", F.lit(0.0)))


def yearly_returns(bars: DataFrame) -> DataFrame:
    y = bars.groupBy("symbol", F.year("ts").alias("year")).agg(F.max_by("close", "ts").alias("c"))
    return y.select("symbol", "year", R.pct_change("c", 1, order="year").alias("r"))


def down_years(bars: DataFrame, asset: str, benchmark: str) -> DataFrame:
    """Years in which both the asset and the benchmark lost."""
    g = yearly_returns(bars).where("r < 0")
    a = g.where(F.col("symbol") == asset).select("year", F.col("r").alias("asset_return"))
    b = g.where(F.col("symbol") == benchmark).select("year", F.col("r").alias("base_return"))
    return a.join(b, "year")


def split_periods(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Label train and validation rows; locked rows are dropped."""
    d = F.to_date(ts)
    period = F.when(d <= F.lit(I.TRAIN_END).cast("date"), "train").when(
        d.between(F.lit(I.VALIDATION_START).cast("date"), F.lit(I.VALIDATION_END).cast("date")), "validation"
    )
    return df.withColumn("period", period).where("period IS NOT NULL")
