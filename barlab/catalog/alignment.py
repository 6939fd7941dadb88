"""Joins and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.features import BASE, CUM, O, W, PCT
from barlab.functions import rolling as R
from barlab.operators import align as A
from barlab.operators import pairs as PW
from barlab.plans import inputs as I
from barlab.plans import strategies as S
from barlab.registry import oracle, query


@query("align_ffill", oracle("s:symbol d:ts f:value", I.BARS, I.ORDERS_DAILY,
    "x AS (SELECT b.symbol, b.ts, o.value AS v FROM bars AS b LEFT JOIN (SELECT ts, value FROM orders_daily WHERE series = '2-HIGH') AS o ON b.ts = o.ts)",
    f"SELECT symbol, ts, last_value(v IGNORE NULLS) OVER {CUM} AS value FROM x"))
def align_ffill(spark, d):
    obs = I.orders_daily(spark, d).where("series = '2-HIGH'").select("ts", "value")
    return A.align_ffill(I.bars(spark, d).select("symbol", "ts"), obs, ["value"])


@query("align_dedupe_mean", oracle("d:ts f:value", I.ORDERS_DAILY,
    "SELECT ts, AVG(value) AS value FROM orders_daily GROUP BY ts"))
def align_dedupe_mean(spark, d):
    return A.dedupe_mean(I.orders_daily(spark, d))


@query("asof_feature_row", oracle("s:symbol d:month_end d:feature_ts f:close f:r", I.BARS, I.RETS, """
SELECT symbol, last_day(ts) AS month_end, MAX(ts) AS feature_ts, arg_max(close, ts) AS close, arg_max_null(r, ts) AS r FROM rets GROUP BY 1, 2"""))
def asof_feature_row(spark, d):
    last = F.max_by(F.struct("ts", "close", "r"), "ts").alias("last")
    x = I.returns(I.bars(spark, d)).groupBy("symbol", F.last_day("ts").alias("month_end")).agg(last)
    return x.select("symbol", "month_end", F.col("last.ts").alias("feature_ts"), "last.close", "last.r")


@query("asof_join", oracle("s:symbol d:ts f:value", I.BARS, I.MACRO,
    "SELECT b.symbol, b.ts, m.value FROM bars AS b ASOF LEFT JOIN macro AS m ON b.ts >= m.ts"))
def asof_join(spark, d):
    """True as-of fill, offered next to the exact-timestamp alignment."""
    cal = I.bars(spark, d).select("symbol", "ts")
    # the observations belong to every symbol, so resolve each calendar day once and join it back
    day = cal.select(F.lit("all").alias("feed"), "ts").distinct()
    obs = I.macro_monthly(spark, d).withColumn("feed", F.lit("all"))
    return cal.join(A.asof_bucket(day, obs, ["value"], ("feed",)).drop("feed"), "ts", "left").select("symbol", "ts", "value")


@query("publication_lag", oracle("d:ts d:lag_1 d:lag_5", """
x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ts FROM orders)""", """
SELECT ts, CAST(ts + INTERVAL 1 DAY * (CASE isodow(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) AS DATE) AS lag_1,
  CAST(ts + INTERVAL 1 DAY * (CASE isodow(ts) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END) AS DATE) AS lag_5 FROM x"""))
def publication_lag(spark, d):
    x = I.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("ts")).distinct()
    return x.select("ts", A.business_day_shift("ts", 1).alias("lag_1"), A.business_day_shift("ts", 5).alias("lag_5"))


@query("benchmark_ratio_join", oracle("s:symbol d:ts f:close f:base_close f:ratio", I.BARS, BASE, "SELECT * FROM ratios"))
def benchmark_ratio_join(spark, d):
    return A.benchmark_ratio(I.bars(spark, d), I.BENCHMARK).select("symbol", "ts", "close", "base_close", "ratio")


@query("positions_to_returns", oracle("s:candidate_id d:ts f:exposure f:strategy_return", I.BARS, I.RETS, S.POS_SQL, """
SELECT p.candidate_id, p.ts, p.exposure, p.exposure * coalesce(r.r, 0) AS strategy_return
FROM positions AS p LEFT JOIN rets AS r ON r.symbol = p.symbol AND r.ts = p.ts"""))
def positions_to_returns(spark, d):
    r = I.returns(I.bars(spark, d)).select("symbol", "ts", "r")
    return S.positions_to_returns(S.positions(spark, d), r).select("candidate_id", "ts", "exposure", "strategy_return")


@query("selected_asset_return", oracle("d:ts s:traded_asset f:asset_return", I.BARS, I.RETS,
    f"x AS (SELECT symbol, ts, r, {PCT('close', 63)} AS m FROM rets)",
    """pick AS (SELECT ts, coalesce(arg_max(symbol, (m, -ascii(symbol))) FILTER (m IS NOT NULL), 'N') AS traded_asset FROM x GROUP BY ts)""",
    "SELECT p.ts, p.traded_asset, coalesce(x.r, 0) AS asset_return FROM pick AS p LEFT JOIN x ON x.ts = p.ts AND x.symbol = p.traded_asset"))
def selected_asset_return(spark, d):
    x = I.returns(I.bars(spark, d)).withColumn("m", R.pct_change("close", 63))
    best = F.max(F.when(F.col("m").isNotNull(), F.struct("m", (-F.ascii("symbol")).alias("pos"), "symbol"))).alias("b")
    pick = x.groupBy("ts").agg(best).select("ts", F.coalesce("b.symbol", F.lit(I.BENCHMARK)).alias("traded_asset"))
    return S.selected_asset_return(pick, x.select("ts", F.col("symbol").alias("asset"), "r"))


@query("feature_name_semijoin", oracle("s:spec s:feature",
    "s AS (SELECT DISTINCT p_brand || '|threshold|' || p_size || '|1|1' AS spec, p_brand AS feature FROM part)",
    "f AS (SELECT p_brand AS feature FROM part GROUP BY 1 HAVING 2 * SUM(p_size) >= 51 * COUNT(*))",
    "SELECT spec, feature FROM s WHERE feature IN (SELECT feature FROM f)"))
def feature_name_semijoin(spark, d):
    part = I.table(spark, d, "part")
    specs = part.select(F.concat_ws("|", "p_brand", F.lit("threshold"), F.col("p_size").cast("string"), F.lit("1"), F.lit("1")).alias("spec"),
                        F.col("p_brand").alias("feature")).distinct()
    known = part.groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").alias("sizes"), F.count(F.lit(1)).alias("rows")).where("2 * sizes >= 51 * rows").select("feature")
    return A.keep_known_features(specs, known).select("spec", "feature")


@query("candidate_x_bars", oracle("s:candidate_id s:symbol i:rows i:hits", I.BARS, I.RETS, S.CAND_SQL, """
SELECT c.candidate_id, r.symbol, COUNT(*) AS rows, COUNT(*) FILTER (r.r > c.threshold) AS hits
FROM candidates AS c JOIN rets AS r ON r.symbol = c.symbol GROUP BY 1, 2"""))
def candidate_x_bars(spark, d):
    j = S.on_series(S.threshold_candidates(spark, d), I.returns(I.bars(spark, d)))
    return j.groupBy("candidate_id", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("r") > F.col("threshold")).alias("hits"))


@query("pairwise_candidate_join", oracle("s:left_id s:right_id i:n_obs f:corr", I.BARS, I.RETS, S.POS_SQL, S.SRET_SQL, """
SELECT * FROM (SELECT a.candidate_id AS left_id, b.candidate_id AS right_id, COUNT(*) AS n_obs, corr(a.strategy_return, b.strategy_return) AS corr
FROM sret AS a JOIN sret AS b ON a.ts = b.ts AND a.candidate_id < b.candidate_id GROUP BY 1, 2) WHERE abs(corr) >= 0.5"""))
def pairwise_candidate_join(spark, d):
    """Correlated pairs on common timestamps; tiles of candidates meet, only qualifying pairs leave a task."""
    e = PW.similar_pairs(S.strategy_returns(spark, d), min_corr=0.5, min_jaccard=2.0, min_share=0.0, min_obs=2)
    return e.select("left_id", "right_id", "n_obs", "corr")


@query("down_year_join", oracle("i:year f:asset_return f:base_return", I.BARS, """
y AS (SELECT symbol, year(ts) AS year, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2)""",
    "g AS (SELECT symbol, year, c / lag(c) OVER (PARTITION BY symbol ORDER BY year) - 1 AS r FROM y)",
    "SELECT a.year, a.r AS asset_return, b.r AS base_return FROM g AS a JOIN g AS b ON a.year = b.year WHERE a.symbol = 'A' AND b.symbol = 'N' AND a.r < 0 AND b.r < 0"))
def down_year_join(spark, d):
    return S.down_years(I.bars(spark, d), "A", I.BENCHMARK)


@query("align_to_decision", oracle("s:symbol d:decision_date f:month_return", I.BARS, I.RETS,
    "m AS (SELECT symbol, last_day(ts) AS ts, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2)",
    "g AS (SELECT symbol, ts, c / lag(c) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS month_return FROM m)",
    "dec AS (SELECT DISTINCT symbol, CAST(date_trunc('week', ts) + INTERVAL 4 DAY AS DATE) AS decision_date FROM bars)",
    "SELECT d.symbol, d.decision_date, g.month_return FROM dec AS d LEFT JOIN g ON g.symbol = d.symbol AND g.ts = d.decision_date"))
def align_to_decision(spark, d):
    b = I.bars(spark, d)
    m = b.groupBy("symbol", F.last_day("ts").alias("decision_date")).agg(F.max_by("close", "ts").alias("c"))
    g = m.select("symbol", "decision_date", R.pct_change("c", 1, order="decision_date").alias("month_return"))
    dec = b.select("symbol", F.date_add(F.trunc("ts", "week"), 4).alias("decision_date")).distinct()
    return dec.join(g, ["symbol", "decision_date"], "left")
