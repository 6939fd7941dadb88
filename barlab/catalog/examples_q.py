"""Resampling and decision examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.features import CUM, DAILY_SQL, O, W
from barlab.functions import rolling as R
from barlab.operators import align as A
from barlab.operators import examples as E
from barlab.plans import decisions as D
from barlab.plans import inputs as I
from barlab.plans import strategies as S
from barlab.registry import oracle
from barlab.registry import sharing_query as query

DF = " ".join(f"f:{c}" for c in D.FEATURES)
POL = " ".join(f"f:{c}" for c in D.POLITICAL_COLUMNS)

for _name, _label, _sql in (("week_fri", E.week_end, D.WEEK_END), ("month_end", E.month_end, "last_day(ts)"),
                            ("year_end", E.year_end, "make_date(year(ts), 12, 31)")):
    def _make(label):
        def run(spark, d):
            x = I.returns(I.bars(spark, d)).withColumn("sparse", F.when(F.col("r") > 0, F.col("r")))
            return E.resample_last(x, label("ts"), ["close", "sparse"])
        return run

    query(f"resample_{_name}", oracle("s:symbol d:period_end f:close f:sparse", I.BARS, I.RETS,
        f"SELECT symbol, {_sql} AS period_end, arg_max(close, ts) AS close, arg_max(r, ts) FILTER (r > 0) AS sparse FROM rets GROUP BY 1, 2"))(_make(_label))


@query("examples_monthly", oracle(f"s:symbol d:decision_date d:target_end f:close f:next_return i:target_year i:target_month f:month_number f:quarter_number s:period {DF} {POL}",
    I.BARS, I.RETS, DAILY_SQL, D.MONTHLY_SQL, "SELECT * FROM monthly"))
def examples_monthly(spark, d):
    return D.monthly(spark, d).drop("target_week", "calendar_week")


@query("examples_weekly", oracle(f"s:symbol d:decision_date d:target_end f:close f:next_return i:target_year i:target_month i:target_week f:month_number f:quarter_number f:calendar_week s:period b:sp500_down_year b:locked_period {DF} {POL}",
    I.BARS, I.RETS, DAILY_SQL, D.WEEKLY_SQL, "SELECT * FROM weekly"))
def examples_weekly(spark, d):
    return D.weekly(spark, d)


@query("examples_annual", oracle(f"s:symbol d:decision_date f:close f:return_next_year i:target_year b:target_positive {DF} {POL}",
    I.BARS, I.RETS, DAILY_SQL, D.ANNUAL_SQL, "SELECT * FROM annual"))
def examples_annual(spark, d):
    return D.annual(spark, d)


@query("asset_momentum", oracle("s:symbol d:period_end f:close f:next_return f:mom_4 f:mom_13 f:mom_26 f:mom_52 f:vol",
    I.BARS, D.ASSETS_SQL, "SELECT * FROM weekly_assets"))
def asset_momentum(spark, d):
    return D.weekly_assets(spark, d)


@query("asset_momentum_monthly", oracle("s:symbol d:period_end f:close f:next_return f:mom_3 f:mom_6 f:mom_12 f:vol", I.BARS,
    "m AS (SELECT symbol, last_day(ts) AS period_end, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)",
    "mr AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY period_end) - 1 AS r FROM m)",
    """SELECT symbol, period_end, close, lead(close) OVER w / close - 1 AS next_return, close / lag(close, 3) OVER w - 1 AS mom_3,
       close / lag(close, 6) OVER w - 1 AS mom_6, close / lag(close, 12) OVER w - 1 AS mom_12,
       CASE WHEN COUNT(r) OVER w3 >= 3 THEN stddev_samp(r) OVER w3 * sqrt(12.0) END AS vol
       FROM mr WINDOW w AS (PARTITION BY symbol ORDER BY period_end), w3 AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def asset_momentum_monthly(spark, d):
    m = E.resample_last(I.bars(spark, d), E.month_end("ts"), ["close"])
    return E.asset_momentum(E.spine(m, "month"), (3, 6, 12), 3, 12.0)


@query("calendar_cycle", oracle("s:symbol i:target_year f:month_number f:quarter_number f:january_return f:first_5_days_return f:santa_rally_return f:year_after_negative_year f:consecutive_positive_years", I.BARS,
    "x AS (SELECT symbol, ts, close, year(ts) AS y, row_number() OVER (PARTITION BY symbol, year(ts) ORDER BY ts) AS a, row_number() OVER (PARTITION BY symbol, year(ts) ORDER BY ts DESC) AS z FROM bars)",
    """g AS (SELECT symbol, y, CASE WHEN COUNT(*) FILTER (month(ts) = 1) >= 2 THEN arg_max(close, ts) FILTER (month(ts) = 1) / arg_min(close, ts) FILTER (month(ts) = 1) - 1 END AS jan,
        CASE WHEN COUNT(*) FILTER (a <= 5) >= 2 THEN arg_max(close, ts) FILTER (a <= 5) / arg_min(close, ts) FILTER (a <= 5) - 1 END AS f5,
        CASE WHEN COUNT(*) >= 2 THEN arg_max(close, ts) / arg_min(close, ts) - 1 END AS yr,
        arg_min(close, ts) FILTER (z <= 5) AS tail5, arg_max(close, ts) FILTER (a <= 2) AS head2 FROM x GROUP BY 1, 2)""",
    """SELECT g.symbol, g.y + 1 AS target_year, 12 AS month_number, 4 AS quarter_number, g.jan AS january_return, g.f5 AS first_5_days_return,
        g.head2 / p.tail5 - 1 AS santa_rally_return, CASE WHEN g.yr < 0 THEN 1 ELSE 0 END AS year_after_negative_year,
        g.y - coalesce((SELECT MAX(b.y) FROM g AS b WHERE b.symbol = g.symbol AND b.y <= g.y AND (b.yr IS NULL OR b.yr <= 0)), (SELECT MIN(b.y) - 1 FROM g AS b WHERE b.symbol = g.symbol)) AS consecutive_positive_years
        FROM g LEFT JOIN g AS p ON p.symbol = g.symbol AND p.y = g.y - 1"""))
def calendar_cycle(spark, d):
    return E.calendar_cycle(I.bars(spark, d))


@query("political_cycle", oracle(f"i:target_year {POL}", "y AS (SELECT DISTINCT year(o_orderdate) + 20 AS target_year FROM orders UNION SELECT DISTINCT year(o_orderdate) FROM orders)",
    f"SELECT target_year, {D._political_sql('target_year')} FROM y"))
def political_cycle(spark, d):
    y = I.table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    years = y.select(F.explode(F.array(F.col("y"), F.col("y") + 20)).alias("target_year")).distinct()
    return E.political(years)


@query("annual_derived", oracle("s:symbol i:target_year s:feature f:value f:annual_change_1y f:annual_change_3y f:annual_percentile",
    I.BARS, I.RETS, DAILY_SQL, D.ANNUAL_SQL,
    "u AS (" + " UNION ALL ".join(f"SELECT symbol, target_year, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM annual" for c in D.FEATURES) + ")",
    "k AS (SELECT symbol, feature FROM u GROUP BY 1, 2 HAVING COUNT(value) >= 4 AND COUNT(DISTINCT value) >= 3)",
    "v AS (SELECT u.* FROM u SEMI JOIN k ON u.symbol = k.symbol AND u.feature = k.feature)",
    """SELECT *, value - lag(value) OVER w AS annual_change_1y, value - lag(value, 3) OVER w AS annual_change_3y, CAST(NULL AS DOUBLE) AS annual_percentile
       FROM v WINDOW w AS (PARTITION BY symbol, feature ORDER BY target_year)"""))
def annual_derived(spark, d):
    return E.annual_derived(D.annual(spark, d), D.FEATURES)


@query("pad_to_manifest", oracle("s:symbol i:target_year f:sp500_return_21d f:buyback_yield f:hy_oas", I.BARS, I.RETS, DAILY_SQL, D.ANNUAL_SQL,
    "SELECT symbol, target_year, sp500_return_21d, NULL AS buyback_yield, NULL AS hy_oas FROM annual"))
def pad_to_manifest(spark, d):
    x = D.annual(spark, d).select("symbol", "target_year", "sp500_return_21d")
    return E.pad_columns(x, ["sp500_return_21d", "buyback_yield", "hy_oas"])


@query("horizon_return", oracle("s:symbol d:ts f:next_return f:h5", I.BARS, I.RETS,
    f"x AS (SELECT symbol, ts, lead(close) OVER {O} / close - 1 AS nr FROM rets)",
    """SELECT symbol, ts, nr AS next_return, CASE WHEN COUNT(nr) OVER w = 5 THEN product(1 + nr) OVER w - 1 END AS h5
       FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"""))
def horizon_return(spark, d):
    x = I.bars(spark, d).withColumn("next_return", R.ratio(R.lead("close"), "close") - 1.0)
    return x.select("symbol", "ts", "next_return", E.horizon_return("next_return", 5).alias("h5"))


@query("target_shift", oracle("s:symbol d:ts f:direction f:strong_return f:avoid_drawdown", I.BARS, I.RETS,
    "q AS (SELECT symbol, quantile_cont(r, 0.6) AS q60, quantile_cont(r, 0.3) AS q30 FROM rets GROUP BY 1)",
    "SELECT symbol, ts, r AS direction, r - q60 AS strong_return, r - q30 AS avoid_drawdown FROM rets JOIN q USING (symbol)"))
def target_shift(spark, d):
    x = I.returns(I.bars(spark, d)).select("symbol", "ts", "r")
    for t in ("direction", "strong_return", "avoid_drawdown"):
        x = E.target_shift(x, "r", t).withColumnRenamed("target", t)
    return x.drop("r")


@query("subperiod_blocks", oracle("s:symbol i:block i:rows d:first_ts d:last_ts", I.BARS,
    f"x AS (SELECT symbol, ts, ntile(6) OVER {O} AS block FROM bars)",
    "SELECT symbol, block, COUNT(*) AS rows, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM x GROUP BY 1, 2"))
def subperiod_blocks(spark, d):
    return E.blocks(I.bars(spark, d), 6).groupBy("symbol", "block").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("asset_close_reconstruct", oracle("s:symbol d:period_end f:close", I.BARS,
    "rt AS (SELECT b.symbol, b.ts, b.close / nullif(n.close, 0) AS ratio, n.close AS base FROM bars AS b JOIN bars AS n ON n.symbol = 'N' AND n.ts = b.ts WHERE b.symbol <> 'N')",
    "ok AS (SELECT symbol FROM rt GROUP BY 1 HAVING COUNT(ratio * base) >= 104)",
    f"SELECT symbol, {D.WEEK_END} AS period_end, arg_max(ratio * base, ts) AS close FROM rt WHERE symbol IN (SELECT symbol FROM ok) GROUP BY 1, 2"))
def asset_close_reconstruct(spark, d):
    r = A.benchmark_ratio(I.bars(spark, d), I.BENCHMARK).where("symbol <> 'N'")
    c = r.select("symbol", "ts", (F.col("ratio") * F.col("base_close")).alias("close"))
    ok = c.groupBy("symbol").agg(F.count("close").alias("n")).where("n >= 104").select("symbol")
    return E.resample_last(c.join(ok, "symbol", "left_semi"), E.week_end("ts"), ["close"])


@query("aligned_xy", oracle("s:symbol d:ts f:next_return f:x1 f:x2", I.BARS, I.RETS, DAILY_SQL, f"""
y AS (SELECT symbol, ts, lead(close) OVER {O} / close - 1 AS nr FROM bars)""",
    "SELECT y.symbol, y.ts, y.nr AS next_return, f.sp500_return_21d AS x1, f.realized_vol_21d AS x2 FROM y LEFT JOIN daily_features AS f ON f.symbol = y.symbol AND f.ts = y.ts WHERE y.nr IS NOT NULL"))
def aligned_xy(spark, d):
    y = I.bars(spark, d).select("symbol", "ts", (R.ratio(R.lead("close"), "close") - 1.0).alias("next_return"))
    f = D.featured(spark, d, None).select("symbol", "ts", F.col("sp500_return_21d").alias("x1"), F.col("realized_vol_21d").alias("x2"))
    return y.join(f, ["symbol", "ts"], "left").dropna(subset=["next_return"])
