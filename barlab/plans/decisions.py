"""Decision-example fixtures over the derived bars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.operators import examples as E
from barlab.operators import features as X
from barlab.plans import inputs as I

FEATURES = (
    "sp500_return_21d",
    "sp500_return_63d",
    "sp500_distance_sma_50",
    "sp500_drawdown_current",
    "realized_vol_21d",
    "sp500_above_sma_50",
)
SPEC_FEATURES = (*FEATURES, "month_number", "presidential_cycle_year")


def featured(spark: SparkSession, sf_dir: str, symbol: str | None = I.BENCHMARK) -> DataFrame:
    def build() -> DataFrame:
        return X.daily_features(I.bars(spark, sf_dir)).select("symbol", "ts", "close", *FEATURES)

    f = I.shared(f"featured:{sf_dir}", build)
    return f if symbol is None else f.where(F.col("symbol") == symbol)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly examples of the benchmark, with locked and down-year flags."""
    return I.shared(f"weekly:{sf_dir}", lambda: _weekly(spark, sf_dir))


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.bars(spark, sf_dir)
    from barlab.plans.strategies import down_years

    ex = E.decision_examples(featured(spark, sf_dir), E.week_end("ts"), FEATURES)
    ex = E.political(E.target_parts(ex))
    down = down_years(b, I.BENCHMARK, I.BENCHMARK).select(F.col("year").alias("target_year"), F.lit(True).alias("_down"))
    return (
        ex.join(down, "target_year", "left")
        .withColumns(
            {
                "sp500_down_year": F.coalesce("_down", F.lit(False)),
                "locked_period": F.col("target_end") >= F.lit(I.LOCKED_START).cast("date"),
                "period": E.period_label(F.col("target_end"), I.TRAIN_END, I.VALIDATION_END),
            }
        )
        .drop("_down")
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.shared(f"monthly:{sf_dir}", lambda: _monthly(spark, sf_dir))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = E.decision_examples(featured(spark, sf_dir), E.month_end("ts"), FEATURES)
    ex = E.political(E.target_parts(ex))
    return ex.withColumn("period", E.period_label(F.col("target_end"), I.TRAIN_END, I.VALIDATION_END))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual examples of every symbol."""
    return I.shared(f"annual:{sf_dir}", lambda: _annual(spark, sf_dir))


def _annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = E.annual_examples(featured(spark, sf_dir, None), FEATURES)
    return E.political(ex)


def weekly_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, period_end, close, next_return, mom_4, mom_13, mom_26, mom_52, vol) per calendar week."""
    return I.shared(f"weekly_assets:{sf_dir}", lambda: _weekly_assets(spark, sf_dir))


def _weekly_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = E.resample_last(I.bars(spark, sf_dir), E.week_end("ts"), ["close"])
    return E.asset_momentum(E.spine(w, "week"), (4, 13, 26, 52), 13, 52.0)


def _political_sql(y: str) -> str:
    def party(r):
        return "CASE WHEN " + " OR ".join(f"{y} BETWEEN {a} AND {b}" for a, b in r) + " THEN 1 ELSE -1 END"

    p, h, s = party(E.REPUBLICAN_PRESIDENT), party(E.REPUBLICAN_HOUSE), party(E.REPUBLICAN_SENATE)
    c = f"((({y} - 1981) % 4) + 1)"
    return (
        f"{c} AS presidential_cycle_year, CASE WHEN {c} = 4 THEN 1 ELSE 0 END AS is_election_year, "
        f"CASE WHEN {c} = 1 THEN 1 ELSE 0 END AS is_post_election_year, CASE WHEN {c} = 2 THEN 1 ELSE 0 END AS midterm_year_dummy, "
        f"CASE WHEN {c} = 4 THEN 1 ELSE 0 END AS election_year_dummy, {p} AS president_party, {h} AS house_control_party, "
        f"{s} AS senate_control_party, CASE WHEN ({h}) <> ({s}) THEN 1 ELSE 0 END AS split_congress, "
        f"CASE WHEN ({h}) = ({s}) AND ({s}) = ({p}) THEN 1 ELSE 0 END AS unified_government"
    )


POLITICAL_COLUMNS = (
    "presidential_cycle_year is_election_year is_post_election_year midterm_year_dummy election_year_dummy president_party "
    "house_control_party senate_control_party split_congress unified_government"
).split()

WEEK_END = "CAST(ts + INTERVAL 1 DAY * ((12 - isodow(ts)) % 7) AS DATE)"


def _example_sql(name: str, label: str, source: str) -> list[str]:
    feats = ", ".join(f"arg_max_null({c}, ts) AS {c}" for c in FEATURES)
    return [
        f"{name}_per AS (SELECT symbol, {label} AS decision_date, arg_max(close, ts) AS close, {feats} FROM {source} GROUP BY 1, 2)",
        f"""{name}_nxt AS (SELECT *, lead(decision_date) OVER (PARTITION BY symbol ORDER BY decision_date) AS target_end,
          lead(close) OVER (PARTITION BY symbol ORDER BY decision_date) / close - 1 AS next_return FROM {name}_per)""",
        f"""{name} AS (SELECT *, year(target_end) AS target_year, month(target_end) AS target_month, weekofyear(target_end) AS target_week,
          CAST(month(target_end) AS DOUBLE) AS month_number, CAST(quarter(target_end) AS DOUBLE) AS quarter_number,
          CAST(weekofyear(target_end) AS DOUBLE) AS calendar_week, {_political_sql('year(target_end)')},
          CASE WHEN target_end <= DATE '{I.TRAIN_END}' THEN 'train' WHEN target_end <= DATE '{I.VALIDATION_END}' THEN 'validation' ELSE 'locked' END AS period
          FROM {name}_nxt WHERE target_end IS NOT NULL)""",
    ]


DOWN_SQL = [
    "year_close AS (SELECT symbol, year(ts) AS year, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2)",
    "year_ret AS (SELECT symbol, year, c / lag(c) OVER (PARTITION BY symbol ORDER BY year) - 1 AS r FROM year_close)",
    "down_years AS (SELECT year FROM year_ret WHERE symbol = 'N' AND r < 0)",
]
FEATURED_N = ["feat_n AS (SELECT * FROM daily_features WHERE symbol = 'N')"]
WEEKLY_SQL = [
    *DOWN_SQL,
    *FEATURED_N,
    *_example_sql("wk", WEEK_END, "feat_n"),
    "weekly AS (SELECT *, target_year IN (SELECT year FROM down_years) AS sp500_down_year, target_end >= DATE '2001-01-01' AS locked_period FROM wk)",
]
MONTHLY_SQL = [*FEATURED_N, *_example_sql("monthly", "last_day(ts)", "feat_n")]
ANNUAL_SQL = [
    "an_per AS (SELECT symbol, year(ts) AS year, MAX(ts) AS decision_date, arg_max(close, ts) AS close, "
    + ", ".join(f"arg_max_null({c}, ts) AS {c}" for c in FEATURES) + " FROM daily_features GROUP BY 1, 2)",
    """an_nxt AS (SELECT *, lead(year) OVER (PARTITION BY symbol ORDER BY year) AS target_year,
      lead(close) OVER (PARTITION BY symbol ORDER BY year) / close - 1 AS return_next_year FROM an_per)""",
    f"annual AS (SELECT *, return_next_year > 0 AS target_positive, {_political_sql('target_year')} FROM an_nxt WHERE target_year = year + 1)",
]
_WO = "(PARTITION BY symbol ORDER BY period_end)"
ASSETS_SQL = [
    f"wk_close AS (SELECT symbol, {WEEK_END} AS period_end, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)",
    """wk_spine AS (SELECT s.symbol, CAST(d.d AS DATE) AS period_end FROM (SELECT symbol, MIN(period_end) AS a, MAX(period_end) AS b FROM wk_close GROUP BY 1) AS s,
       generate_series(s.a, s.b, INTERVAL 7 DAY) AS d(d))""",
    "wk_full AS (SELECT s.symbol, s.period_end, c.close FROM wk_spine AS s LEFT JOIN wk_close AS c ON c.symbol = s.symbol AND c.period_end = s.period_end)",
    f"wk_r AS (SELECT *, close / lag(close) OVER {_WO} - 1 AS r FROM wk_full)",
    f"""weekly_assets AS (SELECT symbol, period_end, close, lead(close) OVER {_WO} / close - 1 AS next_return,
      {', '.join(f'close / lag(close, {n}) OVER {_WO} - 1 AS mom_{n}' for n in (4, 13, 26, 52))},
      CASE WHEN COUNT(r) OVER (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) >= 13
        THEN stddev_samp(r) OVER (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) * sqrt(52.0) END AS vol FROM wk_r)""",
]
