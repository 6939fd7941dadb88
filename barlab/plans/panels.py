"""Composed panels: several alignment and window operators over one calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions import rolling as R
from barlab.operators import align as A
from barlab.operators import features as X
from barlab.plans import inputs as I

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# Which macro-style column names each order-priority series stands in for.
RATE_COLUMNS = {
    0: ["fed_funds", "cpi", "gold", "vix_level", "m2", "hy_oas", "baa_aaa_spread"],
    1: ["treasury_3m", "core_cpi", "copper", "vix3m_level", "fed_balance_sheet", "ig_oas", "unemployment"],
    2: ["yield_2y", "pce", "oil", "cape", "treasury_general_account", "initial_claims", "industrial_production"],
    3: ["yield_10y", "yield_5y", "dxy_proxy", "earnings_yield", "reverse_repo_level", "payrolls", "real_gdp"],
    4: ["yield_30y", "dividend_yield", "buyback_yield", "lei", "eps_ttm"],
}
RATE_NAMES = {c for cols in RATE_COLUMNS.values() for c in cols}


def rate_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark bars with the five daily series aligned, forward-filled and named."""
    obs = I.orders_daily(spark, sf_dir)
    wide = obs.groupBy("ts").pivot("series", list(PRIORITIES)).agg(F.max("value"))
    wide = wide.select("ts", *[F.col(f"`{p}`").alias(f"x{i}") for i, p in enumerate(PRIORITIES)])
    base = I.bars(spark, sf_dir).where(F.col("symbol") == I.BENCHMARK)
    filled = A.align_ffill(base, wide, [f"x{i}" for i in range(len(PRIORITIES))])
    named = [F.col(f"x{i}").alias(c) for i, cols in RATE_COLUMNS.items() for c in cols]
    return filled.select("symbol", "ts", "close", *named)


def pair_ratios(bars: DataFrame, pairs, windows=(21, 63, 126)) -> DataFrame:
    """Level and returns of named close ratios; a pair with a missing leg yields no rows."""
    legs = F.array(*[F.struct(F.lit(n).alias("pair"), F.lit(a).alias("l"), F.lit(b).alias("r")) for n, a, b in pairs])
    sides = bars.select("ts", "symbol", "close", F.inline(legs))
    both = (
        sides.where((F.col("symbol") == F.col("l")) | (F.col("symbol") == F.col("r")))
        .groupBy("pair", "ts")
        .agg(
            F.max(F.when(F.col("symbol") == F.col("l"), F.col("close"))).alias("lc"),
            F.max(F.when(F.col("symbol") == F.col("r"), F.col("close"))).alias("rc"),
        )
        .where("lc IS NOT NULL AND rc IS NOT NULL")
        .withColumn("level", R.ratio("lc", "rc"))
    )
    return both.select("pair", "ts", "level", *[R.pct_change("level", n, ("pair",)).alias(f"ret_{n}") for n in windows])


def filled_series(bars: DataFrame, benchmark: str, assets: list[str]) -> DataFrame:
    """(ts, symbol, close, base): every asset on every benchmark day, its last close carried on, beside the benchmark's close."""
    days = bars.where(F.col("symbol") == benchmark).select("ts", F.col("close").alias("base"))
    spine = days.withColumn("symbol", F.explode(F.array(*[F.lit(a) for a in assets])))
    x = spine.join(bars.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    return x.withColumn("close", R.forward_fill("close"))


def market_panel(bars, raw_bars, benchmark: str, assets: list[str], pairs=(), macro: DataFrame | None = None, windows=X.FEATURE_WINDOWS) -> DataFrame:
    """One row per benchmark day: structure, calendar, asset, pair, macro and base columns.

    Windows run in long form, per (asset, day), so assets spread over tasks with one sort each; the columns are pivoted last.
    ``macro`` has ts, already lagged to its publication, and value.
    """
    shape = X.calendar(X.bar_structure(raw_bars.where(F.col("symbol") == benchmark)).drop("open", "high", "low", "close", "volume"))
    long = filled_series(bars, benchmark, [*assets, benchmark])
    x = long.withColumn("_r", R.pct_change("close"))
    one = {"close_ratio": R.ratio("close", "base"), "ret_1": F.col("_r")}
    for n in windows:
        one |= {f"ret_{n}": R.pct_change("close", n), f"vol_{n}": R.std("_r", n), f"base_ret_{n}": R.pct_change("base", n) - R.pct_change("close", n), f"drawdown_{n}": R.drawdown("close", n)}
    x = x.withColumns(one)
    wide = x.groupBy("ts").pivot("symbol", [*assets, benchmark]).agg(*[F.max(k).alias(k) for k in one])
    named = {}
    for a in assets:
        named |= {f"{a.lower()}_{k}": f"{a}_{k}" for k in ("close_ratio", "ret_1", *[f"{m}_{n}" for m in ("ret", "vol") for n in windows])}
        named |= {f"base_vs_{a.lower()}_ret_{n}": f"{a}_base_ret_{n}" for n in windows}
    named |= {f"base_{m}_{n}": f"{benchmark}_{m}_{n}" for m in ("ret", "vol", "drawdown") for n in windows}
    out = shape.join(wide.select("ts", *[F.col(f"`{old}`").alias(new) for new, old in named.items()]), "ts")
    if pairs:
        p = pair_ratios(long, pairs)
        p = p.groupBy("ts").pivot("pair", [n for n, _, _ in pairs]).agg(*[F.max(c).alias(c) for c in p.columns if c not in ("pair", "ts")])
        out = out.join(p, "ts", "left")
    if macro is not None:
        out = A.align_ffill(out, macro.select("ts", F.col("value").alias("macro_value")), ["macro_value"]).withColumn("macro_change_63", R.diff("macro_value", 63))
    return out


def annual_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark bars with index-relative returns, lagged macro values and derived spreads."""
    lagged = A.dedupe_mean(A.publication_lag(I.macro_monthly(spark, sf_dir), 5)).withColumnRenamed("value", "macro_value")
    small = I.bars(spark, sf_dir).where("symbol = 'A'").select("ts", F.col("close").alias("small"))
    p = A.align_ffill(rate_panel(spark, sf_dir), small, ["small"])
    p = A.align_ffill(p, lagged, ["macro_value"])
    return p.withColumns(
        {
            "ret_252": R.pct_change("close", 252),
            "rel_ret_252": R.pct_change("small", 252) - R.pct_change("close", 252),
            "hy_minus_ig": F.col("hy_oas") - F.col("ig_oas"),
            "ten_minus_two": F.col("yield_10y") - F.col("yield_2y"),
            "cap_to_gdp": R.ratio("close", "macro_value"),
            "issuance_yield": R.ratio(-F.col("m2"), "close"),
        }
    )
