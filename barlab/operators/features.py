"""Daily feature panels: rolling windows, ratios, calendar and macro-style columns.

Each function adds columns to a bar or panel frame. Columns that share a window spec are added in one
``select`` so Spark sorts every series once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import rolling as R

FEATURE_WINDOWS = (5, 10, 20, 21, 60, 63, 126, 252)


def add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def flag(cond: Column) -> Column:
    """1.0 where true; false and unknown are 0.0."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def trend_columns(x="close", windows=FEATURE_WINDOWS, prefix="") -> dict[str, Column]:
    return {f"{prefix}ret_{n}": R.pct_change(x, n) for n in windows}


def bar_structure(df: DataFrame) -> DataFrame:
    """Range, gap, intraday and volume shape of each bar."""
    h, lo, o, c, v = (F.col(k) for k in ("high", "low", "open", "close", "volume"))
    prev = R.lag("close")
    gap = R.ratio(o, prev) - 1.0
    intraday = R.ratio(c, o) - 1.0
    return add(
        df,
        {
            "range_high_low": R.ratio(h, lo) - 1.0,
            "range_intraday_norm_close": R.ratio(h - lo, c),
            "gap_overnight": gap,
            "return_intraday_open_close": intraday,
            "return_overnight_close_open": gap,
            "opening_range_proxy": R.ratio(h - o, c),
            "dollar_volume": c * v,
            "close_location": R.ratio(c - lo, h - lo),
            "intraday_reversal": F.signum(gap) * -F.signum(intraday),
        },
    )


def range_volatility(df: DataFrame, n: int = 20) -> DataFrame:
    """Parkinson, Garman-Klass and Rogers-Satchell volatility over ``n`` bars."""
    h, lo, o, c = (F.col(k) for k in ("high", "low", "open", "close"))
    hl2 = F.pow(F.ln(h / lo), 2)
    steps = add(
        df,
        {
            "_pk": hl2 / R.PARKINSON,
            "_gk": 0.5 * hl2 - R.GARMAN_KLASS * F.pow(F.ln(c / o), 2),
            "_rs": F.ln(h / o) * F.ln(h / c) + F.ln(lo / o) * F.ln(lo / c),
        },
    )

    def root(x):
        m = R.mean(x, n)
        return F.when(m >= 0, F.sqrt(m))

    return add(
        steps,
        {
            f"vol_parkinson_{n}": root("_pk"),
            f"vol_garman_klass_{n}": root("_gk"),
            f"vol_rogers_satchell_{n}": root("_rs"),
        },
    ).drop("_pk", "_gk", "_rs")


def true_range(df: DataFrame, n: int = 14) -> DataFrame:
    prev = R.lag("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return add(add(df, {"true_range": tr}), {f"atr_{n}": R.mean("true_range", n)})


def activity(df: DataFrame) -> DataFrame:
    """Range expansion, relative volume and gap clustering."""
    base = add(
        df,
        {
            "_range": R.ratio("high", "low") - 1.0,
            "_gap": F.abs(R.ratio("open", R.lag("close")) - 1.0),
        },
    )
    return add(
        base,
        {
            "range_expansion_20": R.ratio("_range", R.mean("_range", 20)) - 1.0,
            "relative_volume_20": R.ratio("volume", R.mean("volume", 20)) - 1.0,
            "gap_cluster_5": R.mean("_gap", 5),
        },
    ).drop("_range", "_gap")


def calendar(df: DataFrame, ts="ts") -> DataFrame:
    d = F.col(ts)
    dom, month, dow = F.dayofmonth(d), F.month(d), F.weekday(d)
    last = F.last_day(d) == F.to_date(d)
    return add(
        df,
        {
            "calendar_month": month.cast("double"),
            "calendar_week": F.weekofyear(d).cast("double"),
            "calendar_day_of_week": dow.cast("double"),
            "calendar_turn_of_month": flag((dom <= 3) | (dom >= 28)),
            "calendar_quarter_end": flag(last & (month % 3 == 0)),
            "calendar_year_end": flag(last & (month == 12)),
            "calendar_january": flag(month == 1),
            "calendar_sell_in_may": flag(month.between(5, 10)),
            "calendar_opex_week_proxy": flag(dom.between(15, 21) & (dow == 4)),
        },
    )


def level_change_z(df: DataFrame, col: str, prefix: str, by=("symbol",)) -> DataFrame:
    """Level, differences and z-scores over 5, 21 and 63 rows."""
    out = {prefix: F.col(col)}
    for n in (5, 21, 63):
        out[f"{prefix}_chg_{n}"] = R.diff(col, n, by)
        out[f"{prefix}_z_{n}"] = R.zscore(col, n, by=by)
    return add(df, out)


def spread(df: DataFrame, left: str, right: str, name: str, by=("symbol",)) -> DataFrame:
    """Difference of two columns with its changes and z-scores; unchanged when a leg is missing."""
    if left not in df.columns or right not in df.columns:
        return df
    return level_change_z(df.withColumn("_spread", F.col(left) - F.col(right)), "_spread", name, by).drop("_spread")


def rolling_moments(df: DataFrame, x: str = "r", windows=(5, 10, 20, 60, 126), wide: int = 30) -> DataFrame:
    """Mean, deviation, bias-corrected skewness and kurtosis, minimum and maximum per window.

    Short windows use plain frames. Windows longer than ``wide`` take their moments from running power
    sums, which cost the same per row at any length.
    """
    out = {}
    for n in windows:
        out |= {f"{x}_min_{n}": R.low(x, n), f"{x}_max_{n}": R.high(x, n)}
        if n <= wide:
            out |= {
                f"{x}_mean_{n}": R.mean(x, n),
                f"{x}_std_{n}": R.std(x, n, ddof=1),
                f"{x}_skew_{n}": R.skew(x, n),
                f"{x}_kurt_{n}": R.kurt(x, n),
            }
    y = add(df, out)
    for n in windows:
        if n > wide:
            y = _power_moments(y, x, n)
    return y


def _power_moments(df: DataFrame, x: str, n: int) -> DataFrame:
    p = R.prefix_sums(df, [x], n, (1, 2, 3, 4))
    k = F.col(f"_n_{x}").cast("double")
    m = F.col(f"_p1_{x}") / F.nullif(k, F.lit(0.0))
    e2, e3, e4 = (F.col(f"_p{i}_{x}") / F.nullif(k, F.lit(0.0)) for i in (2, 3, 4))
    v = e2 - m * m
    c3 = e3 - 3 * m * e2 + 2 * m * m * m
    c4 = e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m
    pos = F.when(v > 1e-24, v)
    full = F.col(f"_n_{x}") >= n
    skew = F.sqrt(k * (k - 1)) / (k - 2) * c3 / F.pow(pos, 1.5)
    kurt = (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * (c4 / (pos * pos) - 3) + 6)
    out = {
        f"{x}_mean_{n}": m + F.col(f"_c_{x}"),
        f"{x}_std_{n}": F.sqrt(F.greatest(v, F.lit(0.0)) * k / (k - 1)),
        f"{x}_skew_{n}": skew,
        f"{x}_kurt_{n}": kurt,
    }
    cols = {c: F.when(full, e) for c, e in out.items()}
    return add(p, cols).drop(f"_n_{x}", f"_c_{x}", *[f"_p{i}_{x}" for i in (1, 2, 3, 4)])


def bollinger(df: DataFrame, x: str = "close", n: int = 20, width: float = 2.0) -> DataFrame:
    mid, sd = R.mean(x, n), R.std(x, n, ddof=1)
    upper, lower = mid + width * sd, mid - width * sd
    return add(df, {"bb_mid": mid, "bb_upper": upper, "bb_lower": lower, "bb_width": R.ratio(upper - lower, mid)})


def price_action(df: DataFrame) -> DataFrame:
    """Gap, body, range and close position of each bar."""
    prev = R.lag("close")
    c, o, h, lo = (F.col(k) for k in ("close", "open", "high", "low"))
    return add(
        df,
        {
            "pa_gap": R.ratio(o, prev) - 1.0,
            "pa_body": R.ratio(c, o) - 1.0,
            "pa_range": R.ratio(h - lo, c),
            "pa_close_pos": R.ratio(c - lo, h - lo),
            "pa_overnight": R.ratio(o - prev, prev),
        },
    )


def daily_features(df: DataFrame) -> DataFrame:
    """Trend, average-distance, volatility and drawdown columns of the benchmark panel."""
    base = add(df, {"_r": R.pct_change("close")})
    year = math.sqrt(252.0)
    sma = {n: R.mean("close", n, mp) for n, mp in ((50, 20), (100, 50), (200, 100))}
    high_year = R.high("close", 252, 63)
    vol21 = R.std("_r", 21, 10) * year
    vol63, vol252 = R.std("_r", 63, 21), R.std("_r", 252, 63)
    out = {f"sp500_return_{n}d": R.pct_change("close", n) for n in (21, 63, 126, 252, 504)}
    out |= {f"sp500_above_sma_{n}": flag(F.col("close") > m) for n, m in sma.items()}
    out |= {f"sp500_distance_sma_{n}": R.ratio("close", sma[n]) - 1.0 for n in (50, 200)}
    out |= {
        "sp500_52w_high_distance": R.ratio("close", high_year) - 1.0,
        "sp500_drawdown_current": R.drawdown("close"),
        "realized_vol_21d": vol21,
        "realized_vol_63d": vol63 * year,
        "realized_vol_126d": R.std("_r", 126, 42) * year,
        "realized_vol_252d": vol252 * year,
        "spy_return_3m": R.pct_change("close", 63),
        "spy_return_6m": R.pct_change("close", 126),
        "spy_return_12m": R.pct_change("close", 252),
        "spy_return_36m": R.pct_change("close", 756),
        "spy_vol_3m": vol63,
        "spy_vol_12m": vol252,
        "spy_drawdown_12m": R.ratio("close", high_year) - 1.0,
    }
    staged = add(base, out)
    spike = flag(F.col("realized_vol_21d") > R.quantile("realized_vol_21d", 252, 0.95, 63))
    return add(staged, {"volatility_spike_dummy": spike}).drop("_r")


def generic_change_z(df: DataFrame, columns: list[str], min_obs: int = 120) -> DataFrame:
    """Level, 252-row change and three-year z-score of extra columns, one row per feature.

    Works on the unpivoted panel: one window serves every column, and columns with too few
    observations drop out on a grouped count.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select("symbol", "ts", F.inline(pairs))
    by = ("symbol", "feature")
    seen = F.count("value").over(Window.partitionBy(*by))
    return (
        long.withColumns(
            {
                "obs": seen,
                "change_12m": R.diff("value", 252, by),
                "z_3y": R.zscore("value", 756, 126, by=by),
            }
        )
        .where(F.col("obs") >= min_obs)
        .drop("obs")
    )


# Canonical name on the left, source column on the right (fixed values).
FEATURE_ALIASES = {
    "vix_level": "vix_level",
    "vix3m_level": "vix3m_level",
    "cape_ratio": "cape",
    "pe_ttm": "pe_ttm",
    "earnings_yield": "earnings_yield",
    "dividend_yield": "dividend_yield",
    "buyback_yield": "buyback_yield",
    "market_cap_to_gdp": "market_cap_to_gdp",
    "fed_funds_rate": "fed_funds",
    "treasury_3m": "treasury_3m",
    "treasury_2y": "yield_2y",
    "yield_5y": "yield_5y",
    "treasury_10y": "yield_10y",
    "treasury_30y": "yield_30y",
    "high_yield_oas": "hy_oas",
    "investment_grade_oas": "ig_oas",
    "baa_aaa_spread": "baa_aaa_spread",
    "excess_bond_premium": "excess_bond_premium",
    "consumer_confidence": "consumer_confidence",
    "unemployment_rate": "unemployment",
    "ism_manufacturing": "ism_manufacturing",
    "recession_dummy": "recession_dummy",
    "money_market_assets": "money_market_assets",
    "financial_conditions_index": "financial_conditions_index",
    "stl_fed_stress_index": "financial_stress",
}


def feature_aliases(df: DataFrame) -> DataFrame:
    """Copy every source column that is present to its canonical name."""
    return add(df, {new: F.col(old).cast("double") for new, old in FEATURE_ALIASES.items() if old in df.columns})


# Year-on-year columns: result name -> source column (fixed values).
YEAR_ON_YEAR = {
    "cpi_yoy": "cpi",
    "core_cpi_yoy": "core_cpi",
    "pce_yoy": "pce",
    "core_pce_yoy": "core_pce",
    "industrial_production_yoy": "industrial_production",
    "real_gdp_yoy": "real_gdp",
    "retail_sales_yoy": "retail_sales_yoy_source",
    "gasoline_yoy": "gasoline_yoy_source",
    "lei_yoy": "lei",
    "eps_ttm_growth": "eps_ttm",
    "m2_yoy": "m2",
    "fed_balance_sheet_yoy": "fed_balance_sheet",
    "commercial_bank_credit_yoy": "commercial_bank_credit",
}


def macro_yoy(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    out = {new: R.pct_change(old, 252) for new, old in YEAR_ON_YEAR.items() if old in have}
    if "unemployment" in have:
        out["unemployment_change_6m"] = R.diff("unemployment", 126)
    if "initial_claims" in have:
        out["initial_claims_4w_avg"] = R.mean("initial_claims", 20, 4)
    if "payrolls" in have:
        out["_pay"] = R.diff("payrolls", 21)
    liquidity = ("m2", "fed_balance_sheet", "treasury_general_account", "reverse_repo_level")
    if have.issuperset(liquidity):
        a, b, c, d = (F.col(k) for k in liquidity)
        out["dollar_liquidity_proxy"] = a + b - c - d
    staged = add(df, out)
    late = {}
    if "cpi" in have:
        late["inflation_change_6m"] = R.diff("cpi_yoy", 126)
    if "payrolls" in have:
        late["payrolls_3m_avg"] = R.mean("_pay", 63, 21)
    return add(staged, late).drop("_pay") if late else staged


def rate_curve(df: DataFrame) -> DataFrame:
    """Policy-rate changes, curve spreads, inversion and a logistic recession proxy."""
    have = set(df.columns)
    out: dict[str, Column] = {}
    if "fed_funds_rate" in have:
        chg = R.diff("fed_funds_rate", 252)
        out |= {"fed_funds_change_252d": chg, "rate_hike_dummy": flag(chg > 0), "rate_cut_dummy": flag(chg < 0)}
        if "cpi_yoy" in have:
            out["real_fed_funds"] = F.col("fed_funds_rate") - F.col("cpi_yoy") * 100.0
    if {"treasury_10y", "cpi_yoy"} <= have:
        out["real_10y_yield"] = F.col("treasury_10y") - F.col("cpi_yoy") * 100.0
    if {"treasury_10y", "treasury_3m"} <= have:
        gap = F.col("treasury_10y") - F.col("treasury_3m")
        out |= {
            "spread_10y_3m": gap,
            "yield_curve_inverted_dummy": flag(gap < 0),
            "nyfed_recession_probability": 1.0 / (1.0 + F.exp(0.6 + 0.9 * gap)),
            "_rn": F.row_number().over(R.ordered()),
        }
    if {"treasury_10y", "treasury_2y"} <= have:
        out["spread_10y_2y"] = F.col("treasury_10y") - F.col("treasury_2y")
    if {"treasury_30y", "yield_5y"} <= have:
        out["spread_30y_5y"] = F.col("treasury_30y") - F.col("yield_5y")
    staged = add(df, out)
    late: dict[str, Column] = {}
    if "spread_10y_3m" in out:
        late["months_since_inversion"] = R.bars_since(F.col("spread_10y_3m") < 0, rn="_rn").cast("double")
    if "spread_10y_2y" in out:
        late["curve_steepening_63d"] = R.diff("spread_10y_2y", 63)
        late["curve_steepening_252d"] = R.diff("spread_10y_2y", 252)
    return add(staged, late).drop("_rn") if late else staged


def credit(df: DataFrame, x: str = "baa_aaa_spread") -> DataFrame:
    return add(
        df,
        {
            "credit_spread_change_21d": R.diff(x, 21),
            "credit_spread_change_63d": R.diff(x, 63),
            "credit_spread_percentile_252d": R.percentile_rank(x, 252, 63),
            "credit_stress_dummy": flag(F.col(x) > R.quantile(x, 252, 0.90, 63)),
        },
    )


def rate_to_decimal(x) -> Column:
    return R._c(x) / 100.0


def external(df: DataFrame) -> DataFrame:
    """Dollar, gold, oil and copper moves; a duration-7 bond return proxy."""
    have = set(df.columns)
    out: dict[str, Column] = {}
    if "dxy_proxy" in have:
        out |= {"dxy_return_252d": R.pct_change("dxy_proxy", 252), "dxy_change_63d": R.diff("dxy_proxy", 63)}
    if "gold" in have:
        out["gold_return_252d"] = R.pct_change("gold", 252)
    if "oil" in have:
        out |= {"oil_yoy": R.pct_change("oil", 252), "oil_return_252d": R.pct_change("oil", 252)}
    if "copper" in have:
        out["copper_return_252d"] = R.pct_change("copper", 252)
        if "gold" in have:
            out["copper_gold_ratio"] = R.ratio("copper", "gold")
    if "treasury_10y" in have:
        rate = rate_to_decimal("treasury_10y")
        old = R.lag(rate, 252)
        bonds = old - 7.0 * (rate - old)
        out |= {"us_bonds_return_252d": bonds, "stocks_vs_bonds_252d": R.pct_change("close", 252) - bonds}
    return add(df, out)


def valuation(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    out: dict[str, Column] = {}
    if "vix_level" in have:
        out |= {
            "vix_change_21d": R.diff("vix_level", 21),
            "vix_percentile_252d": R.percentile_rank("vix_level", 252, 63),
        }
        if "realized_vol_21d" in have:
            out["realized_vol_minus_vix"] = F.col("realized_vol_21d") - F.col("vix_level") / 100.0
        if "vix3m_level" in have:
            out["vix_term_structure"] = R.ratio("vix3m_level", "vix_level")
    if "cape_ratio" in have:
        out["cape_percentile"] = R.expanding_percentile("cape_ratio")
        if "treasury_10y" in have:
            out["cape_minus_10y_yield"] = R.ratio(F.lit(1.0), "cape_ratio") - rate_to_decimal("treasury_10y")
    if {"earnings_yield", "treasury_10y"} <= have:
        premium = F.col("earnings_yield") - rate_to_decimal("treasury_10y")
        out |= {"equity_risk_premium": premium, "earnings_yield_minus_10y_yield": premium}
    if {"dividend_yield", "buyback_yield"} <= have:
        out["shareholder_yield"] = F.col("dividend_yield") + F.col("buyback_yield")
    return add(df, out)


def score_smooth(df: DataFrame, x: str, n: int, by=("symbol",)) -> DataFrame:
    """Rolling mean with one observation enough; series shorter than ``n`` stay as they are."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    smooth = R.mean(x, n, 1, by)
    return add(df, {f"{x}_smooth": F.when(size < n, F.col(x)).otherwise(smooth)})
