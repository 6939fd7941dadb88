"""Windowed daily features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barlab.functions import rolling as R
from barlab.operators import align as A
from barlab.operators import features as X
from barlab.plans import inputs as I
from barlab.plans import panels as P
from barlab.registry import oracle, query, sharing_query

O = "(PARTITION BY symbol ORDER BY ts)"
CUM = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def W(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def G(agg: str, x: str, n: int, mp: int | None = None) -> str:
    """Aggregate text over n rows, NULL under mp observations; ``{w}`` marks the frame."""
    return f"CASE WHEN COUNT({x}) OVER {W(n)} >= {mp or n} THEN {agg.format(w='OVER ' + W(n))} END"


def PCT(x: str, n: int = 1) -> str:
    return f"({x} / nullif(lag({x}, {n}) OVER {O}, 0) - 1)"


def Z(x: str, n: int, mp: int | None = None, std: str = "stddev_pop") -> str:
    sd = f"({std}({x}) OVER {W(n)})"
    return (
        f"CASE WHEN COUNT({x}) OVER {W(n)} >= {mp or n} AND {sd} > 1e-12 "
        f"THEN ({x} - AVG({x}) OVER {W(n)}) / {sd} END"
    )


@query("sma", oracle("s:symbol d:ts f:sma_5 f:sma_20 f:sma_60", I.BARS, f"""
SELECT symbol, ts, {G('AVG(close) {w}', 'close', 5)} AS sma_5, {G('AVG(close) {w}', 'close', 20)} AS sma_20,
       {G('AVG(close) {w}', 'close', 60)} AS sma_60 FROM bars"""))
def sma(spark, d):
    return I.bars(spark, d).select("symbol", "ts", *[R.mean("close", n).alias(f"sma_{n}") for n in (5, 20, 60)])


@query("pct_change_n", oracle("s:symbol d:ts " + " ".join(f"f:ret_{n}" for n in X.FEATURE_WINDOWS), I.BARS,
    "SELECT symbol, ts, " + ", ".join(f"{PCT('close', n)} AS ret_{n}" for n in X.FEATURE_WINDOWS) + " FROM bars"))
def pct_change_n(spark, d):
    b = I.bars(spark, d)
    return b.select("symbol", "ts", *[c.alias(k) for k, c in X.trend_columns().items()])


@query("rolling_vol", oracle("s:symbol d:ts f:vol_20 f:vol_63 f:vol_21_year", I.BARS, I.RETS, f"""
SELECT symbol, ts, {G('stddev_pop(r) {w}', 'r', 20)} AS vol_20, {G('stddev_pop(r) {w}', 'r', 63)} AS vol_63,
       {G('stddev_pop(r) {w}', 'r', 21, 10)} * sqrt(252.0) AS vol_21_year FROM rets"""))
def rolling_vol(spark, d):
    return I.returns(I.bars(spark, d)).select(
        "symbol", "ts", R.std("r", 20).alias("vol_20"), R.std("r", 63).alias("vol_63"),
        (R.std("r", 21, 10) * math.sqrt(252.0)).alias("vol_21_year"))


BASE = ["""base AS (SELECT ts, close AS base_close FROM bars WHERE symbol = 'N')""",
        """ratios AS (SELECT bars.symbol, bars.ts, bars.close, base.base_close, bars.close / nullif(base.base_close, 0) AS ratio
  FROM bars JOIN base ON bars.ts = base.ts)"""]


@query("rel_strength", oracle("s:symbol d:ts f:vs_ret_20 f:vs_ret_63", I.BARS, BASE, f"""
SELECT symbol, ts, {PCT('base_close', 20)} - {PCT('close', 20)} AS vs_ret_20,
       {PCT('base_close', 63)} - {PCT('close', 63)} AS vs_ret_63 FROM ratios WHERE symbol <> 'N'"""))
def rel_strength(spark, d):
    r = A.benchmark_ratio(I.bars(spark, d), I.BENCHMARK).where("symbol <> 'N'")
    return r.select("symbol", "ts", *[
        (R.pct_change("base_close", n) - R.pct_change("close", n)).alias(f"vs_ret_{n}") for n in (20, 63)])


@query("rolling_drawdown", oracle("s:symbol d:ts f:dd_63 f:drawdown_current", I.BARS, f"""
SELECT symbol, ts, close / ({G('MAX(close) {w}', 'close', 63)}) - 1 AS dd_63,
       close / MAX(close) OVER {CUM} - 1 AS drawdown_current FROM bars"""))
def rolling_drawdown(spark, d):
    return I.bars(spark, d).select(
        "symbol", "ts", R.drawdown("close", 63).alias("dd_63"), R.drawdown("close").alias("drawdown_current"))


STRUCT = ("range_high_low range_intraday_norm_close gap_overnight return_intraday_open_close "
          "return_overnight_close_open opening_range_proxy dollar_volume close_location intraday_reversal").split()


@query("bar_structure", oracle("s:symbol d:ts " + " ".join(f"f:{c}" for c in STRUCT), I.RAW_BARS, f"""
SELECT symbol, ts, high / low - 1 AS range_high_low, (high - low) / close AS range_intraday_norm_close,
  open / lag(close) OVER {O} - 1 AS gap_overnight, close / open - 1 AS return_intraday_open_close,
  open / lag(close) OVER {O} - 1 AS return_overnight_close_open, (high - open) / close AS opening_range_proxy,
  close * volume AS dollar_volume, (close - low) / nullif(high - low, 0) AS close_location,
  sign(open / lag(close) OVER {O} - 1) * -sign(close / open - 1) AS intraday_reversal FROM raw_bars"""))
def bar_structure(spark, d):
    return X.bar_structure(I.raw_bars(spark, d)).select("symbol", "ts", *STRUCT)


@query("vol_parkinson", oracle("s:symbol d:ts f:vol_parkinson_20", I.RAW_BARS,
    "x AS (SELECT *, ln(high / low) ^ 2 / (4 * ln(2e0)) AS v FROM raw_bars)",
    f"SELECT symbol, ts, sqrt({G('AVG(v) {w}', 'v', 20)}) AS vol_parkinson_20 FROM x"))
def vol_parkinson(spark, d):
    return X.range_volatility(I.raw_bars(spark, d)).select("symbol", "ts", "vol_parkinson_20")


@query("vol_garman_klass", oracle("s:symbol d:ts f:vol_garman_klass_20", I.RAW_BARS,
    "x AS (SELECT *, 0.5 * ln(high / low) ^ 2 - (2 * ln(2e0) - 1) * ln(close / open) ^ 2 AS v FROM raw_bars)",
    f"m AS (SELECT symbol, ts, {G('AVG(v) {w}', 'v', 20)} AS m FROM x)",
    "SELECT symbol, ts, CASE WHEN m >= 0 THEN sqrt(m) END AS vol_garman_klass_20 FROM m"))
def vol_garman_klass(spark, d):
    return X.range_volatility(I.raw_bars(spark, d)).select("symbol", "ts", "vol_garman_klass_20")


@query("vol_rogers_satchell", oracle("s:symbol d:ts f:vol_rogers_satchell_20", I.RAW_BARS,
    "x AS (SELECT *, ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close) AS v FROM raw_bars)",
    f"m AS (SELECT symbol, ts, {G('AVG(v) {w}', 'v', 20)} AS m FROM x)",
    "SELECT symbol, ts, CASE WHEN m >= 0 THEN sqrt(m) END AS vol_rogers_satchell_20 FROM m"))
def vol_rogers_satchell(spark, d):
    return X.range_volatility(I.raw_bars(spark, d)).select("symbol", "ts", "vol_rogers_satchell_20")


@query("atr", oracle("s:symbol d:ts f:true_range f:atr_14", I.RAW_BARS, f"""x AS (
  SELECT *, greatest(high - low, abs(high - lag(close) OVER {O}), abs(low - lag(close) OVER {O})) AS true_range FROM raw_bars)""",
    f"SELECT symbol, ts, true_range, {G('AVG(true_range) {w}', 'true_range', 14)} AS atr_14 FROM x"))
def atr(spark, d):
    return X.true_range(I.raw_bars(spark, d)).select("symbol", "ts", "true_range", "atr_14")


@query("activity", oracle("s:symbol d:ts f:range_expansion_20 f:relative_volume_20 f:gap_cluster_5", I.RAW_BARS, f"""x AS (
  SELECT *, high / low - 1 AS rg, abs(open / lag(close) OVER {O} - 1) AS gap FROM raw_bars)""", f"""
SELECT symbol, ts, rg / nullif({G('AVG(rg) {w}', 'rg', 20)}, 0) - 1 AS range_expansion_20,
  volume / nullif({G('AVG(volume) {w}', 'volume', 20)}, 0) - 1 AS relative_volume_20,
  {G('AVG(gap) {w}', 'gap', 5)} AS gap_cluster_5 FROM x"""))
def activity(spark, d):
    return X.activity(I.raw_bars(spark, d)).select("symbol", "ts", "range_expansion_20", "relative_volume_20", "gap_cluster_5")


CAL = ("calendar_month calendar_week calendar_day_of_week calendar_turn_of_month calendar_quarter_end "
       "calendar_year_end calendar_january calendar_sell_in_may calendar_opex_week_proxy").split()


@query("calendar_features", oracle("s:symbol d:ts " + " ".join(f"f:{c}" for c in CAL), I.BARS, """
SELECT symbol, ts, month(ts) AS calendar_month, weekofyear(ts) AS calendar_week, isodow(ts) - 1 AS calendar_day_of_week,
  CASE WHEN day(ts) <= 3 OR day(ts) >= 28 THEN 1 ELSE 0 END AS calendar_turn_of_month,
  CASE WHEN last_day(ts) = ts AND month(ts) IN (3, 6, 9, 12) THEN 1 ELSE 0 END AS calendar_quarter_end,
  CASE WHEN month(ts) = 12 AND day(ts) = 31 THEN 1 ELSE 0 END AS calendar_year_end,
  CASE WHEN month(ts) = 1 THEN 1 ELSE 0 END AS calendar_january,
  CASE WHEN month(ts) IN (5, 6, 7, 8, 9, 10) THEN 1 ELSE 0 END AS calendar_sell_in_may,
  CASE WHEN day(ts) BETWEEN 15 AND 21 AND isodow(ts) = 5 THEN 1 ELSE 0 END AS calendar_opex_week_proxy FROM bars"""))
def calendar_features(spark, d):
    return X.calendar(I.bars(spark, d)).select("symbol", "ts", *CAL)


PAIRS = [("a_n", "A", "N"), ("r_n", "R", "N"), ("a_r", "A", "R")]


@query("pair_ratio", oracle("s:pair d:ts f:level f:ret_21 f:ret_63 f:ret_126", I.BARS, """p AS (
  SELECT v.pair AS symbol, l.ts, l.close / nullif(r.close, 0) AS level
  FROM (VALUES ('a_n', 'A', 'N'), ('r_n', 'R', 'N'), ('a_r', 'A', 'R')) AS v(pair, lsym, rsym)
  JOIN bars AS l ON l.symbol = v.lsym JOIN bars AS r ON r.symbol = v.rsym AND r.ts = l.ts)""",
    f"SELECT symbol AS pair, ts, level, {PCT('level', 21)} AS ret_21, {PCT('level', 63)} AS ret_63, {PCT('level', 126)} AS ret_126 FROM p"))
def pair_ratio(spark, d):
    return P.pair_ratios(I.bars(spark, d), PAIRS)


@query("implied_minus_realized", oracle("s:symbol d:ts f:implied_gap f:implied_change", I.BARS, I.RETS, I.ORDERS_DAILY, f"""x AS (
  SELECT r.symbol, r.ts, r.r, o.value * 100 AS implied FROM rets AS r
  LEFT JOIN (SELECT ts, value FROM orders_daily WHERE series = '1-URGENT') AS o ON r.ts = o.ts)""", f"""
SELECT symbol, ts, implied - ({G('stddev_pop(r) {w}', 'r', 21)}) * sqrt(252.0) * 100 AS implied_gap,
  implied - lag(implied) OVER {O} AS implied_change FROM x"""))
def implied_minus_realized(spark, d):
    o = I.orders_daily(spark, d).where("series = '1-URGENT'").select("ts", (F.col("value") * 100).alias("implied"))
    x = I.returns(I.bars(spark, d)).join(o, "ts", "left")
    return x.select("symbol", "ts",
        (F.col("implied") - R.std("r", 21) * math.sqrt(252.0) * 100).alias("implied_gap"),
        R.diff("implied").alias("implied_change"))


LCZ = [f"lvl{k}_{n}" for n in (5, 21, 63) for k in ("_chg", "_z")]


@query("level_change_z", oracle("s:symbol d:ts f:lvl " + " ".join(f"f:{c}" for c in LCZ), I.BARS,
    "x AS (SELECT symbol, ts, ln(close) AS lvl FROM bars)",
    "SELECT symbol, ts, lvl, " + ", ".join(
        f"lvl - lag(lvl, {n}) OVER {O} AS lvl_chg_{n}, {Z('lvl', n)} AS lvl_z_{n}" for n in (5, 21, 63)) + " FROM x"))
def level_change_z(spark, d):
    x = I.bars(spark, d).withColumn("x", F.ln("close"))
    return X.level_change_z(x, "x", "lvl").select("symbol", "ts", "lvl", *LCZ)


@query("spread_features", oracle("s:symbol d:ts f:hl " + " ".join(f"f:{c.replace('lvl', 'hl')}" for c in LCZ), I.RAW_BARS,
    "x AS (SELECT symbol, ts, ln(high) - ln(low) AS hl FROM raw_bars)",
    "SELECT symbol, ts, hl, " + ", ".join(
        f"hl - lag(hl, {n}) OVER {O} AS hl_chg_{n}, {Z('hl', n)} AS hl_z_{n}" for n in (5, 21, 63)) + " FROM x"))
def spread_features(spark, d):
    x = I.raw_bars(spark, d).withColumns({"lh": F.ln("high"), "ll": F.ln("low")})
    return X.spread(x, "lh", "ll", "hl").select("symbol", "ts", "hl", *[c.replace("lvl", "hl") for c in LCZ])


@query("rolling_zscore", oracle("s:symbol d:ts f:z_rule f:z_strict f:z_sample f:z_3y", I.BARS, I.RETS, f"""
SELECT symbol, ts, {Z('r', 60, 20)} AS z_rule, {Z('r', 21)} AS z_strict, {Z('r', 60, 60, 'stddev_samp')} AS z_sample,
  {Z('r', 756, 126)} AS z_3y FROM rets"""))
def rolling_zscore(spark, d):
    return I.returns(I.bars(spark, d)).select("symbol", "ts",
        R.zscore("r", 60, 20).alias("z_rule"), R.zscore("r", 21).alias("z_strict"),
        R.zscore("r", 60, ddof=1).alias("z_sample"), R.zscore("r", 756, 126).alias("z_3y"))


@query("expanding_zscore", oracle("s:symbol d:ts f:z", I.BARS, I.RETS, f"""
SELECT symbol, ts, CASE WHEN COUNT(r) OVER {CUM} >= 30 AND stddev_samp(r) OVER {CUM} > 1e-12
  THEN (r - AVG(r) OVER {CUM}) / stddev_samp(r) OVER {CUM} END AS z FROM rets"""))
def expanding_zscore(spark, d):
    return I.returns(I.bars(spark, d)).select("symbol", "ts", R.expanding_zscore("r").alias("z"))


MOM = [f"r_{k}_{n}" for n in (5, 10, 20, 60, 126) for k in ("mean", "std", "skew", "kurt", "min", "max")]


def _moments(n):
    parts = {"mean": "AVG(r) {w}", "std": "stddev_samp(r) {w}", "skew": "skewness(r) {w}", "kurt": "kurtosis(r) {w}",
             "min": "MIN(r) {w}", "max": "MAX(r) {w}"}
    return ", ".join(f"{G(a, 'r', n)} AS r_{k}_{n}" for k, a in parts.items())


@query("rolling_moments", oracle("s:symbol d:ts " + " ".join(f"f:{c}" for c in MOM), I.BARS, I.RETS,
    "SELECT symbol, ts, " + ", ".join(_moments(n) for n in (5, 10, 20, 60, 126)) + " FROM rets"))
def rolling_moments(spark, d):
    return X.rolling_moments(I.returns(I.bars(spark, d))).select("symbol", "ts", *MOM)


LAGS = (1, 2, 3, 5, 10, 21)


@query("return_lags", oracle("s:symbol d:ts " + " ".join(f"f:r_lag_{n}" for n in LAGS), I.BARS, I.RETS,
    "SELECT symbol, ts, " + ", ".join(f"lag(r, {n}) OVER {O} AS r_lag_{n}" for n in LAGS) + " FROM rets"))
def return_lags(spark, d):
    return I.returns(I.bars(spark, d)).select("symbol", "ts", *[R.lag("r", n).alias(f"r_lag_{n}") for n in LAGS])


@query("bollinger", oracle("s:symbol d:ts f:bb_mid f:bb_upper f:bb_lower f:bb_width", I.BARS, f"""x AS (
  SELECT symbol, ts, {G('AVG(close) {w}', 'close', 20)} AS m, {G('stddev_samp(close) {w}', 'close', 20)} AS s FROM bars)""",
    "SELECT symbol, ts, m AS bb_mid, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, 4 * s / nullif(m, 0) AS bb_width FROM x"))
def bollinger(spark, d):
    return X.bollinger(I.bars(spark, d)).select("symbol", "ts", "bb_mid", "bb_upper", "bb_lower", "bb_width")


@query("price_action", oracle("s:symbol d:ts f:pa_gap f:pa_body f:pa_range f:pa_close_pos f:pa_overnight", I.RAW_BARS, f"""
SELECT symbol, ts, open / lag(close) OVER {O} - 1 AS pa_gap, close / open - 1 AS pa_body, (high - low) / close AS pa_range,
  (close - low) / nullif(high - low, 0) AS pa_close_pos, (open - lag(close) OVER {O}) / lag(close) OVER {O} AS pa_overnight FROM raw_bars"""))
def price_action(spark, d):
    return X.price_action(I.raw_bars(spark, d)).select("symbol", "ts", "pa_gap", "pa_body", "pa_range", "pa_close_pos", "pa_overnight")


def RANK(x, over):
    lst = f"list({x}) FILTER ({x} IS NOT NULL) OVER {over}"
    return (f"CASE WHEN {x} IS NOT NULL THEN (len(list_filter({lst}, lambda v: v < {x})) + "
            f"(len(list_filter({lst}, lambda v: v = {x})) + 1) / 2.0) / len({lst}) END")


@query("rolling_percentile", oracle("s:symbol d:ts f:pct_252", I.BARS, I.RETS,
    f"x AS (SELECT *, list(r) FILTER (r IS NOT NULL) OVER {W(252)} AS v FROM rets)",
    "SELECT symbol, ts, CASE WHEN r IS NOT NULL AND len(v) >= 63 THEN (len(list_filter(v, lambda q: q < r)) + (len(list_filter(v, lambda q: q = r)) + 1) / 2.0) / len(v) END AS pct_252 FROM x"))
def rolling_percentile(spark, d):
    return I.returns(I.bars(spark, d)).select("symbol", "ts", R.percentile_rank("r", 252, 63).alias("pct_252"))


@query("expanding_percentile", oracle("s:symbol d:ts f:pct", I.BARS, I.RETS,
    "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM rets WHERE r IS NOT NULL)",
    """p AS (SELECT a.symbol, a.ts, COUNT(*) AS n, COUNT(*) FILTER (b.r < a.r) AS less, COUNT(*) FILTER (b.r = a.r) AS same
       FROM n AS a JOIN n AS b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY 1, 2)""",
    "SELECT rets.symbol, rets.ts, CASE WHEN n >= 20 THEN (less + (same + 1) / 2.0) / n END AS pct FROM rets LEFT JOIN p ON rets.symbol = p.symbol AND rets.ts = p.ts"))
def expanding_percentile(spark, d):
    return I.returns(I.bars(spark, d)).select("symbol", "ts", R.expanding_percentile("r").alias("pct"))


@query("rolling_quantile_flag", oracle("s:symbol d:ts f:vol f:spike f:calm", I.BARS, I.RETS,
    f"x AS (SELECT symbol, ts, {G('stddev_pop(r) {w}', 'r', 21, 10)} AS vol FROM rets)",
    f"""y AS (SELECT *, {G('quantile_cont(vol, 0.95) {w}', 'vol', 252, 63)} AS q95, {G('quantile_cont(vol, 0.4) {w}', 'vol', 252, 21)} AS q40 FROM x)""",
    "SELECT symbol, ts, vol, CASE WHEN vol > q95 THEN 1 ELSE 0 END AS spike, CASE WHEN vol < q40 THEN 1 ELSE 0 END AS calm FROM y"))
def rolling_quantile_flag(spark, d):
    x = I.returns(I.bars(spark, d)).withColumn("vol", R.std("r", 21, 10))
    return x.select("symbol", "ts", "vol",
        X.flag(F.col("vol") > R.quantile("vol", 252, 0.95, 63)).alias("spike"),
        X.flag(F.col("vol") < R.quantile("vol", 252, 0.40, 21)).alias("calm"))


DAILY = ([f"sp500_return_{n}d" for n in (21, 63, 126, 252, 504)] + [f"sp500_above_sma_{n}" for n in (50, 100, 200)]
         + "sp500_distance_sma_50 sp500_distance_sma_200 sp500_52w_high_distance sp500_drawdown_current realized_vol_21d "
           "realized_vol_63d realized_vol_126d realized_vol_252d spy_return_3m spy_return_6m spy_return_12m spy_return_36m "
           "spy_vol_3m spy_vol_12m spy_drawdown_12m volatility_spike_dummy".split())

DAILY_SQL = [
    f"""daily_base AS (SELECT symbol, ts, close, r,
      {G('AVG(close) {w}', 'close', 50, 20)} AS m50, {G('AVG(close) {w}', 'close', 100, 50)} AS m100, {G('AVG(close) {w}', 'close', 200, 100)} AS m200,
      {G('MAX(close) {w}', 'close', 252, 63)} AS hi, {G('stddev_pop(r) {w}', 'r', 21, 10)} AS s21, {G('stddev_pop(r) {w}', 'r', 63, 21)} AS s63,
      {G('stddev_pop(r) {w}', 'r', 126, 42)} AS s126, {G('stddev_pop(r) {w}', 'r', 252, 63)} AS s252 FROM rets)""",
    f"""daily_features AS (SELECT symbol, ts, close, {', '.join(f'{PCT("close", n)} AS sp500_return_{n}d' for n in (21, 63, 126, 252, 504))},
      {', '.join(f'CASE WHEN close > m{n} THEN 1.0 ELSE 0.0 END AS sp500_above_sma_{n}' for n in (50, 100, 200))},
      close / m50 - 1 AS sp500_distance_sma_50, close / m200 - 1 AS sp500_distance_sma_200, close / hi - 1 AS sp500_52w_high_distance,
      close / MAX(close) OVER {CUM} - 1 AS sp500_drawdown_current, s21 * sqrt(252.0) AS realized_vol_21d, s63 * sqrt(252.0) AS realized_vol_63d,
      s126 * sqrt(252.0) AS realized_vol_126d, s252 * sqrt(252.0) AS realized_vol_252d, {PCT('close', 63)} AS spy_return_3m,
      {PCT('close', 126)} AS spy_return_6m, {PCT('close', 252)} AS spy_return_12m, {PCT('close', 756)} AS spy_return_36m, s63 AS spy_vol_3m,
      s252 AS spy_vol_12m, close / hi - 1 AS spy_drawdown_12m,
      CASE WHEN s21 > {G('quantile_cont(s21, 0.95) {w}', 's21', 252, 63)} THEN 1.0 ELSE 0.0 END AS volatility_spike_dummy FROM daily_base)""",
]


@query("above_sma", oracle("s:symbol d:ts " + " ".join(f"f:{c}" for c in DAILY), I.BARS, I.RETS, DAILY_SQL,
    "SELECT * FROM daily_features"))
def above_sma(spark, d):
    """Above/distance to average, high distance and the whole daily trend panel."""
    return X.daily_features(I.bars(spark, d)).select("symbol", "ts", *DAILY)


@query("generic_change_z", oracle("s:symbol s:feature d:ts f:value f:change_12m f:z_3y", I.RAW_BARS, """u AS (
  SELECT symbol AS sym, ts, 'volume' AS feature, volume AS value FROM raw_bars
  UNION ALL SELECT symbol, ts, 'range', (high - low) / close FROM raw_bars)""",
    "x AS (SELECT sym || '/' || feature AS symbol, sym, feature, ts, value, COUNT(value) OVER (PARTITION BY sym, feature) AS obs FROM u)",
    f"""SELECT sym AS symbol, feature, ts, value, value - lag(value, 252) OVER {O} AS change_12m, {Z('value', 756, 126)} AS z_3y
    FROM x WHERE obs >= 120"""))
def generic_change_z(spark, d):
    x = I.raw_bars(spark, d).withColumn("range", R.ratio(F.col("high") - F.col("low"), "close"))
    return X.generic_change_z(x, ["volume", "range"])


# The five order-priority series stand in for named macro columns on the benchmark calendar.
RATES = P.RATE_COLUMNS
RATE_SQL = [
    """rate_raw AS (SELECT b.symbol, b.ts, b.close, """ + ", ".join(
        f"MAX(CASE WHEN o.series = '{s}' THEN o.value END) AS x{i}" for i, s in enumerate(P.PRIORITIES))
    + """ FROM bars AS b LEFT JOIN orders_daily AS o ON b.ts = o.ts WHERE b.symbol = 'N' GROUP BY 1, 2, 3)""",
    """rates AS (SELECT symbol, ts, close, """ + ", ".join(
        f"last_value(x{i} IGNORE NULLS) OVER {CUM} AS x{i}" for i in range(5)) + " FROM rate_raw)",
    "rate_named AS (SELECT symbol, ts, close, " + ", ".join(f"x{i} AS {c}" for i, cols in RATES.items() for c in cols) + " FROM rates)",
]


def _present(cols, fn):
    return ", ".join(fn(c) for c in cols)


YOY = [k for k, v in X.YEAR_ON_YEAR.items() if v in P.RATE_NAMES]


@query("macro_yoy", oracle("s:symbol d:ts " + " ".join(f"f:{c}" for c in YOY)
    + " f:unemployment_change_6m f:initial_claims_4w_avg f:dollar_liquidity_proxy f:inflation_change_6m f:payrolls_3m_avg",
    I.BARS, I.ORDERS_DAILY, RATE_SQL,
    f"y AS (SELECT *, {PCT('cpi', 252)} AS cy, payrolls - lag(payrolls, 21) OVER {O} AS pay FROM rate_named)",
    "SELECT symbol, ts, " + ", ".join(f"{PCT(X.YEAR_ON_YEAR[k], 252)} AS {k}" for k in YOY) + f""",
      unemployment - lag(unemployment, 126) OVER {O} AS unemployment_change_6m,
      {G('AVG(initial_claims) {w}', 'initial_claims', 20, 4)} AS initial_claims_4w_avg,
      m2 + fed_balance_sheet - treasury_general_account - reverse_repo_level AS dollar_liquidity_proxy,
      cy - lag(cy, 126) OVER {O} AS inflation_change_6m, {G('AVG(pay) {w}', 'pay', 63, 21)} AS payrolls_3m_avg FROM y"""))
def macro_yoy(spark, d):
    out = X.macro_yoy(P.rate_panel(spark, d))
    return out.select("symbol", "ts", *YOY, "unemployment_change_6m", "initial_claims_4w_avg", "dollar_liquidity_proxy",
                      "inflation_change_6m", "payrolls_3m_avg")


RATE_OUT = ("fed_funds_change_252d rate_hike_dummy rate_cut_dummy real_fed_funds real_10y_yield spread_10y_3m "
            "yield_curve_inverted_dummy nyfed_recession_probability months_since_inversion spread_10y_2y spread_30y_5y "
            "curve_steepening_63d curve_steepening_252d").split()


@query("rate_curve_features", oracle("s:symbol d:ts " + " ".join(f"f:{c}" for c in RATE_OUT), I.BARS, I.ORDERS_DAILY, RATE_SQL,
    f"""y AS (SELECT *, row_number() OVER {O} AS rn, {PCT('cpi', 252)} AS cy, fed_funds - lag(fed_funds, 252) OVER {O} AS ff,
      yield_10y - treasury_3m AS g, yield_10y - yield_2y AS g2 FROM rate_named)""", f"""
  SELECT symbol, ts, ff AS fed_funds_change_252d, CASE WHEN ff > 0 THEN 1 ELSE 0 END AS rate_hike_dummy,
   CASE WHEN ff < 0 THEN 1 ELSE 0 END AS rate_cut_dummy, fed_funds - cy * 100 AS real_fed_funds, yield_10y - cy * 100 AS real_10y_yield,
   g AS spread_10y_3m, CASE WHEN g < 0 THEN 1 ELSE 0 END AS yield_curve_inverted_dummy, 1 / (1 + exp(0.6 + 0.9 * g)) AS nyfed_recession_probability,
   rn - last_value(CASE WHEN g < 0 THEN rn END IGNORE NULLS) OVER {CUM} AS months_since_inversion, g2 AS spread_10y_2y,
   yield_30y - yield_5y AS spread_30y_5y, g2 - lag(g2, 63) OVER {O} AS curve_steepening_63d, g2 - lag(g2, 252) OVER {O} AS curve_steepening_252d FROM y"""))
def rate_curve_features(spark, d):
    return X.rate_curve(X.macro_yoy(X.feature_aliases(P.rate_panel(spark, d)))).select("symbol", "ts", *RATE_OUT)


@query("credit_features", oracle("s:symbol d:ts f:credit_spread_change_21d f:credit_spread_change_63d f:credit_spread_percentile_252d f:credit_stress_dummy",
    I.BARS, I.ORDERS_DAILY, RATE_SQL, f"y AS (SELECT *, baa_aaa_spread AS s, list(baa_aaa_spread) FILTER (baa_aaa_spread IS NOT NULL) OVER {W(252)} AS v FROM rate_named)", f"""
  SELECT symbol, ts, s - lag(s, 21) OVER {O} AS credit_spread_change_21d, s - lag(s, 63) OVER {O} AS credit_spread_change_63d,
   CASE WHEN len(v) >= 63 THEN (len(list_filter(v, lambda q: q < s)) + (len(list_filter(v, lambda q: q = s)) + 1) / 2.0) / len(v) END AS credit_spread_percentile_252d,
   CASE WHEN s > {G('quantile_cont(s, 0.9) {w}', 's', 252, 63)} THEN 1 ELSE 0 END AS credit_stress_dummy FROM y"""))
def credit_features(spark, d):
    return X.credit(P.rate_panel(spark, d)).select("symbol", "ts", "credit_spread_change_21d", "credit_spread_change_63d",
        "credit_spread_percentile_252d", "credit_stress_dummy")


EXT = ("dxy_return_252d dxy_change_63d gold_return_252d oil_yoy oil_return_252d copper_return_252d copper_gold_ratio "
       "us_bonds_return_252d stocks_vs_bonds_252d").split()


@query("external_features", oracle("s:symbol d:ts " + " ".join(f"f:{c}" for c in EXT), I.BARS, I.ORDERS_DAILY, RATE_SQL,
    f"y AS (SELECT *, yield_10y / 100 AS rt, lag(yield_10y / 100, 252) OVER {O} AS r0 FROM rate_named)", f"""
  SELECT symbol, ts, {PCT('dxy_proxy', 252)} AS dxy_return_252d, dxy_proxy - lag(dxy_proxy, 63) OVER {O} AS dxy_change_63d,
   {PCT('gold', 252)} AS gold_return_252d, {PCT('oil', 252)} AS oil_yoy, {PCT('oil', 252)} AS oil_return_252d, {PCT('copper', 252)} AS copper_return_252d,
   copper / nullif(gold, 0) AS copper_gold_ratio, r0 - 7 * (rt - r0) AS us_bonds_return_252d, {PCT('close', 252)} - (r0 - 7 * (rt - r0)) AS stocks_vs_bonds_252d FROM y"""))
def external_features(spark, d):
    return X.external(X.feature_aliases(P.rate_panel(spark, d))).select("symbol", "ts", *EXT)


VAL = ("vix_change_21d vix_percentile_252d vix_term_structure cape_percentile cape_minus_10y_yield equity_risk_premium "
       "earnings_yield_minus_10y_yield shareholder_yield").split()


@query("valuation_features", oracle("s:symbol d:ts " + " ".join(f"f:{c}" for c in VAL), I.BARS, I.ORDERS_DAILY, RATE_SQL,
    f"""y AS (SELECT *, list(vix_level) FILTER (vix_level IS NOT NULL) OVER {W(252)} AS v,
        list(cape) FILTER (cape IS NOT NULL) OVER {CUM} AS cv FROM rate_named)""", f"""
  SELECT symbol, ts, vix_level - lag(vix_level, 21) OVER {O} AS vix_change_21d,
   CASE WHEN len(v) >= 63 THEN (len(list_filter(v, lambda q: q < vix_level)) + (len(list_filter(v, lambda q: q = vix_level)) + 1) / 2.0) / len(v) END AS vix_percentile_252d,
   vix3m_level / nullif(vix_level, 0) AS vix_term_structure,
   CASE WHEN len(cv) >= 20 THEN (len(list_filter(cv, lambda q: q < cape)) + (len(list_filter(cv, lambda q: q = cape)) + 1) / 2.0) / len(cv) END AS cape_percentile,
   1 / nullif(cape, 0) - yield_10y / 100 AS cape_minus_10y_yield, earnings_yield - yield_10y / 100 AS equity_risk_premium,
   earnings_yield - yield_10y / 100 AS earnings_yield_minus_10y_yield, dividend_yield + buyback_yield AS shareholder_yield FROM y"""))
def valuation_features(spark, d):
    return X.valuation(X.feature_aliases(P.rate_panel(spark, d))).select("symbol", "ts", *VAL)


@query("bars_since", oracle("s:symbol d:ts i:since", I.BARS, I.RETS,
    f"x AS (SELECT *, row_number() OVER {O} AS rn FROM rets)",
    f"SELECT symbol, ts, rn - last_value(CASE WHEN r < -0.02 THEN rn END IGNORE NULLS) OVER {CUM} AS since FROM x"))
def bars_since(spark, d):
    x = I.returns(I.bars(spark, d)).withColumn("rn", F.row_number().over(R.ordered()))
    return x.select("symbol", "ts", R.bars_since(F.col("r") < -0.02).alias("since"))


@query("score_smooth", oracle("s:symbol d:ts f:r_smooth", I.BARS, I.RETS, f"""
SELECT symbol, ts, CASE WHEN COUNT(*) OVER (PARTITION BY symbol) < 10 THEN r ELSE AVG(r) OVER {W(10)} END AS r_smooth FROM rets"""))
def score_smooth(spark, d):
    return X.score_smooth(I.returns(I.bars(spark, d)), "r", 10).select("symbol", "ts", "r_smooth")


PANEL_N, PAIR_N = X.FEATURE_WINDOWS, (21, 63, 126)
PANEL_PAIRS = (("r_a", "R", "A"), ("a_n", "A", "N"))
MP_COLS = ["range_high_low", "gap_overnight", "calendar_month", "calendar_turn_of_month"] + [
    f"{a}_{k}" for a in ("a", "r") for k in ["close_ratio", "ret_1"] + [f"{m}_{n}" for m in ("ret", "vol") for n in PANEL_N]] + [
    f"base_vs_{a}_ret_{n}" for a in ("a", "r") for n in PANEL_N] + [f"base_{m}_{n}" for m in ("ret", "vol", "drawdown") for n in PANEL_N] + [
    f"{p}_{k}" for p, _, _ in PANEL_PAIRS for k in ["level", *[f"ret_{n}" for n in PAIR_N]]] + ["macro_value", "macro_change_63"]


def _mp_asset(a):
    s = a.upper()
    cols = [f"{a} / nullif(n, 0) AS {a}_close_ratio", f"{PCT(a)} AS {a}_ret_1"]
    for n in PANEL_N:
        cols += [f"{PCT(a, n)} AS {a}_ret_{n}", f"{G('stddev_pop(' + a + '1) {w}', a + '1', n)} AS {a}_vol_{n}",
                 f"{PCT('n', n)} - {PCT(a, n)} AS base_vs_{a}_ret_{n}"]
    return ", ".join(cols)


@sharing_query("market_panel", oracle("d:ts " + " ".join(f"f:{c}" for c in MP_COLS), I.BARS, I.RAW_BARS,
    """px AS (SELECT b.symbol, b.ts, q.open, q.high, q.low, q.close AS rc, b.close AS n, a.close AS a0, r.close AS r0
       FROM bars AS b JOIN raw_bars AS q ON q.symbol = b.symbol AND q.ts = b.ts
       LEFT JOIN bars AS a ON a.symbol = 'A' AND a.ts = b.ts LEFT JOIN bars AS r ON r.symbol = 'R' AND r.ts = b.ts WHERE b.symbol = 'N')""",
    I.MACRO, """lagm AS (SELECT CAST(ts + INTERVAL 1 DAY * (CASE isodow(ts) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END) AS DATE) AS ts, value FROM macro)""",
    "lagm1 AS (SELECT ts, AVG(value) AS value FROM lagm GROUP BY 1)",
    f"""pf AS (SELECT px.*, last_value(a0 IGNORE NULLS) OVER w AS a, last_value(r0 IGNORE NULLS) OVER w AS r, last_value(m.value IGNORE NULLS) OVER w AS macro_value FROM px LEFT JOIN lagm1 AS m ON m.ts = px.ts
       WINDOW w AS (PARTITION BY px.symbol ORDER BY px.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    f"""p1 AS (SELECT *, {PCT('a')} AS a1, {PCT('r')} AS r1, {PCT('n')} AS n1, r / nullif(a, 0) AS r_a_level, a / nullif(n, 0) AS a_n_level FROM pf)""",
    f"""SELECT ts, high / low - 1 AS range_high_low, open / lag(rc) OVER {O} - 1 AS gap_overnight, month(ts) AS calendar_month,
      CASE WHEN day(ts) <= 3 OR day(ts) >= 28 THEN 1 ELSE 0 END AS calendar_turn_of_month, {_mp_asset('a')}, {_mp_asset('r')},
      """ + ", ".join(f"{PCT('n', n)} AS base_ret_{n}, {G('stddev_pop(n1) {w}', 'n1', n)} AS base_vol_{n}, n / ({G('MAX(n) {w}', 'n', n)}) - 1 AS base_drawdown_{n}"
                      for n in PANEL_N) + ", r_a_level, a_n_level, " + ", ".join(f"{PCT(p + '_level', n)} AS {p}_ret_{n}" for p, _, _ in PANEL_PAIRS for n in PAIR_N)
    + f", macro_value, macro_value - lag(macro_value, 63) OVER {O} AS macro_change_63 FROM p1"))
def market_panel(spark, d):
    """Whole wide panel on the benchmark calendar: structure, calendar, per-asset, pair, macro and base columns."""
    macro = A.dedupe_mean(A.publication_lag(I.macro_monthly(spark, d), 5))
    return P.market_panel(I.bars(spark, d), I.raw_bars(spark, d), I.BENCHMARK, ["A", "R"], PANEL_PAIRS, macro, PANEL_N).select("ts", *MP_COLS)


AP = "ret_252 rel_ret_252 macro_value hy_minus_ig ten_minus_two cap_to_gdp issuance_yield".split()


@sharing_query("annual_panel", oracle("d:ts " + " ".join(f"f:{c}" for c in AP), I.BARS, I.ORDERS_DAILY, I.MACRO, RATE_SQL,
    """lagged AS (SELECT CAST(ts + INTERVAL 1 DAY * (CASE isodow(ts) WHEN 6 THEN 6 WHEN 7 THEN 5 ELSE 7 END) AS DATE) AS ts, value FROM macro)""",
    "lag1 AS (SELECT ts, AVG(value) AS value FROM lagged GROUP BY 1)",
    f"""j AS (SELECT r.*, a.close AS small0, l.value AS mv FROM rate_named AS r LEFT JOIN (SELECT ts, close FROM bars WHERE symbol = 'A') AS a ON r.ts = a.ts
       LEFT JOIN lag1 AS l ON r.ts = l.ts)""",
    f"j2 AS (SELECT *, last_value(small0 IGNORE NULLS) OVER {CUM} AS small, last_value(mv IGNORE NULLS) OVER {CUM} AS macro_value FROM j)",
    f"""SELECT ts, {PCT('close', 252)} AS ret_252, {PCT('small', 252)} - {PCT('close', 252)} AS rel_ret_252, macro_value, hy_oas - ig_oas AS hy_minus_ig,
        yield_10y - yield_2y AS ten_minus_two, close / nullif(macro_value, 0) AS cap_to_gdp, -m2 / nullif(close, 0) AS issuance_yield FROM j2"""))
def annual_panel(spark, d):
    return P.annual_panel(spark, d).select("ts", *AP)


@query("feature_aliases", oracle("s:symbol d:ts " + " ".join(f"f:{k}" for k, v in X.FEATURE_ALIASES.items() if v in P.RATE_NAMES), I.BARS, I.ORDERS_DAILY, RATE_SQL,
    "SELECT symbol, ts, " + ", ".join(f"{v} AS {k}" for k, v in X.FEATURE_ALIASES.items() if v in P.RATE_NAMES) + " FROM rate_named"))
def feature_aliases(spark, d):
    cols = [k for k, v in X.FEATURE_ALIASES.items() if v in P.RATE_NAMES]
    return X.feature_aliases(P.rate_panel(spark, d)).select("symbol", "ts", *cols)
