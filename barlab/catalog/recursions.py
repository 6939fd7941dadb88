"""Recursive sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.features import CUM, G, O, W, Z
from barlab.functions import rolling as R
from barlab.operators import recursive as RC
from barlab.plans import inputs as I
from barlab.registry import oracle, query


@query("hysteresis_state", oracle("s:symbol d:ts i:state", I.BARS, f"z AS (SELECT symbol, ts, {Z('close', 20, 20)} AS z FROM bars)",
    f"SELECT symbol, ts, coalesce(last_value(CASE WHEN z <= -1 THEN 1 WHEN z >= 0.5 THEN 0 END IGNORE NULLS) OVER {CUM}, 0) AS state FROM z"))
def hysteresis_state(spark, d):
    z = I.bars(spark, d).withColumn("z", R.zscore("close", 20))
    return z.select("symbol", "ts", R.hysteresis(F.col("z") <= -1, F.col("z") >= 0.5).alias("state"))


def fold(state: str, init: str, step: str, rows: str = "x", key: str = "symbol") -> list[str]:
    """Recursive CTE that walks every series row by row: ``p`` is the previous state, ``n`` the next row."""
    return [
        f"num AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS rn FROM {rows})",
        f"walk AS (SELECT {key}, ts, rn, {init} FROM num AS n WHERE rn = 1 UNION ALL SELECT n.{key}, n.ts, n.rn, {step} FROM walk AS p JOIN num AS n ON n.{key} = p.{key} AND n.rn = p.rn + 1)",
    ]


def recursive(out, *parts):
    text = oracle(out, *parts)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


MEMORY_STEP = """CASE WHEN n.w <> p.cur AND p.run + 1 >= 3 AND p.held >= 5 THEN n.w ELSE p.cur END AS cur,
   CASE WHEN n.w = p.cur THEN 0 WHEN p.run + 1 >= 3 AND p.held >= 5 THEN 0 ELSE p.run + 1 END AS run,
   CASE WHEN n.w <> p.cur AND p.run + 1 >= 3 AND p.held >= 5 THEN 1 ELSE p.held + 1 END AS held"""
MEMORY_INIT = "1 AS cur, CASE WHEN n.w = -1 THEN 1 ELSE 0 END AS run, 6 AS held"


@query("position_memory", recursive("s:symbol d:ts i:position", I.BARS, I.RETS,
    "x AS (SELECT symbol, ts, CASE WHEN r < 0 THEN -1 ELSE 1 END AS w FROM rets)", fold("", MEMORY_INIT, MEMORY_STEP),
    "SELECT symbol, ts, cur AS position FROM walk"))
def position_memory(spark, d):
    x = I.returns(I.bars(spark, d)).select("symbol", "ts", F.signum("r").alias("signal"))
    return RC.position_memory(x, "signal", ("symbol",), 3, 5).select("symbol", "ts", "position")


@query("exposure_smoothing", recursive("s:symbol d:ts f:smoothed", I.BARS, I.RETS,
    "x AS (SELECT symbol, ts, greatest(least(r * 30, 1e0), -1e0) AS v FROM rets WHERE r IS NOT NULL)", fold("", "n.v AS s", "0.35 * p.s + 0.65 * n.v AS s"),
    "SELECT symbol, ts, greatest(least(s, 1e0), -1e0) AS smoothed FROM walk"))
def exposure_smoothing(spark, d):
    x = I.returns(I.bars(spark, d)).where("r IS NOT NULL").select("symbol", "ts", F.greatest(F.least(F.col("r") * 30, F.lit(1.0)), F.lit(-1.0)).alias("v"))
    return RC.exposure_smoothing(x, "v", 0.35, ("symbol",)).select("symbol", "ts", "smoothed")


def _ema(n):
    return f"{2.0 / (n + 1)!r}e0"


@query("ema", recursive("s:symbol d:ts f:ema_12 f:ema_26", I.BARS, "x AS (SELECT symbol, ts, close FROM bars)",
    fold("", "n.close AS a, n.close AS b", f"{_ema(12)} * n.close + (1 - {_ema(12)}) * p.a AS a, {_ema(26)} * n.close + (1 - {_ema(26)}) * p.b AS b"),
    "SELECT symbol, ts, CASE WHEN rn >= 12 THEN a END AS ema_12, CASE WHEN rn >= 26 THEN b END AS ema_26 FROM walk"))
def ema(spark, d):
    return RC.ema(RC.ema(I.bars(spark, d), "close", 12), "close", 26).select("symbol", "ts", "ema_12", "ema_26")


@query("macd", recursive("s:symbol d:ts f:macd_line f:macd_signal f:macd_hist", I.BARS, "x AS (SELECT symbol, ts, close FROM bars)",
    fold("", "n.close AS a, n.close AS b, CAST(NULL AS DOUBLE) AS s", f"""{_ema(12)} * n.close + (1 - {_ema(12)}) * p.a AS a, {_ema(26)} * n.close + (1 - {_ema(26)}) * p.b AS b,
     CASE WHEN n.rn < 26 THEN NULL WHEN p.s IS NULL THEN ({_ema(12)} * n.close + (1 - {_ema(12)}) * p.a) - ({_ema(26)} * n.close + (1 - {_ema(26)}) * p.b)
     ELSE 0.2e0 * (({_ema(12)} * n.close + (1 - {_ema(12)}) * p.a) - ({_ema(26)} * n.close + (1 - {_ema(26)}) * p.b)) + 0.8e0 * p.s END AS s"""),
    "SELECT symbol, ts, CASE WHEN rn >= 26 THEN a - b END AS macd_line, CASE WHEN rn >= 34 THEN s END AS macd_signal, CASE WHEN rn >= 34 THEN a - b - s END AS macd_hist FROM walk"))
def macd(spark, d):
    return RC.macd(I.bars(spark, d)).select("symbol", "ts", "macd_line", "macd_signal", "macd_hist")


@query("rsi_wilder", recursive("s:symbol d:ts f:rsi_14", I.BARS,
    f"m AS (SELECT symbol, ts, close - lag(close) OVER {O} AS d, row_number() OVER {O} AS rn FROM bars)",
    f"seed AS (SELECT symbol, AVG(greatest(d, 0e0)) AS u0, AVG(greatest(-d, 0e0)) AS d0 FROM m WHERE rn BETWEEN 2 AND 15 GROUP BY 1)",
    """walk AS (SELECT m.symbol, m.ts, m.rn, s.u0 AS u, s.d0 AS dn FROM m JOIN seed AS s ON s.symbol = m.symbol WHERE m.rn = 15
       UNION ALL SELECT m.symbol, m.ts, m.rn, (p.u * 13 + greatest(m.d, 0e0)) / 14, (p.dn * 13 + greatest(-m.d, 0e0)) / 14 FROM walk AS p JOIN m ON m.symbol = p.symbol AND m.rn = p.rn + 1)""",
    "SELECT m.symbol, m.ts, CASE WHEN w.dn = 0 THEN 100 ELSE 100 - 100 / (1 + w.u / w.dn) END AS rsi_14 FROM m LEFT JOIN walk AS w ON w.symbol = m.symbol AND w.rn = m.rn"))
def rsi_wilder(spark, d):
    return RC.rsi_wilder(I.bars(spark, d)).select("symbol", "ts", "rsi_14")


@query("ewma_vol", recursive("s:symbol d:ts f:ewma_vol_20", I.BARS, I.RETS, "x AS (SELECT symbol, ts, r FROM rets WHERE r IS NOT NULL)",
    fold("", "n.r AS m, 0e0 AS v, 1e0 AS w", f"p.m + {_ema(20)} * (n.r - p.m) AS m, (1 - {_ema(20)}) * (p.v + {_ema(20)} * (n.r - p.m) * (n.r - p.m)) AS v, (1 - {_ema(20)}) * (1 - {_ema(20)}) * p.w + {_ema(20)} * {_ema(20)} AS w"),
    "SELECT rets.symbol, rets.ts, CASE WHEN rn >= 20 THEN sqrt(v / (1 - w)) END AS ewma_vol_20 FROM rets LEFT JOIN walk ON walk.symbol = rets.symbol AND walk.ts = rets.ts"))
def ewma_vol(spark, d):
    return RC.ewma_vol(I.returns(I.bars(spark, d))).select("symbol", "ts", "ewma_vol_20")


@query("rsi_simple", oracle("s:symbol d:ts f:rsi", I.BARS, f"m AS (SELECT symbol, ts, close - lag(close) OVER {O} AS d FROM bars)",
    "g AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0e0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0e0) END AS l FROM m)",
    f"SELECT symbol, ts, 100 - 100 / (1 + ({G('AVG(u) {w}', 'u', 14)}) / nullif({G('AVG(l) {w}', 'l', 14)}, 0)) AS rsi FROM g"))
def rsi_simple(spark, d):
    from barlab.operators import signals as SG

    return SG.rsi(I.bars(spark, d), 14).select("symbol", "ts", "rsi")
