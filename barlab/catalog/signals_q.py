"""Signals, votes and exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.features import CUM, DAILY_SQL, G, O, PCT, W, Z
from barlab.catalog.quality import AN_LONG, WK_LONG
from barlab.catalog.recursions import MEMORY_INIT, MEMORY_STEP, fold, recursive
from barlab.functions import rolling as R
from barlab.operators import examples as E
from barlab.operators import quality as Q
from barlab.operators import recursive as RC
from barlab.operators import signals as SG
from barlab.operators import specs as SP
from barlab.operators import votes as V
from barlab.plans import decisions as D
from barlab.plans import inputs as I
from barlab.plans import sweeps as SW
from barlab.registry import oracle
from barlab.registry import sharing_query as query

SIG = "s:symbol d:ts i:signal"
FEAT = [*I.BARS, *I.RETS, *DAILY_SQL]
CO = ["symbol", "ts", "signal"]


@query("ma_crossover", oracle(SIG, I.BARS, f"SELECT symbol, ts, CASE WHEN {G('AVG(close) {w}', 'close', 5)} > {G('AVG(close) {w}', 'close', 20)} THEN 1 ELSE 0 END AS signal FROM bars"))
def ma_crossover(spark, d):
    return SG.ma_crossover(I.bars(spark, d), 5, 20).select(CO)


@query("momentum_threshold", oracle(SIG, I.BARS, f"SELECT symbol, ts, CASE WHEN {PCT('close', 20)} > 0.01 THEN 1 ELSE 0 END AS signal FROM bars"))
def momentum_threshold(spark, d):
    return SG.momentum(I.bars(spark, d), 20, 0.01).select(CO)


@query("mean_reversion", oracle(SIG, I.BARS, f"z AS (SELECT symbol, ts, {Z('close', 60)} AS z FROM bars)",
    f"SELECT symbol, ts, coalesce(last_value(CASE WHEN z <= -1.2 THEN 1 WHEN z >= 0.3 THEN 0 END IGNORE NULLS) OVER {CUM}, 0) AS signal FROM z"))
def mean_reversion(spark, d):
    return SG.mean_reversion(I.bars(spark, d), 60, 1.2, 0.3).select(CO)


RSI = [f"rm AS (SELECT symbol, ts, close - lag(close) OVER {O} AS d FROM bars)",
       "rg AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0e0) END AS u, CASE WHEN d IS NOT NULL THEN greatest(-d, 0e0) END AS l FROM rm)",
       f"rx AS (SELECT symbol, ts, 100 - 100 / (1 + ({G('AVG(u) {w}', 'u', 14)}) / nullif({G('AVG(l) {w}', 'l', 14)}, 0)) AS rsi FROM rg)"]


@query("rsi_reversion", oracle(SIG, I.BARS, RSI,
    f"SELECT symbol, ts, coalesce(last_value(CASE WHEN rsi <= 30 THEN 1 WHEN rsi >= 60 THEN 0 END IGNORE NULLS) OVER {CUM}, 0) AS signal FROM rx"))
def rsi_reversion(spark, d):
    return SG.rsi_reversion(I.bars(spark, d), 14, 30.0, 60.0).select(CO)


@query("breakout", oracle(SIG, I.BARS, f"p AS (SELECT *, lag(close) OVER {O} AS p FROM bars)",
    f"q AS (SELECT *, {G('MAX(p) {w}', 'p', 60)} AS hi, {G('MIN(p) {w}', 'p', 20)} AS lo FROM p)",
    f"SELECT symbol, ts, coalesce(last_value(CASE WHEN close > hi THEN 1 WHEN close < lo THEN 0 END IGNORE NULLS) OVER {CUM}, 0) AS signal FROM q"))
def breakout(spark, d):
    return SG.breakout(I.bars(spark, d), 60, 20).select(CO)


@query("volatility_momentum", oracle(SIG, I.BARS, I.RETS, f"v AS (SELECT *, {G('stddev_pop(r) {w}', 'r', 20)} AS v FROM rets)",
    f"SELECT symbol, ts, CASE WHEN {PCT('close', 60)} > 0 AND v < {G('quantile_cont(v, 0.6) {w}', 'v', 252, 20)} THEN 1 ELSE 0 END AS signal FROM v"))
def volatility_momentum(spark, d):
    return SG.volatility_momentum(I.bars(spark, d), 60, 20, 0.6).select(CO)


@query("linear_score", oracle(SIG + " f:score", I.BARS, I.RETS,
    f"v AS (SELECT symbol, ts, {PCT('close', 20)} AS f, {PCT('close', 60)} AS s, {G('stddev_pop(r) {w}', 'r', 20)} AS v, close / ({G('MAX(close) {w}', 'close', 20)}) - 1 AS dd FROM rets)",
    f"z AS (SELECT symbol, ts, {Z('f', 252, 63)} + {Z('s', 252, 63)} AS a, {Z('v', 252, 63)} AS b, {Z('dd', 252, 63)} AS c FROM v)".replace(" + CASE", ") + (CASE").replace("SELECT symbol, ts, CASE", "SELECT symbol, ts, (CASE").replace("END AS a", "END) AS a"),
    "SELECT symbol, ts, a - b + c AS score, CASE WHEN a - b + c > 0.5 THEN 1 ELSE 0 END AS signal FROM z"))
def linear_score(spark, d):
    return SG.linear_score(I.bars(spark, d), 20, 60, 20, 0.5).select(*CO, "score")


@query("feature_threshold", oracle(SIG + " i:z_signal", FEAT, f"""
SELECT symbol, ts, CASE WHEN sp500_return_21d > 0.01 THEN 1 ELSE 0 END AS signal, CASE WHEN {Z('realized_vol_21d', 120, 30)} > 0.5 THEN 1 ELSE 0 END AS z_signal FROM daily_features"""))
def feature_threshold(spark, d):
    f = SG.feature_zscore(D.featured(spark, d, None), "realized_vol_21d", 120, 0.5).withColumnRenamed("signal", "z_signal")
    return SG.feature_threshold(f, "sp500_return_21d", 0.01).select(*CO, "z_signal")


# Votes on daily rows: (candidate, min_votes, specs) built from training quantiles of the features.
DAY_CAND = [("c1", 1), ("c2", 2), ("c3", 3)]
VOTE_SQL = [
    "dl AS (" + " UNION ALL ".join(f"SELECT symbol, ts, '{c}' AS feature, {c} AS v, CASE WHEN '{c}' IN ('sp500_return_21d', 'realized_vol_21d') THEN {Z(c, 60, 20)} END AS z FROM daily_features" for c in D.FEATURES) + ")",
    """dm AS (SELECT feature, CAST(printf('%.8f', quantile_cont(v, 0.5)) AS DOUBLE) AS m FROM dl WHERE ts <= DATE '1998-12-31' AND symbol = 'N' GROUP BY 1)""",
    """votes AS (SELECT dl.symbol, dl.ts, COUNT(*) FILTER (v > m) AS up, COUNT(*) FILTER (v < m) AS down, COUNT(*) FILTER (z > 0.25) AS zup, SUM(z) FILTER (dl.feature IN ('sp500_return_21d', 'realized_vol_21d')) AS zs,
        COUNT(z) FILTER (dl.feature IN ('sp500_return_21d', 'realized_vol_21d')) AS zn FROM dl JOIN dm ON dl.feature = dm.feature GROUP BY 1, 2)""",
]


def day_long(spark, d):
    return Q.melt(D.featured(spark, d, None), ["symbol", "ts"], D.FEATURES)


def day_votes(spark, d):
    """Per (symbol, ts): votes above and below the training median, z-score votes and the z sum."""
    long = day_long(spark, d)
    med = long.where("symbol = 'N' AND ts <= DATE'1998-12-31'").groupBy("feature").agg(F.percentile("value", 0.5).alias("m"))
    specs = med.select("feature", SP.num(F.col("m")).cast("double").alias("m"))
    zf = F.col("feature").isin("sp500_return_21d", "realized_vol_21d")
    z = long.where(zf).withColumn("z", R.zscore("value", 60, 20, by=("symbol", "feature"))).unionByName(long.where(~zf).withColumn("z", F.lit(None).cast("double")))
    j = z.join(F.broadcast(specs), "feature")
    return j.groupBy("symbol", "ts").agg(
        F.count_if(F.col("value") > F.col("m")).alias("up"), F.count_if(F.col("value") < F.col("m")).alias("down"),
        F.count_if(F.col("z") > 0.25).alias("zup"), F.sum("z").alias("zs"), F.count("z").alias("zn"))


@query("feature_vote", oracle(SIG + " i:z_signal", FEAT, VOTE_SQL, "SELECT symbol, ts, CASE WHEN up >= 3 THEN 1 ELSE 0 END AS signal, CASE WHEN zup >= 1 THEN 1 ELSE 0 END AS z_signal FROM votes"))
def feature_vote(spark, d):
    v = day_votes(spark, d)
    return v.select("symbol", "ts", SG.on(F.col("up") >= 3).alias("signal"), SG.on(F.col("zup") >= 1).alias("z_signal"))


@query("feature_score", oracle(SIG + " f:score", FEAT, VOTE_SQL, "s AS (SELECT symbol, ts, CASE WHEN zn = 2 THEN zs / sqrt(2e0) END AS score FROM votes)",
    "SELECT symbol, ts, score, CASE WHEN score > 0.4 THEN 1 ELSE 0 END AS signal FROM s"))
def feature_score(spark, d):
    v = day_votes(spark, d).withColumn("score", F.when(F.col("zn") == 2, F.col("zs") / F.sqrt(F.lit(2.0))))
    return v.select("symbol", "ts", "score", SG.on(F.col("score") > 0.4).alias("signal"))


@query("vote_position", oracle(SIG, FEAT, VOTE_SQL, "SELECT symbol, ts, CASE WHEN up >= 4 THEN 1 WHEN down >= 3 THEN -1 ELSE 0 END AS signal FROM votes"))
def vote_position(spark, d):
    v = day_votes(spark, d)
    return v.select("symbol", "ts", SG.long_short(F.col("up") >= 4, F.col("down") >= 3).alias("signal"))


@query("long_short_always", recursive("s:symbol d:ts i:position", FEAT, VOTE_SQL,
    "x AS (SELECT symbol, ts, CASE WHEN down >= 3 AND NOT up >= 4 THEN -1 ELSE 1 END AS w FROM votes)", fold("", MEMORY_INIT, MEMORY_STEP), "SELECT symbol, ts, cur AS position FROM walk"))
def long_short_always(spark, d):
    v = day_votes(spark, d)
    x = v.select("symbol", "ts", SG.long_short(F.col("up") >= 4, F.col("down") >= 3, flat=1).alias("signal"))
    return RC.position_memory(x, "signal", ("symbol",), 3, 5).select("symbol", "ts", "position")


@query("long_short_score", recursive("s:symbol d:ts i:position", FEAT, VOTE_SQL,
    "x AS (SELECT symbol, ts, CASE WHEN zn = 2 AND zs / sqrt(2e0) < -0.4 THEN -1 ELSE 1 END AS w FROM votes)", fold("", MEMORY_INIT, MEMORY_STEP), "SELECT symbol, ts, cur AS position FROM walk"))
def long_short_score(spark, d):
    v = day_votes(spark, d)
    low = (F.col("zn") == 2) & (F.col("zs") / F.sqrt(F.lit(2.0)) < -0.4)
    x = v.select("symbol", "ts", F.when(low, -1).otherwise(1).alias("signal"))
    return RC.position_memory(x, "signal", ("symbol",), 3, 5).select("symbol", "ts", "position")


REGIME_SQL = ["regime AS (SELECT ts, CASE WHEN down >= 4 THEN 'CASH' WHEN up >= 4 THEN 'A' ELSE 'N' END AS asset FROM votes WHERE symbol = 'N')"]


def regime(spark, d):
    v = day_votes(spark, d).where("symbol = 'N'")
    a = SG.regime_asset(F.col("up") >= 4, F.col("down") >= 4, F.lit("A"), F.lit("N"), F.lit("CASH"))
    return v.select("ts", a.alias("asset"))


@query("regime_asset", oracle("d:ts s:asset", FEAT, VOTE_SQL, REGIME_SQL, "SELECT * FROM regime"))
def regime_asset(spark, d):
    return regime(spark, d)


# Annual votes: candidate = feature threshold at the median (weight 2) plus a range of volatility.
AV_SQL = [
    "aq AS (SELECT feature, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM an_all WHERE target_year <= 1998 GROUP BY 1)",
    """av AS (SELECT a.sym, a.target_year, a.feature || '_' || d AS candidate_id, CASE WHEN d > 0 THEN a.value > CAST(printf('%.8f', q.q[2]) AS DOUBLE) ELSE a.value < CAST(printf('%.8f', q.q[2]) AS DOUBLE) END AS v1,
       CASE WHEN d > 0 THEN coalesce(b.value BETWEEN CAST(printf('%.8f', r.q[1]) AS DOUBLE) AND CAST(printf('%.8f', r.q[3]) AS DOUBLE), false) ELSE NOT coalesce(b.value BETWEEN CAST(printf('%.8f', r.q[1]) AS DOUBLE) AND CAST(printf('%.8f', r.q[3]) AS DOUBLE), false) END AS v2
       FROM an_all AS a JOIN aq AS q ON q.feature = a.feature JOIN aq AS r ON r.feature = 'realized_vol_21d' JOIN an_all AS b ON b.feature = 'realized_vol_21d' AND b.target_year = a.target_year AND b.sym = a.sym, (VALUES (-1), (1)) AS dd(d))""",
    "apred AS (SELECT sym, target_year, candidate_id, 2 * coalesce(v1, false)::INT + v2::INT >= 2 AS predicted FROM av)",
]
AN_ALL = ["an_all AS (" + " UNION ALL ".join(f"SELECT symbol AS sym, target_year, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM annual" for c in D.FEATURES) + ")"]


def annual_candidates(long):
    t = SP.threshold_specs(long.where("target_year <= 1998"), (0.5,), (2,)).select("feature", "direction", F.col("spec").alias("s1"))
    r = SP.range_specs(long.where("target_year <= 1998 AND feature = 'realized_vol_21d'"), ((0.25, 0.75),)).select("direction", F.col("spec").alias("s2"))
    return t.join(F.broadcast(r), "direction").select(
        F.concat_ws("_", "feature", F.col("direction").cast("string")).alias("candidate_id"), F.array("s1", "s2").alias("specs"), F.lit(2).alias("min_votes"))


def annual_predictions(spark, d):
    long = SW.annual_long(D.annual(spark, d))
    cands = annual_candidates(long)
    specs = SP.parse_period(cands.select(F.explode("specs").alias("spec")).distinct(), default_weight=True)
    paths = V.spec_paths(long, specs, V.annual_vote)
    s = V.weighted_sum(cands, paths, ["candidate_id", "min_votes"])
    need = F.greatest(F.lit(1), F.least("min_votes", "total_weight"))
    pred = s.withColumn("p", F.transform("score", lambda v: v >= need)).select("candidate_id", "p")
    periods = long.agg(F.array_sort(F.collect_set("decision_date")).alias("periods"), F.lit(1).alias("_k"))
    e = V.expand(pred.join(F.broadcast(periods), F.lit(1) == F.col("_k")).drop("_k"), F.col("periods"), "p", "predicted").drop("periods")
    return e.select("candidate_id", "decision_date.symbol", "decision_date.target_year", "predicted")


@query("annual_vote", oracle("s:candidate_id s:symbol i:target_year b:predicted", FEAT, D.ANNUAL_SQL, AN_ALL, AV_SQL, "SELECT candidate_id, sym AS symbol, target_year, predicted FROM apred"))
def annual_vote(spark, d):
    return annual_predictions(spark, d)


CEXP = [*FEAT, *D.WEEKLY_SQL, *WK_LONG, *SW.cand_sql("wk_long", SP.WEEKLY_QUANTILES)]


@query("weighted_exposure", recursive("s:candidate_id s:selector d:decision_date f:exposure", CEXP, "SELECT * FROM cexp"))
def weighted_exposure(spark, d):
    long = SW.period_long(D.weekly(spark, d))
    return SW.exposure_rows(long, SW.candidates(spark, d, long)).select("candidate_id", "selector", "decision_date", "exposure")


@query("select_asset", oracle("s:selector d:decision_date s:traded_asset f:asset_return", I.BARS, D.ASSETS_SQL, SW.PICK_SQL, "SELECT * FROM picks"))
def select_asset(spark, d):
    return SW.ranked_assets(D.weekly_assets(spark, d))


@query("score_to_position", oracle("s:symbol d:ts f:position", I.BARS, I.RETS, "SELECT symbol, ts, CASE WHEN r * -1 >= 0.002 THEN 1 ELSE -1 END AS position FROM rets"))
def score_to_position(spark, d):
    x = I.returns(I.bars(spark, d))
    return x.select("symbol", "ts", SG.score_to_position(F.col("r"), F.lit(-1.0), F.lit(0.002)).alias("position"))


@query("prediction_exposure", oracle("s:symbol d:ts f:exposure", I.BARS, I.RETS, "s AS (SELECT symbol, stddev_pop(r) AS s FROM rets WHERE ts <= DATE '1998-12-31' GROUP BY 1)",
    "SELECT symbol, ts, greatest(least(tanh(0.1 + 0.8 * r / s), 1e0), -1e0) AS exposure FROM rets JOIN s USING (symbol)"))
def prediction_exposure(spark, d):
    from barlab.operators import ml as M

    x = I.returns(I.bars(spark, d)).withColumn("train", F.col("ts") <= F.lit(I.TRAIN_END).cast("date"))
    return M.prediction_exposure(x, "r", F.col("train"), 0.1, 0.8, ("symbol",)).select("symbol", "ts", "exposure")
