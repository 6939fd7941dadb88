"""Grouped reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.backtests import WKEV, weekly_positions
from barlab.catalog.gates_q import WS, weekly_board
from barlab.catalog.recursions import recursive
from barlab.operators import gates as GT
from barlab.operators import leaderboard as LB
from barlab.plans import boards as BD
from barlab.plans import inputs as I
from barlab.plans import sweeps as SW
from barlab.registry import oracle
from barlab.registry import sharing_query as query


@query("method_summary", oracle("s:method i:rows i:accepted i:verified_sharpe_robust i:best_candidate f:best_score f:best_train_sharpe", BD.BOARD, WS,
    """SELECT method, COUNT(*) AS rows, COUNT(*) FILTER (accepted) AS accepted, COUNT(*) FILTER (verified_sharpe_robust) AS verified_sharpe_robust, arg_max(row_id, (score, -row_id)) AS best_candidate, MAX(score) AS best_score,
       arg_max(train_sharpe, (score, -row_id)) AS best_train_sharpe FROM wk GROUP BY 1"""))
def method_summary(spark, d):
    return LB.method_summary(weekly_board(spark, d), "score", ("accepted", "verified_sharpe_robust"), ("train_sharpe",), ident="row_id")


@query("efficiency_report", oracle("s:method i:rows i:verified_count f:verified_per_hour f:time_to_first_verified f:best_score_240m f:best_score_480m f:best_score_720m", BD.BOARD, WS,
    """SELECT method, COUNT(*) AS rows, COUNT(*) FILTER (verified_sharpe_robust) AS verified_count, COUNT(*) FILTER (verified_sharpe_robust) / (MAX(elapsed_seconds) / 3600) AS verified_per_hour,
       MIN(first_seen_minute) FILTER (verified_sharpe_robust) AS time_to_first_verified, MAX(score) FILTER (first_seen_minute <= 240) AS best_score_240m, MAX(score) FILTER (first_seen_minute <= 480) AS best_score_480m,
       MAX(score) FILTER (first_seen_minute <= 720) AS best_score_720m FROM wk GROUP BY 1"""))
def efficiency_report(spark, d):
    return LB.efficiency(weekly_board(spark, d), "elapsed_seconds", "first_seen_minute", "score", "verified_sharpe_robust")


def jobs(spark, d):
    e = I.table(spark, d, "events")
    start = F.col("ts")
    secs = F.floor(F.col("value") * 60).cast("bigint")
    return e.select(F.col("event_type").alias("method"), start.alias("start"), F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + secs * 1000000).alias("end"))


JOBS = ["jobs AS (SELECT event_type AS method, ts AS start, ts + INTERVAL 1 SECOND * CAST(floor(value * 60) AS BIGINT) AS fin FROM events)",
    "je AS (SELECT method, start AS t, 1 AS d, 0 AS o FROM jobs UNION ALL SELECT method, fin, -1, 1 FROM jobs WHERE fin IS NOT NULL)",
    "jl AS (SELECT method, SUM(d) OVER (ORDER BY t, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM je)",
    "jm AS (SELECT method, SUM(d) OVER (PARTITION BY method ORDER BY t, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM je)"]


@query("parallelism_sweep", oracle("s:method i:max_parallel i:jobs f:spread_seconds", JOBS,
    "s AS (SELECT method, COUNT(*) AS jobs, epoch_us(MAX(start)) / 1000000.0 - epoch_us(MIN(start)) / 1000000.0 AS spread FROM jobs GROUP BY 1 UNION ALL SELECT 'all', COUNT(*), epoch_us(MAX(start)) / 1000000.0 - epoch_us(MIN(start)) / 1000000.0 FROM jobs)",
    "p AS (SELECT 'all' AS method, MAX(lv) AS m FROM jl UNION ALL SELECT method, MAX(lv) FROM jm GROUP BY 1)",
    "SELECT p.method, m AS max_parallel, jobs, spread AS spread_seconds FROM p JOIN s ON s.method = p.method"))
def parallelism_sweep(spark, d):
    j = jobs(spark, d)
    both = LB.max_parallel(j, ("method",)).unionByName(LB.max_parallel(j).select(F.lit("all").alias("method"), "max_parallel"))
    us = F.unix_micros(F.col("start").cast("timestamp"))
    spread = (F.max(us) / 1000000.0 - F.min(us) / 1000000.0).alias("spread_seconds")
    n = j.groupBy("method").agg(F.count(F.lit(1)).alias("jobs"), spread).unionByName(j.agg(F.count(F.lit(1)).alias("jobs"), spread).select(F.lit("all").alias("method"), "jobs", "spread_seconds"))
    return both.join(n, "method")


@query("rejection_counts", oracle("s:fail_reason i:rows", BD.BOARD, WS,
    "SELECT r AS fail_reason, COUNT(*) AS rows FROM (SELECT unnest([reason_down_5pct, reason_calmar, reason_sharpe]) AS r FROM wk) WHERE r <> '' GROUP BY 1"))
def rejection_counts(spark, d):
    w = weekly_board(spark, d).select("candidate_id", F.concat_ws(";", "reason_down_5pct", "reason_calmar", "reason_sharpe").alias("fail_reasons"))
    return LB.explode_reasons(w).groupBy("fail_reason").agg(F.count(F.lit(1)).alias("rows"))


@query("fail_reason_explode", oracle("i:row_id s:fail_reason", BD.BOARD, WS, "SELECT row_id, r AS fail_reason FROM (SELECT row_id, unnest([reason_down_5pct, reason_calmar, reason_sharpe]) AS r FROM wk) WHERE r <> ''"))
def fail_reason_explode(spark, d):
    w = weekly_board(spark, d).select("row_id", F.concat_ws(";", "reason_down_5pct", "reason_calmar", "reason_sharpe").alias("fail_reasons"))
    return LB.explode_reasons(w, ident="row_id")


@query("candidates_evaluated", oracle("i:wave i:candidates_evaluated i:stages", BD.BOARD, "s AS (SELECT wave, stage, MAX(feature_count) AS n FROM board GROUP BY 1, 2)", "SELECT wave, SUM(n) AS candidates_evaluated, COUNT(*) AS stages FROM s GROUP BY 1"))
def candidates_evaluated(spark, d):
    return LB.candidates_evaluated(BD.board(spark, d), "stage", "feature_count", ("wave",))


@query("stage_inventory", oracle("s:method i:wave i:found i:expected b:complete", BD.BOARD, "f AS (SELECT DISTINCT replace(method, ' ', '-') AS method, wave, stage FROM board)", "SELECT method, wave, COUNT(*) AS found, 16 AS expected, COUNT(*) = 16 AS complete FROM f GROUP BY 1, 2"))
def stage_inventory(spark, d):
    """Method, wave and stage read from file names, found against expected."""
    b = BD.board(spark, d)
    files = b.select(F.concat(F.lit("out/"), F.replace("method", F.lit(" "), F.lit("-")), F.lit("/wave_"), F.col("wave").cast("string"), F.lit("_stage_"), F.col("stage").cast("string"), F.lit(".csv")).alias("file"))
    p = files.select(F.regexp_extract("file", "^out/([^/]+)/", 1).alias("method"), F.regexp_extract("file", r"wave_(\d+)", 1).cast("int").alias("wave"), F.regexp_extract("file", r"stage_(\d+)", 1).cast("int").alias("stage"))
    g = p.groupBy("method", "wave").agg(F.count_distinct("stage").alias("found"))
    return g.withColumn("expected", F.lit(16)).withColumn("complete", F.col("found") == F.col("expected"))


@query("engine_comparison", oracle("s:track s:engine i:rows_available i:valid f:evaluated_per_min f:valid_per_min f:first_valid_seconds f:best_validation_calmar b:winner", BD.BOARD,
    "e AS (SELECT 'track' || wave AS track, method AS engine, *, train_calmar > 0 AND validation_calmar > 0 AND NOT locked_opened AS ok FROM board)",
    """g AS (SELECT track, engine, COUNT(*) AS rows_available, COUNT(*) FILTER (ok) AS valid, COUNT(*) / (MAX(elapsed_seconds) / 60) AS evaluated_per_min, COUNT(*) FILTER (ok) / (MAX(elapsed_seconds) / 60) AS valid_per_min,
       MIN(elapsed_seconds) FILTER (ok) AS first_valid_seconds, MAX(validation_calmar) FILTER (ok) AS bv, MAX(train_calmar) AS bt FROM e GROUP BY 1, 2)""",
    "SELECT *, bv AS best_validation_calmar, row_number() OVER (PARTITION BY track ORDER BY round(valid_per_min, 9) DESC, bv DESC, bt DESC, engine DESC) = 1 AS winner FROM g"))
def engine_comparison(spark, d):
    e = BD.board(spark, d).withColumns({"track": F.concat(F.lit("track"), F.col("wave").cast("string")), "ok": (F.col("train_calmar") > 0) & (F.col("validation_calmar") > 0) & ~F.col("locked_opened")})
    mins = F.max("elapsed_seconds") / 60.0
    g = e.groupBy("track", F.col("method").alias("engine")).agg(
        F.count(F.lit(1)).alias("rows_available"), F.count_if("ok").alias("valid"), (F.count(F.lit(1)) / mins).alias("evaluated_per_min"), (F.count_if("ok") / mins).alias("valid_per_min"),
        F.min(F.when(F.col("ok"), F.col("elapsed_seconds"))).alias("first_valid_seconds"), F.max(F.when(F.col("ok"), F.col("validation_calmar"))).alias("best_validation_calmar"), F.max("train_calmar").alias("bt"))
    best = g.groupBy("track").agg(F.max_by("engine", F.struct(F.round("valid_per_min", 9).alias("a"), F.col("best_validation_calmar").alias("b"), "bt", "engine")).alias("w"))
    return g.join(best, "track").withColumn("winner", F.col("engine") == F.col("w")).drop("w", "bt")


@query("leaderboard_summary", oracle("i:rows i:candidates i:accepted i:verified i:unique_verified i:best_row f:best_score", BD.BOARD, WS,
    "SELECT COUNT(*) AS rows, COUNT(DISTINCT candidate_id) AS candidates, COUNT(*) FILTER (accepted) AS accepted, COUNT(*) FILTER (verified_sharpe_robust) AS verified, COUNT(DISTINCT candidate_id) FILTER (verified_sharpe_robust) AS unique_verified, arg_max(row_id, (score, -row_id)) AS best_row, MAX(score) AS best_score FROM wk"))
def leaderboard_summary(spark, d):
    w = weekly_board(spark, d)
    ok = F.col("verified_sharpe_robust")
    return w.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("candidate_id").alias("candidates"), F.count_if("accepted").alias("accepted"), F.count_if(ok).alias("verified"),
        F.count_distinct(F.when(ok, F.col("candidate_id"))).alias("unique_verified"), F.max_by("row_id", F.struct("score", (-F.col("row_id")).alias("i"))).alias("best_row"), F.max("score").alias("best_score"))


@query("ml_candidate_to_row", oracle("i:row_id s:candidate_id s:features i:feature_count f:train_cagr f:train_mdd f:validation_calmar s:asset_selector f:score", BD.BOARD,
    "SELECT row_id, 'ml_' || candidate_id AS candidate_id, 'a,b' AS features, 2 AS feature_count, train_cagr, train_mdd, validation_calmar, 'single_asset' AS asset_selector, train_sharpe * 1e6 + train_cagr * 100000 + train_min_year_return * 10000 - abs(train_mdd) * 1000 AS score FROM board"))
def ml_candidate_to_row(spark, d):
    """Learning metrics in the weekly layout; CAGR and drawdown already are decimals and stay so."""
    b = BD.board(spark, d).select("row_id", F.concat(F.lit("ml_"), F.col("candidate_id").cast("string")).alias("candidate_id"), F.array(F.lit("b"), F.lit("a")).alias("f"),
        *[c for c in ("train_cagr", "train_mdd", "train_sharpe", "train_calmar", "validation_calmar", "validation_sharpe", "validation_cagr", "train_min_year_return", "train_down_min_return", "average_abs_exposure", "exposure_turnover")],
        *[c for c in ("train_years_positive", "train_years_total", "validation_years_positive", "validation_years_total", "train_down_years_ge_5pct", "train_down_years_total", "validation_down_years_ge_5pct", "validation_down_years_total")])
    b = b.withColumns({"features": F.array_join(F.array_sort("f"), ","), "feature_count": F.size("f"), "asset_selector": F.lit("single_asset")})
    return GT.weekly_scores(b).select("row_id", "candidate_id", "features", "feature_count", "train_cagr", "train_mdd", "validation_calmar", "asset_selector", F.col("score_sharpe").alias("score"))


@query("weekly_to_universal", recursive("s:candidate_id d:timestamp s:frequency f:strategy_return s:sample_role f:turnover f:exposure f:benchmark_return", WKEV,
    "SELECT candidate_id, ts AS timestamp, 'weekly' AS frequency, strategy_return, CASE period WHEN 'train' THEN 'is' WHEN 'validation' THEN 'oos' ELSE 'locked' END AS sample_role, abs(exposure - coalesce(lag(exposure) OVER (PARTITION BY candidate_id ORDER BY ts), 0)) AS turnover, exposure, spy_return AS benchmark_return FROM posw"))
def weekly_to_universal(spark, d):
    return SW.to_universal(weekly_positions(spark, d))


@query("leaderboard_to_returns", recursive("s:candidate_id s:source_method i:periods f:total_return b:supported", WKEV,
    "SELECT candidate_id, CASE WHEN contains(candidate_id, 'vol') THEN 'beam' ELSE 'bandit' END AS source_method, COUNT(*) AS periods, product(1 + strategy_return) - 1 AS total_return, true AS supported FROM posw WHERE NOT contains(candidate_id, 'month_number') GROUP BY 1, 2 UNION ALL SELECT DISTINCT candidate_id, 'unsupported', 0, CAST(NULL AS DOUBLE), false FROM posw WHERE contains(candidate_id, 'month_number')"))
def leaderboard_to_returns(spark, d):
    """Re-evaluate every leaderboard row into returns; rows of unsupported methods are tagged, not dropped."""
    from barlab.plans import decisions as D
    from barlab.operators import search as SE

    ex = D.weekly(spark, d)
    long = SW.period_long(ex)
    board = SW.candidates(spark, d, long).withColumn("method", F.when(F.col("candidate_id").contains("month_number"), "external").when(F.col("candidate_id").contains("vol"), "beam").otherwise("bandit"))
    text = board.withColumns({"specs": F.array_join("specs", ";"), "asset_selector": F.col("selector")})
    rows = SE.decode(text.drop("selector"))
    ok = rows.where("method <> 'external'")
    pos = SW.rotation_positions(ex.where("period <> 'locked'"), long, ok.drop("method", "asset_selector"), D.weekly_assets(spark, d))
    good = pos.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("periods"), (F.product(1.0 + F.col("strategy_return")) - 1.0).alias("total_return"))
    good = good.join(ok.select("candidate_id", F.col("method").alias("source_method")), "candidate_id").withColumn("supported", F.lit(True))
    bad = rows.where("method = 'external'").select("candidate_id", F.lit("unsupported").alias("source_method"), F.lit(0).alias("periods"), F.lit(None).cast("double").alias("total_return"), F.lit(False).alias("supported"))
    return good.unionByName(bad)


@query("rejection_ledger", oracle("i:row_id s:reason s:model i:horizon s:features f:train_calmar f:validation_calmar", BD.BOARD, WS,
    "SELECT row_id, reason_sharpe AS reason, method AS model, feature_count AS horizon, 'f' || row_id % 9 || ',g' AS features, train_calmar, validation_calmar FROM wk WHERE reason_sharpe <> ''"))
def rejection_ledger(spark, d):
    """Rejected rows appended as JSON lines and read back."""
    from barlab.sources import files as FS

    w = weekly_board(spark, d).where("reason_sharpe <> ''")
    rows = w.select("row_id", F.col("reason_sharpe").alias("reason"), F.col("method").alias("model"), F.col("feature_count").alias("horizon"),
        F.concat(F.lit("f"), (F.col("row_id") % 9).cast("string"), F.lit(",g")).alias("features"), "train_calmar", "validation_calmar")
    path = FS.scratch(spark, "ledger")
    rows.write.mode("append").json(path)
    return spark.read.schema(rows.schema).json(path)


@query("stage_failures", oracle("s:candidate_id s:method f:score b:accepted i:stages i:failed_stages", BD.BOARD,
    "f AS (SELECT DISTINCT method, wave, stage FROM board WHERE stage_failed)", "t AS (SELECT COUNT(DISTINCT (method, wave, stage)) AS a, COUNT(DISTINCT (method, wave, stage)) FILTER (stage_failed) AS b FROM board)",
    "SELECT 'stage_error_' || method || '_' || wave || '_' || stage AS candidate_id, method, -1e9 AS score, false AS accepted, a AS stages, b AS failed_stages FROM f, t"))
def stage_failures(spark, d):
    b = BD.board(spark, d)
    stage = F.struct("method", "wave", "stage")
    total = b.agg(F.count_distinct(stage).alias("stages"), F.count_distinct(F.when(F.col("stage_failed"), stage)).alias("failed_stages"), F.lit(1).alias("_k"))
    err = b.where("stage_failed").select("method", "wave", "stage").distinct()
    rows = err.select(F.concat_ws("_", F.lit("stage_error"), "method", F.col("wave").cast("string"), F.col("stage").cast("string")).alias("candidate_id"), "method", F.lit(-1e9).alias("score"), F.lit(False).alias("accepted"))
    return rows.join(F.broadcast(total), F.lit(1) == F.col("_k")).drop("_k")


