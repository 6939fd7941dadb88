"""Scores and acceptance gates and named scalars (2.10)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from barlab.catalog.backtests import GATE_OUT, gate_sql
from barlab.catalog.features import CUM
from barlab.catalog.quality import UNI_SQL, universal_returns
from barlab.functions import text as TX
from barlab.operators import backtest as B
from barlab.operators import gates as GT
from barlab.plans import boards as BD
from barlab.plans import inputs as I
from barlab.registry import oracle
from barlab.registry import sharing_query as query
from barlab.session import checkpoint

G_OUT = GATE_OUT.replace("s:candidate_id", "i:row_id")


@query("survival_gate", oracle(G_OUT, BD.BOARD, gate_sql("(SELECT * EXCLUDE (accepted, robust_passes) FROM board)"), "SELECT * FROM gt"))
def survival_gate(spark, d):
    b = BD.board(spark, d).drop("accepted", "robust_passes")
    return GT.survival_gate(b).select([x.split(":")[1] for x in G_OUT.split()])


@query("survival_score", oracle("i:row_id f:survival_score", BD.BOARD, gate_sql("(SELECT * EXCLUDE (accepted, robust_passes) FROM board)"), "SELECT row_id, survival_score FROM gt"))
def survival_score(spark, d):
    b = GT.survival_gate(BD.board(spark, d).drop("accepted", "robust_passes"))
    return b.select("row_id", GT.survival_score().alias("survival_score"))


@query("annual_scores", oracle("i:row_id f:validation_score f:train_only_score f:crisis_score s:validation_reason s:train_only_reason s:crisis_reason", BD.BOARD,
    """a AS (SELECT row_id, feature_count % 6 + 1 AS fc, least(train_years_positive, 14) / 14e0 AS ta, validation_years_positive / 12e0 AS va, 24 AS tt, 12 AS vt, train_down_years_ge_5pct AS tn, 3 AS tnt, validation_down_years_ge_5pct AS vn, 2 AS vnt,
       row_id % 4 AS fn, row_id % 3 AS fnb, row_id % 5 AS vfnb, 0.55e0 AS base, average_abs_exposure / 4 + 0.01 AS tm, exposure_turnover / 2 + 0.01 AS vm, train_years_positive AS th FROM board)""",
    """SELECT row_id, va * 100 + ta * 30 + vn * 8 + tn * 2 + greatest(0, va - base) * 20 - vm * 10 - greatest(0, fc - 2) * 0.5 AS validation_score,
       CASE WHEN ta >= 1 THEN 5000 ELSE 0 END + ta * 1000 + th * 10 + tn * 35 + CASE WHEN tn = tnt THEN 250 ELSE 0 END - fc * 8 - tm * 10 AS train_only_score,
       ta * 1000 + tn / 3e0 * 600 + tn * 30 - fnb * 1500 - fn * 250 - fc * 80 - tm * 10 AS crisis_score,
       CASE WHEN va < 0.7 THEN 'validation_accuracy' WHEN ta < 0.7 THEN 'train_accuracy' WHEN va <= base THEN 'baseline' WHEN vn < 1 THEN 'misses_validation_stress' WHEN fc > 4 THEN 'too_many_features' ELSE '' END AS validation_reason,
       CASE WHEN ta < 1 THEN 'train_not_perfect' WHEN tn < tnt THEN 'misses_train_stress' WHEN fc > 5 THEN 'too_many_features' ELSE '' END AS train_only_reason,
       CASE WHEN fc > 3 THEN 'too_many_features' WHEN ta < 0.9 THEN 'train_accuracy' WHEN tn / 3e0 < 0.8 THEN 'misses_train_stress' WHEN fnb > 0 THEN 'train_false_negative_big' WHEN va < 0.9 THEN 'validation_accuracy'
         WHEN va <= base THEN 'baseline' WHEN vn / 2e0 < 2 / 3e0 THEN 'misses_validation_stress' WHEN vfnb > 0 THEN 'validation_false_negative_big' ELSE '' END AS crisis_reason FROM a"""))
def annual_scores(spark, d):
    k = F.col("row_id")
    b = BD.board(spark, d).select(
        "row_id", (F.col("feature_count") % 6 + 1).alias("feature_count"), (F.least("train_years_positive", F.lit(14)) / 14.0).alias("train_accuracy"), (F.col("validation_years_positive") / 12.0).alias("validation_accuracy"),
        F.lit(24).alias("train_total"), F.lit(12).alias("validation_total"), F.col("train_down_years_ge_5pct").alias("train_negative_hits"), F.lit(3).alias("train_negative_total"),
        F.col("validation_down_years_ge_5pct").alias("validation_negative_hits"), F.lit(2).alias("validation_negative_total"), (k % 4).alias("train_false_negative"), (k % 3).alias("train_false_negative_big"),
        (k % 5).alias("validation_false_negative_big"), F.lit(0.55).alias("always_positive_validation_accuracy"), (F.col("average_abs_exposure") / 4 + 0.01).alias("train_return_mae"),
        (F.col("exposure_turnover") / 2 + 0.01).alias("validation_return_mae"), F.col("train_years_positive").alias("train_hits"))
    return GT.annual_scores(b).select("row_id", "validation_score", "train_only_score", "crisis_score", "validation_reason", "train_only_reason", "crisis_reason")


@query("monthly_score", oracle("i:row_id f:monthly_score s:rejection_reason b:accepted", BD.BOARD,
    "m AS (SELECT *, CASE WHEN train_min_year_return = 0 THEN -1 ELSE train_min_year_return END AS tmin FROM board)",
    """SELECT row_id, CASE WHEN train_years_positive = 14 AND tmin >= 0.1 THEN 10000 ELSE 0 END + train_years_positive * 120 + tmin * 2000 + train_cagr * 500 - greatest(0, abs(train_mdd) - 0.25) * 600 - exposure_turnover * 120
       - greatest(0, average_abs_exposure - 0.75) * 80 - greatest(0, feature_count - 3) * 15 AS monthly_score, CASE WHEN train_years_positive < 14 THEN 'train_year_below_10pct' ELSE '' END AS rejection_reason, train_years_positive >= 14 AS accepted FROM m"""))
def monthly_score(spark, d):
    b = BD.board(spark, d).withColumn("train_years_ge_10pct", F.col("train_years_positive")).drop("accepted")
    return GT.monthly_score(b).select("row_id", "monthly_score", "rejection_reason", "accepted")


WS = ["ws AS (SELECT *, CASE WHEN train_calmar > 0 THEN validation_calmar / train_calmar END AS cr, CASE WHEN train_sharpe > 0 THEN validation_sharpe / train_sharpe END AS sr FROM board)",
    """wv AS (SELECT *, train_calmar > 1 AND validation_calmar > 1 AND coalesce(cr >= 0.8, false) AND NOT locked_opened AS verified_calmar_similarity,
       train_sharpe > 1 AND validation_sharpe > 1 AND coalesce(sr >= 0.8, false) AND train_cagr >= 0.04 AND validation_cagr >= 0.03 AND train_years_positive >= 10 AND validation_years_positive >= 9 AND average_abs_exposure >= 0.15 AND NOT locked_opened AS verified_sharpe_robust,
       CASE WHEN train_down_years_ge_5pct < 3 THEN 'train_down_year_below_5pct' WHEN train_years_positive < 14 THEN 'train_year_not_positive' ELSE '' END AS reason_down_5pct,
       CASE WHEN train_calmar <= 1 THEN 'train_calmar_below_or_equal_1' ELSE '' END AS reason_calmar,
       CASE WHEN train_sharpe <= 1 THEN 'train_sharpe_below_or_equal_1' WHEN train_cagr < 0.04 THEN 'train_cagr_below_4pct' WHEN train_years_positive < 10 THEN 'train_positive_years_below_10' WHEN average_abs_exposure < 0.15 THEN 'average_abs_exposure_below_15pct' ELSE '' END AS reason_sharpe,
       train_cagr * 100000 + train_min_year_return * 10000 - abs(train_mdd) * 1000 - greatest(0, feature_count - 5) * 10 AS tail FROM ws)""",
    """wk AS (SELECT *, reason_down_5pct = '' AND validation_years_positive = 12 AND validation_down_years_ge_5pct = 2 AS verified_train_validation_5pct, train_calmar * 1e6 + tail AS score_calmar, train_sharpe * 1e6 + tail AS score_sharpe,
       train_sharpe * 1e6 + train_years_positive * 20000 + train_cagr * 100000 + train_min_year_return * 50000 - abs(train_mdd) * 1000 - greatest(0, feature_count - 5) * 10 AS score_sharpe_years,
       CASE WHEN train_down_years_ge_5pct = 3 AND train_down_min_return >= 0.05 THEN 50000 ELSE 0 END + CASE WHEN train_years_positive = 14 AND train_min_year_return > 0 THEN 25000 ELSE 0 END + train_down_years_ge_5pct * 600 + train_years_positive * 160
        + train_down_min_return * 6000 + train_min_year_return * 3000 + train_cagr * 750 - greatest(0, abs(train_mdd) - 0.3) * 700 - exposure_turnover * 180 - greatest(0, average_abs_exposure - 0.8) * 100 - greatest(0, feature_count - 5) * 12 AS score_down_5pct FROM wv)"""]
WS_OUT = "i:row_id f:score_down_5pct f:score_calmar f:score_sharpe f:score_sharpe_years s:reason_down_5pct s:reason_calmar s:reason_sharpe b:verified_calmar_similarity b:verified_sharpe_robust b:verified_train_validation_5pct"


def weekly_board(spark, d):
    return GT.weekly_scores(BD.board(spark, d))


@query("weekly_scores", oracle(WS_OUT, BD.BOARD, WS, "SELECT * FROM wk"))
def weekly_scores(spark, d):
    return weekly_board(spark, d).select([x.split(":")[1] for x in WS_OUT.split()])


VER = ["flags AS (SELECT bool_or(verified_sharpe_robust) AS s, bool_or(verified_calmar_similarity) AS c FROM wk)",
       "ver AS (SELECT wk.* FROM wk, flags WHERE CASE WHEN s THEN verified_sharpe_robust WHEN c THEN verified_calmar_similarity ELSE verified_train_validation_5pct END)"]


@query("verified_rows", oracle("i:row_id f:score_sharpe b:strict", BD.BOARD, WS, VER,
    "SELECT row_id, score_sharpe, train_years_total = 14 AND validation_years_total = 12 AS strict FROM ver"))
def verified_rows(spark, d):
    w = weekly_board(spark, d)
    strict = GT.strict_years(w).select("row_id", F.lit(True).alias("strict"))
    return GT.verified_cascade(w).join(strict, "row_id", "left").select("row_id", "score_sharpe", F.coalesce("strict", F.lit(False)).alias("strict"))


@query("stamp_sharpe_validity", oracle("i:row_id f:ratio b:verified b:relaxed b:verified_years b:relaxed_years", BD.BOARD, WS, """
SELECT row_id, sr AS ratio, train_sharpe > 1 AND validation_sharpe > 1 AND coalesce(sr >= 0.8, false) AND NOT locked_opened AS verified, train_sharpe > 0 AND validation_sharpe > 0 AND NOT locked_opened AS relaxed,
 train_sharpe > 1 AND train_cagr >= 0.04 AND train_years_positive >= 10 AND average_abs_exposure >= 0.15 AND NOT locked_opened AS verified_years, train_sharpe > 0 AND NOT locked_opened AS relaxed_years FROM ws"""))
def stamp_sharpe_validity(spark, d):
    a = GT.stamp_sharpe_validity(BD.board(spark, d)).withColumnsRenamed({"verified_sharpe_robust": "verified", "relaxed_valid": "relaxed", "validation_sharpe_ratio_to_train": "ratio"})
    b = GT.stamp_sharpe_validity(a, positive_years=True)
    return b.select("row_id", "ratio", "verified", "relaxed", F.col("verified_sharpe_robust").alias("verified_years"), F.col("relaxed_valid").alias("relaxed_years"))


@query("early_soft_hard_gates", oracle("i:row_id s:early_rejection s:soft_rejection s:hard_rejection", BD.BOARD, """
SELECT row_id, CASE WHEN train_calmar < 0.5 THEN 'early_train_calmar' WHEN abs(train_mdd) > 0.45 THEN 'early_train_mdd' WHEN trades_per_year < 4 THEN 'early_too_few_trades' WHEN trades_per_year > 150 THEN 'early_too_many_trades' ELSE '' END AS early_rejection,
 CASE WHEN train_block_min_calmar < 0 THEN 'soft_train_block_min_calmar' WHEN validation_block_min_calmar < 0 THEN 'soft_validation_block_min_calmar' WHEN train_blocks_positive < 5 THEN 'soft_train_blocks_positive' WHEN validation_blocks_positive < 5 THEN 'soft_validation_blocks_positive' ELSE '' END AS soft_rejection,
 CASE WHEN train_block_min_calmar < 0.5 THEN 'train_block_min_calmar' WHEN validation_block_min_calmar < 0.5 THEN 'validation_block_min_calmar' WHEN train_blocks_positive < 6 THEN 'train_blocks_positive' WHEN validation_blocks_positive < 6 THEN 'validation_blocks_positive' ELSE '' END AS hard_rejection FROM board"""))
def early_soft_hard_gates(spark, d):
    return GT.walkforward_gates(BD.board(spark, d)).select("row_id", "early_rejection", "soft_rejection", "hard_rejection")


@query("shootout_flags_score", oracle("i:row_id b:quick_pass b:near_final f:shootout_score s:method", BD.BOARD, """q AS (SELECT *,
  train_calmar >= 0.5 AND validation_calmar >= 0.5 AND abs(train_mdd) <= 0.45 AND abs(validation_mdd) <= 0.45 AND trades_per_year BETWEEN 6 AND 150 AND long_fraction BETWEEN 0.2 AND 0.9 AND train_blocks_positive >= 4 AND validation_blocks_positive >= 4 AS quick_pass,
  train_calmar >= 1 AND validation_calmar >= 1 AND abs(train_mdd) <= 0.35 AND abs(validation_mdd) <= 0.35 AND walkforward_passes >= 3 AS near_final FROM board)""", """
SELECT row_id, quick_pass, near_final, CASE WHEN quick_pass THEN 100 ELSE 0 END + CASE WHEN near_final THEN 250 ELSE 0 END + CASE WHEN accepted THEN 500 ELSE 0 END + 8 * robust_passes + 4 * walkforward_passes + 2 * train_calmar + 2 * validation_calmar
 - abs(train_mdd) * 4 - abs(validation_mdd) * 4 AS shootout_score, CASE row_id % 5 WHEN 0 THEN 'hinted' WHEN 1 THEN 'beam' WHEN 2 THEN 'bandit' WHEN 3 THEN 'adaptive' ELSE 'genetic' END AS method FROM q"""))
def shootout_flags_score(spark, d):
    k = F.col("row_id") % 5
    b = GT.shootout(BD.board(spark, d)).withColumns({
        "marathon_method": F.when(k == 0, "hinted").when(k == 1, "nan").otherwise(""),
        "source_file": F.when(k == 1, "out/beam_7.csv").when(k == 2, "out/bandit.csv").when(k == 4, "genetic/x.csv").otherwise("misc.csv")})
    return GT.infer_method(b).select("row_id", "quick_pass", "near_final", "shootout_score", "method")


@query("ml_gates", oracle("i:row_id s:rejection_reason", BD.BOARD, """
SELECT row_id, CASE WHEN train_calmar < 1 THEN 'train_calmar' WHEN train_cagr < 0.03 OR train_mdd < -0.3 THEN 'train_total_metrics' WHEN train_calmar > 8 THEN 'train_calmar_too_high' WHEN long_fraction < 0.1 THEN 'too_short_biased'
 WHEN long_fraction > 0.95 THEN 'too_long_biased' WHEN trades_per_year < 6 THEN 'too_few_trades' WHEN trades_per_year > 120 THEN 'too_many_trades' WHEN validation_calmar < 1 THEN 'validation_calmar'
 WHEN validation_cagr < 0.03 OR validation_mdd < -0.3 THEN 'validation_total_metrics' WHEN train_calmar / greatest(validation_calmar, 1e-9) > 2.5 THEN 'train_validation_calmar_ratio' WHEN excess_pvalue > 0.6 THEN 'validation_excess_pvalue'
 WHEN bootstrap_calmar_p05 < -1 THEN 'validation_bootstrap_calmar_p05' ELSE '' END AS rejection_reason FROM board"""))
def ml_gates(spark, d):
    return GT.learning_gates(BD.board(spark, d)).select("row_id", "rejection_reason")


@query("ml_survival_score", oracle("i:row_id f:survival_score", BD.BOARD, """
SELECT row_id, validation_calmar + bootstrap_calmar_p05 - 0.25 * greatest(0, train_calmar - greatest(validation_calmar, 0) * 2) - complexity_penalty - repeated_failure_penalty - CASE WHEN validation_mdd < -0.3 THEN abs(validation_mdd) - 0.3 ELSE 0 END AS survival_score FROM board"""))
def ml_survival_score(spark, d):
    return GT.learning_score(BD.board(spark, d)).select("row_id", "survival_score")


@query("annual_return_gate", oracle("s:candidate_id f:min_annual_return f:min_annual_calmar b:annual_return_ok b:annual_calmar_ok", UNI_SQL,
    "u AS (SELECT candidate_id || '/' || year(timestamp) AS symbol, candidate_id, timestamp AS ts, strategy_return AS x FROM uni)",
    f"n AS (SELECT *, product(1 + x) OVER {CUM} AS nav FROM u)", f"dd AS (SELECT *, nav / MAX(nav) OVER {CUM} - 1 AS dd FROM n)",
    "g AS (SELECT candidate_id, symbol, COUNT(*) AS n, arg_max(nav, ts) AS f, MIN(dd) AS mdd FROM dd GROUP BY 1, 2)",
    "h AS (SELECT candidate_id, f - 1 AS r, CASE WHEN mdd < -1e-12 THEN (CASE WHEN f > 0 THEN pow(f, 252e0 / n) - 1 ELSE -1 END) / abs(mdd) ELSE 999 END AS c FROM g)",
    "SELECT candidate_id, MIN(r) AS min_annual_return, MIN(c) AS min_annual_calmar, MIN(r) >= -0.2 AS annual_return_ok, MIN(c) >= 0 AS annual_calmar_ok FROM h GROUP BY 1"))
def annual_return_gate(spark, d):
    u = universal_returns(spark, d).withColumns({"year": F.year("timestamp"), "one": F.lit(1.0)})
    m = B.metrics_next_returns(u, "one", "strategy_return", ["candidate_id", "year"], "timestamp")
    y = m.select("candidate_id", (F.col("final_nav") - 1.0).alias("annual_return"), F.col("calmar").alias("annual_calmar"))
    return GT.yearly_floor(y, ["candidate_id"], -0.2, 0.0)


@query("diversity_gate")
def diversity_gate(spark, d):
    """Greedy diversity per method over the best rows that pass the gates."""
    from barlab.operators import leaderboard as LB

    b = GT.learning_gates(BD.board(spark, d)).where("rejection_reason = ''")
    b = LB.best_per(b, ["candidate_id"], [F.col("score"), -F.col("row_id")])
    names = F.array(*[F.lit(x) for x in ("pa_gap", "rsi_14", "ret_5", "vol_20", "roll_mean", "macd_line", "pending_vix", "lag_1")])
    f = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(names, ((F.col("row_id") * (i + 1)) % 8).cast("int")))
    fam = F.transform(F.array_distinct(f), lambda x: TX.learning_family(x))
    rows = b.select("candidate_id", F.col("method").alias("run"), "score", F.array_distinct(f).alias("features"), fam.alias("families"), "long_fraction", "trades_per_year",
                    (1.0 + F.col("train_cagr")).alias("final_nav"), F.col("row_id").cast("string").alias("signature"))
    return GT.diversity(rows).select("run", "candidate_id", "score", "verdict")


@query("valid_candidate_check", oracle("i:row_id s:rule", BD.BOARD, WS, """
(SELECT row_id, 'sharpe_robust' AS rule FROM wk WHERE verified_sharpe_robust AND NOT locked_opened ORDER BY validation_sharpe DESC, train_sharpe DESC, row_id LIMIT 1)
UNION ALL (SELECT row_id, 'positive_calmar' FROM wk WHERE train_calmar > 0 AND validation_calmar > 0 AND NOT locked_opened ORDER BY validation_calmar DESC, train_calmar DESC, row_id LIMIT 1)"""))
def valid_candidate_check(spark, d):
    w = weekly_board(spark, d).where("NOT locked_opened").withColumn("candidate_id", F.col("row_id"))
    a = GT.best_by(w.where("verified_sharpe_robust"), "validation_sharpe", "train_sharpe").select("row_id", F.lit("sharpe_robust").alias("rule"))
    b = GT.best_by(w.where("train_calmar > 0 AND validation_calmar > 0"), "validation_calmar", "train_calmar").select("row_id", F.lit("positive_calmar").alias("rule"))
    return a.unionByName(b)


@query("spy_only_guard", oracle("i:row_id s:rule", BD.BOARD, """
SELECT row_id, CASE row_id % 3 WHEN 0 THEN 'spy_long_short_always' WHEN 1 THEN 'spy_long_short_score' END AS rule FROM board WHERE row_id % 3 < 2 AND row_id % 4 <> 1"""))
def spy_only_guard(spark, d):
    k = F.col("row_id")
    b = BD.board(spark, d).select("row_id", F.when(k % 3 == 0, "spy_long_short_always").when(k % 3 == 1, "spy_long_short_score").otherwise("portfolio_regime").alias("rule"),
        F.when(k % 4 == 0, "spy").when(k % 4 == 1, "TLT").alias("asset"))
    return GT.single_asset_guard(b).select("row_id", "rule")


# --- named scalars ----------------------------------------------------------------------------

FN = ["fn AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) || '_' || x AS name FROM part, (SELECT unnest(['ret_5', 'vol_20', 'pending_vix', 'sma', 'credit', 'level', 'pa_gap', 'yield', 'gap', 'macd']) AS x))",
      "fp AS (SELECT CASE WHEN contains(name, 'pending') THEN 'pending_' || name WHEN contains(name, 'macd') OR contains(name, 'pa_gap') THEN regexp_replace(name, '^.*_(macd|pa_gap)$', '\\1') || '_' || length(name) ELSE name END AS name FROM fn)"]


def names(spark, d):
    x = I.table(spark, d, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("p")).distinct()
    sfx = F.array(*[F.lit(s) for s in ("ret_5", "vol_20", "pending_vix", "sma", "credit", "level", "pa_gap", "yield", "gap", "macd")])
    n = x.select("p", F.explode(sfx).alias("s")).select(F.concat_ws("_", "p", "s").alias("name"))
    return n.select(F.when(F.col("name").contains("pending"), F.concat(F.lit("pending_"), "name"))
        .when(F.col("name").contains("macd") | F.col("name").contains("pa_gap"), F.concat(F.regexp_extract("name", "_(macd|pa_gap)$", 1), F.lit("_"), F.length("name").cast("string")))
        .otherwise(F.col("name")).alias("name")).distinct()


@query("feature_prefix", oracle("s:p_brand s:prefix", "SELECT DISTINCT p_brand, replace(replace(lower(replace('^' || p_brand || '-X.' || p_type, '^', '')), '-', '_'), '.', '_') AS prefix FROM part"))
def feature_prefix(spark, d):
    p = I.table(spark, d, "part")
    return p.select("p_brand", TX.feature_prefix(F.concat(F.lit("^"), "p_brand", F.lit("-X."), "p_type")).alias("prefix")).distinct()


@query("feature_family", oracle("s:name s:daily s:panel s:learning", FN, f"""
SELECT DISTINCT name, {TX.classify_sql(TX.DAILY_FAMILIES, 'name', "'other'")} AS daily, {TX.classify_sql(TX.PANEL_FAMILIES, 'name', "'other'")} AS panel,
 CASE WHEN starts_with(name, 'pending_') THEN {TX.classify_sql(TX.PENDING_FAMILIES, 'name', "'pending_other'")} ELSE {TX.classify_sql(TX.LEARNING_FAMILIES, 'name', "split_part(name, '_', 1)")} END AS learning FROM fp"""))
def feature_family(spark, d):
    n = F.col("name")
    return names(spark, d).select("name", TX.daily_family(n).alias("daily"), TX.panel_family(n).alias("panel"), TX.learning_family(n).alias("learning"))


@query("feature_groups", oracle("s:grp i:features s:first_name", FN, "d AS (SELECT DISTINCT name FROM fp)",
    " UNION ALL ".join(f"SELECT '{g}' AS grp, COUNT(*) AS features, MIN(name) AS first_name FROM d WHERE {TX.rule_sql(r, 'name')} HAVING COUNT(*) > 0" for g, r in TX.GROUP_RULES)))
def feature_groups(spark, d):
    n = F.col("name")
    tags = F.array_compact(F.array(*[F.when(TX.matches(n, r), F.lit(g)) for g, r in TX.GROUP_RULES]))
    return names(spark, d).select("name", F.explode(tags).alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("features"), F.min("name").alias("first_name"))




def _topic_sql():
    parts = []
    for a, toks in TX.IDEA_TOPICS:
        hit = " OR ".join(f"contains(t, '{w}')" for w in a)
        for tok in toks:
            parts.append(f"SELECT doc_id, '{tok}' AS tok FROM ideas WHERE {hit}")
    none = " AND ".join(f"NOT contains(t, '{w}')" for a, _ in TX.IDEA_TOPICS for w in a)
    parts += [f"SELECT doc_id, '{tok}' FROM ideas WHERE {none}" for tok in TX.DEFAULT_IDEA_TOKENS]
    return "tk AS (" + " UNION ".join(parts) + ")"


@query("literature_groups", oracle("i:doc_id i:features s:names", "ideas AS (SELECT doc_id, lower(text) AS t FROM documents)", FN, "d AS (SELECT DISTINCT name FROM fp)", _topic_sql(),
    "f AS (SELECT DISTINCT k.doc_id, d.name FROM (SELECT DISTINCT tok FROM tk) AS u JOIN d ON contains(d.name, u.tok) JOIN tk AS k ON k.tok = u.tok)", "SELECT doc_id, COUNT(*) AS features, string_agg(name, ',' ORDER BY name) AS names FROM f GROUP BY 1"))
def literature_groups(spark, d):
    """Features each idea text points to: topic words to tokens, tokens to names."""
    # a text is lowered once and read once; what is kept of it is one bit per topic, or the last bit if it has none
    texts = I.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("t"))
    bits = F.lit(0)
    for k, (words, _) in enumerate(TX.IDEA_TOPICS):
        bits = bits + F.when(reduce(or_, [F.col("t").contains(w) for w in words]), 1 << k).otherwise(0)
    token_sets = [*(toks for _, toks in TX.IDEA_TOPICS), TX.DEFAULT_IDEA_TOKENS]
    ideas = texts.select("doc_id", bits.alias("topics")).groupBy("doc_id").agg(
        F.bit_or(F.when(F.col("topics") == 0, 1 << len(TX.IDEA_TOPICS)).otherwise(F.col("topics"))).alias("topics"))
    ideas = checkpoint(ideas)
    # names resolve once per distinct topic set, of which there are at most 2^9, and their list is written out once
    every = sorted({x for s in token_sets for x in s})
    n = F.col("name")
    tagged = names(spark, d).select("name", F.explode(F.array_compact(F.array(*[F.when(n.contains(x), F.lit(x)) for x in every]))).alias("tok"))
    sets = F.array(*[F.when(F.col("topics").bitwiseAND(1 << k) != 0, F.array(*[F.lit(x) for x in toks])) for k, toks in enumerate(token_sets)])
    kinds = ideas.select("topics").distinct().select("topics", F.explode(F.array_distinct(F.flatten(F.array_compact(sets)))).alias("tok"))
    per = kinds.join(tagged, "tok").groupBy("topics").agg(F.array_sort(F.collect_set("name")).alias("names"))
    per = per.select("topics", F.size("names").alias("features"), F.array_join("names", ",").alias("names"))
    # the side with the names is bounded by the feature list and never meets a hot key in a shuffle
    return ideas.join(F.broadcast(per), "topics").select("doc_id", "features", "names")


@query("rate_to_decimal", oracle("d:ts s:series f:rate", "o AS (SELECT CAST(o_orderdate AS DATE) AS ts, o_orderpriority AS series, MAX(o_totalprice) / 100 AS rate FROM orders GROUP BY 1, 2)", "SELECT * FROM o"))
def rate_to_decimal(spark, d):
    from barlab.operators import features as X

    g = I.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("series")).agg(F.max("o_totalprice").alias("v"))
    return g.select("ts", "series", X.rate_to_decimal("v").alias("rate"))


@query("json_safe", oracle("i:row_id s:payload", BD.BOARD, """
SELECT row_id, '{"method":"' || method || '","specs":["a","b"]' || CASE WHEN row_id % 5 < 3 THEN ',"stage":' || stage ELSE '' END || '}' AS payload FROM board"""))
def json_safe(spark, d):
    k = F.col("row_id")
    x = F.when(k % 5 == 3, F.lit(float("nan"))).when(k % 5 == 4, F.lit(float("inf"))).otherwise(F.col("stage").cast("double"))
    return BD.board(spark, d).select("row_id", F.to_json(F.struct("method", F.split(F.lit("a;b"), ";").alias("specs"), TX.json_safe(x).cast("bigint").alias("stage"))).alias("payload"))


@query("truthy", oracle("i:row_id b:flag f:value", BD.BOARD, """
SELECT row_id, row_id % 6 IN (0, 1, 2) AS flag, CASE row_id % 4 WHEN 0 THEN 1.5 WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE row_id END AS value FROM board"""))
def truthy(spark, d):
    k = F.col("row_id")
    text = F.get(F.array(*[F.lit(x) for x in (" TRUE ", "1", "Yes", "no", "0", "")]), (k % 6).cast("int"))
    val = F.when(k % 4 == 0, "1.5").when(k % 4 == 1, "abc").when(k % 4 == 2, "inf").otherwise(k.cast("string"))
    return BD.board(spark, d).select("row_id", TX.truthy(text).alias("flag"), TX.finite_or(val, -1.0).alias("value"))


@query("feature_count", oracle("i:row_id i:feature_count", BD.BOARD, "SELECT row_id, CASE row_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE row_id % 3 + 1 END AS feature_count FROM board"))
def feature_count(spark, d):
    from barlab.plans.rules import feature_count as fc

    k = F.col("row_id")
    specs = F.array_join(F.array_repeat(F.lit("f|threshold|1|0|1"), (k % 3 + 1).cast("int")), ";")
    b = BD.board(spark, d).select("row_id", F.when(k % 4 == 0, "ma_crossover").when(k % 4 == 1, "momentum_threshold").when(k % 4 == 2, "linear_score").otherwise("feature_vote").alias("rule"),
        F.when(k % 4 == 3, specs).alias("feature_specs"))
    return b.select("row_id", fc(b).alias("feature_count"))


@query("sample_role_summary", oracle("s:candidate_id s:roles", UNI_SQL, "g AS (SELECT candidate_id, sample_role, MIN(timestamp) AS t FROM uni GROUP BY 1, 2)", "SELECT candidate_id, string_agg(sample_role, ',' ORDER BY t) AS roles FROM g GROUP BY 1"))
def sample_role_summary(spark, d):
    from barlab.operators import robust as RB

    return RB.sample_roles(universal_returns(spark, d))


