"""Scores and acceptance gates: column expressions over a leaderboard. Thresholds are fixed values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col


def over(x: Column, limit: float) -> Column:
    return F.greatest(F.lit(0.0), x - F.lit(limit))


def under(x: Column, limit: float) -> Column:
    return F.greatest(F.lit(0.0), F.lit(limit) - x)


def known(x, default: float) -> Column:
    v = c(x) if isinstance(x, str) else x
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).otherwise(F.lit(default))


def nonzero(x: str, default: float) -> Column:
    """Missing and zero both take the default."""
    v = F.coalesce(c(x).cast("double"), F.lit(0.0))
    return F.when(v == 0, F.lit(default)).otherwise(v)


def reason(rules) -> Column:
    """First failing rule's name; empty text when all hold."""
    out = None
    for name, bad in rules:
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out.otherwise("")


SURVIVAL = {
    "train_calmar": (1.25, 8.0), "validation_calmar": 1.25, "ratio": 2.5, "cagr": 0.06, "mdd": 0.30,
    "trades": (12.0, 90.0), "long": (0.25, 0.75), "negative_years": 0, "features": 5,
}


def survival_gate(df: DataFrame, k: dict = SURVIVAL) -> DataFrame:
    """Fourteen checks: how many hold, the first that fails, acceptance and the score."""
    tc, vc = c("train_calmar"), c("validation_calmar")
    gap_bad = (vc == 0) | (tc / F.nullif(vc, F.lit(0.0)) > k["ratio"])
    rules = [
        ("train_calmar", tc < k["train_calmar"][0]),
        ("validation_calmar", vc < k["validation_calmar"]),
        ("train_calmar_too_high", tc > k["train_calmar"][1]),
        ("train_validation_gap", gap_bad),
        ("train_cagr", c("train_cagr") < k["cagr"]),
        ("validation_cagr", c("validation_cagr") < k["cagr"]),
        ("train_mdd", F.abs("train_mdd") > k["mdd"]),
        ("validation_mdd", F.abs("validation_mdd") > k["mdd"]),
        ("too_few_trades", c("trades_per_year") < k["trades"][0]),
        ("too_many_trades", c("trades_per_year") > k["trades"][1]),
        ("too_little_long", c("long_fraction") < k["long"][0]),
        ("too_much_long", c("long_fraction") > k["long"][1]),
        ("validation_negative_years", c("validation_negative_years") > k["negative_years"]),
        ("too_many_features", c("feature_count") > k["features"]),
    ]
    passes = F.size(F.filter(F.array(*[~F.coalesce(bad, F.lit(True)) for _, bad in rules]), lambda ok: ok))
    out = df.withColumns({"robust_passes": passes, "robust_total": F.lit(len(rules)), "rejection_reason": reason(rules)})
    out = out.withColumn("accepted", c("rejection_reason") == "")
    return out.withColumn("survival_score", survival_score())


def survival_score() -> Column:
    z = lambda n: F.coalesce(c(n).cast("double"), F.lit(0.0))
    tc, vc = z("train_calmar"), z("validation_calmar")
    return (
        z("robust_passes") * 10.0 + vc + 0.25 * tc + z("validation_cagr") + 0.5 * z("train_cagr")
        - 0.35 * F.greatest(F.lit(0.0), tc - 2.0 * F.greatest(vc, F.lit(0.0)))
        - F.greatest(F.lit(0.0), z("feature_count") - 2.0) * 0.15
        - over(tc, 8.0)
        - (under(z("trades_per_year"), 12.0) * 0.08 + over(z("trades_per_year"), 90.0) * 0.02)
        - (under(z("long_fraction"), 0.25) * 4.0 + over(z("long_fraction"), 0.75) * 4.0)
        - (over(F.abs(z("train_mdd")), 0.30) * 3.0 + over(F.abs(z("validation_mdd")), 0.30) * 3.0)
        - z("validation_negative_years") * 0.8
    )


def annual_scores(df: DataFrame) -> DataFrame:
    """Validation, train-only and crisis-stable scores with their rejection reasons."""
    ta, va = c("train_accuracy"), c("validation_accuracy")
    fc, base = c("feature_count"), c("always_positive_validation_accuracy")
    tn, tnt = c("train_negative_hits"), c("train_negative_total")
    vn, vnt = c("validation_negative_hits"), c("validation_negative_total")
    mae_t, mae_v = nonzero("train_return_mae", 1.0), nonzero("validation_return_mae", 1.0)
    validation = (
        va * 100.0 + ta * 30.0 + vn * 8.0 + tn * 2.0 + F.greatest(F.lit(0.0), va - base) * 20.0 - mae_v * 10.0
        - F.greatest(F.lit(0.0), fc - 2.0) * 0.5
    )
    perfect = (
        F.when(ta >= 1.0, 5000.0).otherwise(0.0) + ta * 1000.0 + c("train_hits") * 10.0 + tn * 35.0
        + F.when((tnt > 0) & (tn == tnt), 250.0).otherwise(0.0) - fc * 8.0 - mae_t * 10.0
    )
    crisis = (
        ta * 1000.0 + tn / F.greatest(F.lit(1), tnt) * 600.0 + tn * 30.0 - c("train_false_negative_big") * 1500.0
        - c("train_false_negative") * 250.0 - fc * 80.0 - mae_t * 10.0
    )
    stress_t = F.when(tnt > 0, tn / F.nullif(tnt, F.lit(0)))
    stress_v = F.when(vnt > 0, vn / F.nullif(vnt, F.lit(0)))
    return df.withColumns({
        "validation_score": validation, "train_only_score": perfect, "crisis_score": crisis,
        "validation_reason": reason([
            ("too_few_validation_years", c("validation_total") < 8), ("validation_accuracy", va < 0.70), ("train_accuracy", ta < 0.70),
            ("baseline", va <= base), ("misses_validation_stress", (vnt > 0) & (vn < 1)), ("too_many_features", fc > 4)]),
        "train_only_reason": reason([
            ("too_few_train_years", c("train_total") < 20), ("train_not_perfect", ta < 1.0), ("misses_train_stress", (tnt > 0) & (tn < tnt)),
            ("too_many_features", fc > 5)]),
        "crisis_reason": reason([
            ("too_many_features", fc > 3), ("train_accuracy", ta < 0.90), ("misses_train_stress", stress_t < 0.80),
            ("train_false_negative_big", c("train_false_negative_big") > 0), ("validation_accuracy", va < 0.90), ("baseline", va <= base),
            ("misses_validation_stress", stress_v < 2.0 / 3.0), ("validation_false_negative_big", c("validation_false_negative_big") > 0)]),
    })


def monthly_score(df: DataFrame, floor: float = 0.10, multi_asset: bool = False) -> DataFrame:
    """Ten per cent in every training year; expects train_years_ge_floor and train_years_total."""
    passed, total = c("train_years_ge_10pct"), c("train_years_total")
    tmin = nonzero("train_min_year_return", -1.0)
    score = (
        F.when((passed == F.greatest(F.lit(1), total)) & (tmin >= floor), 10000.0).otherwise(0.0) + passed * 120.0 + tmin * 2000.0
        + F.coalesce("train_cagr", F.lit(0.0)) * 500.0 - over(F.abs(F.coalesce("train_mdd", F.lit(0.0))), 0.25) * 600.0
        - c("exposure_turnover") * 120.0 - over(c("average_abs_exposure"), 0.75) * 80.0 - F.greatest(F.lit(0.0), c("feature_count") - 3.0) * 15.0
    )
    if multi_asset:
        score = score + F.least(c("unique_assets_used"), F.lit(10)) * 3.0
    out = df.withColumns({
        "rejection_reason": reason([("no_train_years", total == 0), ("train_year_below_10pct", passed < total)]),
        "monthly_score": score,
    })
    return out.withColumn("accepted", c("rejection_reason") == "")


def stamp_weekly(df: DataFrame) -> DataFrame:
    """Calmar and Sharpe verification flags of a weekly row."""
    tc, vc = known("train_calmar", -1.0), known("validation_calmar", -1.0)
    ts, vs = known("train_sharpe", -1.0), known("validation_sharpe", -1.0)
    cr, sr = F.when(tc > 0, vc / F.nullif(tc, F.lit(0.0))), F.when(ts > 0, vs / F.nullif(ts, F.lit(0.0)))
    t4, v3 = known("train_cagr", -1.0) >= 0.04, known("validation_cagr", -1.0) >= 0.03
    active = known("average_abs_exposure", 0.0) >= 0.15
    close = lambda r: F.coalesce(r >= 0.80, F.lit(False))
    open_ = F.coalesce("locked_opened", F.lit(False)) if "locked_opened" in df.columns else F.lit(False)
    return df.withColumns({
        "train_calmar_gt_1": tc > 1.0, "validation_calmar_gt_1": vc > 1.0, "validation_calmar_ratio_to_train": cr,
        "validation_calmar_ge_80pct_train": close(cr),
        "verified_calmar_similarity": (tc > 1.0) & (vc > 1.0) & close(cr) & ~open_,
        "train_sharpe_gt_1": ts > 1.0, "validation_sharpe_gt_1": vs > 1.0, "validation_sharpe_ratio_to_train": sr,
        "validation_sharpe_ge_80pct_train": close(sr), "train_cagr_ge_4pct": t4, "validation_cagr_ge_3pct": v3,
        "exposure_active_enough": active,
        "verified_sharpe_robust": (ts > 1.0) & (vs > 1.0) & close(sr) & t4 & v3 & active & ~open_
        & (c("train_years_positive") >= 10) & (c("validation_years_positive") >= 9),
    })


def weekly_scores(df: DataFrame) -> DataFrame:
    """Down-year, Calmar, Sharpe and Sharpe-with-positive-years scores and their rejection reasons."""
    df = stamp_weekly(df)
    fc = F.greatest(F.lit(0.0), c("feature_count") - 5.0)
    cagr, mdd, low = known("train_cagr", -1.0), F.abs(known("train_mdd", -1.0)), known("train_min_year_return", -1.0)
    ratio = lambda n: F.least(known(n, -1e6), F.lit(1e6)) * 1e6
    tail = cagr * 100000.0 + low * 10000.0 - mdd * 1000.0 - fc * 10.0
    dmin = F.coalesce("train_down_min_return", F.lit(-1.0))
    tmin = F.coalesce("train_min_year_return", F.lit(-1.0))
    dtot, ytot = F.greatest(F.lit(1), c("train_down_years_total")), F.greatest(F.lit(1), c("train_years_total"))
    dpass, ypos = c("train_down_years_ge_5pct"), c("train_years_positive")
    down = (
        F.when((dpass == dtot) & (dmin >= 0.05), 50000.0).otherwise(0.0) + F.when((ypos == ytot) & (tmin > 0), 25000.0).otherwise(0.0)
        + dpass * 600.0 + ypos * 160.0 + dmin * 6000.0 + tmin * 3000.0 + F.coalesce("train_cagr", F.lit(0.0)) * 750.0
        - over(F.abs(F.coalesce("train_mdd", F.lit(0.0))), 0.30) * 700.0 - c("exposure_turnover") * 180.0
        - over(c("average_abs_exposure"), 0.80) * 100.0 - fc * 12.0
    )
    none = ("no_train_years", c("train_years_total") == 0)
    ts = known("train_sharpe", -1.0)
    out = df.withColumns({
        "score_down_5pct": down, "score_calmar": ratio("train_calmar") + tail, "score_sharpe": ratio("train_sharpe") + tail,
        "score_sharpe_years": ratio("train_sharpe") + ypos * 20000.0 + cagr * 100000.0 + low * 50000.0 - mdd * 1000.0 - fc * 10.0,
        "reason_down_5pct": reason([none, ("no_train_down_years", c("train_down_years_total") == 0),
            ("train_down_year_below_5pct", dpass < c("train_down_years_total")), ("train_year_not_positive", ypos < c("train_years_total"))]),
        "reason_calmar": reason([none, ("train_calmar_below_or_equal_1", known("train_calmar", -1.0) <= 1.0)]),
        "reason_sharpe": reason([none, ("train_sharpe_below_or_equal_1", ts <= 1.0), ("train_cagr_below_4pct", known("train_cagr", -1.0) < 0.04),
            ("train_positive_years_below_10", ypos < 10), ("average_abs_exposure_below_15pct", known("average_abs_exposure", 0.0) < 0.15)]),
    })
    full = lambda a, b: (c(a) > 0) & (c(b) == c(a))
    ok = (c("reason_down_5pct") == "") & full("validation_years_total", "validation_years_positive") & full("validation_down_years_total", "validation_down_years_ge_5pct")
    return out.withColumn("verified_train_validation_5pct", F.coalesce(ok, F.lit(False)))


def verified_cascade(df: DataFrame) -> DataFrame:
    """Sharpe-verified rows if any exist, else Calmar-verified, else the five per cent rule."""
    flags = df.agg(F.coalesce(F.bool_or("verified_sharpe_robust"), F.lit(False)).alias("_s"),
                   F.coalesce(F.bool_or("verified_calmar_similarity"), F.lit(False)).alias("_c"), F.lit(1).alias("_k"))
    j = df.join(F.broadcast(flags), F.lit(1) == c("_k"))
    keep = F.when(c("_s"), c("verified_sharpe_robust")).when(c("_c"), c("verified_calmar_similarity")).otherwise(c("verified_train_validation_5pct"))
    return j.where(keep).drop("_s", "_c", "_k")


def strict_years(df: DataFrame, train: int = 14, validation: int = 12, train_down: int = 3, validation_down: int = 2) -> DataFrame:
    """Verified rows whose year totals are complete; down-year totals count only outside the Sharpe branch."""
    base = verified_cascade(df)
    years = (c("train_years_total") == train) & (c("validation_years_total") == validation)
    downs = (c("train_down_years_total") == train_down) & (c("validation_down_years_total") == validation_down)
    return base.where(years & F.when(c("verified_sharpe_robust"), ~c("locked_opened")).otherwise(downs))


def stamp_sharpe_validity(df: DataFrame, positive_years: bool = False) -> DataFrame:
    """Verified and relaxed validity in the similarity mode or the training-years mode."""
    ts, vs = c("train_sharpe"), c("validation_sharpe")
    ratio = F.when(ts > 0, vs / F.nullif(ts, F.lit(0.0)))
    open_ = ~c("locked_opened")
    close = F.coalesce(ratio >= 0.80, F.lit(False))
    if positive_years:
        ok = (ts > 1.0) & (c("train_cagr") >= 0.04) & (c("train_years_positive") >= 10) & (c("average_abs_exposure") >= 0.15) & open_
        relaxed = (ts > 0) & open_
    else:
        ok, relaxed = (ts > 1.0) & (vs > 1.0) & close & open_, (ts > 0) & (vs > 0) & open_
    no = F.lit(False)
    return df.withColumns({
        "validation_sharpe_ratio_to_train": ratio, "train_sharpe_gt_1": F.coalesce(ts > 1.0, no), "validation_sharpe_gt_1": F.coalesce(vs > 1.0, no),
        "validation_sharpe_ge_80pct_train": close, "verified_sharpe_robust": F.coalesce(ok, no), "relaxed_valid": F.coalesce(relaxed, no),
    })


def walkforward_gates(df: DataFrame) -> DataFrame:
    """Early, soft and hard rejection of a walk-forward row."""
    tm, vm, tp, vp = c("train_block_min_calmar"), c("validation_block_min_calmar"), c("train_blocks_positive"), c("validation_blocks_positive")
    tpy = c("trades_per_year")
    return df.withColumns({
        "early_rejection": reason([("early_train_calmar", c("train_calmar") < 0.50), ("early_train_mdd", F.abs("train_mdd") > 0.45),
                                   ("early_too_few_trades", tpy < 4.0), ("early_too_many_trades", tpy > 150.0)]),
        "soft_rejection": reason([("soft_train_block_min_calmar", tm < 0), ("soft_validation_block_min_calmar", vm < 0),
                                  ("soft_train_blocks_positive", tp < 5), ("soft_validation_blocks_positive", vp < 5)]),
        "hard_rejection": reason([("train_block_min_calmar", tm < 0.5), ("validation_block_min_calmar", vm < 0.5),
                                  ("train_blocks_positive", tp < 6), ("validation_blocks_positive", vp < 6)]),
    })


def shootout(df: DataFrame) -> DataFrame:
    """Quick pass, near final and the combined score across search families."""
    tc, vc, tm, vm = c("train_calmar"), c("validation_calmar"), F.abs("train_mdd"), F.abs("validation_mdd")
    quick = (
        (tc >= 0.5) & (vc >= 0.5) & (tm <= 0.45) & (vm <= 0.45) & c("trades_per_year").between(6.0, 150.0) & c("long_fraction").between(0.20, 0.90)
        & (c("train_blocks_positive") >= 4) & (c("validation_blocks_positive") >= 4)
    )
    near = (tc >= 1.0) & (vc >= 1.0) & (tm <= 0.35) & (vm <= 0.35) & (c("walkforward_passes") >= 3)
    out = df.withColumns({"quick_pass": quick, "near_final": near})
    on = lambda n, v: F.when(c(n), v).otherwise(0.0)
    return out.withColumn(
        "shootout_score",
        on("quick_pass", 100.0) + on("near_final", 250.0) + on("accepted", 500.0) + 8.0 * c("robust_passes") + 4.0 * c("walkforward_passes")
        + 2.0 * tc + 2.0 * vc - tm * 4.0 - vm * 4.0,
    )


def infer_method(df: DataFrame, hints=("marathon_method", "meta_method"), text="source_file") -> DataFrame:
    """Search method from explicit hints, then from names in the file or candidate text."""
    known = [F.nullif(F.nullif(F.col(h), F.lit("")), F.lit("nan")) for h in hints if h in df.columns]
    t = F.concat_ws("/", text, F.col("candidate_id").cast("string"))
    named = None
    for m in ("adaptive", "beam", "bayesian", "bandit", "genetic"):
        named = F.when(t.contains(m), m) if named is None else named.when(t.contains(m), m)
    return df.withColumn("method", F.coalesce(*known, named, F.lit("adaptive")))


def learning_gates(df: DataFrame, k: dict | None = None) -> DataFrame:
    """Training, behaviour, validation and statistical checks; the first failure names the rejection."""
    k = {"min_train_calmar": 1.0, "max_train_calmar": 8.0, "min_cagr": 0.03, "max_mdd": 0.30, "min_trades": 6.0, "max_trades": 120.0,
         "min_long": 0.10, "max_long": 0.95, "min_validation_calmar": 1.0, "max_ratio": 2.5, "max_pvalue": 0.60, "min_p05": -1.0} | (k or {})
    lf, tpy = c("long_fraction"), c("trades_per_year")
    vc = F.greatest(c("validation_calmar"), F.lit(1e-9))
    return df.withColumn("rejection_reason", reason([
        ("train_calmar", c("train_calmar") < k["min_train_calmar"]),
        ("train_total_metrics", (c("train_cagr") < k["min_cagr"]) | (c("train_mdd") < -k["max_mdd"])),
        ("train_calmar_too_high", c("train_calmar") > k["max_train_calmar"]),
        ("too_short_biased", lf < k["min_long"]), ("too_long_biased", lf > k["max_long"]),
        ("always_long", lf > 0.98), ("always_short", lf < 0.02),
        ("too_few_trades", tpy < k["min_trades"]), ("too_many_trades", tpy > k["max_trades"]),
        ("validation_calmar", c("validation_calmar") < k["min_validation_calmar"]),
        ("validation_total_metrics", (c("validation_cagr") < k["min_cagr"]) | (c("validation_mdd") < -k["max_mdd"])),
        ("train_validation_calmar_ratio", (c("train_calmar") > 0) & (c("train_calmar") / vc > k["max_ratio"])),
        ("validation_excess_pvalue", c("excess_pvalue") > k["max_pvalue"]),
        ("validation_bootstrap_calmar_p05", c("bootstrap_calmar_p05") < k["min_p05"]),
    ]))


def learning_score(df: DataFrame) -> DataFrame:
    v = F.coalesce("validation_calmar", F.lit(-10.0))
    gap = F.greatest(F.lit(0.0), c("train_calmar") - F.greatest(v, F.lit(0.0)) * 2.0)
    slip = F.when(c("validation_mdd") < -0.30, F.abs("validation_mdd") - 0.30).otherwise(0.0)
    return df.withColumn(
        "survival_score",
        v + F.coalesce("bootstrap_calmar_p05", F.lit(0.0)) - 0.25 * gap - c("complexity_penalty") - c("repeated_failure_penalty") - slip,
    )


def yearly_floor(years: DataFrame, by, min_return: float, min_calmar: float) -> DataFrame:
    """Every year at or above both floors."""
    return years.groupBy(*by).agg(
        F.min("annual_return").alias("min_annual_return"), F.min("annual_calmar").alias("min_annual_calmar"),
        (F.min("annual_return") >= min_return).alias("annual_return_ok"), (F.min("annual_calmar") >= min_calmar).alias("annual_calmar_ok"),
    )


def single_asset_guard(df: DataFrame, rules=("spy_long_short_always", "spy_long_short_score"), asset: str = "SPY") -> DataFrame:
    """Keep rows of the allowed rules that name no other asset."""
    ok = c("rule").isin(*rules)
    for k in ("risk_asset", "safe_asset", "stress_asset", "asset"):
        if k in df.columns:
            ok = ok & (F.coalesce(F.upper(k), F.lit(asset)) == asset)
    return df.where(ok)


#: Rows of one run that a task holds against the accepted rows; weights of the behaviour distance (fixed values).
RUN_ROWS, TRADES_SCALE, NAV_SCALE = 100_000, 150.0, 5.0
_DIVERSE = ("features", "long_fraction", "trades_per_year", "final_nav", "signature")


def _alike(left: str, right: str, min_distance: float, min_behavior: float) -> dict[str, Column]:
    """Why the row ``left`` may not stand beside the accepted row ``right``; both are struct columns."""
    a, b = c(left), c(right)
    both = F.size(F.array_intersect(a["features"], b["features"]))
    far = 1.0 - both / F.greatest(F.lit(1), F.size(F.array_union(a["features"], b["features"])))
    nav = lambda x: F.ln(F.greatest(x["final_nav"], F.lit(1e-9)))
    gap = F.abs(a["long_fraction"] - b["long_fraction"]) + F.abs(a["trades_per_year"] - b["trades_per_year"]) / TRADES_SCALE + F.abs(nav(a) - nav(b)) / NAV_SCALE
    return {
        "feature_duplicate": F.coalesce(far < min_distance, F.lit(False)),
        "feature_family_duplicate": a["_family"].eqNullSafe(b["_family"]),
        "behavior_duplicate": a["signature"].eqNullSafe(b["signature"]) | F.coalesce(gap < min_behavior, F.lit(False)),
    }


def diversity(df: DataFrame, min_distance: float = 0.15, min_behavior: float = 0.02, by=("run",)) -> DataFrame:
    """Greedy pick in score order: enough feature distance, a new family signature and new behaviour.

    Rounds of local winners: the best open row of every family signature is a winner; the winners of a run are accepted in order up
    to the first that conflicts with one before it, and open rows that conflict with accepted ones leave. A run accepts one row for
    a signature at most, so its winners and accepted rows are few however many candidates it has; its rows are dealt over
    tasks by count. Every verdict follows from the accepted rows before it. Ties go by candidate_id, then by row.
    """
    from barlab.session import checkpoint

    by = list(by)
    fields = [*_DIVERSE, "_family", "_row"]
    order = F.struct(F.coalesce(-F.col("score").cast("double"), F.lit(math.inf)).alias("s"), F.col("candidate_id").cast("string").alias("i"), F.col("_row").alias("r"))
    x = df.withColumns({"_row": F.monotonically_increasing_id(), "_family": F.array_join(F.array_sort(F.array_distinct("families")), ",")})
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / RUN_ROWS).cast("int").alias("_salts"))
    x = checkpoint(x.withColumn("_order", order).join(sizes, by).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int")))
    rows = x.select(*by, "_salts", "_salt", "_order", F.struct(*fields).alias("_one"))
    whys = lambda one, two: _alike(one, two, min_distance, min_behavior)
    clash = lambda one, two: reduce(lambda p, q: p | q, whys(one, two).values())
    spread = lambda a: a.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select(*by, "_salt", F.col("_order").alias("_before"), F.col("_one").alias("_other"))
    accepted, left = None, rows
    while True:
        best = left.groupBy(*by, F.col("_one._family").alias("_f")).agg(F.min_by(F.struct("_salts", "_salt", "_order", "_one"), "_order").alias("b")).select(*by, "b.*")
        best = checkpoint(best.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_order"))))
        pairs = best.select(*by, "_rank", "_one").join(best.select(*by, F.col("_rank").alias("_earlier"), F.col("_one").alias("_other")), by).where("_earlier < _rank")
        first = pairs.where(clash("_one", "_other")).groupBy(*by).agg(F.min("_rank").alias("_stop"))
        fresh = checkpoint(best.join(first, by, "left").where(F.col("_stop").isNull() | (F.col("_rank") < F.col("_stop"))).select(*rows.columns))
        if fresh.isEmpty():
            break
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        left = checkpoint(left.join(spread(fresh), [*by, "_salt"], "left").groupBy("_one._row").agg(F.bool_or(F.coalesce(clash("_one", "_other"), F.lit(False))).alias("_gone"), F.any_value(F.struct(*rows.columns)).alias("_all")).where("NOT _gone").select("_all.*"))
    if accepted is None:
        return df.withColumn("verdict", F.lit(None).cast("string"))
    seen = rows.join(spread(accepted).where("_other IS NOT NULL"), [*by, "_salt"], "left").withColumn("_after", F.coalesce(F.col("_before") < F.col("_order"), F.lit(False)))
    flags = seen.groupBy(F.col("_one._row").alias("_row")).agg(*[F.bool_or(F.col("_after") & w).alias(n) for n, w in whys("_one", "_other").items()])
    verdict = F.when(F.col("feature_duplicate"), "feature_duplicate").when(F.col("feature_family_duplicate"), "feature_family_duplicate").when(F.col("behavior_duplicate"), "behavior_duplicate").otherwise("accepted")
    return x.join(flags, "_row").select(*df.columns, verdict.alias("verdict"))


def best_by(df: DataFrame, *order: str) -> DataFrame:
    """Single best row by descending columns, ties by candidate_id."""
    return df.orderBy(*[c(o).desc_nulls_last() for o in order], "candidate_id").limit(1)
