"""Machine learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.features import DAILY_SQL, O, Z
from barlab.functions import rolling as R
from barlab.operators import align as A
from barlab.operators import features as X
from barlab.operators import gates as GT
from barlab.operators import ml as M
from barlab.operators import recursive as RC
from barlab.operators import search as SE
from barlab.plans import decisions as D
from barlab.plans import inputs as I
from barlab.plans import strategies as S
from barlab.plans import sweeps as SW
from barlab.registry import oracle
from barlab.registry import sharing_query as query

COLS = D.FEATURES


def xy(spark, d):
    """Benchmark features with next return, zero-filled; locked rows are gone."""
    f = D.featured(spark, d).withColumn("next_return", R.ratio(R.lead("close"), "close") - 1.0)
    f = S.split_periods(f).dropna(subset=["next_return"])
    return M.zero_fill(f.select("symbol", "ts", "period", "next_return", *COLS), COLS)


XY = [*I.BARS, *I.RETS, *DAILY_SQL, "xy0 AS (SELECT symbol, ts, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in COLS) + f", lead(close) OVER {O} / close - 1 AS y FROM daily_features WHERE symbol = 'N')",
    "xy AS (SELECT *, CASE WHEN ts <= DATE '1998-12-31' THEN 'train' ELSE 'validation' END AS period FROM xy0 WHERE y IS NOT NULL AND ts <= DATE '2000-12-31')"]


def train():
    return F.col("period") == "train"


@query("corr_model", oracle("d:ts f:score", XY,
    "w AS (SELECT " + ", ".join(f"coalesce(SUM({c} * y) / nullif(sqrt(SUM({c} ^ 2)) * sqrt(SUM(y ^ 2)), 0), 0) AS w{i}" for i, c in enumerate(COLS)) + " FROM xy WHERE period = 'train')",
    "SELECT ts, " + " + ".join(f"{c} * w{i}" for i, c in enumerate(COLS)) + " AS score FROM xy, w"))
def corr_model(spark, d):
    return M.corr_model(xy(spark, d), COLS, "next_return", train()).select("ts", "score")


@query("ridge_closed_form")
def ridge_closed_form(spark, d):
    return M.ridge(xy(spark, d), COLS, "next_return", train(), 1.0).select("ts", "score")


@query("ridge_mllib")
def ridge_mllib(spark, d):
    out, _ = M.fit_regressor(xy(spark, d), COLS, "next_return", train(), "ridge", alpha=0.001)
    return out.select("ts", "score")


@query("forest")
def forest(spark, d):
    out, _ = M.fit_regressor(xy(spark, d), COLS, "next_return", train(), "random_forest", n_estimators=16, max_depth=3, seed=7)
    return out.select("ts", "score")


@query("boosting")
def boosting(spark, d):
    out, _ = M.fit_regressor(xy(spark, d), COLS, "next_return", train(), "hist_gradient_boosting", iterations=8, max_depth=3, seed=7)
    return out.select("ts", "score")


@query("logistic")
def logistic(spark, d):
    return M.logistic(xy(spark, d), COLS, "next_return", train()).select("ts", "score")


@query("median_impute_train", oracle("d:decision_date " + " ".join(f"f:{c}" for c in COLS), [*I.BARS, *I.RETS, *DAILY_SQL], D.WEEKLY_SQL,
    "m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m{i}" for i, c in enumerate(COLS)) + " FROM weekly WHERE period = 'train')",
    "SELECT decision_date, " + ", ".join(f"coalesce({c}, m{i}, 0) AS {c}" for i, c in enumerate(COLS)) + " FROM weekly, m"))
def median_impute_train(spark, d):
    return M.median_impute(D.weekly(spark, d), COLS, train()).select("decision_date", *COLS)


@query("zero_fill", oracle("d:ts f:a f:b", [*I.BARS, *I.RETS], "SELECT ts, coalesce(r, 0) AS a, CASE WHEN r > 0 THEN r ELSE 0 END AS b FROM rets WHERE symbol = 'N'"))
def zero_fill(spark, d):
    x = I.returns(I.bars(spark, d)).where("symbol = 'N'").select("ts", F.col("r").alias("a"), F.when(F.col("r") > 0, F.col("r")).when(F.col("r") < -0.01, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))).alias("b"))
    return M.zero_fill(x, ["a", "b"])


def ml_rows(spark, d, models=("ridge", "random_forest")):
    """Fit each model on training weeks, turn predictions into exposure, then the weekly leaderboard."""
    ex = D.weekly(spark, d).where("period <> 'locked'")
    ex = M.median_impute(ex, COLS, train()).withColumn("y", F.coalesce("next_return", F.lit(0.0)))
    picks = SW.ranked_assets(D.weekly_assets(spark, d), ("mom_26",)).drop("selector")
    pos = None
    for m in models:
        out, _ = M.fit_regressor(ex, COLS, "y", train(), m, alpha=0.01, n_estimators=16, seed=3)
        out = out.withColumn("candidate_id", F.lit(f"ml_{m}"))
        out = M.prediction_exposure(out, "score", train(), 0.0, 1.0, ("candidate_id",)).drop("score")
        p = out.join(picks, "decision_date").select("candidate_id", F.lit("machine_learning").alias("method"), F.col("target_end").alias("ts"), "target_year", "period", "sp500_down_year",
            F.col("y").alias("spy_return"), "traded_asset", "exposure", (F.col("exposure") * F.col("asset_return")).alias("strategy_return"))
        pos = p if pos is None else pos.unionByName(p)
    return pos


@query("ml_candidate_eval")
def ml_candidate_eval(spark, d):
    return SW.evaluate_positions(ml_rows(spark, d), 52.0).select("candidate_id", "train_cagr", "train_sharpe", "validation_sharpe", "train_years_total", "average_exposure", "most_used_asset")


def linear_specs(spark, n):
    c = SE.ml_candidates(COLS, spark.range(n), 61)
    return c.select(F.col("candidate_id").alias("spec_id"), F.when(F.col("model") == "ridge", "ridge").otherwise("corr").alias("model"), "alpha", "features")


def sweep(spark, d, n=60):
    x = xy(spark, d).withColumn("train", train())
    s = M.linear_sweep(x, linear_specs(spark, n), COLS)
    return s.withColumn("period", F.when(F.col("train"), "train").otherwise("validation"))


@query("ml_sweep_eval")
def ml_sweep_eval(spark, d):
    """Many linear specs at once: one Gram matrix, per-spec solves, metrics, statistics and gates."""
    scored = sweep(spark, d)
    m = M.sweep_metrics(scored)
    w = SW.period_wide(m.withColumn("tpy", F.col("trades") / (F.col("periods") / 252.0)), "spec_id", ["calmar", "cagr", "mdd", "sharpe", "long_fraction", "tpy"])
    w = w.withColumns({"long_fraction": F.col("train_long_fraction"), "trades_per_year": F.col("train_tpy")}).join(M.sweep_statistics(scored), "spec_id")
    return GT.learning_gates(w).select("excess_pvalue", "bootstrap_calmar_p05", "spec_id", "train_calmar", "validation_calmar", "train_sharpe", "validation_sharpe", "long_fraction", "trades_per_year", "rejection_reason")


@query("forest_classifier")
def forest_classifier(spark, d):
    return M.fit_classifier(xy(spark, d), COLS, "next_return", train(), "random_forest", n_estimators=16, max_depth=3, seed=7).select("ts", "score")


@query("boosting_classifier")
def boosting_classifier(spark, d):
    return M.fit_classifier(xy(spark, d), COLS, "next_return", train(), "gradient_boosting", iterations=5, max_depth=2, seed=7).select("ts", "score")


@query("feature_importance")
def feature_importance(spark, d):
    _, fitted = M.fit_regressor(xy(spark, d), COLS, "next_return", train(), "random_forest", n_estimators=16, max_depth=3, seed=7)
    return M.importance(spark, fitted, COLS)


@query("feature_ablation")
def feature_ablation(spark, d):
    """Validation Calmar with and without the most important feature."""
    x = xy(spark, d)
    full, fitted = M.fit_regressor(x, COLS, "next_return", train(), "ridge", alpha=0.001)
    top = M.importance(spark, fitted, COLS).orderBy(F.col("importance").desc(), "feature").head()["feature"]
    less, _ = M.fit_regressor(x, [c for c in COLS if c != top], "next_return", train(), "ridge", alpha=0.001)
    both = full.select("ts", "period", "score", "next_return", F.lit("all").alias("spec_id")).unionByName(less.select("ts", "period", "score", "next_return", F.lit(f"without {top}").alias("spec_id")))
    return M.sweep_metrics(both).where("period = 'validation'").select("spec_id", "calmar", "final_nav")


MAT = [f"r_{k}_{n}" for n in (5, 10, 20, 60, 126) for k in ("mean", "std", "skew", "kurt", "min", "max")] + [f"r_lag_{n}" for n in (1, 2, 3, 5, 10, 21)] + [
    "rsi_14", "macd_line", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_width", "ewma_vol_20", "vol_parkinson_20", "pa_gap", "pa_body", "pa_range", "pa_close_pos", "pa_overnight", "hl_vol"]


def feature_matrix_raw(spark, d):
    """Moments, lags, technical, volatility and price-action columns of every symbol."""
    raw = X.range_volatility(X.price_action(I.raw_bars(spark, d))).select("symbol", "ts", "vol_parkinson_20", "pa_gap", "pa_body", "pa_range", "pa_close_pos", "pa_overnight", (F.ln("high") - F.ln("low")).alias("hl"))
    b = RC.technical(I.returns(I.bars(spark, d)).select("symbol", "ts", "close", "r"))
    b = X.bollinger(X.rolling_moments(b)).withColumns({f"r_lag_{n}": R.lag("r", n) for n in (1, 2, 3, 5, 10, 21)}).drop("bb_mid")
    return b.join(raw, ["symbol", "ts"]).withColumn("hl_vol", R.std("hl", 20)).drop("hl")


@query("feature_matrix")
def feature_matrix(spark, d):
    """Fifty-one columns standardised over 252 rows; each family has its own oracle query."""
    m = feature_matrix_raw(spark, d)
    return R.zscores(m.select("symbol", "ts", *MAT), MAT, 252, ddof=1)


@query("standardised_block", oracle("s:symbol d:ts f:r_mean_20 f:r_lag_5", I.BARS, I.RETS,
    f"x AS (SELECT symbol, ts, CASE WHEN COUNT(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN AVG(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS a, lag(r, 5) OVER {O} AS b FROM rets)",
    f"SELECT symbol, ts, {Z('a', 252, 252, 'stddev_samp')} AS r_mean_20, {Z('b', 252, 252, 'stddev_samp')} AS r_lag_5 FROM x"))
def standardised_block(spark, d):
    x = I.returns(I.bars(spark, d)).withColumns({"a": R.mean("r", 20), "b": R.lag("r", 5)})
    x = R.zscores(x.select("symbol", "ts", "a", "b"), ["a", "b"], 252, ddof=1)
    return x.select("symbol", "ts", F.col("a").alias("r_mean_20"), F.col("b").alias("r_lag_5"))


@query("pending_features_join", oracle("s:symbol d:ts f:pending_high f:pending_urgent", I.BARS, I.ORDERS_DAILY,
    "p AS (SELECT ts, MAX(value) FILTER (series = '2-HIGH') AS h, MAX(value) FILTER (series = '1-URGENT') AS u FROM orders_daily GROUP BY 1)",
    "j AS (SELECT b.symbol, b.ts, p.h, p.u FROM bars AS b LEFT JOIN p ON p.ts = b.ts)",
    "SELECT symbol, ts, last_value(h IGNORE NULLS) OVER w AS pending_high, last_value(u IGNORE NULLS) OVER w AS pending_urgent FROM j WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def pending_features_join(spark, d):
    p = I.orders_daily(spark, d).groupBy("ts").pivot("series", ["2-HIGH", "1-URGENT"]).agg(F.max("value"))
    p = p.select("ts", F.col("`2-HIGH`").alias("pending_high"), F.col("`1-URGENT`").alias("pending_urgent"))
    return A.align_ffill(I.bars(spark, d).select("symbol", "ts"), p, ["pending_high", "pending_urgent"])


@query("ml_sweep")
def ml_sweep(spark, d):
    """Unique learning candidates evaluated, stamped and trimmed to the state."""
    from barlab.operators import leaderboard as LB

    m = M.sweep_metrics(sweep(spark, d, 90)).where("period = 'train'")
    rows = m.select(F.col("spec_id").alias("candidate_id"), F.lit("machine_learning").alias("method"), F.lit(0).alias("stage"), F.col("sharpe").alias("train_sharpe"), "calmar")
    st = LB.stamp(rows.withColumn("seq", F.lit(0)), 1)
    return LB.state_merge(st, "train_sharpe", 20).select("candidate_id", "method", "wave", "run_stamp", "train_sharpe", "calmar")


