"""Whole candidate sweeps as single jobs: catalogs, candidates, positions, metrics, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions import rolling as R
from barlab.operators import backtest as B
from barlab.operators import examples as E
from barlab.operators import quality as Q
from barlab.operators import signals as SG
from barlab.operators import specs as SP
from barlab.operators import votes as V
from barlab.plans import decisions as D
from barlab.plans import inputs as I
from barlab.plans import rulebook as RB
from barlab.plans import strategies as S

SELECTORS = ("mom_4", "mom_13", "mom_26", "mom_52", "low_vol_13w")
KNOBS = ("candidate_id", "selector", "intercept", "scale", "smoothing")


def period_long(ex: DataFrame) -> DataFrame:
    return Q.melt(ex.where("period <> 'locked'"), ["decision_date", "period"], D.SPEC_FEATURES)


def candidates(spark: SparkSession, sf_dir: str, long: DataFrame, quantiles=SP.WEEKLY_QUANTILES) -> DataFrame:
    """One candidate per feature and quantile: that feature's spec plus a reversed volatility spec."""
    t = SP.threshold_specs(long.where("period = 'train'"), quantiles, (1, 2))
    main = t.where("direction = 1 AND weight = 2").select("feature", "qi", F.col("spec").alias("s1"))
    other = t.where("direction = -1 AND weight = 1 AND feature = 'realized_vol_21d'").select("qi", F.col("spec").alias("s2"))
    q = F.col("qi")
    return main.join(F.broadcast(other), "qi").select(
        F.concat_ws("_", "feature", F.col("qi").cast("string")).alias("candidate_id"),
        F.array("s1", "s2").alias("specs"),
        F.get(F.array(*[F.lit(s) for s in SELECTORS]), F.pmod(q, F.lit(5))).alias("selector"),
        ((q - 3) * 0.1).alias("intercept"), (0.5 + q * 0.1).alias("scale"),
        F.when(q % 2 == 1, 0.2).otherwise(0.0).alias("smoothing"),
    )


def exposure_rows(long: DataFrame, cands: DataFrame) -> DataFrame:
    """(candidate_id, selector, decision_date, exposure) for every candidate and unlocked period."""
    specs = SP.parse_period(cands.select(F.explode("specs").alias("spec")).distinct())
    # imputation uses all unlocked rows, as the reference mode does
    paths = V.spec_paths(V.fill_median(long), specs, V.period_signal)
    e = V.exposures(cands, paths, KNOBS)
    periods = long.agg(F.array_sort(F.collect_set("decision_date")).alias("periods"))
    e = e.join(F.broadcast(periods.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k")).drop("_k")
    return V.expand(e.select("candidate_id", "selector", "exposure", "periods"), F.col("periods"), "exposure", "exposure").drop("periods")


def ranked_assets(assets: DataFrame, selectors=SELECTORS, benchmark: str = I.BENCHMARK) -> DataFrame:
    """(selector, decision_date, traded_asset, asset_return): best asset per selector and period.

    Selection depends on selector and period only, so it is computed once and shared by all
    candidates; the lowest volatility wins for the volatility selector, the first name wins ties, and
    a period without any score falls back to the benchmark.
    """
    pairs = F.array(*[
        F.struct(F.lit(s).alias("selector"), (-F.col("vol") if s.startswith("low_vol") else F.col(s)).alias("score")) for s in selectors
    ])
    x = assets.select("symbol", F.col("period_end").alias("decision_date"), "next_return", F.inline(pairs))
    best = F.min_by(F.struct("symbol", "next_return"), F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "symbol")))
    base = F.max(F.when(F.col("symbol") == benchmark, F.struct("symbol", "next_return")))
    g = x.groupBy("selector", "decision_date").agg(best.alias("b"), base.alias("f"))
    pick = F.coalesce("b", "f")
    return g.select("selector", "decision_date", F.coalesce(pick["symbol"], F.lit(benchmark)).alias("traded_asset"),
                    F.coalesce(pick["next_return"], F.lit(0.0)).alias("asset_return"))


def rotation_positions(ex: DataFrame, long: DataFrame, cands: DataFrame, assets: DataFrame) -> DataFrame:
    e = exposure_rows(long, cands)
    picks = ranked_assets(assets)
    base = ex.select("decision_date", F.col("target_end").alias("ts"), "target_year", "period", "sp500_down_year", F.coalesce("next_return", F.lit(0.0)).alias("spy_return"))
    p = e.join(picks, ["selector", "decision_date"]).join(F.broadcast(base), "decision_date")
    return p.withColumn("strategy_return", F.col("exposure") * F.col("asset_return"))


def benchmark_positions(ex: DataFrame, long: DataFrame, cands: DataFrame) -> DataFrame:
    """Positions in the benchmark alone (monthly study)."""
    base = ex.select("decision_date", F.col("target_end").alias("ts"), "target_year", "period", F.coalesce("next_return", F.lit(0.0)).alias("spy_return"))
    p = exposure_rows(long, cands).join(F.broadcast(base), "decision_date")
    return p.withColumns({"traded_asset": F.lit(I.BENCHMARK), "strategy_return": F.col("exposure") * F.col("spy_return"), "sp500_down_year": F.lit(False)})


def period_wide(df: DataFrame, key: str, cols, periods=("train", "validation")) -> DataFrame:
    """Long metrics per period to train_* and validation_* columns in one aggregation."""
    aggs = [F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{p}_{c}") for p in periods for c in cols]
    return df.groupBy(key).agg(*aggs)


def evaluate_positions(pos: DataFrame, ppy: float, floor: float = 0.10) -> DataFrame:
    """Leaderboard row per candidate from positions: metrics, year counts and exposure profile.

    Grouping sets give the period, year and whole-candidate aggregates in one pass over the
    positions, so the (large) position table is computed and shuffled once.
    """
    by = ["candidate_id", "period"]
    x = pos.withColumn("_dx", F.abs(R.diff("exposure", 1, ["candidate_id"])))
    x = B.curve(x, "strategy_return", by)
    e, r = F.col("exposure"), F.col("strategy_return")
    sets = [["candidate_id", "period", "target_year"], ["candidate_id", "period"], ["candidate_id"]]
    g = x.groupingSets(sets, "candidate_id", "period", "target_year").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.product(1.0 + r).alias("f"), F.min("drawdown").alias("mdd"),
        F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.bool_or("sp500_down_year").alias("down"),
        F.avg(e).alias("avg_e"), F.avg(F.abs(e)).alias("abs_e"), F.min(e).alias("min_e"), F.max(e).alias("max_e"),
        F.count_if(e > 0.05).alias("n_long"), F.count_if(F.abs(e) <= 0.05).alias("n_cash"), F.count_if(e < -0.05).alias("n_short"),
        F.avg("_dx").alias("turnover"), F.mode("traded_asset", True).alias("mode_asset"), F.size(F.collect_set("traded_asset")).alias("n_assets"),
    )
    year, period, whole = F.col("gid") == 0, F.col("gid") == 1, F.col("gid") == 3
    ret = F.col("f") - 1.0
    g = g.withColumn("cagr", B.annualised(F.col("f"), F.col("n"), ppy))
    g = g.withColumns({"calmar": B.calmar(F.col("cagr"), F.col("mdd"), None), "sharpe": B.sharpe(F.col("m"), F.col("s"), ppy)})
    one = lambda c: F.max(F.when(whole, F.col(c)))
    aggs = []
    for p in ("train", "validation"):
        here = F.col("period") == p
        y = year & here
        aggs += [F.max(F.when(period & here, F.col(c))).alias(f"{p}_{c}") for c in ("cagr", "mdd", "calmar", "sharpe")]
        aggs += [
            F.count_if(y & (ret > 0)).alias(f"{p}_years_positive"), F.count_if(y).alias(f"{p}_years_total"),
            F.min(F.when(y, ret)).alias(f"{p}_min_year_return"), F.count_if(y & F.col("down") & (ret >= 0.05)).alias(f"{p}_down_years_ge_5pct"),
            F.count_if(y & F.col("down")).alias(f"{p}_down_years_total"), F.min(F.when(y & F.col("down"), ret)).alias(f"{p}_down_min_return"),
            F.count_if(y & (ret >= floor)).alias(f"{p}_years_ge_floor"),
        ]
    profile = {
        "average_exposure": "avg_e", "average_abs_exposure": "abs_e", "min_exposure": "min_e", "max_exposure": "max_e", "weeks_long": "n_long",
        "weeks_cash_like": "n_cash", "weeks_short": "n_short", "exposure_turnover": "turnover", "most_used_asset": "mode_asset", "unique_assets_used": "n_assets",
    }
    aggs += [one(c).alias(k) for k, c in profile.items()]
    return g.groupBy("candidate_id").agg(*aggs).fillna(0.0, ["exposure_turnover"])


# --- daily rule sweep -------------------------------------------------------------------------

#: Parameter lists of the daily rules.
RULE_SPACE: dict[str, tuple] = {
    "fast_window": (3, 5, 8, 10, 12, 15, 18, 20), "slow_window": (10, 20, 30, 40, 60, 90, 120, 150),
    "momentum_window": (5, 10, 20, 60), "threshold": (-0.02, 0.0, 0.02, 0.05),
    "reversion_window": (10, 20, 60), "entry_zscore": (0.5, 1.0, 1.5), "exit_zscore": (0.0, 0.5),
    "rsi_window": (7, 14), "rsi_buy": (25.0, 35.0), "rsi_sell": (55.0, 65.0),
    "breakout_window": (20, 55, 120), "exit_window": (10, 20, 60),
    "volatility_window": (20, 60), "volatility_quantile": (0.5, 0.7),
    "fast_return_window": (5, 20), "slow_return_window": (60, 120), "risk_window": (20, 60), "score_threshold": (0.0, 1.0),
    "feature_name": D.FEATURES, "feature_threshold": (0.0, 0.02), "feature_z_window": (60, 252), "feature_z_threshold": (0.31, 1.05),
}


def rule_space() -> dict[str, Column]:
    kinds = {int: SP.ints, float: SP.floats, str: lambda v: F.array(*[F.lit(x) for x in v])}
    return {k: kinds[type(v[0])](v) for k, v in RULE_SPACE.items()}


def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of every rule family for each symbol of the bar table."""
    sym = I.bars(spark, sf_dir).select("symbol").distinct()
    g = SP.rule_grid(sym, rule_space())
    return RB.with_keys(g).withColumn("candidate_id", RB.identity(g)).select("candidate_id", "symbol", "rule", "feature_count", *RB.SLOTS, "p", "q")


def evaluate_rules(bars: DataFrame, cands: DataFrame, cost: float = 0.0002) -> DataFrame:
    """One leaderboard row per rule candidate: train and validation metrics, gates and score.

    ``bars`` hold close and the feature columns that candidates name; indicators restart at the split.
    """
    from barlab.operators import gates as GT

    run = RB.equity_rows(RB.signal_rows(S.split_periods(bars), cands), cost)
    m = rule_metrics(run).join(cands.select("candidate_id", "rule", "feature_count"), "candidate_id")
    return GT.survival_gate(m)


def rule_metrics(run: DataFrame, cash: float = B.CASH) -> DataFrame:
    """Train and validation metrics per candidate in one pass over the candidate-bar rows.

    Grouping sets give period and year aggregates together; trades are counted as entries, so no trade
    table is built for the sweep.
    """
    by = ("candidate_id", "period")
    side = F.signum("position")
    x = run.withColumns({
        "_ret": R.pct_change("equity", 1, by), "_dd": R.drawdown("equity", by=by),
        "_in": F.when((side != 0) & ~F.coalesce(R.lag(side, 1, by), F.lit(0.0)).eqNullSafe(side), 1).otherwise(0),
        "_year": F.year("ts"),
    })
    g = x.groupingSets([["candidate_id", "period", "_year"], ["candidate_id", "period"]], "candidate_id", "period", "_year").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.min_by("equity", "ts").alias("first"), F.max_by("equity", "ts").alias("last"),
        F.min("_dd").alias("mdd"), F.avg((F.coalesce("_ret", F.lit(0.0)) != 0).cast("double")).alias("active"), F.sum("_in").alias("trades"),
    )
    years = F.col("n") / 252.0
    g = g.withColumn("cagr", F.when(F.col("last") > 0, F.pow(F.col("last") / cash, 1.0 / years) - 1.0).otherwise(-1.0))
    g = g.withColumn("calmar", B.calmar(F.col("cagr"), F.col("mdd"), 0.0))
    whole = F.col("gid") == 1
    at = lambda p, c: F.max(F.when(whole & (F.col("period") == p), c if not isinstance(c, str) else F.col(c)))
    return g.groupBy("candidate_id").agg(
        *[at(p, c).alias(f"{p}_{c}") for p in ("train", "validation") for c in ("calmar", "cagr", "mdd")],
        at("train", F.col("trades") / years).alias("trades_per_year"), at("train", "active").alias("long_fraction"),
        F.count_if(~whole & (F.col("period") == "validation") & (F.col("last") < F.col("first"))).alias("validation_negative_years"),
    )


# --- annual votes -----------------------------------------------------------------------------

def annual_long(ex: DataFrame) -> DataFrame:
    return Q.melt(ex.withColumn("decision_date", F.struct("symbol", "target_year")), ["decision_date", "target_year"], D.FEATURES)


def label_annual(year: Column, train_end: int = 1998, validation_end: int = 2000) -> Column:
    return F.when(year <= train_end, "train").when(year <= validation_end, "validation").otherwise("locked")




# --- SQL texts of the weekly candidate sweep --------------------------------------------------

_SEL = "list_value(" + ", ".join(f"'{s}'" for s in SELECTORS) + ")"


def cand_sql(long: str, quantiles) -> list[str]:
    qs = ", ".join(str(q) for q in quantiles)
    return [
        f"cq AS (SELECT feature, quantile_cont(value, [{qs}]) AS qs FROM {long} WHERE period = 'train' GROUP BY 1)",
        f"ct AS (SELECT feature, CAST(i AS BIGINT) AS qi, printf('%.8f', qs[i + 1]) AS v FROM cq, range({len(quantiles)}) AS t(i))",
        f"""cands AS (SELECT a.feature || '_' || a.qi AS candidate_id, a.feature || '|threshold|' || a.v || '|1|2' AS s1, 'realized_vol_21d|threshold|' || b.v || '|-1|1' AS s2,
          a.feature AS f1, CAST(a.v AS DOUBLE) AS t1, CAST(b.v AS DOUBLE) AS t2, {_SEL}[a.qi % 5 + 1] AS selector, (a.qi - 3) * 0.1e0 AS intercept, 0.5e0 + a.qi * 0.1e0 AS scale,
          CASE WHEN a.qi % 2 = 1 THEN 0.2e0 ELSE 0e0 END AS smoothing FROM ct AS a JOIN ct AS b ON a.qi = b.qi AND b.feature = 'realized_vol_21d')""",
        f"cmed AS (SELECT feature, quantile_cont(value, 0.5) AS m FROM {long} GROUP BY 1)",
        f"cfill AS (SELECT l.decision_date, l.feature, coalesce(l.value, m.m, 0) AS value FROM {long} AS l JOIN cmed AS m ON l.feature = m.feature)",
        """craw AS (SELECT c.*, a.decision_date, row_number() OVER (PARTITION BY c.candidate_id ORDER BY a.decision_date) AS rn,
          greatest(least(c.intercept + c.scale * (CASE WHEN a.value >= c.t1 THEN 2e0 ELSE -2e0 END + CASE WHEN b.value >= c.t2 THEN -1e0 ELSE 1e0 END) / 3, 1e0), -1e0) AS raw
          FROM cands AS c JOIN cfill AS a ON a.feature = c.f1 JOIN cfill AS b ON b.feature = 'realized_vol_21d' AND b.decision_date = a.decision_date)""",
        """cwalk AS (SELECT candidate_id, selector, decision_date, rn, smoothing, raw AS s FROM craw WHERE rn = 1 UNION ALL
          SELECT n.candidate_id, n.selector, n.decision_date, n.rn, n.smoothing, n.smoothing * p.s + (1 - n.smoothing) * n.raw FROM cwalk AS p JOIN craw AS n ON n.candidate_id = p.candidate_id AND n.rn = p.rn + 1)""",
        "cexp AS (SELECT candidate_id, selector, decision_date, greatest(least(s, 1e0), -1e0) AS exposure FROM cwalk)",
    ]


PICK_SQL = [
    "psc AS (" + " UNION ALL ".join(
        f"SELECT symbol, period_end, next_return, '{s}' AS selector, {'-vol' if s.startswith('low') else s} AS score FROM weekly_assets" for s in SELECTORS) + ")",
    """prk AS (SELECT *, row_number() OVER (PARTITION BY selector, period_end ORDER BY score IS NULL, score DESC, symbol) AS k, COUNT(score) OVER (PARTITION BY selector, period_end) AS n FROM psc)""",
    """picks AS (SELECT selector, period_end AS decision_date, coalesce(MAX(CASE WHEN n > 0 AND k = 1 THEN symbol WHEN n = 0 AND symbol = 'N' THEN symbol END), 'N') AS traded_asset,
       coalesce(MAX(CASE WHEN n > 0 AND k = 1 THEN next_return WHEN n = 0 AND symbol = 'N' THEN next_return END), 0) AS asset_return FROM prk GROUP BY 1, 2)""",
]
POSW_SQL = ["""posw AS (SELECT e.candidate_id, e.selector, e.decision_date, w.target_end AS ts, w.target_year, w.period, w.sp500_down_year, coalesce(w.next_return, 0) AS spy_return,
   p.traded_asset, p.asset_return, e.exposure, e.exposure * p.asset_return AS strategy_return
   FROM cexp AS e JOIN picks AS p ON p.selector = e.selector AND p.decision_date = e.decision_date JOIN weekly AS w ON w.decision_date = e.decision_date)"""]
POSM_SQL = ["""posm AS (SELECT e.candidate_id, e.decision_date, w.target_end AS ts, w.target_year, w.period, false AS sp500_down_year, coalesce(w.next_return, 0) AS spy_return,
   'N' AS traded_asset, e.exposure, e.exposure * coalesce(w.next_return, 0) AS strategy_return FROM cexp AS e JOIN monthly AS w ON w.decision_date = e.decision_date)"""]


def eval_sql(pos: str, ppy: float) -> list[str]:
    """Metrics, year counts and profile of a position CTE."""
    met = "cagr mdd calmar sharpe".split()
    cnt = "years_positive years_total min_year_return down_years_ge_5pct down_years_total down_min_return".split()

    def wide(cols):
        return ", ".join(f"MAX(CASE WHEN period = '{p}' THEN {c} END) AS {p}_{c}" for p in ("train", "validation") for c in cols)

    return [
        f"""ev_nav AS (SELECT *, product(1 + strategy_return) OVER (PARTITION BY candidate_id, period ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM {pos})""",
        "ev_dd AS (SELECT *, nav / MAX(nav) OVER (PARTITION BY candidate_id, period ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM ev_nav)",
        f"""ev_g AS (SELECT candidate_id, period, COUNT(*) AS n, arg_max(nav, ts) AS f, MIN(dd) AS mdd, AVG(strategy_return) AS m, stddev_samp(strategy_return) AS s FROM ev_dd GROUP BY 1, 2)""",
        f"ev_c AS (SELECT *, CASE WHEN f > 0 THEN pow(f, {ppy}e0 / n) - 1 ELSE -1 END AS cagr FROM ev_g)",
        f"ev_m AS (SELECT *, CASE WHEN mdd < 0 THEN cagr / abs(mdd) END AS calmar, CASE WHEN s > 1e-12 THEN m / s * sqrt({ppy}e0) ELSE 0 END AS sharpe FROM ev_c)",
        f"""ev_y AS (SELECT candidate_id, period, target_year, product(1 + strategy_return) - 1 AS r, product(1 + spy_return) - 1 AS base_return, bool_or(sp500_down_year) AS down,
          AVG(exposure) AS average_exposure, MIN(exposure) AS min_exposure, MAX(exposure) AS max_exposure, COUNT(*) AS periods, COUNT(DISTINCT traded_asset) AS unique_assets_used FROM {pos} GROUP BY 1, 2, 3)""",
        """ev_yc AS (SELECT candidate_id, period, COUNT(*) FILTER (r > 0) AS years_positive, COUNT(*) AS years_total, MIN(r) AS min_year_return,
          COUNT(*) FILTER (down AND r >= 0.05) AS down_years_ge_5pct, COUNT(*) FILTER (down) AS down_years_total, MIN(r) FILTER (down) AS down_min_return FROM ev_y GROUP BY 1, 2)""",
        f"ev_d AS (SELECT *, abs(exposure - lag(exposure) OVER (PARTITION BY candidate_id ORDER BY ts)) AS dx FROM {pos})",
        f"ev_a AS (SELECT candidate_id, traded_asset, COUNT(*) AS n FROM {pos} GROUP BY 1, 2)",
        "ev_t AS (SELECT candidate_id, arg_min(traded_asset, (-n, traded_asset)) AS most_used_asset, COUNT(*) AS unique_assets_used FROM ev_a GROUP BY 1)",
        """ev_p AS (SELECT candidate_id, AVG(exposure) AS average_exposure, AVG(abs(exposure)) AS average_abs_exposure, MIN(exposure) AS min_exposure, MAX(exposure) AS max_exposure,
          COUNT(*) FILTER (exposure > 0.05) AS weeks_long, COUNT(*) FILTER (abs(exposure) <= 0.05) AS weeks_cash_like, COUNT(*) FILTER (exposure < -0.05) AS weeks_short,
          coalesce(AVG(dx), 0) AS exposure_turnover FROM ev_d GROUP BY 1)""",
        f"ev_mw AS (SELECT candidate_id, {wide(met)} FROM ev_m GROUP BY 1)",
        f"ev_cw AS (SELECT candidate_id, {wide(cnt)} FROM ev_yc GROUP BY 1)",
        "ev AS (SELECT * FROM ev_mw JOIN ev_cw USING (candidate_id) JOIN ev_p USING (candidate_id) JOIN ev_t USING (candidate_id))",
    ]


EVAL_OUT = ("s:candidate_id " + " ".join(f"f:{p}_{c}" for p in ("train", "validation") for c in ("cagr", "mdd", "calmar", "sharpe", "min_year_return", "down_min_return"))
            + " " + " ".join(f"i:{p}_{c}" for p in ("train", "validation") for c in ("years_positive", "years_total", "down_years_ge_5pct", "down_years_total"))
            + " f:average_exposure f:average_abs_exposure f:min_exposure f:max_exposure i:weeks_long i:weeks_cash_like i:weeks_short f:exposure_turnover s:most_used_asset i:unique_assets_used")


def to_universal(pos: DataFrame, run_id: str = "weekly") -> DataFrame:
    """Weekly positions in the audit layout: roles, turnover, benchmark."""
    prev = F.coalesce(R.lag("exposure", 1, ["candidate_id"]), F.lit(0.0))
    role = F.when(F.col("period") == "train", "is").when(F.col("period") == "validation", "oos").otherwise("locked")
    return pos.select(
        "candidate_id", F.col("ts").alias("timestamp"), F.lit("weekly").alias("frequency"), "strategy_return", role.alias("sample_role"),
        F.abs(F.col("exposure") - prev).alias("turnover"), "exposure", F.col("spy_return").alias("benchmark_return"),
    )
