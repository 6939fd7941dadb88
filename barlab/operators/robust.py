"""Statistical audit of return series: bootstrap, splits, multiple testing, costs, duplicates.

Input is the long return table (candidate_id, timestamp, frequency, strategy_return, ...).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.functions import rolling as R
from barlab.operators import backtest as B

# Search methods whose candidates are generated (fixed values); callers pass further engine names.
GENERATED = (
    "beam", "genetic", "random", "random_broad", "bandit", "hpo", "machine_learning", "optuna_tpe_hyperband",
    "sobol_random_asha_real", "dehb_real", "bohb_real", "smac_mf_real",
)
# frequency: (block rows, periods per year)
FREQUENCY = {"daily": (21, 252), "weekly": (13, 52), "monthly": (4, 12)}


def _by_frequency(i: int) -> Column:
    out = None
    for k, v in FREQUENCY.items():
        out = F.when(F.col("frequency") == k, v[i]) if out is None else out.when(F.col("frequency") == k, v[i])
    return out


def sample_roles(r: DataFrame) -> DataFrame:
    """Distinct roles in order of first appearance."""
    g = r.groupBy("candidate_id", "sample_role").agg(F.min("timestamp").alias("t"))
    return g.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("t", "sample_role"))).alias("s")).select(
        "candidate_id", F.array_join("s.sample_role", ",").alias("roles")
    )


def return_metrics(r: DataFrame, by=("candidate_id",), x: str = "strategy_return", order: str = "timestamp", ppy: Column | float = 252.0) -> DataFrame:
    """CAGR, drawdown, Calmar, Sharpe (sample deviation) and share of winning periods.

    Without a drawdown Calmar is NULL (unbounded) for a gain and zero otherwise.
    """
    p = ppy if isinstance(ppy, Column) else F.lit(float(ppy))
    c = B.curve(r.where(F.col(x).isNotNull()).withColumn("_p", p.cast("double")), x, by, order)
    v = F.col(x)
    g = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), F.max_by("nav", order).alias("_f"), F.least(F.min("drawdown"), F.lit(0.0)).alias("mdd"), F.avg(v).alias("_m"),
        F.stddev_samp(v).alias("_s"), F.avg((v > 0).cast("double")).alias("profit_periods_pct"), F.max("_p").alias("_p"),
    )
    g = g.withColumn("cagr", F.when(F.col("_f") > 0, F.pow(F.col("_f"), F.col("_p") / F.col("periods")) - 1.0).otherwise(-1.0))
    return g.withColumns({
        "calmar": F.when(F.col("mdd") < -1e-12, F.col("cagr") / F.nullif(F.abs("mdd"), F.lit(0.0))).otherwise(F.when(F.col("cagr") <= 0, 0.0)),
        "sharpe": F.coalesce(F.when(F.col("_s") > 1e-12, F.col("_m") / F.col("_s") * F.sqrt("_p")), F.lit(0.0)),
    }).drop("_f", "_m", "_s", "_p")


BOOT_SCHEMA = "candidate_id string, sample int, cagr double, mdd double, sharpe double, calmar double"


def starts(seed: int, candidate: int, sample, block, n: int):
    """Start row of each block: integer hash of (candidate key, sample, block), reproducible anywhere."""
    x = (candidate % 1000003 * 7919 + sample * 104729 + block * 1299709 + seed * 15485863) % 2147483647
    x = (x * 48271) % 2147483647
    return (x * 48271) % 2147483647 % n


def path_metrics(paths: np.ndarray, ppy: float) -> tuple[np.ndarray, ...]:
    """Metrics of each row of a matrix of return paths."""
    equity = np.cumprod(1.0 + paths, axis=1)
    final = equity[:, -1]
    n = paths.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        cagr = np.where(final > 0, np.power(np.where(final > 0, final, 1.0), ppy / n) - 1.0, -1.0)
        mdd = np.min(equity / np.maximum.accumulate(equity, axis=1) - 1.0, axis=1)
        sd = paths.std(axis=1, ddof=1) if n > 1 else np.zeros(len(paths))
        sharpe = np.where(sd > 1e-12, paths.mean(axis=1) / np.where(sd > 1e-12, sd, 1.0) * math.sqrt(ppy), 0.0)
        calmar = np.where(mdd < -1e-12, cagr / np.where(mdd < -1e-12, -mdd, 1.0), np.where(cagr > 0, np.nan, 0.0))
    return cagr, mdd, sharpe, calmar


def bootstrap_samples(r: DataFrame, samples: int = 1000, seed: int = 42, batch: int = 100, x: str = "strategy_return", block: int | None = None, key: str | None = None) -> DataFrame:
    """Circular block bootstrap: one row of metrics per candidate and sample.

    A candidate's series (one row per period, bounded by the calendar) travels once per batch of
    samples; resampling and metrics are matrix operations inside the task. Work spreads over
    candidates x batches, so a few candidates with many samples still use every core.
    """
    ident = F.crc32(F.col("candidate_id").cast("binary")) if key is None else F.col(key)
    s = r.where(F.col(x).isNotNull()).groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("timestamp", F.col(x).alias("v")))).alias("s"), F.max("frequency").alias("frequency"), F.max(ident).alias("key")
    )
    s = s.select("candidate_id", "key", F.col("s.v").alias("v"),
                 (F.lit(block) if block else _by_frequency(0)).alias("block"), _by_frequency(1).alias("ppy"))
    jobs = s.withColumn("b0", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(batch))))
    jobs = jobs.repartition("candidate_id", "b0")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                v = np.asarray(row.v, dtype=float)
                n, ids = len(v), np.arange(row.b0, min(row.b0 + batch, samples))
                if n <= row.block:
                    paths = np.tile(v, (len(ids), 1))
                else:
                    blocks = -(-n // row.block)
                    st = starts(seed, int(row.key), ids[:, None].astype(np.int64), np.arange(blocks, dtype=np.int64)[None, :], n)
                    idx = ((st[:, :, None] + np.arange(row.block)[None, None, :]) % n).reshape(len(ids), -1)[:, :n]
                    paths = v[idx]
                cagr, mdd, sharpe, calmar = path_metrics(paths, float(row.ppy))
                yield pd.DataFrame({"candidate_id": row.candidate_id, "sample": ids.astype("int32"), "cagr": cagr, "mdd": mdd, "sharpe": sharpe, "calmar": calmar})

    out = jobs.mapInPandas(run, BOOT_SCHEMA)
    return out.withColumn("calmar", F.when(~F.isnan("calmar"), F.col("calmar")))


def bootstrap_summary(samples: DataFrame) -> DataFrame:
    q = lambda c, p: F.percentile(c, p)
    return samples.groupBy("candidate_id").agg(
        q("cagr", 0.05).alias("bootstrap_cagr_p05"), q("cagr", 0.50).alias("bootstrap_cagr_p50"), q("cagr", 0.95).alias("bootstrap_cagr_p95"),
        q("sharpe", 0.05).alias("bootstrap_sharpe_p05"), q("sharpe", 0.50).alias("bootstrap_sharpe_p50"), q("sharpe", 0.95).alias("bootstrap_sharpe_p95"),
        q("calmar", 0.05).alias("bootstrap_calmar_p05"), F.avg((F.col("cagr") > 0).cast("double")).alias("bootstrap_prob_cagr_positive"),
    )


def split_half(r: DataFrame, x: str = "strategy_return") -> DataFrame:
    """CAGR of the first floor(n / 2) rows and of the rest."""
    by = ("candidate_id",)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    h = r.where(F.col(x).isNotNull()).withColumns({"_rn": F.row_number().over(R.ordered(by, "timestamp")), "_n": n})
    first = F.col("_rn") <= F.floor(F.col("_n") / 2)
    g = h.groupBy(*by).agg(
        F.product(F.when(first, 1.0 + F.col(x))).alias("f1"), F.count_if(first).alias("n1"), F.product(F.when(~first, 1.0 + F.col(x))).alias("f2"),
        F.count_if(~first).alias("n2"), F.max(_by_frequency(1)).alias("p"),
    )
    cagr = lambda f, k: F.when(F.col(k) == 0, 0.0).when(F.col(f) > 0, F.pow(F.col(f), F.col("p") / F.col(k)) - 1.0).otherwise(-1.0)
    g = g.withColumns({"half_1_cagr": cagr("f1", "n1"), "half_2_cagr": cagr("f2", "n2")})
    return g.select("candidate_id", "half_1_cagr", "half_2_cagr", ((F.col("half_1_cagr") >= 0) & (F.col("half_2_cagr") >= 0)).alias("split_pass"))


def leave_one_year_out(r: DataFrame, x: str = "strategy_return") -> DataFrame:
    """Smallest CAGR after dropping each year in turn. Years reduce to products first, so only the
    candidate's year list (bounded by the calendar) meets in one row."""
    y = r.where(F.col(x).isNotNull()).groupBy("candidate_id", F.year("timestamp").alias("year")).agg(
        F.product(1.0 + F.col(x)).alias("f"), F.count(F.lit(1)).cast("double").alias("n"), F.max(_by_frequency(1)).cast("double").alias("p")
    )
    g = y.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("year", "f", "n"))).alias("ys"), F.max("p").alias("p"))

    def without(s):
        rest = F.filter("ys", lambda o: o["year"] != s["year"])
        f = F.aggregate(rest, F.lit(1.0), lambda a, o: a * o["f"])
        n = F.aggregate(rest, F.lit(0.0), lambda a, o: a + o["n"])
        return F.when(f > 0, F.pow(f, F.col("p") / n) - 1.0).otherwise(-1.0)

    enough = F.size("ys") >= 3
    low = F.when(enough, F.array_min(F.transform("ys", without)))
    return g.select("candidate_id", low.alias("leave_one_year_out_min_cagr"), F.size("ys").alias("leave_one_year_out_years"),
                    (~enough | (low >= 0)).alias("leave_one_year_out_pass"))


def calendar_profit(r: DataFrame, x: str = "strategy_return", months: float = 0.52, years: float = 0.50) -> DataFrame:
    v = 1.0 + F.coalesce(x, F.lit(0.0))
    m = r.groupBy("candidate_id", F.trunc("timestamp", "month").alias("month")).agg(F.product(v).alias("f"))
    y = m.groupBy("candidate_id", F.year("month").alias("year")).agg(F.product("f").alias("fy"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("f") > 1).alias("w"))
    g = y.groupBy("candidate_id").agg((F.sum("w") / F.sum("n")).alias("profit_months_pct"), F.avg((F.col("fy") > 1).cast("double")).alias("profit_years_pct"))
    return g.withColumn("calendar_profit_pass", (F.col("profit_months_pct") >= months) & (F.col("profit_years_pct") >= years))


def multiple_testing(r: DataFrame, generated_methods=GENERATED) -> DataFrame:
    """Generated methods must carry their number of trials."""
    g = r.groupBy("candidate_id").agg(F.max("source_method").alias("m"), F.max("n_trials").alias("t"))
    generated = F.col("m").isin(*generated_methods)
    reason = F.when(F.col("t").isNull() & generated, "missing_n_trials_generated_strategy").when(F.col("t") < 1, "n_trials_lt_1").otherwise("")
    n = F.when(F.col("t").isNull(), F.when(~generated, 1)).otherwise(F.col("t").cast("int"))
    return g.select("candidate_id", n.alias("n_trials"), (reason == "").alias("multiple_testing_pass"), reason.alias("multiple_testing_fail_reason"))


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    """Standard normal distribution function."""
    return x.map(NormalDist().cdf, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    """Standard normal quantile."""
    return p.map(NormalDist().inv_cdf, na_action="ignore")


def sharpe_confidence(r: DataFrame, x: str = "strategy_return", min_psr: float = 0.95, min_dsr: float = 0.0) -> DataFrame:
    """Probabilistic and deflated Sharpe per candidate.

    Sharpe enters in per-period units; skewness and kurtosis are bias corrected; the expected maximum
    of n trials uses the Euler constant and is not scaled by the dispersion of trial Sharpes.
    """
    v = F.col(x)
    g = r.where(v.isNotNull()).groupBy("candidate_id").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2")
    ).join(multiple_testing(r).select("candidate_id", "n_trials"), "candidate_id")
    n = F.col("n")
    sk = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    ku = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3.0)
    g = g.withColumns({"sr": F.coalesce(F.when(F.col("s") > 1e-12, F.col("m") / F.col("s")), F.lit(0.0)), "sk": F.coalesce(sk, F.lit(0.0)), "ku": F.coalesce(ku, F.lit(3.0))})
    var = (1.0 - F.col("sk") * F.col("sr") + (F.col("ku") - 1.0) / 4.0 * F.pow("sr", 2)) / (n - 1)
    t = F.col("n_trials").cast("double")
    gamma = float(np.euler_gamma)
    g = g.withColumns({"var": F.when(var > 0, var), "p1": F.when(t > 1, 1.0 - 1.0 / t), "p2": F.when(t > 1, 1.0 - 1.0 / (t * math.e))})
    e_max = (1.0 - gamma) * norm_ppf("p1") + gamma * norm_ppf("p2")
    psr = F.round(F.coalesce(norm_cdf(F.col("sr") / F.sqrt("var")), F.lit(0.0)), 4)
    dsr = F.round(F.coalesce(norm_cdf((F.col("sr") - e_max) / F.sqrt("var")), F.lit(0.0)), 4)
    known = (n >= 3) & t.isNotNull()
    g = g.withColumns({"psr": F.when(known, psr), "_d": dsr})
    g = g.withColumn("dsr", F.when(known, F.when(t == 1, F.col("psr")).when(n < 10, 0.0).otherwise(F.col("_d"))))
    ok = (F.col("psr") >= min_psr) & ((t == 1) | (F.col("dsr") >= min_dsr))
    return g.select("candidate_id", "psr", "dsr", F.coalesce(ok, F.lit(False)).alias("psr_dsr_pass"))


def cost_stress(r: DataFrame, bps: float = 1.5, multiplier: float = 2.0, keep: float = 0.70) -> DataFrame:
    """Share of CAGR left after charging turnover; net series pass, gross ones without turnover fail."""
    by = ("candidate_id",)
    v = F.coalesce("strategy_return", F.lit(0.0))
    drag = F.coalesce("turnover", F.lit(0.0)) * (bps / 10000.0 * multiplier)
    g = r.groupBy(*by).agg(
        F.bool_or("returns_are_net").alias("net"), F.count("turnover").alias("t"), F.count(F.lit(1)).alias("n"), F.max(_by_frequency(1)).alias("p"),
        F.product(1.0 + v).alias("f0"), F.product(1.0 + v - drag).alias("f1"),
    )
    cagr = lambda f: F.when(F.col(f) > 0, F.pow(F.col(f), F.col("p") / F.col("n")) - 1.0).otherwise(-1.0)
    g = g.withColumns({"c0": cagr("f0"), "c1": cagr("f1")})
    ratio = F.when(F.col("c0") > 1e-12, F.col("c1") / F.nullif(F.col("c0"), F.lit(0.0)))
    keeps = F.when(F.col("net"), 1.0).when(F.col("t") == 0, F.lit(None)).otherwise(ratio)
    reason = F.when(F.col("net"), "").when(F.col("t") == 0, "gross_returns_missing_turnover").when(F.coalesce(ratio >= keep, F.lit(False)), "").otherwise("cost_stress_retention_too_low")
    return g.select("candidate_id", F.col("net").alias("returns_are_net"), keeps.alias("cost_score_retention"), (reason == "").alias("cost_pass"), reason.alias("cost_fail_reason"))


def fingerprints(r: DataFrame, x: str = "strategy_return") -> DataFrame:
    """Digest of a candidate's returns in whole hundred-millionths; rows hash per year first."""
    item = F.struct("timestamp", F.round(F.coalesce(x, F.lit(0.0)) * 1e8).cast("bigint").cast("string").alias("t"))
    y = r.groupBy("candidate_id", F.year("timestamp").alias("y")).agg(F.array_sort(F.collect_list(item)).alias("s"))
    y = y.select("candidate_id", "y", F.sha2(F.array_join("s.t", ","), 256).alias("h"))
    g = y.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("y", "h"))).alias("s"))
    return g.select("candidate_id", F.substring(F.sha2(F.array_join("s.h", ","), 256), 1, 16).alias("fingerprint"))


def exact_edges(f: DataFrame) -> DataFrame:
    """Star edges: every copy links to the smallest id with its fingerprint (no pairs within a group)."""
    head = f.groupBy("fingerprint").agg(F.min("candidate_id").alias("left_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return f.join(head, "fingerprint").where("candidate_id <> left_id").select("left_id", F.col("candidate_id").alias("right_id"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(candidate_id, root): smallest id reachable. Labels spread over neighbours and jump to their
    label's label each round, so long chains settle in logarithmically many rounds; every round is
    checkpointed. A candidate joins its own edges only."""
    from barlab.session import checkpoint

    both = checkpoint(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).union(edges.select("right_id", "left_id")).distinct())
    lab = checkpoint(nodes.select(F.col("candidate_id").alias("id"), F.col("candidate_id").alias("root")))
    for _ in range(max_rounds):
        near = both.join(lab, both["b"] == lab["id"]).groupBy("a").agg(F.min("root").alias("m"))
        step = lab.join(near, lab["id"] == near["a"], "left").select("id", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("was"))
        hop = step.select(F.col("id").alias("h"), F.col("root").alias("hr"))
        nxt = step.join(hop, step["root"] == hop["h"]).select("id", F.least("root", "hr").alias("root"), "was")
        nxt = checkpoint(nxt)
        moved = nxt.where("root <> was").limit(1).count()
        lab = nxt.select("id", "root")
        if not moved:
            return lab.select(F.col("id").alias("candidate_id"), "root")
    raise RuntimeError("labels did not settle")


def duplicate_groups(results: DataFrame, edges: DataFrame, metric: str = "cagr") -> DataFrame:
    """Group id, size and representative (robust first, then metric, then id) of duplicate components."""
    from barlab.operators.specs import numbered

    lab = components(results.select("candidate_id"), edges)
    roots = numbered(lab.select("root").distinct(), [F.col("root")], "k")
    gid = roots.select("root", F.concat(F.lit("dup_"), F.lpad((F.col("k") + 1).cast("string"), 4, "0")).alias("duplicate_group_id"))
    x = results.join(lab, "candidate_id").join(gid, "root")
    order = F.struct((~F.coalesce("robust_pass", F.lit(False))).alias("r"), (-F.coalesce(metric, F.lit(-1e308))).alias("m"), F.col("candidate_id").alias("i"))
    head = x.groupBy("root").agg(F.min_by("candidate_id", order).alias("_head"), F.count(F.lit(1)).alias("duplicate_group_size"))
    x = x.join(head, "root").withColumn("duplicate_representative", F.col("candidate_id") == F.col("_head"))
    eligible = F.coalesce("robust_pass", F.lit(False)) & F.col("duplicate_representative") & F.coalesce("correlation_pass", F.lit(True))
    return x.withColumn("portfolio_eligible", eligible).drop("root", "_head")


def year_table(r: DataFrame) -> DataFrame:
    return r.groupBy("candidate_id", F.year("timestamp").alias("year"), "sample_role").agg(
        F.count(F.lit(1)).alias("periods"), (F.product(1.0 + F.coalesce("strategy_return", F.lit(0.0))) - 1.0).alias("strategy_return")
    )


def verdict(r: DataFrame, samples: int = 1000, max_drawdown: float = 0.35) -> DataFrame:
    """All checks of every candidate with the verdict and the joined reasons."""
    from barlab.operators import quality as Q
    from barlab.session import checkpoint

    # ten checks read the same return table: materialise it once instead of deriving it ten times
    r = checkpoint(r)
    q = Q.returns_quality(r.withColumn("seq", F.col("timestamp"))).select("candidate_id", "data_quality_pass", F.col("fail_reasons").alias("quality_reasons"))
    x = r.groupBy("candidate_id").agg(F.max("source_method").alias("source_method"))
    parts = [
        return_metrics(r, ppy=_by_frequency(1)), bootstrap_summary(bootstrap_samples(r, samples)), split_half(r), leave_one_year_out(r), calendar_profit(r),
        multiple_testing(r), sharpe_confidence(r), cost_stress(r), B.benchmark_link(r, ["candidate_id"]), q,
    ]
    for p in parts:
        x = x.join(p, "candidate_id")
    boot = (
        (F.col("bootstrap_prob_cagr_positive") >= 0.95) & (F.col("bootstrap_cagr_p05") >= 0) & (F.col("bootstrap_sharpe_p05") >= 0)
    )
    deep = F.abs("mdd") > max_drawdown
    x = x.withColumn("bootstrap_pass", boot)
    x = x.withColumn(
        "statistical_pass",
        F.col("bootstrap_pass") & F.col("split_pass") & F.col("leave_one_year_out_pass") & F.col("calendar_profit_pass") & ~deep & F.col("psr_dsr_pass"),
    )
    x = x.withColumn("robust_pass", F.col("data_quality_pass") & F.col("statistical_pass") & F.col("multiple_testing_pass") & F.col("cost_pass"))
    reasons = F.array_compact(F.array(
        F.nullif("quality_reasons", F.lit("")),
        *[F.when(~F.col(k), f"{k}_false") for k in ("bootstrap_pass", "split_pass", "leave_one_year_out_pass", "calendar_profit_pass")],
        F.when(deep, "max_drawdown_limit_exceeded"), F.when(~F.col("psr_dsr_pass"), "psr_dsr_pass_false"),
        F.nullif("multiple_testing_fail_reason", F.lit("")), F.nullif("cost_fail_reason", F.lit("")), F.when(~F.col("correlation_pass"), "correlation_pass_false"),
    ))
    return x.withColumns({"fail_reasons": F.array_join(reasons, ";"), "portfolio_eligible": F.col("robust_pass") & F.col("correlation_pass")})


# --- validation statistics of a positions series ----------------------------------------------

CALMAR_NONE = 999.0


def series_calmar(f: Column, n: Column, mdd: Column) -> Column:
    """Calmar on 252 rows a year: 999 for a gain without drawdown, zero for none."""
    cagr = F.when(f > 0, F.pow(f, 252.0 / n) - 1.0).otherwise(-1.0)
    return F.when(F.abs(mdd) > 1e-12, cagr / F.nullif(F.abs(mdd), F.lit(0.0))).otherwise(F.when(cagr > 0, CALMAR_NONE).otherwise(0.0))


def grouped_calmar(df: DataFrame, x: str, by, order: str) -> DataFrame:
    c = B.curve(df, x, by, order)
    g = c.groupBy(*by).agg(F.max_by("nav", order).alias("_f"), F.count(F.lit(1)).alias("_n"), F.least(F.min("drawdown"), F.lit(0.0)).alias("_d"))
    return g.select(*by, series_calmar(F.col("_f"), F.col("_n"), F.col("_d")).alias("calmar"))


def shuffle_orders(seed: int, shuffles: np.ndarray, n: int) -> np.ndarray:
    """(shuffles x n) permutations: the order of integer keys mixed from row and shuffle number; shuffle 0 changes nothing."""
    x = (np.arange(1, n + 1, dtype=np.int64) * 7919 + shuffles[:, None].astype(np.int64) * 104729 + seed * 1299709) % 2147483647
    x = (x * 48271) % 2147483647
    out = np.argsort((x * 48271) % 2147483647, axis=1, kind="stable")
    out[shuffles == 0] = np.arange(n)
    return out


def row_calmar(paths: np.ndarray) -> np.ndarray:
    """Calmar of each row of a matrix of daily return paths, by the rule of ``series_calmar``."""
    equity = np.cumprod(1.0 + paths, axis=1)
    final, n = equity[:, -1], paths.shape[1]
    worst = np.minimum((equity / np.maximum.accumulate(equity, axis=1) - 1.0).min(axis=1), 0.0)
    cagr = np.where(final > 0, np.power(np.where(final > 0, final, 1.0), 252.0 / n) - 1.0, -1.0)
    deep = np.abs(worst) > 1e-12
    return np.where(deep, cagr / np.where(deep, np.abs(worst), 1.0), np.where(final > 1, 999.0, 0.0))


def shuffled(df: DataFrame, shuffles: int, by, order: str, score, schema: str, batch: int = 50) -> DataFrame:
    """``score(shuffle numbers, positions, returns)`` for each series and batch of the numbers 0..shuffles.

    A series (one row per period, bounded by the calendar) travels once per batch; the shuffles of a batch are one matrix
    inside the task, so nothing of size series x shuffles x rows is shuffled.
    """
    row = F.struct(order, F.coalesce("position", F.lit(0.0)).cast("double").alias("p"), F.coalesce("next_return", F.lit(0.0)).cast("double").alias("r"))
    s = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("s"))
    jobs = s.select(F.struct(*by).alias("key"), F.col("s.p").alias("p"), F.col("s.r").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(shuffles), F.lit(batch))).alias("b0"))
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def run(frames):
        for pdf in frames:
            for job in pdf.itertuples():
                p, r = np.asarray(job.p, dtype=float), np.asarray(job.r, dtype=float)
                out = score(np.arange(job.b0, min(job.b0 + batch, shuffles + 1)), p, r)
                for c in by:
                    out[c] = job.key[c]
                yield out

    return jobs.repartition("key", "b0").mapInPandas(run, f"{fields}, {schema}")


def permutation_pvalue(df: DataFrame, k: int = 300, seed: int = 101, by=("candidate_id",), order: str = "timestamp") -> DataFrame:
    """(shuffles at least as good + 1) / (k + 1) on Calmar."""

    def score(ks: np.ndarray, p: np.ndarray, r: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"shuffle": ks, "calmar": row_calmar(p[shuffle_orders(seed, ks, len(p))] * r)})

    c = shuffled(df, k, by, order, score, "shuffle int, calmar double")
    base = c.where("shuffle = 0").select(*by, F.col("calmar").alias("base"))
    j = c.where("shuffle > 0").join(base, list(by))
    # equality up to the last digit counts as at least as good
    return j.groupBy(*by).agg(((F.count_if(F.round("calmar", 9) >= F.round("base", 9)) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("pvalue"), F.max("base").alias("calmar"))


def pbo(df: DataFrame, shuffles: int = 300, splits: int = 8, seed: int = 202, by=("candidate_id",), order: str = "timestamp") -> DataFrame:
    """Share of rotations in which the in-sample best ranks at or below the middle out of sample.

    Blocks are contiguous; each adjacent half is in-sample once. A series of fewer than twenty rows says nothing and
    counts as overfitted.
    """
    splits += splits % 2

    def score(ks: np.ndarray, p: np.ndarray, r: np.ndarray) -> pd.DataFrame:
        x, blocks, half = p[shuffle_orders(seed, ks, len(p))] * r, np.array_split(np.arange(len(p)), splits), splits // 2
        side = lambda parts: row_calmar(x[:, np.concatenate(parts)]) if sum(map(len, parts)) else np.full(len(ks), np.nan)
        turned = [blocks[t:] + blocks[:t] for t in range(splits)]
        return pd.concat([pd.DataFrame({"shuffle": ks, "rotation": t, "i": side(b[:half]), "o": side(b[half:])}) for t, b in enumerate(turned)])

    w = shuffled(df, shuffles, by, order, score, "shuffle int, rotation int, i double, o double")
    w = w.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), 9) for c in ("i", "o")})
    # the smallest shuffle number wins ties; values compare at nine digits
    best = w.groupBy(*by, "rotation").agg(F.max_by("o", F.struct("i", (-F.col("shuffle")).alias("s"))).alias("ob"))
    j = w.join(best, [*by, "rotation"])
    rank = j.groupBy(*by, "rotation").agg(F.avg((F.col("o") <= F.col("ob")).cast("double")).alias("rank"))
    out = rank.groupBy(*by).agg(F.avg((F.col("rank") <= 0.5).cast("double")).alias("pbo"))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return out.join(rows, list(by)).select(*by, F.when(F.col("_n") < 20, 1.0).otherwise(F.col("pbo")).alias("pbo"))


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """One-sided normal tail probability."""
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), na_action="ignore")


def mean_pvalue(df: DataFrame, x: str, by=("candidate_id",)) -> DataFrame:
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    z = F.when((F.col("n") >= 3) & (F.col("s") > 1e-12), F.col("m") / (F.col("s") / F.sqrt("n")))
    g = g.withColumn("z", z)
    flat = F.when((F.col("n") >= 3) & (F.col("m") > 0), 0.0).otherwise(1.0)
    return g.select(*by, F.coalesce(upper_tail("z"), flat).alias("mean_pvalue"))


def regime_calmar(df: DataFrame, by=("candidate_id",), order: str = "timestamp") -> DataFrame:
    """Calmar inside up, down, crisis (worst tenth) and quiet rows; under five rows counts as zero."""
    q = df.groupBy(*by).agg(F.percentile("next_return", 0.10).alias("_lo"), F.percentile(F.abs("next_return"), 0.50).alias("_md"), F.count("next_return").alias("_all"))
    r = F.col("next_return")
    tags = F.array_compact(F.array(
        F.when(r > 0, F.lit("up")), F.when(r < 0, F.lit("down")), F.when(r <= F.col("_lo"), F.lit("crisis")), F.when(F.abs(r) <= F.col("_md"), F.lit("quiet")),
    ))
    x = df.join(q, list(by)).where("_all >= 20").withColumns({"regime": F.explode(tags), "_x": F.col("position") * r})
    key = [*by, "regime"]
    n = x.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    c = grouped_calmar(x, "_x", key, order).join(n, key)
    return c.select(*key, "rows", F.when(F.col("rows") < 5, 0.0).otherwise(F.col("calmar")).alias("calmar"))


def trade_concentration(df: DataFrame, by=("candidate_id",), order: str = "timestamp", top: int = 5) -> DataFrame:
    """Share of the five best winning islands in all winnings; one without winnings."""
    x = B._islands(df.withColumn("_x", F.col("position") * F.col("next_return")), F.col("position"), by, order)
    t = x.groupBy(*by, "island").agg((F.product(1.0 + F.col("_x")) - 1.0).alias("r"))
    w = Window.partitionBy(*by).orderBy(F.col("r").desc(), "island")
    g = t.withColumn("_k", F.row_number().over(w)).groupBy(*by).agg(
        F.sum(F.when((F.col("r") > 0) & (F.col("_k") <= top), F.col("r"))).alias("a"), F.sum(F.when(F.col("r") > 0, F.col("r"))).alias("b")
    )
    return g.select(*by, F.when(F.col("b") > 1e-12, F.col("a") / F.col("b")).otherwise(1.0).alias("trade_concentration_top5"))


def validation_summary(df: DataFrame, paths: int = 300, shuffles: int = 300, splits: int = 8) -> DataFrame:
    """Bootstrap, permutation, overfitting, regime and concentration statistics of validated series.

    ``df``: candidate_id, timestamp, position, next_return, n_trials, source_method.
    """
    from barlab.session import checkpoint

    x = df.withColumns({"strategy_return": F.col("position") * F.col("next_return"), "frequency": F.lit("daily")})
    x = checkpoint(x.withColumn("excess", F.col("strategy_return") - F.col("next_return")))
    b = bootstrap_samples(x, paths).groupBy("candidate_id").agg(F.percentile("calmar", 0.05).alias("bootstrap_calmar_p05"), F.percentile("calmar", 0.5).alias("bootstrap_calmar_p50"))
    e = bootstrap_samples(x, paths, x="excess").groupBy("candidate_id").agg(F.percentile("calmar", 0.05).alias("bootstrap_excess_calmar_p05"), F.percentile("calmar", 0.5).alias("bootstrap_excess_calmar_p50"))
    reg = regime_calmar(x).groupBy("candidate_id").agg(F.min("calmar").alias("regime_min_calmar"))
    parts = [
        b, e, mean_pvalue(x, "excess").withColumnRenamed("mean_pvalue", "excess_pvalue"),
        permutation_pvalue(x, shuffles).select("candidate_id", F.col("pvalue").alias("random_baseline_pvalue")),
        sharpe_confidence(x).select("candidate_id", F.col("dsr").alias("deflated_sharpe")), pbo(x, shuffles, splits), reg, trade_concentration(x),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "candidate_id", "left")
    return out
