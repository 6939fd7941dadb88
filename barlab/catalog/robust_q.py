"""Statistical robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.quality import UNI_SQL, universal_returns
from barlab.operators import pairs as PW
from barlab.operators import robust as RB
from barlab.registry import oracle
from barlab.registry import sharing_query as query
from barlab.sources.files import scratch

# the layout of the audit: daily net returns, the benchmark's as next_return, the exposure as position
WU_SQL = [*UNI_SQL, "wu AS (SELECT candidate_id, timestamp, 'daily' AS frequency, strategy_return, coalesce(benchmark_return, 0) AS next_return, exposure AS position FROM uni)"]


def daily_universal(spark, d):
    return universal_returns(spark, d).select("candidate_id", "timestamp", F.lit("daily").alias("frequency"), "strategy_return", F.coalesce("benchmark_return", F.lit(0.0)).alias("next_return"), F.col("exposure").alias("position"))


def metric_sql(src, key, ppy, order="timestamp", x="strategy_return"):
    w = f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return [f"m1 AS (SELECT *, product(1 + {x}) OVER {w} AS nav FROM {src})", f"m2 AS (SELECT *, nav / MAX(nav) OVER {w} - 1 AS dd FROM m1)",
        f"m3 AS (SELECT {key}, COUNT(*) AS periods, arg_max(nav, {order}) AS f, MIN(dd) AS mdd, AVG({x}) AS m, stddev_samp({x}) AS s, AVG(({x} > 0)::INT::DOUBLE) AS profit_periods_pct FROM m2 GROUP BY {key})",
        f"m4 AS (SELECT *, CASE WHEN f > 0 THEN pow(f, {ppy}e0 / periods) - 1 ELSE -1 END AS cagr FROM m3)",
        f"m5 AS (SELECT *, CASE WHEN mdd < -1e-12 THEN cagr / abs(mdd) WHEN cagr <= 0 THEN 0 END AS calmar, CASE WHEN s > 1e-12 THEN m / s * sqrt({ppy}e0) ELSE 0 END AS sharpe FROM m4)"]


@query("return_metrics", oracle("s:candidate_id i:periods f:mdd f:profit_periods_pct f:cagr f:calmar f:sharpe", UNI_SQL, metric_sql("uni", "candidate_id", 252), "SELECT * FROM m5"))
def return_metrics(spark, d):
    return RB.return_metrics(universal_returns(spark, d))


BOOT_N = 40


def boot_sql(n):
    """Paths of n samples per candidate; block starts hash a numeric candidate key."""
    return [*WU_SQL,
        "bc AS (SELECT candidate_id, COUNT(*) AS n, list(strategy_return ORDER BY timestamp) AS v FROM wu GROUP BY 1)",
        "bk AS (SELECT *, (ascii(candidate_id) * 1000 + CAST(split_part(candidate_id, '_', 2) AS BIGINT) * 200 + CAST(split_part(candidate_id, '_', 3) AS BIGINT)) % 1000003 AS key FROM bc)",
        f"bs AS (SELECT candidate_id, n, v, sample, i, ((((((key * 7919 + sample * 104729 + (i // 21) * 1299709 + 42 * 15485863) % 2147483647) * 48271) % 2147483647) * 48271) % 2147483647) % n AS st FROM bk, range({n}) AS s(sample), range(20000) AS r(i) WHERE i < n)",
        "bp AS (SELECT candidate_id || '/' || sample AS pk, candidate_id, sample, i, v[(st + i % 21) % n + 1] AS x FROM bs)",
        *metric_sql("bp", "pk", 252, "i", "x"), "bm AS (SELECT split_part(pk, '/', 1) AS candidate_id, CAST(split_part(pk, '/', 2) AS BIGINT) AS sample, cagr, mdd, sharpe, calmar FROM m5)"]


def boot_input(spark, d):
    p = F.split("candidate_id", "_")
    key = (F.ascii("candidate_id") * 1000 + p[1].cast("bigint") * 200 + p[2].cast("bigint")) % 1000003
    return daily_universal(spark, d).withColumn("key", key)


BOOT_OUT = "s:candidate_id " + " ".join(f"f:bootstrap_{m}_{q}" for m in ("cagr", "sharpe") for q in ("p05", "p50", "p95")) + " f:bootstrap_calmar_p05 f:bootstrap_prob_cagr_positive"


@query("block_bootstrap")
def block_bootstrap(spark, d):
    """Bootstrap summary of 1000 samples per candidate."""
    return RB.bootstrap_summary(RB.bootstrap_samples(boot_input(spark, d), 1000, key="key"))


@query("bootstrap_paths", oracle("s:candidate_id i:sample f:cagr f:mdd f:sharpe f:calmar", boot_sql(BOOT_N), "SELECT * FROM bm"))
def bootstrap_paths(spark, d):
    """Metrics of every resampled path."""
    return RB.bootstrap_samples(boot_input(spark, d), BOOT_N, batch=10, key="key")


@query("split_half", oracle("s:candidate_id f:half_1_cagr f:half_2_cagr b:split_pass", UNI_SQL,
    "h AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY timestamp) <= COUNT(*) OVER (PARTITION BY candidate_id) // 2 AS a FROM uni)",
    "g AS (SELECT candidate_id, product(1 + strategy_return) FILTER (a) AS f1, COUNT(*) FILTER (a) AS n1, product(1 + strategy_return) FILTER (NOT a) AS f2, COUNT(*) FILTER (NOT a) AS n2 FROM h GROUP BY 1)",
    "SELECT candidate_id, pow(f1, 252e0 / n1) - 1 AS half_1_cagr, pow(f2, 252e0 / n2) - 1 AS half_2_cagr, f1 >= 1 AND f2 >= 1 AS split_pass FROM g"))
def split_half(spark, d):
    return RB.split_half(universal_returns(spark, d))


@query("leave_one_year_out", oracle("s:candidate_id f:leave_one_year_out_min_cagr i:leave_one_year_out_years b:leave_one_year_out_pass", UNI_SQL,
    "y AS (SELECT DISTINCT candidate_id, year(timestamp) AS y FROM uni)",
    "g AS (SELECT y.candidate_id, y.y, pow(product(1 + u.strategy_return), 252e0 / COUNT(*)) - 1 AS c FROM y JOIN uni AS u ON u.candidate_id = y.candidate_id AND year(u.timestamp) <> y.y GROUP BY 1, 2)",
    "SELECT candidate_id, MIN(c) AS leave_one_year_out_min_cagr, COUNT(*) AS leave_one_year_out_years, MIN(c) >= 0 AS leave_one_year_out_pass FROM g GROUP BY 1"))
def leave_one_year_out(spark, d):
    return RB.leave_one_year_out(universal_returns(spark, d))


@query("calendar_profit", oracle("s:candidate_id f:profit_months_pct f:profit_years_pct b:calendar_profit_pass", UNI_SQL,
    "m AS (SELECT candidate_id, AVG((f > 1)::INT::DOUBLE) AS a FROM (SELECT candidate_id, date_trunc('month', timestamp) AS k, product(1 + strategy_return) AS f FROM uni GROUP BY 1, 2) GROUP BY 1)",
    "y AS (SELECT candidate_id, AVG((f > 1)::INT::DOUBLE) AS b FROM (SELECT candidate_id, year(timestamp) AS k, product(1 + strategy_return) AS f FROM uni GROUP BY 1, 2) GROUP BY 1)",
    "SELECT candidate_id, a AS profit_months_pct, b AS profit_years_pct, a >= 0.52 AND b >= 0.5 AS calendar_profit_pass FROM m JOIN y USING (candidate_id)"))
def calendar_profit(spark, d):
    return RB.calendar_profit(universal_returns(spark, d))


@query("multiple_testing_gate", oracle("s:candidate_id i:n_trials b:multiple_testing_pass s:multiple_testing_fail_reason", UNI_SQL,
    "SELECT candidate_id, MAX(n_trials) AS n_trials, MAX(n_trials) IS NOT NULL AS multiple_testing_pass, CASE WHEN MAX(n_trials) IS NULL THEN 'missing_n_trials_generated_strategy' ELSE '' END AS multiple_testing_fail_reason FROM uni GROUP BY 1"))
def multiple_testing_gate(spark, d):
    return RB.multiple_testing(universal_returns(spark, d))


@query("psr_dsr")
def psr_dsr(spark, d):
    return RB.sharpe_confidence(universal_returns(spark, d))


@query("cost_stress", oracle("s:candidate_id b:returns_are_net f:cost_score_retention b:cost_pass s:cost_fail_reason", UNI_SQL,
    "g AS (SELECT candidate_id, bool_or(returns_are_net) AS net, COUNT(*) AS n, product(1 + strategy_return) AS f0, product(1 + strategy_return - turnover * 0.0003e0) AS f1 FROM uni GROUP BY 1)",
    "h AS (SELECT *, CASE WHEN f0 > 0 THEN pow(f0, 252e0 / n) - 1 ELSE -1 END AS c0, CASE WHEN f1 > 0 THEN pow(f1, 252e0 / n) - 1 ELSE -1 END AS c1 FROM g)",
    "k AS (SELECT *, CASE WHEN net THEN 1 WHEN c0 > 1e-12 THEN c1 / c0 END AS r FROM h)",
    "SELECT candidate_id, net AS returns_are_net, r AS cost_score_retention, coalesce(r >= 0.7, false) AS cost_pass, CASE WHEN coalesce(r >= 0.7, false) THEN '' ELSE 'cost_stress_retention_too_low' END AS cost_fail_reason FROM k"))
def cost_stress(spark, d):
    return RB.cost_stress(universal_returns(spark, d))


# near copies: every candidate again as "copy" (exact) and as "near" (slightly scaled returns)
COPY_SQL = [*UNI_SQL, """cp AS (SELECT candidate_id, timestamp, strategy_return, exposure FROM uni UNION ALL SELECT candidate_id || 'x', timestamp, strategy_return, exposure FROM uni WHERE ends_with(candidate_id, '5_20')
   UNION ALL SELECT candidate_id || 'y', timestamp, strategy_return * 0.9e0 + CASE WHEN day(timestamp) = 3 THEN 0.0001e0 ELSE 0 END, CASE WHEN day(timestamp) < 3 THEN 0 ELSE exposure END FROM uni WHERE ends_with(candidate_id, '60'))"""]


def with_copies(spark, d):
    u = universal_returns(spark, d).select("candidate_id", "timestamp", "strategy_return", "exposure")
    x = u.where(F.col("candidate_id").endswith("5_20")).withColumn("candidate_id", F.concat("candidate_id", F.lit("x")))
    y = u.where(F.col("candidate_id").endswith("60")).withColumns({
        "candidate_id": F.concat("candidate_id", F.lit("y")), "exposure": F.when(F.dayofmonth("timestamp") < 3, 0.0).otherwise(F.col("exposure")),
        "strategy_return": F.col("strategy_return") * 0.9 + F.when(F.dayofmonth("timestamp") == 3, 0.0001).otherwise(0.0)})
    return u.unionByName(x).unionByName(y)


@query("duplicates_exact", oracle("s:left_id s:right_id", COPY_SQL, "SELECT candidate_id AS left_id, candidate_id || 'x' AS right_id FROM (SELECT DISTINCT candidate_id FROM uni WHERE ends_with(candidate_id, '5_20'))"))
def duplicates_exact(spark, d):
    return RB.exact_edges(RB.fingerprints(with_copies(spark, d)))


NEAR = ["npair AS (SELECT a.candidate_id AS left_id, b.candidate_id AS right_id, COUNT(*) AS n_obs, corr(a.strategy_return, b.strategy_return) AS c, COUNT(*) FILTER (abs(a.exposure) > 1e-12 AND abs(b.exposure) > 1e-12) AS i, COUNT(*) FILTER (abs(a.exposure) > 1e-12 OR abs(b.exposure) > 1e-12) AS u FROM cp AS a JOIN cp AS b ON a.timestamp = b.timestamp AND a.candidate_id < b.candidate_id GROUP BY 1, 2)",
    "nact AS (SELECT candidate_id, COUNT(*) FILTER (abs(exposure) > 1e-12) AS n FROM cp GROUP BY 1)",
    "npj AS (SELECT p.*, p.i / nullif(a.n + b.n - p.i, 0)::DOUBLE AS j FROM npair AS p JOIN nact AS a ON a.candidate_id = left_id JOIN nact AS b ON b.candidate_id = right_id)"]


@query("duplicates_near_corr", oracle("s:left_id s:right_id i:n_obs f:corr", COPY_SQL, NEAR, "SELECT left_id, right_id, n_obs, c AS corr FROM npair WHERE abs(c) >= 0.98 AND n_obs >= greatest(10, (SELECT COUNT(DISTINCT timestamp) FROM cp) // 2)"))
def duplicates_near_corr(spark, d):
    r = with_copies(spark, d).withColumnRenamed("timestamp", "ts")
    return PW.similar_pairs(r, min_jaccard=2.0, exposure="exposure").select("left_id", "right_id", "n_obs", "corr")


@query("duplicates_position_jaccard", oracle("s:left_id s:right_id f:jaccard", COPY_SQL, NEAR, "SELECT left_id, right_id, j AS jaccard FROM npj WHERE j >= 0.9"))
def duplicates_position_jaccard(spark, d):
    r = with_copies(spark, d).withColumnRenamed("timestamp", "ts")
    return PW.similar_pairs(r, min_corr=2.0, exposure="exposure").select("left_id", "right_id", "jaccard")


@query("duplicate_components", oracle("s:candidate_id s:duplicate_group_id i:duplicate_group_size b:duplicate_representative", COPY_SQL, NEAR,
    "ed AS (SELECT left_id AS a, right_id AS b FROM npair WHERE abs(c) >= 0.98 AND n_obs >= greatest(10, (SELECT COUNT(DISTINCT timestamp) FROM cp) // 2))", "sy AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed)",
    "nodes AS (SELECT candidate_id AS id, product(1 + strategy_return) AS f, COUNT(*) AS n FROM cp GROUP BY 1)",
    "reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, s.b FROM reach AS r JOIN sy AS s ON s.a = r.b)", "rt AS (SELECT a AS id, MIN(b) AS root FROM reach GROUP BY 1)",
    "gid AS (SELECT root, 'dup_' || lpad(CAST(row_number() OVER (ORDER BY root) AS VARCHAR), 4, '0') AS g FROM (SELECT DISTINCT root FROM rt))",
    "x AS (SELECT rt.id, g, COUNT(*) OVER (PARTITION BY rt.root) AS sz, row_number() OVER (PARTITION BY rt.root ORDER BY round(pow(f, 252e0 / n) - 1, 9) DESC, rt.id) AS k FROM rt JOIN gid USING (root) JOIN nodes ON nodes.id = rt.id)",
    "SELECT id AS candidate_id, g AS duplicate_group_id, sz AS duplicate_group_size, k = 1 AS duplicate_representative FROM x").replace("WITH ", "WITH RECURSIVE ", 1))
def duplicate_components(spark, d):
    c = with_copies(spark, d)
    edges = RB.exact_edges(RB.fingerprints(c)).unionByName(PW.similar_pairs(c.withColumnRenamed("timestamp", "ts"), min_jaccard=2.0, exposure="exposure").select("left_id", "right_id"))
    res = c.groupBy("candidate_id").agg(F.round(F.pow(F.product(1.0 + F.col("strategy_return")), 252.0 / F.count(F.lit(1))) - 1.0, 9).alias("cagr"), F.lit(True).alias("robust_pass"), F.lit(True).alias("correlation_pass"))
    return RB.duplicate_groups(res, edges).select("candidate_id", "duplicate_group_id", "duplicate_group_size", "duplicate_representative")


def verdicts(spark, d, samples=1000):
    return RB.verdict(universal_returns(spark, d), samples)


@query("robust_verdict")
def robust_verdict(spark, d):
    return verdicts(spark, d).select("candidate_id", "cagr", "mdd", "bootstrap_cagr_p05", "statistical_pass", "robust_pass", "portfolio_eligible", "fail_reasons")


@query("chunks_merge", oracle("s:source_method i:candidates i:robust_pass f:best_cagr b:partial", UNI_SQL,
    "g AS (SELECT candidate_id, MAX(source_method) AS source_method, pow(product(1 + strategy_return), 252e0 / COUNT(*)) - 1 AS cagr FROM uni GROUP BY 1)",
    "SELECT source_method, COUNT(*) AS candidates, COUNT(*) FILTER (cagr > 0) AS robust_pass, MAX(cagr) AS best_cagr, false AS partial FROM g GROUP BY 1"))
def chunks_merge(spark, d):
    """Audit results of candidate chunks put together; a missing chunk marks the table partial."""
    u = universal_returns(spark, d)
    chunk = lambda df: df.withColumn("chunk", F.pmod(F.xxhash64("candidate_id"), F.lit(4)))
    wanted = chunk(u.select("candidate_id", "source_method").distinct())
    allp = None
    for k in range(4):
        part = chunk(u).where(F.col("chunk") == k)
        done = RB.return_metrics(part).join(part.groupBy("candidate_id").agg(F.max("source_method").alias("source_method")), "candidate_id")
        path = scratch(spark, f"audit_chunk_{k}")
        done.write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path)
        allp = done if allp is None else allp.unionByName(done)
    g = allp.groupBy("source_method").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("cagr") > 0).alias("robust_pass"), F.max("cagr").alias("best_cagr"))
    # a candidate without an audit row belongs to a chunk that is missing or was cut short
    open_rows = wanted.join(allp.select("candidate_id"), "candidate_id", "left_anti").groupBy("source_method").agg(F.count(F.lit(1)).alias("missing"))
    return g.join(open_rows, "source_method", "left").withColumn("partial", F.coalesce(F.col("missing") > 0, F.lit(False))).drop("missing")


LCGROW = "(((((({rn} * 7919 + k * 104729 + {s} * 1299709) % 2147483647) * 48271) % 2147483647) * 48271) % 2147483647)"


def shuffle_sql(k, seed):
    return ["pn AS (SELECT candidate_id, timestamp, next_return, position, row_number() OVER (PARTITION BY candidate_id ORDER BY timestamp) AS rn FROM wu)",
        f"pr AS (SELECT pn.*, k, row_number() OVER (PARTITION BY candidate_id, k ORDER BY {LCGROW.format(rn='rn', s=seed)}, rn) AS dest FROM pn, range(1, {k + 1}) AS t(k))",
        "ps AS (SELECT a.candidate_id, a.timestamp, a.rn, a.k, b.position * a.next_return AS x FROM pr AS a JOIN pr AS b ON b.candidate_id = a.candidate_id AND b.k = a.k AND b.dest = a.rn UNION ALL SELECT candidate_id, timestamp, rn, 0, position * next_return FROM pn)"]


def calmar_sql(src, key, order, out):
    w = f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return [f"{out}1 AS (SELECT *, product(1 + x) OVER {w} AS nav FROM {src})", f"{out}2 AS (SELECT *, nav / MAX(nav) OVER {w} - 1 AS dd FROM {out}1)",
        f"{out}3 AS (SELECT {key}, COUNT(*) AS n, arg_max(nav, ({order})) AS f, MIN(dd) AS mdd FROM {out}2 GROUP BY {key})",
        f"{out} AS (SELECT *, CASE WHEN abs(mdd) > 1e-12 THEN (CASE WHEN f > 0 THEN pow(f, 252e0 / n) - 1 ELSE -1 END) / abs(mdd) WHEN f > 1 THEN 999 ELSE 0 END AS calmar FROM {out}3)"]


@query("permutation_pvalue", oracle("s:candidate_id f:pvalue f:calmar", WU_SQL, shuffle_sql(300, 101), calmar_sql("ps", "candidate_id, k", "rn", "pc"),
    "b AS (SELECT candidate_id, calmar FROM pc WHERE k = 0)", "SELECT p.candidate_id, (COUNT(*) FILTER (round(p.calmar, 9) >= round(b.calmar, 9)) + 1e0) / (COUNT(*) + 1) AS pvalue, MAX(b.calmar) AS calmar FROM pc AS p JOIN b USING (candidate_id) WHERE k > 0 GROUP BY 1"))
def permutation_pvalue(spark, d):
    return RB.permutation_pvalue(daily_universal(spark, d), 300, 101)


@query("pbo")
def pbo(spark, d):
    return RB.pbo(daily_universal(spark, d), 300, 8, 202)


@query("mean_pvalue")
def mean_pvalue(spark, d):
    return RB.mean_pvalue(universal_returns(spark, d), "strategy_return")


@query("regime_calmar", oracle("s:candidate_id s:regime i:rows f:calmar", WU_SQL,
    "q AS (SELECT candidate_id, quantile_cont(next_return, 0.1) AS lo, quantile_cont(abs(next_return), 0.5) AS md FROM wu GROUP BY 1)",
    "rx AS (SELECT w.candidate_id, timestamp, position * next_return AS x, unnest(list_filter([CASE WHEN next_return > 0 THEN 'up' END, CASE WHEN next_return < 0 THEN 'down' END, CASE WHEN next_return <= lo THEN 'crisis' END, CASE WHEN abs(next_return) <= md THEN 'quiet' END], lambda z: z IS NOT NULL)) AS regime FROM wu AS w JOIN q USING (candidate_id))",
    calmar_sql("rx", "candidate_id, regime", "timestamp", "rc"), "SELECT candidate_id, regime, n AS rows, CASE WHEN n < 5 THEN 0 ELSE calmar END AS calmar FROM rc"))
def regime_calmar(spark, d):
    return RB.regime_calmar(daily_universal(spark, d))


@query("trade_concentration_top5", oracle("s:candidate_id f:trade_concentration_top5", WU_SQL,
    "a AS (SELECT candidate_id, timestamp, position * next_return AS x, CASE WHEN lag(position) OVER (PARTITION BY candidate_id ORDER BY timestamp) = position THEN 0 ELSE 1 END AS c FROM wu)",
    "b AS (SELECT *, SUM(c) OVER (PARTITION BY candidate_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM a)", "t AS (SELECT candidate_id, isl, product(1 + x) - 1 AS r FROM b GROUP BY 1, 2)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY r DESC, isl) AS k FROM t)", "SELECT candidate_id, CASE WHEN SUM(r) FILTER (r > 0) > 1e-12 THEN SUM(r) FILTER (r > 0 AND k <= 5) / SUM(r) FILTER (r > 0) ELSE 1 END AS trade_concentration_top5 FROM k GROUP BY 1"))
def trade_concentration_top5(spark, d):
    return RB.trade_concentration(daily_universal(spark, d))


@query("robustness_summary")
def robustness_summary(spark, d):
    """Daily series, as the summary annualises them."""
    u = universal_returns(spark, d).select(
        "candidate_id", "timestamp", F.col("exposure").alias("position"), F.coalesce("benchmark_return", F.lit(0.0)).alias("next_return"),
        F.lit(50).alias("n_trials"), F.lit("machine_learning").alias("source_method"))
    return RB.validation_summary(u, 300, 300, 8)


@query("year_table", oracle("s:candidate_id i:year s:sample_role i:periods f:strategy_return", UNI_SQL, "SELECT candidate_id, year(timestamp) AS year, sample_role, COUNT(*) AS periods, product(1 + strategy_return) - 1 AS strategy_return FROM uni GROUP BY 1, 2, 3"))
def year_table(spark, d):
    return RB.year_table(universal_returns(spark, d))


