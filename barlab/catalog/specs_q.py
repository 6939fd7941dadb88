"""Spec catalogs, grids and candidate algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.features import DAILY_SQL
from barlab.catalog.quality import AN_LONG, WK_LONG
from barlab.functions import text as TX
from barlab.operators import quality as Q
from barlab.operators import specs as SP
from barlab.plans import decisions as D
from barlab.plans import inputs as I
from barlab.plans import sweeps as SW
from barlab.registry import oracle
from barlab.registry import sharing_query as query

FEAT = [I.BARS, I.RETS, DAILY_SQL]
FEAT = [c for p in FEAT for c in p]


def thr_sql(src, qs, weights, name="t", skip_one=False):
    w = ", ".join(str(x) for x in weights)
    tail = "CASE WHEN w = 1 THEN '' ELSE '|' || w END" if skip_one else "'|' || w"
    return [f"{name}q AS (SELECT feature, quantile_cont(value, [{', '.join(map(str, qs))}]) AS qs FROM {src} GROUP BY 1)",
            f"""{name} AS (SELECT feature, 'threshold' AS kind, lo, CAST(NULL AS DOUBLE) AS hi, dir AS direction, w AS weight,
              feature || '|threshold|' || printf('%.8f', lo) || '|' || dir || {tail} AS spec
              FROM (SELECT feature, unnest(qs) AS lo FROM {name}q), (VALUES (-1), (1)) AS d(dir), (SELECT unnest([{w}]) AS w) WHERE lo IS NOT NULL)"""]


def rng_sql(src, ranges, weights, name="r", skip_one=False, dirs=(-1, 1)):
    w = ", ".join(str(x) for x in weights)
    dd = ", ".join(f"({x})" for x in dirs)
    tail = "CASE WHEN w = 1 THEN '' ELSE '|' || w END" if skip_one else "'|' || w"
    un = " UNION ALL ".join(f"SELECT feature, quantile_cont(value, {a}) AS lo, quantile_cont(value, {b}) AS hi FROM {src} GROUP BY 1" for a, b in ranges)
    return [f"""{name} AS (SELECT feature, 'range' AS kind, lo, hi, dir AS direction, w AS weight,
              feature || '|range|' || printf('%.8f', lo) || '|' || printf('%.8f', hi) || '|' || dir || {tail} AS spec
              FROM ({un}), (VALUES {dd}) AS d(dir), (SELECT unnest([{w}]) AS w) WHERE lo < hi)"""]


SPEC_OUT = "s:spec s:feature s:kind i:direction i:weight"


@query("spec_catalog_weekly", oracle(SPEC_OUT, FEAT, D.WEEKLY_SQL, WK_LONG, "tr AS (SELECT * FROM wk_long WHERE period = 'train')",
    thr_sql("tr", SP.WEEKLY_QUANTILES, (1, 2, 3)), rng_sql("tr", ((0.2, 0.8),), (1,)),
    "SELECT DISTINCT spec, feature, kind, direction, weight FROM (SELECT * FROM t UNION ALL SELECT * FROM r)"))
def spec_catalog_weekly(spark, d):
    long = SW.period_long(D.weekly(spark, d)).where("period = 'train'")
    return SP.weekly_catalog(long).select("spec", "feature", "kind", "direction", "weight")


MO_LONG = ["mo_long AS (" + " UNION ALL ".join(
    f"SELECT decision_date, period, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM monthly WHERE period <> 'locked'" for c in D.SPEC_FEATURES) + ")"]


@query("spec_catalog_monthly", oracle(SPEC_OUT, FEAT, D.MONTHLY_SQL, MO_LONG, "tr AS (SELECT * FROM mo_long WHERE period = 'train')",
    thr_sql("tr", SP.MONTHLY_QUANTILES, (1, 2)), rng_sql("tr", ((0.25, 0.75),), (1,)),
    "SELECT DISTINCT spec, feature, kind, direction, weight FROM (SELECT * FROM t UNION ALL SELECT * FROM r)"))
def spec_catalog_monthly(spark, d):
    long = SW.period_long(D.monthly(spark, d)).where("period = 'train'")
    return SP.monthly_catalog(long).select("spec", "feature", "kind", "direction", "weight")


@query("spec_catalog_annual", oracle(SPEC_OUT, FEAT, D.ANNUAL_SQL, AN_LONG, "tr AS (SELECT * FROM an_long WHERE target_year <= 1998 AND NOT contains(feature, 'above'))",
    thr_sql("tr", SP.ANNUAL_QUANTILES, (1,), "t1", True), thr_sql("tr", (0.5,), (2,), "t2"), rng_sql("tr", SP.ANNUAL_RANGES, (1,), "r1", True), rng_sql("tr", ((0.25, 0.75),), (2,), "r2", dirs=(1,)),
    "SELECT DISTINCT spec, feature, kind, direction, weight FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)"))
def spec_catalog_annual(spark, d):
    long = Q.melt(D.annual(spark, d).where("symbol = 'N' AND target_year <= 1998"), ["target_year"], D.FEATURES)
    return SP.annual_catalog(long, exclude=("above",)).select("spec", "feature", "kind", "direction", "weight")


DAY_LONG = ["day_long AS (" + " UNION ALL ".join(f"SELECT ts, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM daily_features WHERE symbol = 'N' AND ts <= DATE '1998-12-31'" for c in D.FEATURES) + ")"]


@query("spec_catalog_daily", oracle("s:spec s:feature s:kind i:win_rows i:direction s:family", FEAT, DAY_LONG,
    f"dq AS (SELECT feature, quantile_cont(value, [{', '.join(map(str, SP.DAILY_QUANTILES))}]) AS qs FROM day_long GROUP BY 1)",
    """dv AS (SELECT DISTINCT feature, 'threshold' AS kind, v AS value, 0 AS wn FROM (SELECT feature, unnest(qs) AS v FROM dq UNION ALL SELECT feature, 0e0 FROM dq WHERE list_min(qs) < 0 AND list_max(qs) > 0)
       UNION ALL SELECT feature, 'zscore', z, w FROM dq, (SELECT unnest([-1e0, -0.5e0, 0e0, 0.5e0, 1e0]) AS z), (SELECT unnest([20, 60, 120, 252]) AS w))""",
    f"""SELECT DISTINCT feature || '|' || kind || '|' || printf('%.8f', value) || '|' || wn || '|' || dir AS spec, feature, kind, wn AS win_rows, dir AS direction,
       {TX.classify_sql(TX.DAILY_FAMILIES, 'feature', "'other'")} AS family FROM dv, (VALUES (-1), (1)) AS d(dir)"""))
def spec_catalog_daily(spark, d):
    long = Q.melt(D.featured(spark, d).where("ts <= DATE'1998-12-31'"), ["ts"], D.FEATURES)
    s = SP.daily_catalog(long)
    return s.select("spec", "feature", "kind", F.col("window").alias("win_rows"), "direction", TX.daily_family(F.col("feature")).alias("family"))


@query("param_grid", oracle("s:symbol i:fast i:slow f:level",
    "SELECT DISTINCT l_returnflag AS symbol, f AS fast, s AS slow, v AS level FROM lineitem, (SELECT unnest([5, 10, 20]) AS f), (SELECT unnest([20, 50, 100]) AS s), (SELECT unnest([0.5e0, 1e0]) AS v)"))
def param_grid(spark, d):
    sym = I.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct()
    return SP.param_grid(sym, {"fast": SP.ints((5, 10, 20)), "slow": SP.ints((20, 50, 100)), "level": SP.floats((0.5, 1.0))})


@query("rule_grid", oracle("s:symbol s:rule i:fast_window i:slow_window i:momentum_window f:threshold i:reversion_window f:entry_zscore f:exit_zscore i:breakout_window i:exit_window",
    "s AS (SELECT DISTINCT l_returnflag AS symbol FROM lineitem)", """
SELECT symbol, 'ma_crossover' AS rule, f AS fast_window, w AS slow_window, NULL AS momentum_window, NULL AS threshold, NULL AS reversion_window, NULL AS entry_zscore, NULL AS exit_zscore, NULL AS breakout_window, NULL AS exit_window
 FROM s, (SELECT unnest([5, 20, 50]) AS f), (SELECT unnest([20, 50, 100]) AS w) WHERE f < w
UNION ALL SELECT symbol, 'momentum_threshold', NULL, NULL, m, t, NULL, NULL, NULL, NULL, NULL FROM s, (SELECT unnest([10, 60]) AS m), (SELECT unnest([0e0, 0.02e0]) AS t)
UNION ALL SELECT symbol, 'mean_reversion', NULL, NULL, NULL, NULL, n, a, b, NULL, NULL FROM s, (SELECT unnest([20, 60]) AS n), (SELECT unnest([0.5e0, 1e0]) AS a), (SELECT unnest([0e0, 0.75e0]) AS b) WHERE a > b
UNION ALL SELECT symbol, 'breakout', NULL, NULL, NULL, NULL, NULL, NULL, NULL, k, x FROM s, (SELECT unnest([20, 60]) AS k), (SELECT unnest([10, 40]) AS x) WHERE x <= k
UNION ALL SELECT symbol, 'volatility_momentum', NULL, NULL, m, NULL, NULL, NULL, NULL, NULL, NULL FROM s, (SELECT unnest([10, 60]) AS m)"""))
def rule_grid(spark, d):
    sym = I.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct()
    space = {"fast_window": SP.ints((5, 20, 50)), "slow_window": SP.ints((20, 50, 100)), "momentum_window": SP.ints((10, 60)), "threshold": SP.floats((0.0, 0.02)),
             "reversion_window": SP.ints((20, 60)), "entry_zscore": SP.floats((0.5, 1.0)), "exit_zscore": SP.floats((0.0, 0.75)),
             "breakout_window": SP.ints((20, 60)), "exit_window": SP.ints((10, 40))}
    return SP.rule_grid(sym, space)


@query("stage_shard", oracle("i:candidate_id f:score i:index", """
n AS (SELECT o_custkey AS candidate_id, o_totalprice AS score, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS index FROM orders)""",
    "SELECT candidate_id, score, index FROM n WHERE index % 16 = 3"))
def stage_shard(spark, d):
    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_totalprice").alias("score"), "o_orderkey")
    return SP.stage_shard(o, [F.col("score").desc(), F.col("o_orderkey")], 3, 16).drop("o_orderkey")


@query("expand_all_features", oracle("s:symbol s:feature_name f:feature_threshold", "s AS (SELECT DISTINCT l_returnflag AS symbol FROM lineitem)",
    f"SELECT symbol, f AS feature_name, v AS feature_threshold FROM s, (SELECT unnest([{', '.join(repr(f) for f in D.FEATURES)}]) AS f), (SELECT unnest([0e0, 0.5e0]) AS v)"))
def expand_all_features(spark, d):
    names = Q.numeric_columns(D.featured(spark, d))
    sym = I.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct()
    return SP.param_grid(sym, {"feature_name": F.array(*[F.lit(n) for n in names]), "feature_threshold": SP.floats((0.0, 0.5))})


RANKED = ["ranked AS (SELECT p_brand AS spec, row_number() OVER (ORDER BY n DESC, p_brand) AS rank FROM (SELECT p_brand, SUM(p_size) AS n FROM part GROUP BY 1))"]


@query("seed_combinations", oracle("s:specs i:size i:min_votes", RANKED, """
x AS (SELECT [a.spec, b.spec] AS specs, 2 AS size FROM ranked AS a JOIN ranked AS b ON a.rank < b.rank WHERE (a.rank + b.rank) % 3 = 0
  UNION ALL SELECT [a.spec, b.spec, c.spec], 3 FROM ranked AS a JOIN ranked AS b ON a.rank < b.rank JOIN ranked AS c ON b.rank < c.rank WHERE (a.rank + b.rank + c.rank) % 3 = 0)""",
    "SELECT array_to_string(specs, ';') AS specs, size, v AS min_votes FROM x, (SELECT unnest([1, 2, 3]) AS v) WHERE v <= size"))
def seed_combinations(spark, d):
    from barlab.operators import search as SE

    n = I.table(spark, d, "part").groupBy(F.col("p_brand").alias("spec")).agg(F.sum("p_size").alias("n"))
    seeds = SP.numbered(n, [F.col("n").desc(), F.col("spec")], "rank").select("spec", (F.col("rank") + 1).alias("rank"))
    return SE.seed_combinations(seeds, sizes=(2, 3), modulus=3).select(F.array_join("specs", ";").alias("specs"), "size", "min_votes")


@query("inverse_spec", oracle("s:spec s:inverse", "s AS (SELECT DISTINCT p_brand || '|threshold|' || p_size || '|0|1' AS spec FROM part)",
    "SELECT spec, regexp_replace(spec, '[^|]+$', '-1') AS inverse FROM s"))
def inverse_spec(spark, d):
    s = I.table(spark, d, "part").select(F.concat_ws("|", "p_brand", F.lit("threshold"), F.col("p_size").cast("string"), F.lit("0"), F.lit("1")).alias("spec")).distinct()
    return s.withColumn("inverse", SP.inverse(F.col("spec")))


@query("asset_universes", oracle("i:year s:universe", """
a AS (SELECT year(l_shipdate) AS year, list_sort(list_distinct(list(l_returnflag))) AS av FROM lineitem GROUP BY 1)""",
    "SELECT DISTINCT year, array_to_string(u, ',') AS universe FROM (SELECT year, unnest(list_concat([list_filter(['N'], lambda x: list_contains(av, x)), list_filter(['N', 'A', 'Q'], lambda x: list_contains(av, x)), list_filter(['N', 'R', 'A'], lambda x: list_contains(av, x))], list_transform(av, lambda x: [x]))) AS u FROM a) WHERE len(u) > 0"))
def asset_universes(spark, d):
    a = I.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("av"))
    u = SP.universes(F.col("av"), [["N"], ["N", "A", "Q"], ["N", "R", "A"]])
    return a.select("year", F.explode(u).alias("u")).select("year", F.array_join("u", ",").alias("universe"))


@query("candidate_id", oracle("i:o_orderkey s:candidate_id s:readable", """
SELECT o_orderkey, 'weekly_' || substring(sha256('{"specs":["' || o_orderpriority || '","' || o_orderstatus || '"],"scale":' || o_orderkey % 7 || '}'), 1, 16) AS candidate_id,
  'priority_' || replace(o_orderpriority, '-', '_') || '_rule_ma_stage_' || o_orderkey % 7 AS readable FROM orders"""))
def candidate_id(spark, d):
    o = I.table(spark, d, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("specs"), (F.col("o_orderkey") % 7).alias("scale"),
        F.col("o_orderpriority").alias("priority"), F.lit("ma").alias("rule"), (F.col("o_orderkey") % 7).alias("stage"))
    return o.select("o_orderkey", SP.digest_id("weekly_", F.col("specs"), F.col("scale")).alias("candidate_id"),
                    SP.params_text(o, ["rule", "stage", "priority"]).alias("readable"))


@query("candidate_decode", oracle("i:o_orderkey s:first_spec i:n_specs s:asset s:selector f:scale i:min_votes", """
SELECT o_orderkey, o_orderstatus || '|threshold|1|1|1' AS first_spec, 2 AS n_specs, CASE WHEN o_orderkey % 3 = 0 THEN 'SPY' ELSE o_orderpriority END AS asset,
 CASE WHEN o_orderkey % 5 = 0 THEN 'momentum_26w' ELSE 'momentum_4w' END AS selector, CASE WHEN o_orderkey % 7 = 0 THEN 1e0 ELSE (o_orderkey % 7) / 4e0 END AS scale,
 CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 4 END AS min_votes FROM orders"""))
def candidate_decode(spark, d):
    from barlab.operators import search as SE

    k = F.col("o_orderkey")
    rows = I.table(spark, d, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit("|threshold|1|1|1;"), "o_orderpriority", F.lit("|range|1|2|1|1")).alias("specs"),
        F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("assets"), F.when(k % 5 == 0, "").otherwise("momentum_4w").alias("asset_selector"),
        ((k % 7) / 4.0).alias("scale"), (k % 4).alias("min_votes"))
    c = SE.decode(rows)
    return c.select("o_orderkey", F.get("specs", F.lit(0)).alias("first_spec"), F.size("specs").alias("n_specs"), F.get("assets", F.lit(0)).alias("asset"),
                    F.col("selector"), "scale", "min_votes")


@query("spec_parse", oracle("s:spec s:feature s:kind f:lo f:hi i:direction i:weight", FEAT, D.WEEKLY_SQL, WK_LONG, "tr AS (SELECT * FROM wk_long WHERE period = 'train')",
    thr_sql("tr", SP.WEEKLY_QUANTILES, (1, 2, 3)), rng_sql("tr", ((0.2, 0.8),), (1,)),
    "SELECT DISTINCT spec, feature, kind, CAST(printf('%.8f', lo) AS DOUBLE) AS lo, CAST(printf('%.8f', hi) AS DOUBLE) AS hi, direction, weight FROM (SELECT * FROM t UNION ALL SELECT * FROM r)"))
def spec_parse(spark, d):
    long = SW.period_long(D.weekly(spark, d)).where("period = 'train'")
    return SP.parse_period(SP.weekly_catalog(long).select("spec"))


@query("spec_encode", oracle("i:o_orderkey s:signature s:rules s:reweighted s:daily_kind i:daily_window", """
SELECT o_orderkey, CASE WHEN a < b THEN a || ';' || b WHEN a = b THEN a ELSE b || ';' || a END AS signature,
 a || ' >= 0.5 direction 1 weight 2 ; ' || b || ' between 1 and 2 direction -1 weight 3' AS rules, a || '|threshold|0.5|1|3' AS reweighted, 'zscore' AS daily_kind, w AS daily_window
FROM (SELECT o_orderkey, 'f' || o_orderstatus AS a, 'f' || substring(o_orderpriority, 3, 1) AS b, o_orderkey % 252 AS w FROM orders)"""))
def spec_encode(spark, d):
    o = I.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("f"), "o_orderstatus").alias("a"), F.concat(F.lit("f"), F.substring("o_orderpriority", 3, 1)).alias("b"), (F.col("o_orderkey") % 252).alias("w"))
    s1, s2 = F.concat("a", F.lit("|threshold|0.5|1|2")), F.concat("b", F.lit("|range|1|2|-1|3"))
    x = o.withColumns({"specs": F.array(s1, s2), "spec": SP.daily_text("a", F.lit("zscore"), F.lit(0.5), "w", F.lit(1))})
    x = SP.parse_daily(x)
    return x.select("o_orderkey", SP.signature(F.col("specs")).alias("signature"), SP.rules_text(F.col("specs")).alias("rules"),
                    SP.with_weight(F.get("specs", F.lit(0)), F.lit(3)).alias("reweighted"), F.col("kind").alias("daily_kind"), F.col("window").alias("daily_window"))
