"""Rule specs: catalogs from training quantiles, text forms, parameter grids, identities.

Text dialects
  daily   feature|kind|value|window|direction            kind is threshold or zscore
  annual  feature|threshold|v|dir[|w], feature|range|lo|hi|dir[|w]
  period  feature|threshold|v|dir|w,   feature|range|lo|hi|dir|w      (weekly and monthly)
Numbers are written with eight decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKLY_QUANTILES = (0.15, 0.25, 0.35, 0.5, 0.65, 0.75, 0.85)
MONTHLY_QUANTILES = (0.2, 0.35, 0.5, 0.65, 0.8)
ANNUAL_QUANTILES = (0.25, 0.5, 0.75)
ANNUAL_RANGES = ((0.20, 0.80), (0.25, 0.75), (0.33, 0.67))
DAILY_QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def num(x: Column) -> Column:
    return F.format_string("%.8f", x + F.lit(0.0))


def _ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def threshold_specs(long: DataFrame, quantiles, weights, directions=(-1, 1)) -> DataFrame:
    """One row per feature, quantile, direction and weight; one exact percentile pass over the features."""
    q = long.groupBy("feature").agg(F.percentile("value", F.array(*[F.lit(float(v)) for v in quantiles])).alias("qs"))
    x = q.select("feature", F.posexplode("qs").alias("qi", "lo")).where("lo IS NOT NULL")
    x = x.withColumn("direction", F.explode(_ints(directions))).withColumn("weight", F.explode(_ints(weights)))
    spec = F.concat_ws("|", "feature", F.lit("threshold"), num(F.col("lo")), F.col("direction").cast("string"), F.col("weight").cast("string"))
    return x.select("feature", F.lit("threshold").alias("kind"), "qi", "lo", F.lit(None).cast("double").alias("hi"), "direction", "weight", spec.alias("spec"))


def range_specs(long: DataFrame, ranges, weights=(1,), directions=(-1, 1)) -> DataFrame:
    cols = [F.percentile("value", F.array(F.lit(a), F.lit(b))).alias(f"r{i}") for i, (a, b) in enumerate(ranges)]
    q = long.groupBy("feature").agg(*cols)
    x = q.select("feature", F.posexplode(F.array(*[f"r{i}" for i in range(len(ranges))])).alias("qi", "r"))
    x = x.select("feature", "qi", F.col("r")[0].alias("lo"), F.col("r")[1].alias("hi")).where("lo < hi")
    x = x.withColumn("direction", F.explode(_ints(directions))).withColumn("weight", F.explode(_ints(weights)))
    spec = F.concat_ws("|", "feature", F.lit("range"), num(F.col("lo")), num(F.col("hi")), F.col("direction").cast("string"), F.col("weight").cast("string"))
    return x.select("feature", F.lit("range").alias("kind"), "qi", "lo", "hi", "direction", "weight", spec.alias("spec"))


def _distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["spec"])


def weekly_catalog(long: DataFrame) -> DataFrame:
    return _distinct(threshold_specs(long, WEEKLY_QUANTILES, (1, 2, 3)), range_specs(long, ((0.20, 0.80),)))


def monthly_catalog(long: DataFrame) -> DataFrame:
    return _distinct(threshold_specs(long, MONTHLY_QUANTILES, (1, 2)), range_specs(long, ((0.25, 0.75),)))


def annual_catalog(long: DataFrame, exclude=()) -> DataFrame:
    """Quantile thresholds both ways, double weight at the median, three ranges; weight one is not written."""
    x = long
    for term in exclude:
        x = x.where(~F.lower("feature").contains(term.lower()))
    short = F.regexp_replace("spec", r"\|1$", "")
    t1 = threshold_specs(x, ANNUAL_QUANTILES, (1,)).withColumn("spec", short)
    t2 = threshold_specs(x, (0.5,), (2,))
    r1 = range_specs(x, ANNUAL_RANGES).withColumn("spec", short)
    r2 = range_specs(x, ((0.25, 0.75),), (2,), (1,))
    return _distinct(t1, t2, r1, r2)


def daily_catalog(long: DataFrame, quantiles=DAILY_QUANTILES, windows=(20, 60, 120, 252), levels=(-1.0, -0.5, 0.0, 0.5, 1.0)) -> DataFrame:
    """Quantile thresholds, zero where the quantiles straddle it, and z-score levels per window."""
    q = long.groupBy("feature").agg(F.percentile("value", F.array(*[F.lit(float(v)) for v in quantiles])).alias("qs"))
    zero = F.when((F.array_min("qs") < 0) & (F.array_max("qs") > 0), F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    t = q.select("feature", F.lit("threshold").alias("kind"), F.explode(F.array_union("qs", zero)).alias("value"), F.lit(0).alias("window"))
    z = q.select("feature", F.lit("zscore").alias("kind"), F.explode(F.array(*[F.lit(v) for v in levels])).alias("value"))
    z = z.withColumn("window", F.explode(_ints(windows)))
    x = t.unionByName(z).withColumn("direction", F.explode(_ints((-1, 1))))
    return x.withColumn("spec", daily_text("feature", "kind", "value", "window", "direction")).dropDuplicates(["spec"])


def daily_text(feature, kind, value, window, direction) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    clean = F.replace(c(feature), F.lit("|"), F.lit("_"))
    return F.concat_ws("|", clean, c(kind), num(c(value)), c(window).cast("string"), c(direction).cast("string"))


def parse_daily(df: DataFrame, spec: str = "spec") -> DataFrame:
    p = F.split(spec, r"\|")
    return df.withColumns(
        {
            "feature": p[0], "kind": p[1], "value": p[2].cast("double"),
            "window": p[3].cast("double").cast("int"), "direction": p[4].cast("double").cast("int"),
        }
    )


def parse_period(df: DataFrame, spec: str = "spec", default_weight: bool = False) -> DataFrame:
    """Annual (optional weight) and weekly/monthly texts to typed columns."""
    p = F.split(spec, r"\|")
    is_range = p[1] == "range"
    at = lambda i: F.get(p, F.lit(i)).try_cast("double")
    weight = F.when(is_range, at(5)).otherwise(at(4))
    return df.withColumns(
        {
            "feature": p[0],
            "kind": p[1],
            "lo": at(2),
            "hi": F.when(is_range, at(3)),
            "direction": F.when(is_range, at(4)).otherwise(at(3)).cast("int"),
            "weight": (F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1.0)) if default_weight else weight).cast("int"),
        }
    )


def signature(specs: Column, limit: int = 4) -> Column:
    """Sorted distinct feature names of a spec list, the first four."""
    names = F.array_sort(F.array_distinct(F.transform(specs, lambda s: F.substring_index(s, "|", 1))))
    return F.array_join(F.slice(names, 1, limit), ";")


def feature_names(specs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(specs, lambda s: F.substring_index(s, "|", 1))))


def rules_text(specs: Column) -> Column:
    def one(s):
        p = F.split(s, r"\|")
        tail = F.concat(F.lit(" direction "), F.element_at(p, -2), F.lit(" weight "), F.element_at(p, -1))
        rng = F.concat(p[0], F.lit(" between "), p[2], F.lit(" and "), F.get(p, F.lit(3)), tail)
        return F.when(p[1] == "range", rng).otherwise(F.concat(p[0], F.lit(" >= "), p[2], tail))

    return F.array_join(F.transform(specs, one), " ; ")


def with_weight(spec: Column, weight: Column) -> Column:
    """Replace or append the weight field of a threshold or range text."""
    p = F.split(spec, r"\|")
    base = F.when(p[1] == "range", 5).otherwise(4)
    return F.concat_ws("|", F.slice(p, F.lit(1), base), weight.cast("string"))


def inverse(spec: Column) -> Column:
    return F.regexp_replace(spec, r"[^|]+$", "-1")


def param_grid(seed: DataFrame, parameters: dict[str, Column]) -> DataFrame:
    """All combinations of parameter lists by chained explodes (no join)."""
    out = seed
    for name, values in parameters.items():
        out = out.withColumn(name, F.explode(values))
    return out


def floats(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ints(values) -> Column:
    return _ints(values)


# Parameter names per rule and what makes a combination valid (fixed values).
RULE_PARAMETERS = {
    "ma_crossover": ("fast_window", "slow_window"),
    "momentum_threshold": ("momentum_window", "threshold"),
    "mean_reversion": ("reversion_window", "entry_zscore", "exit_zscore"),
    "rsi_reversion": ("rsi_window", "rsi_buy", "rsi_sell"),
    "breakout": ("breakout_window", "exit_window"),
    "volatility_momentum": ("momentum_window", "volatility_window", "volatility_quantile"),
    "linear_score": ("fast_return_window", "slow_return_window", "risk_window", "score_threshold"),
    "feature_threshold": ("feature_name", "feature_threshold"),
    "feature_zscore": ("feature_name", "feature_z_window", "feature_z_threshold"),
}
RULE_VALID = {
    "ma_crossover": "fast_window < slow_window",
    "mean_reversion": "entry_zscore > exit_zscore",
    "rsi_reversion": "rsi_buy < rsi_sell",
    "breakout": "exit_window <= breakout_window",
    "linear_score": "fast_return_window < slow_return_window",
}


def rule_grid(seed: DataFrame, space: dict[str, Column]) -> DataFrame:
    """Union of the per-rule grids; every rule uses only its own parameters and drops invalid rows."""
    parts = []
    for rule, names in RULE_PARAMETERS.items():
        use = [n for n in names if n in space]
        if not use:
            continue
        g = param_grid(seed.withColumn("rule", F.lit(rule)), {n: space[n] for n in use})
        if rule in RULE_VALID:
            g = g.where(RULE_VALID[rule])
        parts.append(g)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def params_text(df: DataFrame, names) -> Column:
    """Readable identity: sorted name-value pairs, cleaned; long ones become rule plus digest."""
    items = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}-"), F.col(n).cast("string"))) for n in sorted(names)]
    raw = F.concat_ws("_", *items)
    clean = F.translate(F.replace(raw, F.lit("."), F.lit("p")), "-|;", "___")
    return F.when(F.length(clean) <= 180, clean).otherwise(F.concat(F.col("rule"), F.lit("_"), F.substring(F.sha1(clean), 1, 16)))


def digest_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16))


def universes(available: Column, groups) -> Column:
    """Preset asset groups cut to what is available, then single assets, without repeats."""
    cut = [F.filter(F.array(*[F.lit(a) for a in g]), lambda a: F.array_contains(available, a)) for g in groups]
    singles = F.transform(available, lambda a: F.array(a))
    return F.array_distinct(F.concat(F.filter(F.array(*cut), lambda g: F.size(g) > 0), singles))


def numbered(df: DataFrame, order, name: str = "index") -> DataFrame:
    """Zero-based global row number without a single-task window.

    Rows are range-partitioned by the whole sort key and checkpointed; each partition numbers its own
    rows, and offsets come from the (partition-count sized) table of partition sizes.
    """
    from barlab.session import checkpoint

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpoint(placed)
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    local = F.col("_id") - F.shiftleft(F.shiftright("_id", 33), 33)
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_off") + local).drop("_id", "_part", "_off")


def stage_shard(df: DataFrame, order, stage: int, total: int) -> DataFrame:
    """Rows whose enumeration index falls into the stage."""
    return numbered(df, order).where(F.pmod("index", F.lit(total)) == stage)
