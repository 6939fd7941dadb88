"""Spec evaluation: distinct specs once, then candidates as sums of spec paths.

A spec's path is the array of its signals over the decision periods, in period order (52 a year for
weekly examples, so bounded by the calendar). Candidates join paths by spec - compact rows instead of
candidates x periods - and expand to positions only after the sum. Explode keeps the partitioning by
candidate, so later windows and groupings on candidate_id need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period_signal(value: Column, kind: Column, lo: Column, hi: Column, direction: Column) -> Column:
    """+1/-1 by value >= lo, or lo <= value <= hi, times the direction."""
    active = F.when(kind == "range", (value >= lo) & (value <= hi)).otherwise(value >= lo)
    return F.when(active, 1.0).otherwise(-1.0) * direction


def annual_vote(value: Column, kind: Column, lo: Column, hi: Column, direction: Column) -> Column:
    """1 when the strict threshold holds, or the range (or, reversed, its complement) does.

    A reversed range counts unknown values as a vote; every other unknown is no vote.
    """
    inside = F.coalesce((value >= lo) & (value <= hi), F.lit(False))
    thr = F.coalesce(F.when(direction >= 0, value > lo).otherwise(value < lo), F.lit(False))
    rng = F.when(direction >= 0, inside).otherwise(~inside)
    return F.when(kind == "range", rng).otherwise(thr).cast("double")


def fill_median(long: DataFrame, fit: Column | None = None) -> DataFrame:
    """Missing values take the feature's median over the ``fit`` rows (all rows by default), then zero."""
    v = F.col("value") if fit is None else F.when(fit, F.col("value"))
    med = long.groupBy("feature").agg(F.percentile(v, 0.5).alias("_m"))
    return long.join(F.broadcast(med), "feature").withColumn("value", F.coalesce("value", "_m", F.lit(0.0))).drop("_m")


def spec_paths(long: DataFrame, specs: DataFrame, signal, order: str = "decision_date") -> DataFrame:
    """(spec, weight, path): every distinct spec evaluated on every period."""
    d = specs.select("spec", "feature", "kind", "lo", "hi", "direction", "weight").dropDuplicates(["spec"])
    j = long.join(d, "feature")
    s = signal(F.col("value"), F.col("kind"), F.col("lo"), F.col("hi"), F.col("direction"))
    g = j.select("spec", "weight", order, s.alias("s")).groupBy("spec", "weight").agg(
        F.array_sort(F.collect_list(F.struct(order, "s"))).alias("p")
    )
    return g.select("spec", "weight", F.col("p.s").alias("path"))


def weighted_sum(candidates: DataFrame, paths: DataFrame, keys) -> DataFrame:
    """Candidate rows with ``score`` = sum of weight x path, and the total absolute weight."""
    x = candidates.select("*", F.explode("specs").alias("spec")).join(paths, "spec")
    g = x.groupBy(*keys).agg(
        F.collect_list(F.transform("path", lambda v: v * F.col("weight"))).alias("_p"), F.sum(F.abs("weight")).alias("total_weight")
    )
    first = F.element_at("_p", 1)
    rest = F.slice("_p", F.lit(2), F.size("_p"))
    return g.withColumn("score", F.aggregate(rest, first, lambda a, p: F.zip_with(a, p, lambda x, y: x + y))).drop("_p")


def clip(x: Column, lo=-1.0, hi=1.0) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def smooth(path: Column, alpha: Column) -> Column:
    """Exponential smoothing of an exposure array, clipped; no-op for alpha 0."""
    a = clip(alpha, 0.0, 0.95)

    def step(acc, v):
        prev = F.try_element_at(acc, F.lit(-1))
        return F.array_append(acc, F.when(prev.isNull(), v).otherwise(a * prev + (F.lit(1.0) - a) * v))

    rolled = F.transform(F.aggregate(path, F.array().cast("array<double>"), step), lambda v: clip(v))
    return F.when(a <= 0, path).otherwise(rolled)


def exposures(candidates: DataFrame, paths: DataFrame, keys) -> DataFrame:
    """Array of exposures per candidate: clip(intercept + scale * weighted vote), then smoothing."""
    s = weighted_sum(candidates, paths, keys)
    raw = F.transform("score", lambda v: clip(F.col("intercept") + F.col("scale") * v / F.col("total_weight")))
    return s.withColumn("exposure", smooth(raw, F.col("smoothing"))).drop("score", "total_weight")


def expand(df: DataFrame, periods: Column, path: str, name: str, order: str = "decision_date") -> DataFrame:
    """One row per candidate and period; ``periods`` is the sorted period array."""
    z = F.arrays_zip(periods.alias("d"), F.col(path).alias("v"))
    keep = [c for c in df.columns if c != path]
    return df.select(*keep, F.explode(z).alias("_z")).select(*keep, F.col("_z.d").alias(order), F.col("_z.v").alias(name))
