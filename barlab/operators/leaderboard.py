"""Leaderboard algebra: dedupe, merge, top-k, states, reports.

Deduplication and best-row picks are hash aggregations with map-side combine, so an identity that
repeats in a third of all rows reduces before the shuffle. Rank filters use row_number limits, which
Spark also applies before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per(df: DataFrame, keys, order) -> DataFrame:
    """Row with the greatest order tuple per key."""
    cols = df.columns
    best = F.max_by(F.struct(*cols), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_b")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best).select("_b.*")


def stamp(df: DataFrame, wave: int) -> DataFrame:
    """Method, wave and stage identity of a run."""
    return df.withColumns({"wave": F.lit(wave), "run_stamp": F.concat_ws("/", "method", F.lit(str(wave)), F.col("stage").cast("string"))})


def sort_rows(df: DataFrame, score: str = "score", *ties) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), *(ties or ("candidate_id",)))


def merge(parts, key: str = "candidate_id", score: str = "score", ties=()) -> DataFrame:
    """Union of stages with differing columns, best row per identity."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return best_per(out, [key], [F.col(score), *[-F.col(t) for t in ties]])


def top_per(df: DataFrame, n: int, by, order) -> DataFrame:
    """First n rows per group; the rank limit runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def topk_plus(df: DataFrame, n: int, flag: Column, order) -> DataFrame:
    """The n best rows together with every flagged row."""
    top = df.orderBy(*order).limit(n)
    rest = df.where(flag)
    return top.unionByName(rest).distinct()


def state_merge(states: DataFrame, score: str, n: int = 500, ties=("seq",)) -> DataFrame:
    """Best entry per (method, candidate), then the n best per method."""
    one = best_per(states, ["method", "candidate_id"], [F.coalesce(score, F.lit(float("-inf"))), *[-F.col(t) for t in ties]])
    return top_per(one, n, ["method"], [F.col(score).desc_nulls_last(), F.col("candidate_id")])


def file_accounting(found: DataFrame, expected: DataFrame, by="method") -> DataFrame:
    """Files found against expected per method; absent methods show zero."""
    f = found.groupBy(by).agg(F.count_distinct("source_file").alias("found"))
    return expected.join(f, by, "left").select(by, "expected", F.coalesce("found", F.lit(0)).alias("found"),
                                               (F.coalesce("found", F.lit(0)) < F.col("expected")).alias("incomplete"))


def chunks(df: DataFrame, order, n: int) -> DataFrame:
    """Contiguous chunks of ceil(rows / n) rows."""
    from barlab.operators.specs import numbered

    x = numbered(df, order)
    total = x.agg(F.count(F.lit(1))).head()[0]
    size = max(1, -(-total // n))
    return x.withColumn("chunk", F.floor(F.col("index") / size))


def method_summary(df: DataFrame, score: str, flags=(), values=(), by: str = "method", ident: str = "candidate_id") -> DataFrame:
    best = F.max_by(F.struct(ident, score, *values), F.struct(F.col(score), (-F.col(ident)) if dict(df.dtypes)[ident] != "string" else F.col(ident))).alias("_b")
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(f).alias(f) for f in flags], best)
    return g.select(by, "rows", *flags, F.col(f"_b.{ident}").alias("best_candidate"), F.col(f"_b.{score}").alias("best_score"), *[F.col(f"_b.{v}").alias(f"best_{v}") for v in values])


def efficiency(df: DataFrame, elapsed: str, seen: str, score: str, flag: str, marks=(240, 480, 720), by: str = "method") -> DataFrame:
    """Verified rows per hour of the longest run, minute of the first one, best score by minute marks."""
    hours = F.greatest(F.coalesce(F.max(elapsed), F.lit(0.0)) / 3600.0, F.lit(1e-9))
    out = [
        F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("verified_count"), (F.count_if(flag) / hours).alias("verified_per_hour"),
        F.min(F.when(F.col(flag), F.col(seen))).alias("time_to_first_verified"),
        *[F.max(F.when(F.col(seen) <= k, F.col(score))).alias(f"best_score_{k}m") for k in marks],
    ]
    return df.groupBy(by).agg(*out)


def max_parallel(jobs: DataFrame, by=(), bucket: str = "minute") -> DataFrame:
    """Largest number of jobs running at once; at equal times starts come before ends.

    Two-level running sum: net change per instant, then per time bucket. The bucket table is small
    and gives each bucket its opening level; inside a bucket only its own instants are summed, so no
    task sees the whole event stream; a minute holds at most sixty million distinct instants.
    """
    ev = jobs.select(*by, F.inline(F.array(
        F.struct(F.col("start").alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.col("end").alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e")),
    ))).where("t IS NOT NULL")
    inst = ev.groupBy(*by, "t").agg(F.sum("s").alias("s"), F.sum("e").alias("e")).withColumn("_b", F.date_trunc(bucket, "t"))
    per = inst.groupBy(*by, "_b").agg(F.sum(F.col("s") - F.col("e")).alias("net"))
    open_w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    opening = per.withColumn("open", F.coalesce(F.sum("net").over(open_w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("net")
    j = inst.join(opening, [*by, "_b"])
    before = F.coalesce(F.sum(F.col("s") - F.col("e")).over(Window.partitionBy(*by, "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.col("open") + before + F.col("s")
    return j.withColumn("level", level).groupBy(*by).agg(F.max("level").alias("max_parallel"))


def candidates_evaluated(df: DataFrame, stage: str, count: str, by=()) -> DataFrame:
    """Sum over stages of each stage's largest reported count."""
    per = df.groupBy(*by, stage).agg(F.max(count).alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("candidates_evaluated"), F.count(F.lit(1)).alias("stages"))


def explode_reasons(df: DataFrame, reasons: str = "fail_reasons", ident: str = "candidate_id") -> DataFrame:
    return df.select(ident, F.explode(F.split(reasons, ";")).alias("fail_reason")).where("fail_reason <> ''")
