"""Validation of bars, return series and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR_COLUMNS = ("open", "high", "low", "close", "volume")

# Limits per frequency: (minimum periods, minimum active periods) - fixed values.
PERIOD_LIMITS = {"daily": (504, 100), "weekly": (156, 40), "monthly": (60, 18)}
PERIODS_PER_YEAR = {"daily": 252, "weekly": 52, "monthly": 12}
RETURN_COLUMNS = (
    "candidate_id",
    "run_id",
    "source_method",
    "timestamp",
    "frequency",
    "strategy_return",
    "returns_are_net",
    "sample_role",
)


def require_columns(df: DataFrame, required, allowed=None, forbidden_tokens=()) -> DataFrame:
    """Raise on missing, unsupported or forbidden column names (driver-side schema check)."""
    have = [c.lower() for c in df.columns]
    missing = sorted(set(required) - set(have))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    bad = sorted(c for c in have if any(t in c for t in forbidden_tokens))
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    if allowed is not None and set(have) - set(allowed):
        raise ValueError(f"unsupported columns: {sorted(set(have) - set(allowed))}")
    return df


def numeric_columns(df: DataFrame, exclude=BAR_COLUMNS) -> list[str]:
    """Numeric columns that are not part of the bar contract."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    out = [f.name for f in df.schema.fields if f.dataType.simpleString() in numeric and f.name not in exclude]
    if not out:
        raise ValueError("no feature columns found")
    return out


def split_columns(df: DataFrame, keys=("ts",)) -> tuple[list[str], list[str]]:
    """Price columns and feature columns of a wide panel."""
    price = [c for c in df.columns if c in (*BAR_COLUMNS, "adj_close")]
    return price, [c for c in numeric_columns(df, (*price, *keys))]


def bar_reason(dup: Column | None = None) -> Column:
    """First violated rule of a bar row, NULL when the row is valid."""
    c = F.when(F.col("ts").isNull(), "bad_timestamp")
    if dup is not None:
        c = c.when(dup, "duplicate_timestamp")
    missing = F.lit(False)
    for k in BAR_COLUMNS:
        missing = missing | F.col(k).isNull() | F.isnan(k)
    c = c.when(missing, "not_numeric")
    bad = F.lit(False)
    for k in ("open", "high", "low", "close"):
        bad = bad | (F.col(k) <= 0)
    return c.when(bad, "price_not_positive").when(F.col("volume") < 0, "volume_negative")


def quarantine(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """Add ``reason`` per row. Repeated timestamps come from a pre-aggregated count, so a timestamp
    copied many times never gathers in one task."""
    dup = bars.groupBy(*by, "ts").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_dup", F.lit(True)).drop("_n")
    marked = bars.join(dup, [*by, "ts"], "left")
    return marked.withColumn("reason", bar_reason(F.col("_dup").isNotNull())).drop("_dup")


def validate(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """Violation counts in two map-side aggregations."""
    keys = bars.groupBy(*by, "ts").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bar_reason() == "not_numeric").alias("nn"),
        F.count_if(bar_reason() == "price_not_positive").alias("pp"),
        F.count_if(bar_reason() == "volume_negative").alias("vv"),
    )
    return keys.agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("ts").isNull(), F.col("n")).otherwise(0)).alias("bad_timestamp"),
        F.sum(F.when(F.col("ts").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("duplicate_timestamp"),
        F.sum("nn").alias("not_numeric"),
        F.sum("pp").alias("price_not_positive"),
        F.sum("vv").alias("volume_negative"),
    )


def checked(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """Strict contract: raise inside the job on the first invalid row, otherwise pass rows through."""
    q = quarantine(bars, by)
    ok = F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("invalid bar: "), F.col("reason"))))
    return q.where(ok).drop("reason")


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the last by ``order`` (hash aggregation; a hot key combines map-side)."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def adjust(bars: DataFrame, order, by=("symbol",)) -> DataFrame:
    """Keep the last duplicate, drop incomplete rows, scale prices by adj_close / close."""
    x = keep_last(bars, [*by, "ts"], order).dropna(subset=["open", "high", "low", "close", "adj_close"])
    ratio = F.col("adj_close") / F.nullif(F.col("close"), F.lit(0.0))
    prices = {k: F.col(k) * ratio for k in ("open", "high", "low", "close")}
    out = x.select(*by, "ts", *[c.alias(k) for k, c in prices.items()], F.coalesce("volume", F.lit(0.0)).alias("volume"))
    return out.dropna(subset=["open", "high", "low", "close"])


def returns_quality(r: DataFrame, max_contribution: float = 0.40) -> DataFrame:
    """Per-candidate checks of a return table: reasons, warnings and the measured values.

    ``seq`` is the arrival order; a series is unsorted when a later row has an earlier timestamp.
    """
    freq = F.lower("frequency")
    v = F.when(~F.isnan("strategy_return") & (F.abs("strategy_return") != float("inf")), F.col("strategy_return"))
    from pyspark.sql import Window

    prev = F.lag("timestamp").over(Window.partitionBy("candidate_id").orderBy("seq"))
    x = r.withColumns({"_f": freq, "_v": v, "_back": F.col("timestamp") < prev})
    dup = r.groupBy("candidate_id", "timestamp").agg(F.count(F.lit(1)).alias("n")).groupBy("candidate_id").agg(
        F.max("n").alias("max_copies")
    )
    ret = F.col("strategy_return")
    g = x.groupBy("candidate_id").agg(
        F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col("seq"))).alias("frequency"),
        F.count("_v").alias("rows"),
        F.count_if(F.col("timestamp").isNull()).alias("bad_ts"),
        F.count_if(F.col("_back")).alias("back"),
        F.count_if(ret.isNull() | F.isnan(ret)).alias("nan_ret"),
        F.count_if(F.col("_v").isNull()).alias("not_finite"),
        F.count_if(ret < -1.0).alias("below"),
        F.count_if(F.abs("_v") > 1e-12).alias("active"),
        F.stddev_samp("_v").alias("std"),
        F.max("_v").alias("mx"),
        F.min("_v").alias("mn"),
        F.sum(F.when(F.col("_v") > 0, F.col("_v"))).alias("pos"),
    ).join(dup, "candidate_id")
    share = F.when(F.col("pos") > 0, F.greatest(F.col("mx"), F.lit(0.0)) / F.col("pos")).otherwise(0.0)
    need = F.create_map(*[k for p in PERIOD_LIMITS.items() for k in (F.lit(p[0]), F.lit(p[1][0]))])
    act = F.create_map(*[k for p in PERIOD_LIMITS.items() for k in (F.lit(p[0]), F.lit(p[1][1]))])
    g = g.withColumns({"contribution": share, "need": need[F.col("frequency")], "need_active": act[F.col("frequency")]})
    known = F.col("need").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("bad_ts") > 0, F.lit("invalid_timestamp")),
        F.when(F.col("max_copies") > 1, F.lit("duplicate_timestamp")),
        F.when(F.col("back") > 0, F.lit("timestamp_not_sorted")),
        F.when(~known, F.concat(F.lit("unknown_frequency:"), "frequency")),
        F.when(F.col("nan_ret") > 0, F.lit("nan_return")),
        F.when(F.col("not_finite") > 0, F.lit("infinite_return")),
        F.when(F.col("below") > 0, F.lit("return_below_minus_100pct")),
        F.when(known & (F.col("rows") < F.col("need")), F.concat(F.lit("too_few_periods:"), F.col("rows").cast("string"), F.lit("<"), F.col("need").cast("string"))),
        F.when(known & (F.col("active") < F.col("need_active")), F.concat(F.lit("too_few_active_periods:"), F.col("active").cast("string"), F.lit("<"), F.col("need_active").cast("string"))),
        F.when((F.col("rows") > 1) & (F.col("std") <= 1e-12), F.lit("zero_return_std")),
        F.when(F.col("contribution") > max_contribution, F.concat(F.lit("single_period_profit_concentration:"), F.format_string("%.6f", F.col("contribution")), F.lit(f">{max_contribution:.6f}"))),
    ))
    return g.select(
        "candidate_id",
        "frequency",
        "rows",
        F.col("active").alias("active_periods"),
        "std",
        F.col("contribution").alias("max_single_period_profit_contribution"),
        (F.size(reasons) == 0).alias("data_quality_pass"),
        F.array_join(reasons, ";").alias("fail_reasons"),
        F.when((F.col("rows") > 0) & (F.col("mn") > 0), "all_returns_positive").otherwise("").alias("warnings"),
    )


def melt(df: DataFrame, keys, columns, name="feature", value="value") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keys, F.inline(pairs))


def coverage(long: DataFrame, name: str = "asset", ts: str = "ts") -> DataFrame:
    """First and last non-null date of each series."""
    d = F.when(F.col("value").isNotNull(), F.col(ts))
    return long.groupBy(name).agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.count("value").alias("n"))


def usable_features(long: DataFrame, min_count, min_distinct: int, min_share: float = 0.0) -> DataFrame:
    """Features with enough training observations: max(min_count, share of rows) values, min_distinct distinct."""
    g = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.count_distinct("value").alias("u")
    )
    need = F.greatest(F.lit(min_count).cast("bigint"), F.floor(F.col("rows") * min_share))
    return g.withColumn("usable", (F.col("n") >= need) & (F.col("u") >= min_distinct))


def feature_quality(non_null, first_year, free: Column, note: Column, source: Column, ideal: int) -> Column:
    none = F.when(
        source.contains("no free public series") | note.contains("pago") | note.contains("no gratis fiable"),
        "sin_datos_publicos_fiables",
    ).otherwise("sin_datos")
    return (
        F.when(non_null == 0, none)
        .when(free.contains("proxy") | note.contains("proxy"), "proxy")
        .when(free.contains("no") | (first_year > ideal), "parcial")
        .otherwise("buena")
    )


def nonempty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
