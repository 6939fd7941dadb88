"""Calendar resampling and decision examples: what was known at t, and the return realised after t."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import rolling as R

# Years of party control, inclusive (fixed values).
REPUBLICAN_PRESIDENT = ((1981, 1992), (2001, 2008), (2017, 2020), (2025, 2028))
REPUBLICAN_HOUSE = ((1995, 2006), (2011, 2018), (2023, 2026))
REPUBLICAN_SENATE = ((1981, 1986), (1995, 2001), (2003, 2006), (2015, 2020), (2025, 2026))


def week_end(ts) -> Column:
    """Friday on or after the date."""
    return F.next_day(F.date_sub(ts, 1), "FRI")


def month_end(ts) -> Column:
    return F.last_day(ts)


def year_end(ts) -> Column:
    return F.make_date(F.year(ts), F.lit(12), F.lit(31))


def resample_last(df: DataFrame, label: Column, values, by=("symbol",), name: str = "period_end") -> DataFrame:
    """Last non-null value of each column per bucket (partial aggregation, no sort of the input)."""
    return df.groupBy(*by, label.alias(name)).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ts"))).alias(v) for v in values]
    )


def political(df: DataFrame, year: str = "target_year") -> DataFrame:
    y = F.col(year)

    def party(ranges) -> Column:
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | y.between(lo, hi)
        return F.when(hit, 1.0).otherwise(-1.0)

    cyc = F.pmod(y - 1981, F.lit(4)) + 1
    p, h, s = party(REPUBLICAN_PRESIDENT), party(REPUBLICAN_HOUSE), party(REPUBLICAN_SENATE)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return df.withColumns(
        {
            "presidential_cycle_year": cyc.cast("double"),
            "is_election_year": one(cyc == 4),
            "is_post_election_year": one(cyc == 1),
            "midterm_year_dummy": one(cyc == 2),
            "election_year_dummy": one(cyc == 4),
            "president_party": p,
            "house_control_party": h,
            "senate_control_party": s,
            "split_congress": one(h != s),
            "unified_government": one((h == s) & (s == p)),
        }
    )


def period_label(target: Column, train_end, validation_end) -> Column:
    return (
        F.when(target <= F.lit(train_end).cast("date"), "train")
        .when(target <= F.lit(validation_end).cast("date"), "validation")
        .otherwise("locked")
    )


def without_locked(df: DataFrame, target: str, locked_start) -> DataFrame:
    return df.where(F.col(target) < F.lit(locked_start).cast("date"))


def decision_examples(features: DataFrame, label: Column, columns, by=("symbol",)) -> DataFrame:
    """One row per period: last close and features inside it, plus the next period's end and return.

    ``features`` holds ts, close and feature columns; the feature row is the last trading row of the
    period, whole, so a feature that is NULL there stays NULL.
    """
    last = F.max_by(F.struct("close", *columns), "ts").alias("last")
    per = features.where("close IS NOT NULL").groupBy(*by, label.alias("decision_date")).agg(last)
    per = per.select(*by, "decision_date", "last.*")
    nxt = {
        "target_end": R.lead("decision_date", 1, by, "decision_date"),
        "next_return": R.ratio(R.lead("close", 1, by, "decision_date"), "close") - 1.0,
    }
    return per.withColumns(nxt).where("target_end IS NOT NULL AND close > 0")


def target_parts(df: DataFrame, target: str = "target_end") -> DataFrame:
    t = F.col(target)
    return df.withColumns(
        {
            "target_year": F.year(t),
            "target_month": F.month(t),
            "target_week": F.weekofyear(t),
            "month_number": F.month(t).cast("double"),
            "quarter_number": F.quarter(t).cast("double"),
            "calendar_week": F.weekofyear(t).cast("double"),
        }
    )


def spine(buckets: DataFrame, step: str, name: str = "period_end", by=("symbol",)) -> DataFrame:
    """Every calendar bucket between a series' first and last, empty ones with NULL values."""
    span = buckets.groupBy(*by).agg(F.min(name).alias("_a"), F.max(name).alias("_b"))
    if step == "week":
        days = F.sequence("_a", "_b", F.expr("interval 7 days"))
    else:
        starts = F.sequence(F.trunc("_a", "month"), F.trunc("_b", "month"), F.expr("interval 1 month"))
        days = F.transform(starts, lambda d: F.last_day(d))
    full = span.select(*by, F.explode(days).alias(name))
    return full.join(buckets, [*by, name], "left")


def asset_momentum(closes: DataFrame, horizons, vol_rows: int, per_year: float, by=("symbol",)) -> DataFrame:
    """Next-period return, momentum and volatility over calendar buckets (empty buckets included)."""
    o = "period_end"
    staged = closes.withColumn("_r", R.pct_change("close", 1, by, o))
    out = {"next_return": R.ratio(R.lead("close", 1, by, o), "close") - 1.0}
    out |= {f"mom_{n}": R.pct_change("close", n, by, o) for n in horizons}
    out["vol"] = R.std("_r", vol_rows, ddof=1, by=by, order=o) * math.sqrt(per_year)
    return staged.withColumns(out).drop("_r")


def annual_examples(features: DataFrame, columns, by=("symbol",)) -> DataFrame:
    """Features at the last bar of a year, target = return of the following calendar year's last close."""
    last = F.max_by(F.struct("ts", "close", *columns), "ts").alias("last")
    per = features.groupBy(*by, F.year("ts").alias("year")).agg(last)
    per = per.select(*by, "year", F.col("last.ts").alias("decision_date"), "last.close", *[f"last.{c}" for c in columns])
    nxt = R.ratio(R.lead("close", 1, by, "year"), "close") - 1.0
    out = per.withColumns({"next_year": R.lead("year", 1, by, "year"), "return_next_year": nxt})
    return (
        out.where("next_year = year + 1")
        .withColumn("target_year", F.col("next_year"))
        .withColumn("target_positive", F.col("return_next_year") > 0)
        .drop("next_year", "year")
    )


def calendar_cycle(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """Per series and target year: January, first-days, turn-of-year and streak features of the year before."""
    yr = F.year("ts").alias("year")
    asc = F.row_number().over(Window.partitionBy(*by, "year").orderBy("ts"))
    desc = F.row_number().over(Window.partitionBy(*by, "year").orderBy(F.col("ts").desc()))
    x = bars.select(*by, "ts", "close", yr).withColumns({"_a": asc, "_d": desc})
    jan, first5 = F.month("ts") == 1, F.col("_a") <= 5

    def span(cond):
        t = F.when(cond, F.col("ts"))
        move = R.ratio(F.max_by("close", t), F.min_by("close", t)) - 1.0
        return F.when(F.count(t) >= 2, move)

    y = x.groupBy(*by, "year").agg(
        span(jan).alias("january_return"),
        span(first5).alias("first_5_days_return"),
        span(F.lit(True)).alias("_yr"),
        F.min_by("close", F.when(F.col("_d") <= 5, F.col("ts"))).alias("_tail5"),
        F.max_by("close", F.when(F.col("_a") <= 2, F.col("ts"))).alias("_head2"),
    )
    o = "year"
    prev_year = R.lag("year", 1, by, o)
    y = y.withColumns(
        {
            "santa_rally_return": F.when(prev_year == F.col("year") - 1, R.ratio("_head2", R.lag("_tail5", 1, by, o)) - 1.0),
            "_break": F.when(F.coalesce(F.col("_yr"), F.lit(-1.0)) > 0, 0).otherwise(1),
        }
    )
    island = F.sum("_break").over(R.running(by, o))
    y = y.withColumn("_isl", island)
    streak = F.sum(1 - F.col("_break")).over(
        Window.partitionBy(*by, "_isl").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    )
    return y.select(
        *by,
        (F.col("year") + 1).alias("target_year"),
        F.lit(12.0).alias("month_number"),
        F.lit(4.0).alias("quarter_number"),
        "january_return",
        "first_5_days_return",
        "santa_rally_return",
        F.when(F.col("_yr") < 0, 1.0).otherwise(0.0).alias("year_after_negative_year"),
        streak.cast("double").alias("consecutive_positive_years"),
    )


def annual_derived(examples: DataFrame, columns, by=("symbol",)) -> DataFrame:
    """Yearly changes and expanding percentile of each usable feature, in long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = examples.select(*by, "target_year", F.inline(pairs))
    usable = (
        long.groupBy(*by, "feature")
        .agg(F.count("value").alias("n"), F.count_distinct("value").alias("u"))
        .where("n >= 4 AND u >= 3")
        .select(*by, "feature")
    )
    key = (*by, "feature")
    o = "target_year"
    return long.join(usable, list(key), "left_semi").withColumns(
        {
            "annual_change_1y": R.diff("value", 1, key, o),
            "annual_change_3y": R.diff("value", 3, key, o),
            "annual_percentile": R.expanding_percentile("value", 20, key, o),
        }
    )


def pad_columns(df: DataFrame, names) -> DataFrame:
    """Add missing manifest columns as NULL doubles."""
    missing = {c: F.lit(None).cast("double") for c in names if c not in df.columns}
    return df.withColumns(missing) if missing else df


def horizon_return(next_return: str, h: int, by=("symbol",)) -> Column:
    """Compounded return over the next ``h`` rows; NULL where fewer remain."""
    w = R.ordered(by).rowsBetween(0, h - 1)
    return F.when(F.count(next_return).over(w) == h, F.product(1.0 + F.col(next_return)).over(w) - 1.0)


def target_shift(df: DataFrame, x: str, target: str, by=("symbol",)) -> DataFrame:
    """Shift a return so that zero separates the classes of the chosen target."""
    level = {"direction": None, "strong_return": 0.60, "avoid_drawdown": 0.30}[target]
    if level is None:
        return df.withColumn("target", F.col(x))
    cut = df.groupBy(*by).agg(F.percentile(x, level).alias("_cut"))
    return df.join(cut, list(by)).withColumn("target", F.col(x) - F.col("_cut")).drop("_cut")


def blocks(df: DataFrame, k: int, by=("symbol",), order="ts", name: str = "block") -> DataFrame:
    """Split each series into k contiguous blocks; leading blocks take the remainder rows."""
    return df.withColumn(name, F.ntile(k).over(R.ordered(by, order)))
