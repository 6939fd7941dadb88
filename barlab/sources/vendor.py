"""Vendor payloads turned into bars and observation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE_SCHEMA = (
    "timestamp array<bigint>, indicators struct<quote array<struct<open array<double>, high array<double>, "
    "low array<double>, close array<double>, volume array<double>>>, adjclose array<struct<adjclose array<double>>>>"
)


def bars_from_quotes(payloads: DataFrame, payload: str = "payload", keys=("symbol",)) -> DataFrame:
    """Chart payloads (parallel arrays) to adjusted bars; incomplete rows are dropped."""
    p = payloads.select(*keys, F.from_json(payload, QUOTE_SCHEMA).alias("p"))
    q, adj = F.col("p.indicators.quote")[0], F.col("p.indicators.adjclose")[0]["adjclose"]
    zipped = F.arrays_zip(
        F.col("p.timestamp").alias("t"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"),
        q["close"].alias("close"), q["volume"].alias("volume"), adj.alias("adjclose"),
    )
    rows = p.select(*keys, F.inline(zipped)).dropna(subset=["open", "high", "low", "close", "adjclose"])
    k = F.col("adjclose") / F.nullif(F.col("close"), F.lit(0.0))
    return rows.select(
        *keys,
        F.to_date(F.timestamp_seconds("t")).alias("ts"),
        (F.col("open") * k).alias("open"),
        (F.col("high") * k).alias("high"),
        (F.col("low") * k).alias("low"),
        F.col("adjclose").alias("close"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
    )


def bars_from_vendor_csv(df: DataFrame) -> DataFrame:
    """Case-insensitive vendor headers to the bar contract, dates as text."""
    names = {c.strip().lower(): c for c in df.columns}
    date = names.get("date") or names.get("timestamp")
    missing = [c for c in ("open", "high", "low", "close") if c not in names]
    if date is None or missing:
        raise ValueError(f"vendor table lacks columns: {missing or ['date']}")
    volume = F.col(f"`{names['volume']}`").cast("double") if "volume" in names else F.lit(0.0)
    keep = [F.col(f"`{names['symbol']}`").alias("symbol")] if "symbol" in names else []
    return df.select(
        *keep,
        F.date_format(F.col(f"`{date}`"), "yyyy-MM-dd").alias("timestamp"),
        *[F.col(f"`{names[c]}`").cast("double").alias(c) for c in ("open", "high", "low", "close")],
        volume.alias("volume"),
    )


def ratio_csv(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) of ratio files with a preamble to (file, ts, ratio, call, put, total).

    The header is the first line that names a date and a put/call ratio; columns are found by name.
    """
    is_head = F.col("line").rlike("(?i)(date|trade_date)") & F.col("line").rlike("(?i)p[/_]?c")
    head = (
        lines.where(is_head)
        .groupBy("file")
        .agg(F.min_by(F.struct("line_no", "line"), "line_no").alias("h"))
        .select("file", F.col("h.line_no").alias("head_no"),
                F.transform(F.split("h.line", ","), lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ /]", "_")).alias("names"))
    )
    pos = lambda test: F.array_position(F.transform("names", test), True)
    head = head.select(
        "file", "head_no",
        pos(lambda c: c.contains("date")).alias("i_date"),
        pos(lambda c: c.contains("p_c")).alias("i_ratio"),
        pos(lambda c: c.contains("call")).alias("i_call"),
        pos(lambda c: c.contains("put")).alias("i_put"),
        pos(lambda c: c.contains("total")).alias("i_total"),
    )
    body = lines.join(head, "file").where(F.col("line_no") > F.col("head_no")).withColumn("v", F.split("line", ","))

    def cell(i: str) -> Column:
        return F.when(F.col(i) > 0, F.try_element_at("v", F.col(i).cast("int")))

    out = body.select(
        "file",
        F.try_to_date(F.trim(cell("i_date")), "MM/dd/yyyy").alias("ts"),
        *[F.trim(cell(f"i_{c}")).try_cast("double").alias(c) for c in ("ratio", "call", "put", "total")],
    )
    return out.dropna(how="all", subset=["ratio", "call", "put", "total"])


def date_from_parts(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.try_make_date("year", "month", "day").alias("ts"), F.col(value)) if hasattr(F, "try_make_date") else df.select(
        F.make_date("year", "month", "day").alias("ts"), F.col(value)
    )


def series_values(df: DataFrame, value: str) -> DataFrame:
    """Text observations with '.' for missing: numeric, missing rows dropped."""
    v = F.nullif(F.trim(F.col(value)), F.lit(".")).try_cast("double")
    return df.withColumn(value, v).where(F.col(value).isNotNull())


def valuation(df: DataFrame) -> DataFrame:
    """Price, earnings and dividend columns to yields; rows with nothing known are dropped."""
    p, e, d = F.col("sp500"), F.col("earnings"), F.col("dividend")
    nz = lambda x: F.nullif(x, F.lit(0.0))
    out = df.select(
        "ts",
        F.col("cape").alias("cape"),
        (e / nz(p)).alias("earnings_yield"),
        (p / nz(e)).alias("pe_ttm"),
        e.alias("eps_ttm"),
        (d / nz(p)).alias("dividend_yield"),
    )
    return out.dropna(how="all", subset=["cape", "earnings_yield", "pe_ttm", "eps_ttm", "dividend_yield"])
