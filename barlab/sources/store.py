"""Versioned series on parquet.

Data lives under ``data/library=/symbol=/version=``; the manifest is an append-only log of put and
tombstone events, and the state of a version is its last event. Readers resolve versions from the
small manifest first, so the data scan prunes to one partition per series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("library", "symbol", "version")
LOG = "library string, symbol string, version string, seq bigint, n_rows bigint, content_hash string, metadata string, tombstone boolean"


def _next_seq(spark: SparkSession, root: str) -> int:
    log = manifest_log(spark, root)
    return int(log.agg(F.max("seq")).head()[0] or 0) + 1


def manifest_log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{root}/manifest")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def records(spark: SparkSession, root: str) -> DataFrame:
    """Current state of every version, tombstoned ones included."""
    log = manifest_log(spark, root)
    rest = [c for c in log.columns if c not in KEY]
    return log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("s")).select(*KEY, "s.*")


def versions(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root).where("NOT tombstone").drop("tombstone")


def content_hash(series: DataFrame, by=KEY, value: str = "close") -> DataFrame:
    """Order-sensitive digest per series: rows hash per year, years hash into one value.

    Values enter in whole millionths, so the text does not depend on float formatting.
    """
    item = F.struct("ts", F.concat_ws("=", F.date_format("ts", "yyyy-MM-dd"), F.round(F.col(value) * 1000000).cast("bigint").cast("string")).alias("x"))
    chunk = series.groupBy(*by, F.year("ts").alias("year")).agg(F.array_sort(F.collect_list(item)).alias("rows"), F.count(F.lit(1)).alias("n"))
    chunk = chunk.select(*by, "year", "n", F.sha2(F.array_join("rows.x", "|"), 256).alias("h"))
    whole = chunk.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("year", "h"))).alias("hs"), F.sum("n").alias("n_rows"))
    return whole.select(*by, "n_rows", F.sha2(F.concat_ws("/", *by, F.array_join("hs.h", "|")), 256).alias("content_hash"))


def put(series: DataFrame, root: str, metadata: str = "{}", replace: bool = False) -> None:
    """Write rows carrying library, symbol and version. An existing live version is an error unless
    ``replace`` is set; only the partitions present in the input are rewritten."""
    spark = series.sparkSession
    fresh = content_hash(series)
    if not replace:
        clash = fresh.join(versions(spark, root).select(*KEY), list(KEY), "left_semi").limit(1).collect()
        if clash:
            raise ValueError(f"version exists: {clash[0]['library']}/{clash[0]['symbol']}/{clash[0]['version']}")
    seq = _next_seq(spark, root)
    # repartition by the folder key and a slice of time: few files per folder, no single writer per hot series
    (
        series.repartition(*KEY, F.year("ts"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*KEY)
        .parquet(f"{root}/data")
    )
    fresh.select(
        *KEY, F.lit(seq).cast("bigint").alias("seq"), "n_rows", "content_hash", F.lit(metadata).alias("metadata"), F.lit(False).alias("tombstone")
    ).write.mode("append").parquet(f"{root}/manifest")


def tombstone(spark: SparkSession, root: str, library: str, symbol: str, version: str, reason: str) -> None:
    """Soft delete: append an event; the version stays listed but is never read again."""
    hit = versions(spark, root).where(
        (F.col("library") == library) & (F.col("symbol") == symbol) & (F.col("version") == version)
    )
    seq = _next_seq(spark, root)
    event = hit.select(
        *KEY, F.lit(seq).cast("bigint").alias("seq"), "n_rows", "content_hash",
        F.to_json(F.struct(F.lit(reason).alias("tombstone_reason"))).alias("metadata"), F.lit(True).alias("tombstone"),
    )
    event.write.mode("append").parquet(f"{root}/manifest")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """Latest live version per (library, symbol): the greatest version text."""
    return versions(spark, root).groupBy("library", "symbol").agg(F.max("version").alias("version"))


def read_latest(spark: SparkSession, root: str, library: str | None = None, symbol: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of the latest live versions, optionally between two dates inclusive."""
    pick = latest(spark, root)
    # partition values would be type-inferred; the key columns are text
    data = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    data = data.withColumns({k: F.col(k).cast("string") for k in KEY})
    if library is not None:
        pick, data = pick.where(F.col("library") == library), data.where(F.col("library") == library)
    if symbol is not None:
        pick, data = pick.where(F.col("symbol") == symbol), data.where(F.col("symbol") == symbol)
    if start is not None:
        data = data.where(F.col("ts") >= F.lit(start).cast("date"))
    if end is not None:
        data = data.where(F.col("ts") <= F.lit(end).cast("date"))
    return data.join(pick, list(KEY), "left_semi")


def version_order(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("library", "symbol").orderBy(F.col("version").desc())
    return versions(spark, root).withColumn("rank", F.row_number().over(w))
