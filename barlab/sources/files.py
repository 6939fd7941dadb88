"""File sources and sinks: bars, manifests, leaderboards and result bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.operators import quality as Q
from barlab.session import ensure_checkpoint_dir

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in Q.BAR_COLUMNS]
)
MANIFEST_COLUMNS = ("feature", "source", "free", "note")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def read_bars(spark: SparkSession, path, fmt: str = "csv", strict: bool = True) -> DataFrame:
    """Bars with a fixed schema (no inference pass); strict mode fails on the first invalid row."""
    reader = spark.read.schema(BAR_SCHEMA)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return Q.checked(df) if strict else df


def read_manifest(spark: SparkSession, path) -> DataFrame:
    """Semicolon-separated feature manifest; missing required columns are an error."""
    df = spark.read.option("header", True).option("sep", ";").csv(path)
    return Q.require_columns(df, MANIFEST_COLUMNS)


def read_leaderboards(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """Many leaderboard files in one scan, tagged with the file each row came from.

    Empty files add no rows; missing ones are skipped by the reader option.
    """
    df = (
        spark.read.schema(schema).option("header", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).csv(paths)
    )
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_seeds(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def first_seed_per_spec(seeds: DataFrame, features: DataFrame) -> DataFrame:
    """Seeds whose feature exists, the first listed per spec."""
    s = seeds.withColumn("feature", F.substring_index("spec", "|", 1))
    s = s.join(features.select("feature").distinct(), "feature", "left_semi")
    return Q.keep_last(s.withColumn("_neg", -F.col("position")), ["spec"], ["_neg"]).drop("_neg")


def write_backtest(metrics: DataFrame, trades: DataFrame, equity: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    trades.write.mode("overwrite").option("header", True).csv(f"{path}/trades")
    equity.write.mode("overwrite").option("header", True).csv(f"{path}/equity")


def write_leaderboard(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


BUNDLE = ("results", "pass", "methods", "year_by_year", "fail_reasons", "duplicates", "bootstrap", "data_quality", "summary")


def write_bundle(tables: dict[str, DataFrame], path: str) -> list[str]:
    """One directory per audit table; nested values become JSON text. Returns the names written."""
    written = []
    for name in BUNDLE:
        if name not in tables:
            continue
        df = tables[name]
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        written.append(name)
    return written
