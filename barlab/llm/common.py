"""Helpers shared by the text operators: readers, Arrow batch size, word rules, stable row numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.session import checkpoint, shared_dir

#: Rows and bytes per Arrow batch between the JVM and Python: bound a worker's memory when rows are very long.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

#: Lower-cases A-Z, keeps digits, a-z and every byte of a non-ASCII character, and turns all other bytes into spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8; null has none."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over small batches; ``fn`` yields column dictionaries."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=target)

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors and is compressed."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return read_back(df, path)


def read_back(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, to which ``df`` has been written."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of doc_id as text leaves ``fold``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def numbered(df: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Gapless numbers from 0 in the order of ``keys``, and how many there are.

    Range partitions are numbered on their own and shifted by the sizes of those before them, so no task sees more
    than its range. Rows equal in every key are interchangeable; the source partition splits large groups of them.
    Only one number per partition reaches the driver.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tie = "_source_partition"
    placed = df.withColumn(tie, F.spark_partition_id()).repartitionByRange(parts, *keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    placed = checkpoint(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part] = total
        total += sizes[part]
    if not total:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_part", "_at"), 0
    start = F.lit([starts.get(p, 0) for p in range(max(starts) + 1)])[F.col("_part")]
    return placed.withColumn(name, (start + F.col("_at")).cast("long")).drop("_part", "_at"), total
