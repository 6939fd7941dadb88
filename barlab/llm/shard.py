"""Sharding: a Feistel permutation with cycle walking over global row numbers.

The permutation maps 0..rows-1 onto itself, so shard and slot of a row follow from its number, the number of rows
and the seed alone: shard = image mod shards, slot = image div shards. Shard sizes differ by one at most (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import numbered

SHARDS = 24
SEED = 20_240_229
ROUNDS = 4
#: Multipliers below 2**31, so that products of 31-bit numbers stay below 2**62.
MUL_A, MUL_B, MASK31 = 1_103_515_245, 1_540_483_477, (1 << 31) - 1


def half_bits(rows: int) -> int:
    """Bits of one half: the least even-width domain that holds ``rows`` numbers; 31 at most (2**62 rows)."""
    bits = 1
    while 1 << (2 * bits) < rows:
        bits += 1
    return bits


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [(seed * 69_069 + 362_437 * (k + 1)) & MASK31 for k in range(rounds)]


def feistel(x: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    """One pass of the Feistel network over numbers of ``2 * bits`` bits: a bijection whatever the round function."""
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in keys:
        t = (right * MUL_A + key) & MASK31
        t = t ^ (t >> 15)
        t = (t * MUL_B) & MASK31
        t = t ^ (t >> 13)
        left, right = right, left ^ (t & mask)
    return (left << bits) | right


def permuted(x: np.ndarray, rows: int, seed: int = SEED) -> np.ndarray:
    """Image of row numbers: walks the cycle of the wider domain until it is back among 0..rows-1."""
    bits, keys = half_bits(rows), round_keys(seed)
    out = feistel(x.astype(np.int64), bits, keys)
    while (away := out >= rows).any():
        out[away] = feistel(out[away], bits, keys)
    return out


def place(x: np.ndarray, rows: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers, without reading any row."""
    image = permuted(x, rows, seed)
    return image % shards, image // shards


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Place of every document: doc_id, size, text_crc32, row_number, shard, slot.

    Row numbers follow doc_id (nulls first), then text checksum and size; rows equal in all three are interchangeable.
    Size is the UTF-8 length plus 8; a null text counts as empty. Repeated rows get places of their own. An empty table
    gives an empty table. Only doc_id and text are read. The text never leaves the scan.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, total = numbered(small, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def image(n: pd.Series) -> pd.Series:
        return pd.Series(permuted(n.to_numpy(), total, seed))

    at = F.col("_image")
    return rows.withColumn("_image", image("row_number")).select("*", (at % shards).cast("int").alias("shard"), F.expr(f"_image div {shards}").alias("slot")).drop("_image")
