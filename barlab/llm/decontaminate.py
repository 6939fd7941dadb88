"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

A block of consecutive words plays the part of the character block. The shift table says how far the search may
jump from a block that ends at the current word without missing a pattern; a shift of zero opens the bucket of that
suffix block, and only its patterns are compared word by word. Patterns of one length form one searcher, so a short
benchmark item never shortens the jumps of the ten-word windows.

The benchmark is a stated query set: its windows are dealt into blocks of at most ``block_windows`` patterns, each
block is broadcast on its own, and the documents are scanned once per block. Documents are never shuffled when one
block is enough.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import map_rows, words

WINDOW = 10
BLOCK_WINDOWS = 50_000
SCHEMA = "doc_id long, text_hash long, n_words long, spans array<array<int>>, items array<string>"


class WuManber:
    """Searcher for patterns (tuples of words) of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]], block: int = 3):
        self.size = len(patterns[0])
        self.block = min(block, self.size)
        self.skip = self.size - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.size + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.skip), self.size - end)
            self.buckets[p[-self.block :]].append(p)

    def find(self, text: list[bytes]):
        """(start, pattern) of every occurrence, from left to right."""
        block, size, skip, shift = self.block, self.size, self.skip, self.shift.get
        end, n = size, len(text)
        while end <= n:
            key = tuple(text[end - block : end])
            jump = shift(key, skip)
            if jump:
                end += jump
                continue
            start = end - size
            for p in self.buckets[key]:
                if p[0] == text[start] and tuple(text[start:end]) == p:
                    yield start, p
            end += 1


def windows(item: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """Windows of ``size`` words; a shorter item that has words is one window."""
    if not item:
        return set()
    return {tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))}


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Half-open intervals joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def pattern_table(bench: DataFrame, size: int, block_windows: int) -> tuple[DataFrame, int]:
    """(block, window, items): distinct windows with the items that hold them, dealt into bounded blocks."""

    def cut(batches):
        for b in batches:
            rows = [(" ".join(w.decode("utf-8") for w in win), i) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) for win in windows(words(t), size)]
            yield {"window": [r[0] for r in rows], "item_id": [r[1] for r in rows]}

    pairs = map_rows(bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")), cut, "window string, item_id string").distinct()
    blocks = max(1, -(-pairs.count() // block_windows))
    table = pairs.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    return table.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int")), blocks


def scan(docs: DataFrame, patterns: list[tuple[str, list[str]]], hits_only: bool) -> DataFrame:
    """Word spans and items of one block of patterns in every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(patterns)
    state: dict[str, object] = {}

    def search(batches):
        if "searchers" not in state:
            items = {tuple(w.encode("utf-8") for w in win.split(" ")): ids for win, ids in shared.value}
            by_size: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
            for p in items:
                by_size[len(p)].append(p)
            state["items"], state["searchers"] = items, [WuManber(ps) for ps in by_size.values()]
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "text_hash", "n_words", "spans", "items")}
            for doc_id, key, text in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), b["text"].to_pylist(), strict=True):
                ws = words(text)
                spans, found = [], set()
                for s in state["searchers"]:
                    for start, p in s.find(ws):
                        spans.append([start, start + s.size])
                        found.update(state["items"][p])
                if spans or not hits_only:
                    for k, v in zip(out, (doc_id, key, len(ws), merged(spans), sorted(found)), strict=True):
                        out[k].append(v)
            yield out

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), search, SCHEMA)


def find_leaks(docs: DataFrame, bench: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Benchmark passages in documents: doc_id, text_hash, n_words, spans (word intervals), items (ids as sorted strings).

    One row per row of ``docs``; only doc_id and text are read, so extra columns never clash. Null and empty texts have
    no words and no hits. An empty benchmark gives no hits, empty documents give an empty table. Items with a null id
    mark words but add no id; repeated items count once. Repeated documents give repeated rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table, blocks = pattern_table(bench, size, block_windows)
    block = lambda k: [(r["window"], r["items"]) for r in table.filter(F.col("block") == k).select("window", "items").collect()]
    base = scan(docs, block(0), hits_only=False)
    if blocks == 1:
        return base
    rest = scan(docs, block(1), hits_only=True)
    for k in range(2, blocks):
        rest = rest.unionByName(scan(docs, block(k), hits_only=True))
    # Each block adds at most one row per document after the distinct step, so a group is bounded by the number of blocks.
    more = rest.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    both = base.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")

    def join(batches):
        for b in batches:
            c = {k: b[k].to_pylist() for k in b.schema.names}
            yield {
                "doc_id": c["doc_id"], "text_hash": c["text_hash"], "n_words": c["n_words"],
                "spans": [merged(x + (y or [])) for x, y in zip(c["spans"], c["_spans"], strict=True)],
                "items": [sorted({*x, *(y or [])}) for x, y in zip(c["items"], c["_items"], strict=True)],
            }

    return map_rows(both.select("doc_id", "text_hash", "n_words", "spans", "items", "_spans", "_items"), join, SCHEMA)


def leak_digest(leaks: DataFrame) -> DataFrame:
    """Counts and the digest of item ids of ``find_leaks``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return leaks.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage. All columns stay; see ``find_leaks`` for odd rows."""
    bad = find_leaks(docs, bench).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    return whole.join(bad, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_anti").select("_row.*")
