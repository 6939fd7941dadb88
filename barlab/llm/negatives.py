"""Hard-negative mining over Hilbert-ordered candidate blocks with zone maps.

Candidates are ordered by label and by their place on a Hilbert curve through the leading principal axes, and written as
Parquet in blocks of one label with the least and greatest value of every dimension. A query is a window of scores of an
anchor. Interval arithmetic over a block's zone map bounds every score in it from both sides, and a block is read for
a window only if some score could fall inside. Every window is first searched in the blocks with its highest bounds; the
scores found there are floors for the second pass, which therefore hands on little more than the answers. A block is
multiplied once by every anchor that needs it; only scores that reach a floor are looked at window by window.

Positives are the windows without bounds over an anchor's own label; their scores span the windows of the negatives over
the other labels. Anchors are dealt into slices of a bounded size, one broadcast and one search each.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from uuid import uuid4

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import map_rows, read_back, written
from barlab.session import shared_dir

#: Vectors are compared as floor(SCALE * component).
SCALE = 256
#: Rows of a block, and bytes of a Parquet row group that holds some of them.
BLOCK_ROWS, GROUP_BYTES = 1024, 4 << 20
#: Axes of the curve and bits of each; rows (by hash) from which the axes are taken. They decide the order only.
AXES, BITS, SAMPLE_ROWS = 8, 7, 4096
#: Anchors of a slice, on average. A slice, its windows and their positives fit the driver.
SLICE = 8192
#: Blocks that give the first floors of a window; ranges of blocks that one scan is told to read.
PROBES, RANGES = 2, 32
#: Windows whose scores against a block are held at once.
CHUNK = 256
NEAR, FAR = 80, 100

_BLOCK = "block long, label int, n int, low binary, high binary, ids binary, rows binary"


def usable(vectors: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, each once; q are the whole components."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), q.alias("q")).distinct()


def matrix(column, dims: int, kind=float) -> np.ndarray:
    """Rows of an Arrow list column; shorter ones are filled up with zeros."""
    out = np.zeros((len(column), dims), kind)
    out[np.arange(dims) < pc.list_value_length(column).to_numpy()[:, None]] = pc.list_flatten(column).to_numpy()
    return out


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of integer cells of 0 .. 2**bits - 1 per axis on the Hilbert curve (transposed form, then interleaved)."""
    x = cells.astype(np.int64).T.copy()
    bit = 1 << (bits - 1)
    while bit > 1:
        for i in range(len(x)):
            turn = (x[i] & bit) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & (bit - 1))
            x[0] ^= np.where(turn, bit - 1, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = out << 1 | row >> b & 1
    return out


class Curve:
    """Cells along the leading principal axes of a sample."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(axis=0)
        self.axes = np.linalg.svd(sample - self.mean, full_matrices=False)[2][:AXES].T
        at = (sample - self.mean) @ self.axes
        self.low = at.min(axis=0)
        self.step = np.maximum(at.max(axis=0) - self.low, 1e-9) / ((1 << BITS) - 1)

    def place(self, rows: np.ndarray) -> np.ndarray:
        at = np.floor(((rows - self.mean) @ self.axes - self.low) / self.step)
        return hilbert(np.clip(at, 0, (1 << BITS) - 1))


def blocks(rows: DataFrame, dims: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Parquet table of blocks: number, label, rows, least and greatest values, and the vectors in the order of the curve."""
    sample = rows.orderBy(F.xxhash64("vec_id", "q")).limit(SAMPLE_ROWS).select("q").toArrow()["q"]
    curve = Curve(matrix(sample, dims))

    def place(batches):
        for b in batches:
            yield {"vec_id": b["vec_id"], "label": b["label"], "q": b["q"], "place": curve.place(matrix(b["q"], dims))}

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        label, ids, q = None, np.zeros(0, np.int64), np.zeros((0, dims), np.int64)

        def block(rows: int):
            nonlocal number, ids, q
            number += 1
            order = np.argsort(ids[:rows], kind="stable")
            body = q[order]
            out = {"block": [number], "label": [label], "n": [len(order)], "low": [body.min(axis=0).tobytes()], "high": [body.max(axis=0).tobytes()], "ids": [ids[order].tobytes()], "rows": [body.tobytes()]}
            ids, q = ids[rows:], q[rows:]
            return out

        for b in batches:
            if not b.num_rows:
                continue
            labels, more_ids, more_q = b["label"].to_numpy(), b["vec_id"].to_numpy(), matrix(b["q"], dims, np.int64)
            for start, end in pairwise([0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]):
                if len(ids) and labels[start] != label:
                    yield block(block_rows)
                label, ids, q = int(labels[start]), np.concatenate([ids, more_ids[start:end]]), np.concatenate([q, more_q[start:end]])
                while len(ids) >= block_rows:
                    yield block(block_rows)
        if len(ids):
            yield block(block_rows)

    keys = ["label", "place", "vec_id"]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = map_rows(rows, place, "vec_id long, label int, q array<long>, place long")
    cut_up = map_rows(placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys), cut, _BLOCK)
    path = f"{shared_dir(rows.sparkSession)}/blocks-{uuid4().hex}"
    cut_up.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return read_back(cut_up, path)


def longs(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims).astype(float)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors x blocks) least and greatest inner product with any vector between ``low`` and ``high``; exact in whole numbers."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Windows:
    """Score windows of some anchors: ``low <= score <= high`` among rows of the anchor's label, or of all others.

    ``floor`` is a score that enough rows of the window reach. The windows of an anchor follow each other.
    """

    def __init__(self, vec_id, label, q, anchor, same: bool, low, high, tags=None):
        self.vec_id, self.label, self.q = vec_id, label, q
        self.anchor, self.same, self.low, self.high, self.tags = anchor, same, low, high, tags or {}
        self.floor = low.copy()

    def possible(self, label: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows x blocks) whether a block may hold rows of a window, and the greatest score there."""
        least, most = (x[self.anchor] for x in bounds(self.q, low, high))
        fits = (self.label[self.anchor][:, None] == label) == self.same
        return fits & (most >= self.floor[:, None]) & (least <= self.high[:, None]), most


def ranges(numbers: np.ndarray, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that cover the numbers, cut at the widest gaps."""
    numbers = np.unique(numbers)
    if not len(numbers):
        return []
    gaps = np.diff(numbers)
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    cuts = cuts[gaps[cuts] > 1]
    return list(zip(numbers[np.concatenate([[0], cuts + 1])].tolist(), numbers[np.concatenate([cuts, [len(numbers) - 1]])].tolist(), strict=True))


def within(table: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """The blocks in the ranges; the filter reaches the statistics of the Parquet row groups."""
    return table.filter(reduce(lambda a, b: a | b, (F.col("block").between(x, y) for x, y in spans), F.lit(False)))


def probed(table: DataFrame, shared, dims: int) -> dict[int, np.ndarray]:
    """The windows, ascending, that have a block among their PROBES highest bounds, by block."""

    def run(batches):
        w = shared.value
        top, at = np.full((len(w.anchor), PROBES), -np.inf), np.zeros((len(w.anchor), PROBES), np.int64)
        for b in batches:
            if b.num_rows:
                may, most = w.possible(np.asarray(b["label"]), longs(b["low"], dims), longs(b["high"], dims))
                top = np.concatenate([top, np.where(may, most, -np.inf)], axis=1)
                at = np.concatenate([at, np.broadcast_to(np.asarray(b["block"]), may.shape)], axis=1)
                best = np.argsort(-top, axis=1, kind="stable")[:, :PROBES]
                top, at = np.take_along_axis(top, best, 1), np.take_along_axis(at, best, 1)
        k, j = np.nonzero(top > -np.inf)
        yield {"w": k, "block": at[k, j], "most": top[k, j]}

    found = map_rows(table.select("block", "label", "low", "high"), run, "w int, block long, most double")
    first = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("most"), "block"))
    pairs = found.withColumn("_k", first).filter(F.col("_k") <= PROBES).groupBy("block").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return {r.block: np.array(r.w) for r in pairs.collect()}


def chosen(table: DataFrame, shared, dims: int) -> list[tuple[int, int]]:
    """Ranges of the blocks that some window must read; every task hands on RANGES of them at most."""

    def run(batches):
        w = shared.value
        need: list[int] = []
        for b in batches:
            if b.num_rows:
                may, _ = w.possible(np.asarray(b["label"]), longs(b["low"], dims), longs(b["high"], dims))
                need += np.asarray(b["block"])[may.any(axis=0)].tolist()
        spans = ranges(np.array(need, np.int64))
        yield {"low": [x for x, _ in spans], "high": [y for _, y in spans]}

    spans = sorted(tuple(r) for r in map_rows(table.select("block", "label", "low", "high"), run, "low long, high long").collect())
    while len(spans) > RANGES:  # joins the two with the smallest gap
        k = min(range(len(spans) - 1), key=lambda i: spans[i + 1][0] - spans[i][1])
        spans[k : k + 2] = [(spans[k][0], spans[k + 1][1])]
    return spans


class First:
    """The first ``k`` rows seen of every window, by score and then by id."""

    def __init__(self, windows: Windows, k: int):
        self.windows, self.k = windows, k
        self.score = np.full((len(windows.anchor), k), -np.inf)
        self.id = np.zeros((len(windows.anchor), k), np.int64)

    def least(self, own: np.ndarray) -> np.ndarray:
        """Scores that a row must reach to be among the first of the windows ``own``."""
        return np.maximum(self.score[own, -1], self.windows.floor[own])

    def search(self, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Searches a block for the windows ``own``, ascending."""
        w = self.windows
        begin = np.flatnonzero(np.diff(w.anchor[own], prepend=-1))
        least, high = self.least(own), w.high[own]
        scores = w.q[w.anchor[own[begin]]] @ vectors.T
        fits = (scores >= np.minimum.reduceat(least, begin)[:, None]) & (scores <= np.maximum.reduceat(high, begin)[:, None])
        cells = np.flatnonzero(fits)
        # Each score meets the windows of its anchor.
        size = np.diff(begin, append=len(own))[cells // len(ids)]
        at = np.repeat(begin[cells // len(ids)] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score, row = np.repeat(scores.ravel()[cells], size), np.repeat(ids[cells % len(ids)], size)
        last = (score == self.score[own, -1][at]) & (row > self.id[own, -1][at])
        inside = (score >= least[at]) & (score <= high[at]) & (row != w.vec_id[w.anchor[own[at]]]) & ~last
        self._add(own[at[inside]], score[inside], row[inside])

    def _add(self, window: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        own = np.unique(window)
        window = np.concatenate([np.repeat(own, self.k), window])
        score = np.concatenate([self.score[own].ravel(), score])
        row = np.concatenate([self.id[own].ravel(), row])
        order = np.lexsort((row, -score, window))
        place = np.arange(len(order)) - np.searchsorted(window[order], window[order])
        order, place = order[place < self.k], place[place < self.k]
        self.score[window[order], place], self.id[window[order], place] = score[order], row[order]


def searched(table: DataFrame, shared, dims: int, k: int, probes=None) -> DataFrame:
    """(w, rank, score, vec_id and the tags of the window): the first ``k`` rows of every window in the blocks of ``table``.

    With ``probes``, a broadcast of windows by block, a block is searched only for its windows.
    """
    names = list(shared.value.tags)

    def run(batches):
        w = shared.value
        first = First(w, k)
        everything = np.arange(len(w.anchor))
        for b in batches:
            for block, label, low, high, ids, body in zip(*(b[c].to_pylist() for c in ("block", "label", "low", "high", "ids", "rows")), strict=True):
                low, high, vectors = (np.frombuffer(x, "<i8").reshape(-1, dims).astype(float) for x in (low, high, body))
                if probes:
                    need = probes.value.get(block, everything[:0])
                else:
                    may, most = w.possible(np.array([label]), low, high)
                    need = np.flatnonzero(may[:, 0] & (most[:, 0] >= first.least(everything)))
                for c in range(0, len(need), CHUNK):
                    first.search(need[c : c + CHUNK], np.frombuffer(ids, "<i8"), vectors)
        found, at = np.nonzero(first.score > -np.inf)
        # Scores are whole; they are exact up to 2**53 and held in 63 bits beyond.
        score = np.clip(first.score[found, at], -(2.0**62), 2.0**62).astype(np.int64)
        yield {"w": found, "score": score, "vec_id": first.id[found, at]} | {n: w.tags[n][found] for n in names}

    tags = "".join(f", {n} long" for n in names)
    rows = map_rows(table.select("block", "label", "low", "high", "ids", "rows"), run, f"w int, score long, vec_id long{tags}")
    best = Window.partitionBy("w").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(table: DataFrame, windows: Windows, dims: int, k: int) -> DataFrame:
    """The first ``k`` rows of every window, by score and then by vec_id."""
    sc = table.sparkSession.sparkContext
    shared = sc.broadcast(windows)
    probes = probed(table, shared, dims)
    near = within(table, ranges(np.array(list(probes), np.int64)))
    reached = searched(near, shared, dims, k, sc.broadcast(probes)).filter(F.col("rank") == k).select("w", "score").collect()
    for r in reached:
        windows.floor[r.w] = max(windows.floor[r.w], r.score)
    last = sc.broadcast(windows)
    return searched(within(table, chosen(table, last, dims)), last, dims, k)


def mine(vectors: DataFrame, anchors_every: int = 100, k: int = 5, block_rows: int = BLOCK_ROWS, slice_rows: int = SLICE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``anchors_every``; each has its first ``k`` other rows of the same
    label as positives, and for each of these the first ``k`` rows of other labels with scores from 80 to 100 percent of
    the positive's. Scores are exact up to 2**53. Rows with a null vec_id, label or vector, or a null or non-finite component
    take no part. Rows that repeat vec_id, label and whole components count once; rows that share only the vec_id
    are rows of their own, but no anchor meets its own vec_id. Equal scores come by smaller vec_id. A shorter vector is
    filled up with zeros. A negative positive_score has no window. Only vec_id, embedding and label are read, so
    extra columns never clash. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors))
    shape = rows.agg(F.max(F.size("q")).alias("dims"), F.sum((F.col("vec_id") % anchors_every == 0).cast("long")).alias("anchors")).collect()[0]
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not shape.anchors:
        return spark.createDataFrame([], out)
    dims, slices = max(1, shape.dims), -(-shape.anchors // slice_rows)
    table = blocks(rows, dims, block_rows)
    anchors = written(rows.filter(F.col("vec_id") % anchors_every == 0).withColumn("slice", F.pmod(F.xxhash64("vec_id", "q"), F.lit(slices)).cast("int")))
    found = []
    for s in range(slices):
        own = anchors.filter(F.col("slice") == s).select("vec_id", "label", "q").toArrow()
        if not own.num_rows:
            continue
        who = [own["vec_id"].to_numpy(), own["label"].to_numpy(), matrix(own["q"], dims)]
        n = own.num_rows
        positives = search(table, Windows(*who, np.arange(n), True, np.full(n, -np.inf), np.full(n, np.inf)), dims, k)
        pairs = np.array([(r.w, r.score, r.vec_id) for r in positives.select("w", "score", "vec_id").collect()], np.int64).reshape(-1, 3)
        pairs = pairs[pairs[:, 1] >= 0]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        if not len(pairs):
            continue
        tags = {"anchor_id": who[0][pairs[:, 0]], "positive_id": pairs[:, 2], "positive_score": pairs[:, 1]}
        low = -(-NEAR * pairs[:, 1] // FAR)
        windows = Windows(*who, pairs[:, 0], False, low.astype(float), pairs[:, 1].astype(float), tags)
        mined = search(table, windows, dims, k)
        found.append(written(mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], out)
