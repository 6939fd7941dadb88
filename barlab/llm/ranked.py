"""Ranked lexical search by exact maximum inner product over sparse ball trees.

A document is a sparse vector over the terms of the queries, an item a sparse vector of term weights, and the score their inner
product in whole numbers. The texts are read once: each task counts terms, and the vectors are written as a table
with document frequencies and lengths summed beside it. Document vectors are then dealt into groups by their weightiest term, so that
documents that share rare terms lie together, and every group of bounded size becomes a tree of balls with a centroid and a
radius. For an item q, no document of a ball scores more than q.c + |q| r, with |q| over the terms that the ball's documents hold;
sums in doubles are widened by more than their rounding, so the bound is safe. A tree is visited once for all items, the subtree with the
best bound of any item first; an item leaves a subtree when its bound there is under the score that its last place has already.
The leaves are scored exactly, as one matrix product for the items that have come so far.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import WORD_BYTES, map_rows, words, written

TOP = 20
#: Items of one search: their terms and weights are broadcast. More items make more searches over the same table.
BATCH_ITEMS, BATCH_TERMS = 2048, 200_000
#: Documents, and terms of documents, of a tree; documents of a leaf.
TREE_ROWS, TREE_TERMS, LEAF = 4096, 1_000_000, 32
#: Share of a bound by which it is raised: over 1e5 terms doubles lose less than 1e-10.
SLACK = 1e-9
UNIT, BASE, SLOPE = 1_000_000_000, 100, 25


def batches_of(items: DataFrame) -> Iterator[list[tuple]]:
    """(item number, item_id, terms) of the items, in batches of bounded size."""
    batch: list[tuple] = []
    terms: set[bytes] = set()
    for k, r in enumerate(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().toLocalIterator()):
        own = Counter(words(r.text))
        if batch and (len(batch) == BATCH_ITEMS or len(terms | own.keys()) > BATCH_TERMS):
            yield batch
            batch, terms = [], set()
        if own:
            batch.append((k, r.item_id, own))
            terms |= own.keys()
    if batch:
        yield batch


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): length of every document with terms, and its counts of the given terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = pa.array(shared.value, pa.binary())
        for b in batches:
            texts = [(t or b"").translate(WORD_BYTES) for t in b["text"].to_pylist()]
            split = pc.split_pattern(pa.array(texts, pa.binary()), b" ")  # a run of spaces leaves empty words
            doc, word = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
            n = np.bincount(doc[pc.binary_length(word).to_numpy() > 0], minlength=len(texts))
            term = pc.index_in(word, value_set=known).fill_null(-1).to_numpy()
            hit = np.flatnonzero(term >= 0)
            cell, tf = np.unique(doc[hit] * len(known) + term[hit], return_counts=True)
            begin = np.searchsorted(cell, np.arange(len(texts) + 1) * len(known))
            offsets = pa.array(np.append(begin[:-1][n > 0], begin[-1]), pa.int32())  # a document without words has no cells
            lists = {c: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for c, v in (("terms", cell % len(known)), ("tfs", tf))}
            yield {"doc_id": b["doc_id"].filter(pa.array(n > 0)), "n": n[n > 0]} | lists

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")), run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(df: int, n: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


class Trees:
    """Ball tree over the rows of a sparse matrix (terms ``at``, values ``v``, row starts ``start``)."""

    def __init__(self, start: np.ndarray, at: np.ndarray, v: np.ndarray, scale: np.ndarray):
        self.start, self.at, self.v = start, at, v
        self.x = v * scale[at]  # the metric of the tree: weights shared evenly between items and documents
        self.square = self._sums(np.arange(len(start) - 1), self.x * self.x)
        self.members: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.centres, self.radii = [], []
        self.terms = len(scale)
        self._grow(np.arange(len(start) - 1))

    def _cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rows' entries, and where each row begins among them."""
        size = self.start[rows + 1] - self.start[rows]
        begin = np.concatenate([[0], np.cumsum(size)])
        return np.repeat(self.start[rows] - begin[:-1], size) + np.arange(begin[-1]), begin

    def _sums(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        cells, begin = self._cells(rows)
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values[cells])])
        return total[begin[1:]] - total[begin[:-1]]

    def _grow(self, rows: np.ndarray) -> int:
        me = len(self.members)
        cells, begin = self._cells(rows)
        at, x = self.at[cells], self.x[cells]
        centre = np.bincount(at, x, self.terms) / len(rows)
        dot = lambda c: np.add.reduceat(np.append(x * c[at], 0.0), begin[:-1]) * (begin[1:] > begin[:-1])
        away = np.maximum(self.square[rows] - 2 * dot(centre) + centre @ centre, 0)
        self.members.append(rows)
        self.children.append(None)
        self.centres.append(centre)
        # The distance is a small difference of large squares, so the radius gets the rounding of those.
        self.radii.append(float(np.sqrt(away.max() + SLACK * (self.square[rows].max() + centre @ centre))))
        if len(rows) <= LEAF or away.max() <= SLACK * self.square[rows].max():
            return me

        def dense(row: int) -> np.ndarray:
            out = np.zeros(self.terms)
            out[self.at[self.start[row] : self.start[row + 1]]] = self.x[self.start[row] : self.start[row + 1]]
            return out

        one = dense(rows[away.argmax()])
        to_one = self.square[rows] - 2 * dot(one)
        two = dense(rows[to_one.argmax()])
        gap = to_one - (self.square[rows] - 2 * dot(two)) + one @ one - two @ two
        order = np.argsort(gap, kind="stable")
        cut = int(np.clip((gap < 0).sum(), len(rows) // 8, len(rows) - len(rows) // 8))
        left, right = self._grow(rows[order[:cut]]), self._grow(rows[order[cut:]])
        self.children[me] = (left, right)
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(items x nodes) scores that no document of a node exceeds."""
        centres = np.array(self.centres).T
        length = np.sqrt((queries * queries) @ (centres > 0))  # only terms of the ball's documents count
        most = queries @ centres + length * np.array(self.radii)
        return most * (1 + SLACK) + 1

    def scores(self, node: int, weights: np.ndarray, own=None) -> np.ndarray:
        """Exact scores of a leaf's documents; ``weights`` are whole numbers by term, or by term and item, of which ``own`` are taken."""
        rows = self.members[node]
        cells, begin = self._cells(rows)
        terms, at = np.unique(self.at[cells], return_inverse=True)
        docs = np.zeros((len(rows), len(terms)), weights.dtype)
        docs[np.repeat(np.arange(len(rows)), np.diff(begin)), at] = self.v[cells]
        return docs @ (weights[terms] if own is None else weights[np.ix_(terms, own)])


class Best:
    """The first ``top`` (score, -doc_id) seen of every item, and the scores to reach."""

    def __init__(self, items: int, top: int):
        self.top, self.rows = top, [[] for _ in range(items)]
        self.floors = np.ones(items, np.int64)

    def add(self, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Adds documents with their scores (documents x items) for the items ``own``."""
        for j, i in zip(*np.nonzero(scores >= self.floors[own]), strict=True):
            rows = self.rows[own[i]]
            entry = (int(scores[j, i]), -int(ids[j]))
            if len(rows) < self.top:
                heapq.heappush(rows, entry)
            elif entry > rows[0]:
                heapq.heapreplace(rows, entry)
            if len(rows) == self.top:
                self.floors[own[i]] = rows[0][0]


def visit(tree: Trees, items, bound: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Visits the tree for some items of ``best``, best subtree first; returns the number of leaves that were scored.

    ``bound`` has a row for each of the items, ``weights`` a column. Bounds of different items are compared as shares of the whole tree's.
    """
    items, bound, weights = np.atleast_1d(items), np.atleast_2d(bound), weights.reshape(len(weights), -1)
    share = bound / bound[:, :1]
    queue, leaves = [(-1.0, 0, np.arange(len(items)))], 0
    while queue:
        _, node, own = heapq.heappop(queue)
        own = own[bound[own, node] >= best.floors[items[own]]]
        if not len(own):
            continue
        if tree.children[node]:
            for c in tree.children[node]:
                heapq.heappush(queue, (-share[own, c].max(), c, own))
        else:
            leaves += 1
            best.add(items[own], tree.scores(node, weights, own), ids[tree.members[node]])
    return leaves


_NO_ID = (1 << 63) - 1


def grouped(vectors: DataFrame, w: np.ndarray) -> DataFrame:
    """``vectors`` in range partitions by the weightiest term of each document; hashes split groups, and source partitions equal rows."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.argsort(np.argsort(-w, kind="stable")))

    def run(batches):
        for b in batches:
            terms = b["terms"]
            begin = terms.offsets.to_numpy()
            place = shared.value[terms.values.to_numpy()]
            yield {c: b[c] for c in ("doc_id", "n", "terms", "tfs")} | {"_lead": np.minimum.reduceat(place, begin[:-1])} if b.num_rows else {c: [] for c in ("doc_id", "n", "terms", "tfs", "_lead")}

    led = map_rows(vectors, run, "doc_id long, n long, terms array<int>, tfs array<int>, _lead int")
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = led.withColumn("_hash", F.xxhash64("doc_id", "n")).withColumn("_source", F.spark_partition_id())
    return keyed.repartitionByRange(parts, "_lead", "_hash", "_source").drop("_lead", "_hash", "_source")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The documents in tables of at most TREE_ROWS rows and TREE_TERMS terms, or of one row."""
    held, rows, terms = [], 0, 0
    for b in batches:
        start = 0
        for k, size in enumerate(pc.list_value_length(b["terms"]).to_pylist()):
            if rows and (rows == TREE_ROWS or terms + size > TREE_TERMS):
                yield pa.Table.from_batches([*held, b.slice(start, k - start)])
                held, start, rows, terms = [], k, 0, 0
            rows, terms = rows + 1, terms + size
        held.append(b.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


def searched(vectors: DataFrame, items: list[tuple], number: dict[bytes, int], w: np.ndarray, total: int, length: int, top: int) -> DataFrame:
    """(item, item_id, rank, doc_id, score) of a batch of items."""
    whole = np.zeros((len(items), len(number)), np.int64)
    for k, (_, _, own) in enumerate(items):
        for t, c in own.items():
            whole[k, number[t]] = c * w[number[t]]
    names, numbers = [i for _, i, _ in items], [n for n, _, _ in items]
    where = np.flatnonzero(whole)
    shared = vectors.sparkSession.sparkContext.broadcast((where, whole.ravel()[where], whole.shape, w, names, numbers))

    def run(batches):
        where, what, shape, w, names, numbers = shared.value
        whole = np.zeros(shape, np.int64)
        whole.ravel()[where] = what
        scale = np.sqrt(w.astype(float))  # a term of weight 0 is in no score
        # A document has at most UNIT / 1000 for a term. Sums of whole numbers under 2**53 are exact in doubles.
        kind = float if int(whole.sum(axis=1).max()) * (UNIT // 1000) < 1 << 53 else np.int64
        weights = np.ascontiguousarray(whole.T, kind)
        del whole
        queries = weights.T / np.maximum(scale, 1)
        best = Best(len(names), top)

        for docs in forest(batches):
            sizes = pc.list_value_length(docs["terms"]).to_numpy()
            at, tf = (pc.list_flatten(docs[c]).to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            m = BASE - SLOPE + np.array([SLOPE * n * total // length for n in docs["n"].to_pylist()], np.int64)
            v = UNIT * tf // (1000 * tf + 12 * np.repeat(m, sizes))
            tree = Trees(np.concatenate([[0], np.cumsum(sizes)]), at, v, scale)
            visit(tree, np.arange(len(names)), tree.bounds(queries), weights, docs["doc_id"].fill_null(_NO_ID).to_numpy(), best)
        found = [(numbers[k], names[k], None if -i == _NO_ID else -i, s) for k, rows in enumerate(best.rows) for s, i in rows]
        yield {c: [r[j] for r in found] for j, c in enumerate(("item", "item_id", "doc_id", "score"))}

    found = map_rows(vectors, run, "item int, item_id long, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0, equal scores by ascending doc_id.

    Null, empty and wordless texts have no terms: such documents are not counted, such items get no rows. Every row
    of ``docs`` is a document, so repeated rows each take a place; a null doc_id comes last among equal scores. Items
    that repeat item_id and text count once, and items that share only the item_id are ranked each. Only doc_id, item_id
    and text are read, so extra columns never clash. Empty tables give an empty table. Very long texts are counted whole.
    """
    out = []
    for batch in batches_of(items):
        terms = sorted({t for _, _, own in batch for t in own})
        table = written(counted(docs, terms))
        sums = table.agg(F.count("*").alias("total"), F.sum("n").alias("length")).collect()[0]
        if not sums.total:
            break
        df = np.zeros(len(terms), np.int64)
        for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r[0]] = r[1]
        w = np.array([weight(int(d), sums.total) for d in df], np.int64)
        near = grouped(table.filter(F.size("terms") > 0), w)
        number = {t: k for k, t in enumerate(terms)}
        out.append(searched(near, batch, number, w, sums.total, sums.length, top))
    spark = docs.sparkSession
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
