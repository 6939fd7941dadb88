"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe and exact verification.

A function flips signs and applies the fast Hadamard transform three times; its value is the signed axis nearest to the
rotated vector. A table joins a few functions, and a vector goes into the buckets of its nearest combinations of axes,
not only of the nearest one. The number of functions follows from the size of the largest label, so that chance
meetings stay rare; the number of tables follows from the collision rate of pairs at the threshold, measured on random
pairs, so that such a pair misses all of them with a probability of MISS.

Equal vectors of a label are one node. Buckets with the same least node are looked at together, dealt into groups of bounded
size that meet in tiles; a tile computes its cosines in double precision and hands on link counts and a spanning forest, never
a row for a pair. A pair that shares several groups counts in the least one.
"""

from __future__ import annotations

from itertools import product
from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import map_rows, written
from barlab.llm.near import components, dealt, runs

THRESHOLD = 0.93
#: Buckets of a vector in each table, and axes of a function from which they are combined.
PROBES, NEAREST = 4, 3
#: Probability with which a pair at the threshold shares no bucket, by the measured rate of TRIALS random pairs.
MISS, TRIALS = 1e-4, 500
#: Nodes of a tile's side; components held at once in a tile.
SIDE, HELD = 1024, 4_000_000
_SEED = 20_240


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, whose length is a power of two, scaled to keep lengths."""
    n, h = x.shape[-1], 1
    while h < n:
        x = x.reshape(*x.shape[:-1], -1, 2, h) if x.ndim == 2 else x
        x = np.stack([x[..., 0, :] + x[..., 1, :], x[..., 0, :] - x[..., 1, :]], axis=-2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


class Tables:
    """``tables`` tables of ``functions`` functions each for vectors of ``dims`` components."""

    def __init__(self, dims: int, functions: int, tables: int):
        self.dims, self.functions, self.tables = dims, functions, tables
        self.wide = 1 << max(0, dims - 1).bit_length()
        self.signs = np.random.default_rng(_SEED).choice([-1.0, 1.0], (tables, functions, 3, self.wide))
        self.mixes = list(product(range(min(NEAREST, self.wide)), repeat=functions))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows x tables x buckets) numbers of the buckets of unit vectors."""
        rows = np.zeros((len(x), self.wide))
        rows[:, : x.shape[1]] = x
        near = min(NEAREST, self.wide)
        out = []
        for table in self.signs:
            axis, cost = [], []
            for three in table:
                y = rows
                for signs in three:
                    y = hadamard(y * signs)
                size = np.abs(y)
                best = np.argpartition(-size, near - 1, axis=1)[:, :near]
                order = np.argsort(-np.take_along_axis(size, best, 1), axis=1, kind="stable")
                best = np.take_along_axis(best, order, 1)
                at = np.take_along_axis(y, best, 1)
                axis.append(2 * best + (at < 0))
                cost.append(np.abs(at[:, :1]) - np.abs(at))
            total = np.stack([sum(c[:, k] for c, k in zip(cost, mix, strict=True)) for mix in self.mixes], axis=1)
            code = np.stack([sum(a[:, k] * (2 * self.wide) ** i for i, (a, k) in enumerate(zip(axis, mix, strict=True))) for mix in self.mixes], axis=1)
            first = np.argsort(total, axis=1, kind="stable")[:, : min(PROBES, len(self.mixes))]
            out.append(np.take_along_axis(code, first, 1))
        return np.stack(out, axis=1)


def planned(dims: int, most: int, threshold: float) -> Tables:
    """Tables for a label of ``most`` nodes."""
    wide = 1 << max(0, dims - 1).bit_length()
    functions = max(1, ceil(log(max(2, most) * PROBES) / log(2 * wide))) if wide > 1 else 1
    rng = np.random.default_rng(_SEED)
    a, b = rng.standard_normal((2, TRIALS, max(2, dims)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold**2) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    trial = Tables(max(2, dims), functions, 8)
    x, y = trial.codes(a), trial.codes(b)
    rate = min(0.999, max(0.001, float((x[..., :, None] == y[..., None, :]).any(axis=(2, 3)).mean())))
    return Tables(dims, functions, ceil(log(MISS) / log(1 - rate)))


def unit(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for k, row in enumerate(column.to_pylist()):
        out[k, : len(row)] = row
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)  # no overflow in the squares
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector, low, high) of all rows; vector is null where the row links with nothing; low and high name equal ones."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vector = F.when(F.col("label").isNotNull() & whole, F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    return rows.select("*", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")).alias("low"), F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector", "label")).alias("high"))


def entries(nodes: DataFrame, tables: Tables) -> DataFrame:
    """(bucket, node): the buckets of every node, by label and table."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            code = tables.codes(unit(b["vector"], tables.dims))
            node, label = np.asarray(b["node"]), np.asarray(b["label"])
            yield {"label": np.repeat(label, code[0].size), "at": np.tile(np.repeat(np.arange(tables.tables), code.shape[2]), len(node)), "code": code.ravel(), "node": np.repeat(node, code[0].size)}

    out = map_rows(nodes.select("node", "label", "vector"), run, "label long, at int, code long, node long")
    return out.select(F.xxhash64("label", "at", "code").alias("bucket"), "node")


def tiles(nodes: DataFrame, tables: Tables) -> DataFrame:
    """(head, i, j, node, g, heads, label, weight, vector): the nodes of every head, in every tile of their group."""
    found = entries(nodes, tables)
    heads = found.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("head")).filter("members > 1").select("bucket", "head")
    pairs = written(found.join(heads, "bucket").select("node", "head").distinct())
    sizes = pairs.groupBy("head").agg(F.count("*").alias("members")).filter("members > 1")
    side = max(1, min(SIDE, HELD // tables.dims))
    shared = pairs.join(sizes.select("head", F.ceil(F.col("members") / side).cast("int").alias("groups")), "head")
    own = shared.groupBy("node").agg(F.collect_set("head").alias("heads"))  # a head for each bucket of a node at most
    dealt_out = shared.withColumn("g", F.pmod(F.xxhash64("node", "head"), F.col("groups")).cast("int"))
    spread = dealt_out.select("head", "node", "g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("o"))
    spread = spread.select("head", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "node", "g")
    return spread.join(own, "node").join(nodes.select("node", "label", "weight", "vector"), "node")


def linked(tile_rows: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(node, other, links): link counts of a tile (other null) and a spanning forest of its links (links 0)."""

    def run(batches):
        for (head, i, j), t in runs(batches, ["head", "i", "j"]):
            node, g, label, weight = (np.asarray(t[c]) for c in ("node", "g", "label", "weight"))
            x = unit(t["vector"], dims)
            link = (x @ x.T >= threshold) & (label[:, None] == label)
            link &= ((g[:, None] == i) & (g == j)) | ((g[:, None] == j) & (g == i))
            np.fill_diagonal(link, False)
            hit = np.flatnonzero(link.any(axis=1))
            if not len(hit):
                continue
            node, weight, link = node[hit], weight[hit], link[np.ix_(hit, hit)]
            lists = t["heads"].take(hit).to_pylist()
            where = np.repeat(np.arange(len(hit)), [len(v) for v in lists])
            lesser = np.array([h for v in lists for h in v], np.int64)
            where, lesser = where[lesser < head], lesser[lesser < head]
            names, at, times = np.unique(lesser, return_inverse=True, return_counts=True)
            if len(names) and times.max() > 1:
                both = np.flatnonzero(times > 1)
                inside = np.isin(at, both)
                has = np.zeros((len(hit), len(both)), np.float32)
                has[where[inside], np.searchsorted(both, at[inside])] = 1
                link &= has @ has.T == 0
            links = link @ weight
            root = np.arange(len(hit))
            while True:
                low = np.minimum(root, np.where(link, root, len(hit)).min(axis=1))
                if (low == root).all():
                    break
                root = low
            tied, some = np.flatnonzero(root != np.arange(len(hit))), np.flatnonzero(links)
            yield {"node": [*node[some].tolist(), *node[tied].tolist()], "other": [*[None] * len(some), *node[root[tied]].tolist()], "links": [*links[some].tolist(), *[0] * len(tied)]}

    return map_rows(dealt(tile_rows, ["head", "i", "j"]), run, "node long, other long, links long")


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Rows of one label with a cosine of ``threshold`` or more are linked; every pair that shares a bucket is verified, and a pair at
    the threshold shares none with probability MISS, closer pairs with less. n_links counts the other rows linked directly, copies
    included; component_id is the least vec_id that links reach; kept is vec_id = component_id. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing. A shorter vector is
    filled up with zeros. Repeated rows are copies of each other, and each is answered. A null vec_id is
    linked like any other but names a component only where there is no other. Only vec_id, embedding and label are read, so
    extra columns never clash. An empty table gives an empty table.
    """
    rows = written(usable(vectors))
    own = rows.filter("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    own = own.select("*", F.xxhash64("label", "vector").alias("low"), F.xxhash64(F.lit(1), "vector", "label").alias("high"))
    nodes = written(own.withColumn("node", F.monotonically_increasing_id()))
    most = nodes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).agg(F.max("n").alias("n"), F.max("dims").alias("dims")).collect()[0]
    dims = max(1, most.dims or 0)
    found = written(linked(tiles(nodes, planned(dims, most.n or 1, threshold)), dims, threshold))
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other is not null").select("node", "other"))
    whole = nodes.select("node", "low", "high", "first", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    least = whole.groupBy("root").agg(F.min("first").alias("component"))
    answer = whole.join(least, "root").select("low", "high", "component", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    both = rows.select("vec_id", "low", "high").join(answer, ["low", "high"], "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return both.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
