"""N-gram Jaccard join with Bayesian candidate pruning over MinHash values.

Documents are sets of hashed five-word shingles; equal sets are one class and count once. MinHash bands put classes that
may be alike into common buckets. Buckets with the same least class are put together, dealt into groups of bounded size, and
the groups meet pairwise in tiles, so no task ever holds a whole hot bucket and no row is written for a pair. In a tile, pairs compare their MinHash values
a few at a time; with a uniform prior, m matches in n values put the posterior of a similarity of at least t at
P(Binomial(n + 1, t) <= m), and a pair leaves as soon as this falls below the tolerance. The survivors of a tile travel as one bit matrix, and only they are verified exactly on
their shingle sets. A tile hands on link counts and a spanning forest of its links, from which connected components
follow in rounds of small joins.
"""

from __future__ import annotations

from collections import defaultdict
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import WORD_BYTES, map_rows, written

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of ROWS values: a pair at the threshold misses all buckets with probability (1 - 0.8**3)**24 = 3e-8.
ROWS, BANDS = 3, 24
HASHES = ROWS * BANDS
#: Values compared between two looks at the posterior, and the posterior under which a pair is dropped.
LOOK, TOLERANCE = 12, 1e-7
#: Bounds of a tile's side: classes, and shingles of all its classes.
SIDE, SIDE_SHINGLES = 512, 1_000_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MINHASH = _mix(np.arange(1, 2 * HASHES + 1, dtype=_U) * _BASE).reshape(2, HASHES, 1)
_MINHASH[0] |= _U(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words, but not none, is one shingle."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(WORD_BYTES), np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, _U)
    n = len(raw)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(raw.astype(_U) * _powers(_BASE, n)[:n], dtype=_U)])
    words = _mix((sums[end] - sums[start]) * _powers(_INVERSE, n)[start] + (end - start).astype(_U))
    k = min(size, len(words))
    h = np.zeros(len(words) - k + 1, _U)
    for i in range(k):
        h = h * _BASE + words[i : len(words) - k + 1 + i]
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values, each mixed and kept as 16 bits."""
    low = np.full(HASHES, ~_U(0))
    for k in range(0, len(s), 4096):
        low = np.minimum(low, (s[k : k + 4096] * _MINHASH[0] + _MINHASH[1]).min(axis=1))
    return (_mix(low) >> _U(48)).astype("<u2")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket keys of rows of signatures: the band's number and its values, exactly, in 63 bits."""
    v = sig.reshape(-1, BANDS, ROWS).astype(np.int64)
    return (np.arange(BANDS) << 48) | (v[:, :, 0] << 32) | (v[:, :, 1] << 16) | v[:, :, 2]


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For n = LOOK, 2 LOOK, ... values, the fewest matches that keep the posterior at or above the tolerance."""
    out = []
    for n in range(LOOK, HASHES + 1, LOOK):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, low, high, n, sig): 128-bit hash of the shingle set, its size and signature, of every document."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "text_hash", "low", "high", "n", "sig")}
            for doc_id, key, text in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), b["text"].to_pylist(), strict=True):
                s = shingles(text)
                for name, v in zip(out, (doc_id, key, *set_hash(s), len(s), signature(s).tobytes()), strict=True):
                    out[name].append(v)
            yield out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")), run, "doc_id long, text_hash long, low long, high long, n int, sig binary")


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set: the same for equal sets, whatever the order."""
    return tuple(int(x.sum(dtype=_U).astype(np.int64)) for x in (_mix(s + _BASE), _mix(s ^ _INVERSE)))


def runs(batches, keys: list[str]):
    """Arrow tables of complete runs of equal ``keys`` in sorted rows; a run is held only until it ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ks = list(zip(*(b[k].to_pylist() for k in keys), strict=True))
        begin = 0
        for i, k in enumerate(ks):
            if last is not None and k != last:
                if i > begin:
                    held.append(b.slice(begin, i - begin))
                yield last, pa.Table.from_batches(held)
                held, begin = [], i
            last = k
        held.append(b.slice(begin))
    if held:
        yield last, pa.Table.from_batches(held)


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node")


def tiles(classes: DataFrame) -> DataFrame:
    """(head, i, j, node, g, n, heads, sig): the members of every head, in every tile of their group.

    A bucket of two classes or more is named by its least node, its head. The bands of a group of near copies mostly share
    their head, so the buckets of one head are looked at together and a class travels once for all of them. ``heads`` are
    the heads of a class by band.
    """

    def keys(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), "<u2").reshape(-1, HASHES)
            for k in range(0, len(sig), 1024):
                part = band_keys(sig[k : k + 1024])
                yield {"bucket": part.ravel(), "node": np.repeat(np.asarray(b["node"])[k : k + 1024], BANDS), "n": np.repeat(np.asarray(b["n"])[k : k + 1024], BANDS)}

    some = classes.filter(F.col("n") > 0)
    members = map_rows(some.select("node", "n", "sig"), keys, "bucket long, node long, n int")
    heads = members.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("head")).filter("members > 1").select("bucket", "head")
    found = members.join(heads, "bucket").withColumn("band", F.shiftright("bucket", 48).cast("int"))
    own = found.groupBy("node").agg(F.max("n").alias("n"), F.collect_list(F.struct("band", "head")).alias("heads"))  # BANDS entries at most
    own = written(own.select("node", "n", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.element_at(F.map_from_entries("heads"), k.cast("int"))).alias("heads")))
    pairs = own.select("node", "n", F.explode(F.array_distinct(F.array_compact("heads"))).alias("head"))
    sizes = pairs.groupBy("head").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    groups = F.greatest(F.ceil(F.col("members") / SIDE), F.ceil(F.col("weight") / SIDE_SHINGLES)).cast("int")
    dealt_out = pairs.join(sizes.select("head", groups.alias("groups")), "head").withColumn("g", F.pmod(F.xxhash64("node", "head"), F.col("groups")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("o")
    spread = dealt_out.select("head", "node", "g", other).select("head", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "node", "g")
    return spread.join(own.select("node", "n", "heads").join(some.select("node", "sig"), "node"), "node")


def pruned(tile_rows: DataFrame, threshold: float) -> DataFrame:
    """(head, i, j, nodes, bits): for every tile with survivors, their nodes and the bit matrix of the pairs to verify.

    A pair belongs to the least head of the buckets that it shares, so it is verified once.
    """
    least = least_matches(threshold)

    def run(batches):
        for (head, i, j), t in runs(batches, ["head", "i", "j"]):
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(-1, HASHES)
            node, n, g = np.asarray(t["node"]), np.asarray(t["n"]).astype(float), np.asarray(t["g"])
            a = np.flatnonzero(g == i)
            b = a if i == j else np.flatnonzero(g == j)
            left, right = [], []
            keys = band_keys(sig)
            none = np.iinfo(np.int64).max
            heads = np.array([[none if h is None else h for h in hs] for hs in t["heads"].to_pylist()], np.int64)
            for x in a:
                y = b[b > x] if i == j else b
                y = y[np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]) - 1e-9]
                matches = np.zeros(len(y), np.int64)
                for k, enough in enumerate(least):
                    matches += (sig[y, k * LOOK : (k + 1) * LOOK] == sig[x, k * LOOK : (k + 1) * LOOK]).sum(axis=1)
                    y, matches = y[matches >= enough], matches[matches >= enough]
                y = y[np.where(keys[y] == keys[x], heads[x], none).min(axis=1, initial=none) == head] if len(y) else y
                left.append(np.full(len(y), x))
                right.append(y)
            x, y = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
            if len(x):
                used = np.unique(np.concatenate([x, y]))
                bits = np.zeros((len(used), len(used)), bool)
                bits[np.searchsorted(used, x), np.searchsorted(used, y)] = True
                order = np.argsort(node[used])
                bits = bits | bits.T
                bits = bits[np.ix_(order, order)]
                yield {"head": [head], "i": [i], "j": [j], "nodes": [np.sort(node[used])], "bits": [np.packbits(np.triu(bits, 1)).tobytes()]}

    return map_rows(dealt(tile_rows, ["head", "i", "j"]), run, "head long, i int, j int, nodes array<long>, bits binary")


def verified(tile_rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, other, links): exact link counts of a tile (other null) and a spanning forest of its links (links 0)."""
    members = tile_rows.select("head", "i", "j", F.posexplode("nodes").alias("at", "node"), "bits").withColumn("bits", F.when(F.col("at") == 0, F.col("bits")))

    def run(batches):
        for _, t in runs(batches, ["head", "i", "j"]):
            node = np.asarray(t["node"])
            each = [np.frombuffer(x, _U) for x in t["shingles"].to_pylist()]
            sizes = np.array([len(x) for x in each])
            size = len(each)
            bits = np.unpackbits(np.frombuffer(t["bits"][0].as_py(), np.uint8), count=size * size).reshape(size, size).astype(bool)
            vocabulary, local = np.unique(np.concatenate(each), return_inverse=True)
            start = np.concatenate([[0], np.cumsum(sizes)])
            links, root, forest = np.zeros(size, np.int64), list(range(size)), []

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            mark = np.zeros(len(vocabulary), bool)
            for x in range(size):
                ys = np.flatnonzero(bits[x])
                if not len(ys):
                    continue
                own = local[start[x] : start[x + 1]]
                mark[own] = True
                for k in range(0, len(ys), 256):
                    y = ys[k : k + 256]
                    at = np.concatenate([local[start[v] : start[v + 1]] for v in y])
                    both = np.add.reduceat(mark[at].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[y])[:-1]]))
                    near = y[both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9]
                    links[x] += len(near)
                    links[near] += 1
                    for v in near:
                        p, q = find(x), find(v)
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            forest.append((int(node[x]), int(node[v])))
                mark[own] = False
            hit = np.flatnonzero(links)
            if len(hit):
                pairs = forest
                yield {"node": [*node[hit].tolist(), *(p for p, _ in pairs)], "other": [*[None] * len(hit), *(q for _, q in pairs)], "links": [*links[hit].tolist(), *[0] * len(pairs)]}

    return map_rows(dealt(members.join(sets, "node"), ["head", "i", "j"]), run, "node long, other long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's connected component, by alternating large-star and small-star rounds.

    Every round is a group-by with map-side minima and joins over edges; chains settle in a logarithmic number of rounds.
    """
    now = written(edges.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = written(small)
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).collect()[0]
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def join_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, class_id, set_id, copies, n_links, n_shingles, component) of every document.

    class_id numbers the connected components of documents at a similarity of ``threshold`` or more, set_id the documents
    with equal shingle sets; both are the least doc_id among them where there is one. component is a number for the class
    that is set even then, but not the same in every run. copies counts the documents of the
    set, n_links the other sets at the threshold or above. One row per row of ``docs``; only doc_id and text are read, so
    extra columns never clash. Null, empty and wordless texts have no shingles: they are copies of each other and have no
    links. Repeated rows are copies. A null doc_id is answered like any other. Ties cannot occur: all links count. An
    empty table gives an empty table. Very long texts are taken whole.
    """
    rows = written(signed(docs).withColumn("row", F.monotonically_increasing_id()))
    of_set = rows.groupBy("low", "high").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("doc_id").alias("set_id"))
    of_set = written(of_set)
    classes = written(rows.join(of_set.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "doc_id", "low", "high", "n", "sig"))
    survivors = written(pruned(tiles(classes), threshold))

    wanted = survivors.select(F.explode("nodes").alias("node")).distinct().join(classes.select("node", "doc_id", "low", "high"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted, F.col("_doc").eqNullSafe(F.col("doc_id"))).select("node", "low", "high", "text")

    def sets_of(batches):
        for b in batches:
            out: dict[int, bytes] = {}
            for node, low, high, text in zip(*(b[k].to_pylist() for k in ("node", "low", "high", "text")), strict=True):
                s = shingles(text)
                if (low, high) == set_hash(s):  # rows may share a doc_id and differ in text
                    out[node] = s.tobytes()
            yield {"node": list(out), "shingles": list(out.values())}

    sets = map_rows(texts, sets_of, "node long, shingles binary").dropDuplicates(["node"])
    found = written(verified(survivors, sets, threshold))
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("other is not null").select("node", "other"))
    node_set = of_set.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    class_of = node_set.groupBy("root").agg(F.min("set_id").alias("class_id"))
    answer = node_set.join(class_of, "root").select("low", "high", F.col("root").alias("component"), "class_id", "set_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "text_hash", "low", "high", F.col("n").cast("long").alias("n_shingles")).join(answer, ["low", "high"]).select("doc_id", "text_hash", "class_id", "set_id", "copies", "n_links", "n_shingles", "component")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row for each class of near copies: the least doc_id's (a null one only where there is no other).

    All columns stay. Of rows that repeat doc_id and text, one stays.
    """
    last = F.lit((1 << 63) - 1)
    found = join_near(docs, threshold).select(F.coalesce("doc_id", last).alias("_id"), F.col("text_hash").alias("_hash"), "component")
    found = written(found)
    first = found.groupBy("component").agg(F.min("_id").alias("_id"))
    kept = found.join(first, ["component", "_id"]).groupBy("component", "_id").agg(F.min("_hash").alias("_hash")).select("_id", "_hash")
    whole = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), last).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    whole = whole.join(kept, ["_id", "_hash"], "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_hash")))
    return whole.filter("_k = 1").select("_row.*")
