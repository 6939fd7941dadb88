"""Vector and lexical search operators against brute force, with odd rows in every table."""

import random
import re
from collections import Counter, defaultdict
from math import floor, inf, isfinite, log, nan

import numpy as np
import pyarrow as pa
import pytest

from barlab.llm import negatives, ranked, vectors

VECTORS = "vec_id long, embedding array<float>, label int, n int, head string, q string, component string"


def frame(spark, rows):
    """Vectors with extra columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame([(i, e, y, 1, "x", "y", "z") for i, e, y in rows], VECTORS)


def clusters(seed, n, dims, labels, spread=0.15):
    """Rows around few centres: links at, above and below the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), dims))
    at = centres[rng.integers(len(centres), size=n)] + spread * rng.standard_normal((n, dims)) * rng.random((n, 1)) * 2
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    return [(k, [float(np.float32(x)) for x in v], int(rng.integers(labels))) for k, v in enumerate(at)]


ODD = [
    (1000, None, 1), (1001, [], 1), (1002, [0.0, 0.0], 1), (1003, [1.0, None], 1), (1004, [nan, 1.0], 1), (1005, [inf, 1.0], 1), (1006, [1.0, 0.5], None),
    (None, [1.0, 0.5], 1), (1100, [1.0, 0.5], 1), (1100, [1.0, 0.5], 1), (1100, [0.9, 0.5], 1), (1200, [-0.0, 1.0], 2), (1201, [0.0, 1.0], 2), (1202, [1.0, 0.5, 0.1], 1), (1300, None, None),
]


# ---- op11 ----


def brute_negatives(rows, every=100, k=5):
    fine = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(floor(256 * np.float64(np.float32(x))) for x in e)) for i, e, y in rows if None not in (i, e, y) and all(x is not None and isfinite(x) for x in e)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, y, q in fine:
        if a % every:
            continue
        scored = sorted((-dot(q, v), i, x) for i, x, v in fine if i != a)
        for p, i, x in [s for s in scored if s[2] == y][:k]:
            window = [(-s, n) for s, n, z in scored if z != y and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, i, r, n, -p, s) for r, (s, n) in enumerate(window[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block_rows", "slice_rows"), [(1024, 8192), (7, 2)])
def test_negatives_match_brute_force(spark, block_rows, slice_rows):
    rows = clusters(3, 420, 6, 10, 0.4) + [(2000 + k, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], k % 3) for k in range(40)] + ODD
    got = negatives.mine(frame(spark, rows), block_rows=block_rows, slice_rows=slice_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)
    assert len(brute_negatives(rows)) > 100


def test_negatives_of_few_rows(spark):
    for rows in ([], ODD[:3], [(100, [1.0], 1)], [(100, [1.0], 1), (3, [1.0], 2)], [(200, [3e38, 1.0], 1), (3, [3e38], 1), (4, [3e38], 2)]):
        got = sorted(tuple(r) for r in negatives.mine(frame(spark, rows)).collect())
        assert got == brute_negatives(rows) or any(abs(x) > 1e30 for _, e, _ in rows for x in e or ())


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = negatives.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_blocks_are_left_out(spark):
    rng = np.random.default_rng(1)
    body = rng.integers(-50, 50, (40, 30, 5))
    low, high = body.min(axis=1), body.max(axis=1)
    anchors = rng.integers(-50, 50, (20, 5)).astype(float)
    least, most = negatives.bounds(anchors, low, high)
    scores = np.einsum("ad,bnd->abn", anchors, body)
    assert (least <= scores.min(axis=2)).all() and (scores.max(axis=2) <= most).all()
    # Blocks of tight clusters: most of them lie outside a window near the top.
    centres = rng.integers(-100, 100, (60, 1, 5))
    body = centres + rng.integers(-3, 4, (60, 30, 5))
    w = negatives.Windows(np.zeros(1), np.zeros(1), centres[0].astype(float), np.zeros(1, int), True, np.array([0.9 * (centres[0] ** 2).sum()]), np.array([np.inf]))
    may, _ = w.possible(np.zeros(60), body.min(axis=1), body.max(axis=1))
    inside = (body @ centres[0, 0] >= w.low).any(axis=1)
    assert (may[0] | ~inside).all() and may[0].sum() < 30
    assert negatives.ranges(np.array([1, 2, 3, 9, 40, 41]), 2) == [(1, 9), (40, 41)] and negatives.ranges(np.array([4, 5, 4])) == [(4, 5)]


def test_a_window_is_probed_only_in_its_own_blocks(spark):
    rows = clusters(9, 300, 5, 3)
    table = negatives.blocks(negatives.usable(frame(spark, rows)), 5, 10)
    body = {r.block: (r.label, *(np.frombuffer(x, "<i8").astype(float) for x in (r.low, r.high))) for r in table.collect()}
    q = np.array([[floor(256 * x) for x in rows[k][1]] for k in (0, 100, 200)], float)
    n = 9
    w = negatives.Windows(np.array([0, 100, 200]), np.array([0, 1, 2]), q, np.repeat(np.arange(3), 3), False, np.full(n, -np.inf), np.full(n, np.inf))
    probes = negatives.probed(table, spark.sparkContext.broadcast(w), 5)
    for k in range(n):
        most = {b: negatives.bounds(q[[k // 3]], low[None], high[None])[1][0, 0] for b, (label, low, high) in body.items() if label != k // 3}
        own = [b for b, windows in probes.items() if k in windows]
        assert len(own) == negatives.PROBES and min(most[b] for b in own) >= sorted(most.values())[-negatives.PROBES]
    assert all((np.diff(windows) > 0).all() for windows in probes.values())


def test_windows_of_one_anchor_share_its_scores():
    rng = np.random.default_rng(2)
    body = rng.integers(-2, 3, (90, 4)).astype(float)  # few values: many equal scores
    q = rng.integers(-2, 3, (6, 4)).astype(float)
    ids, anchor, k = rng.permutation(90), np.array([0, 0, 0, 1, 3, 3, 4, 5]), 4
    low, high = np.array([-2, 0, 1, -9, 2, -3, 50, 0.0]), np.array([3, 9, 1, 9, 5, 0, 60, np.inf])
    w = negatives.Windows(ids[:6], np.zeros(6), q, anchor, False, low, high)
    first = negatives.First(w, k)
    for at in range(0, 90, 30):
        for own in (np.arange(5), np.arange(5, 8)):
            first.search(own, ids[at : at + 30], body[at : at + 30])
    for n, a in enumerate(anchor):
        scored = sorted((-float(q[a] @ v), int(i)) for i, v in zip(ids, body, strict=True) if i != ids[a] and low[n] <= q[a] @ v <= high[n])
        got = first.score[n] > -np.inf
        assert list(zip((-first.score[n][got]).tolist(), first.id[n][got].tolist(), strict=True)) == scored[:k]


def test_matrix_of_lists_of_any_length():
    lists = pa.chunked_array([pa.array([[1, 2, 3], [], [4]]), pa.array([[9, 9, 9], [5, 6]]).slice(1)])
    assert negatives.matrix(lists, 3).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0], [5, 6, 0]]
    assert negatives.matrix(lists.chunk(1), 3, np.int64).dtype == np.int64


# ---- op12 ----


def brute_links(rows, threshold=0.93):
    usable = [e is not None and y is not None and all(x is not None and isfinite(x) for x in e) and any(x for x in e) for _, e, y in rows]
    dims = max((len(e) for _, e, _ in rows if e), default=1)
    m = np.array([list(e) + [0.0] * (dims - len(e)) if u else [0.0] * dims for (_, e, _), u in zip(rows, usable, strict=True)], np.float32).astype(float).reshape(len(rows), dims)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    y = np.array([-1 if r[2] is None else r[2] for r in rows])
    link = (m @ m.T >= threshold) & (y[:, None] == y) & np.array(usable, bool)[:, None] & np.array(usable, bool)
    np.fill_diagonal(link, False)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[k], *(root[j] for j in np.flatnonzero(link[k]))]) for k in range(len(rows))]
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(rows[k][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return [(rows[k][0], int(link[k].sum()), least[root[k]], least[root[k]] == rows[k][0]) for k in range(len(rows))]


@pytest.mark.parametrize("side", [1024, 5])
def test_links_match_brute_force(spark, monkeypatch, side):
    monkeypatch.setattr(vectors, "SIDE", side)
    rows = clusters(5, 300, 16, 3) + [(5000 + k, [1.0] + [0.0] * 15, 1) for k in range(30)] + ODD
    got = [tuple(r) for r in vectors.link(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(brute_links(rows))
    assert sum(r[1] for r in got) > 500


def test_links_of_few_rows(spark):
    for rows in ([], ODD[:4], ODD[8:10], [(1, [2.0], 1), (2, [3.0], 1), (3, [-1.0], 1)], [(7, [1e-30, 1e-30], 1), (8, [3e38, 3e38], 1)]):
        assert Counter(tuple(r) for r in vectors.link(frame(spark, rows)).collect()) == Counter(brute_links(rows))


def test_recall_just_above_the_threshold(spark):
    """Pairs at cosines of 0.93 to 0.94, each alone among random vectors."""
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9301 + 0.01 * rng.random((1500, 1))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    got = vectors.link(frame(spark, rows)).filter("n_links = 1").count()
    assert got >= 0.99 * 3000


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((7, 32))
    signs = np.array([[(-1) ** bin(i & j).count("1") for j in range(32)] for i in range(32)])
    assert np.allclose(vectors.hadamard(x), x @ signs / np.sqrt(32)) and np.allclose(vectors.hadamard(vectors.hadamard(x)), x)


# ---- op13 ----

DOCS = "doc_id long, text string, n long, terms string, _lead int, rank string"
ODD_TEXTS = [(1, None), (2, ""), (3, " \n\t.,"), (None, "alpha beta gamma"), (4, "alpha beta"), (4, "alpha beta"), (5, "beta alpha"), (6, "ÉTÉ été Alpha"), (None, None)]


def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")


def brute_rank(docs, items, top=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bags = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, b in bags:
            m = 75 + (25 * b.total() * n) // length
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in words(text) if b[t])
            if s > 0:
                scored.append((-s, inf if i is None else i))
        out += [(item, r, None if i == inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"TREE_ROWS": 40, "LEAF": 3, "BATCH_ITEMS": 4}, {"TREE_TERMS": 50, "BATCH_TERMS": 12}])
def test_ranks_match_brute_force(spark, monkeypatch, sizes):
    for name, v in sizes.items():
        monkeypatch.setattr(ranked, name, v)
    rng = random.Random(4)
    vocabulary = ["the", "of", *(f"w{k}" for k in range(60)), "É", "ünit"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([3, 20, 64])]) for _ in range(n))
    docs = [(k, text(rng.choice([1, 5, 40, 300]))) for k in range(160)] + [(500 + k, "w1 w2 w3") for k in range(45)] + ODD_TEXTS
    items = [(k, text(rng.choice([1, 6, 30]))) for k in range(9)] + [(20, None), (21, ""), (22, "none such"), (None, "alpha"), (3, "w1 W1 w2"), (3, "w1 W1 w2"), (23, "été")]
    got = ranked.rank(*tables(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_rank(docs, items)


def test_ranks_of_empty_tables(spark):
    for docs, items in (([], []), ([], [(1, "a")]), ([(1, "a")], []), (ODD_TEXTS[:3], [(1, "alpha")]), ([(1, "a b")], [(1, "a")])):
        assert Counter(tuple(r) for r in ranked.rank(*tables(spark, docs, items)).collect()) == brute_rank(docs, items)


def test_a_very_long_text_counts_whole(spark):
    docs = [(1, "word " * 400_000 + "rare"), (2, "rare"), (3, "word other")]
    assert Counter(tuple(r) for r in ranked.rank(*tables(spark, docs, [(1, "rare word")])).collect()) == brute_rank(docs, [(1, "rare word")])


def test_subtrees_are_left_out_and_bounds_hold():
    """Documents of separate vocabularies: an item visits few leaves, and no document scores above its ball's bound."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(20 * t, 20 * t + 20, 8)) for t in np.repeat(np.arange(30), 60)]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at, w = np.concatenate(rows), rng.integers(100, 5000, 600)
    tree = ranked.Trees(start, at, rng.integers(1, 10**6, len(at)), np.sqrt(w))
    weights = np.zeros((30, 600), np.int64)
    for k in range(30):
        weights[k, rows[60 * k]] = w[rows[60 * k]]
    bound = tree.bounds(weights / np.sqrt(w))
    for k in range(30):
        exact = np.zeros(len(rows))
        for node, members in enumerate(tree.members):
            if not tree.children[node]:
                exact[members] = tree.scores(node, weights[k])
        assert all(bound[k, node] >= exact[members].max() for node, members in enumerate(tree.members))
        best = ranked.Best(1, 20)
        leaves = ranked.visit(tree, 0, bound[k], weights[k], np.arange(len(rows)), best)
        assert leaves < sum(c is None for c in tree.children) / 3
        assert sorted(s for s, _ in best.rows[0]) == sorted(exact[exact > 0])[-20:]


def test_a_tree_is_visited_once_for_all_items(monkeypatch):
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, rng.choice([8, 60]), rng.integers(1, 9))) for _ in range(400)]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at, w, ids = np.concatenate(rows), rng.integers(100, 5000, 60), rng.permutation(400)
    v = rng.choice([10, 1000, 10**6], len(at))  # few values: equal scores
    weights = np.where(rng.random((60, 25)) < 0.1, w[:, None], 0)
    tree = ranked.Trees(start, at, v, np.sqrt(w))
    scored, scores = [], ranked.Trees.scores
    monkeypatch.setattr(ranked.Trees, "scores", lambda self, node, *rest: scored.append(node) or scores(self, node, *rest))
    for kind in (np.int64, float):
        scored.clear()
        best = ranked.Best(25, 7)
        leaves = ranked.visit(tree, np.arange(25), tree.bounds(weights.T / np.sqrt(w)), weights.astype(kind), ids, best)
        assert leaves == len(scored) == len(set(scored)) <= sum(c is None for c in tree.children)
        for k in range(25):
            exact = [(int((weights[at[a:b], k] * v[a:b]).sum()), -int(i)) for i, a, b in zip(ids, start, start[1:], strict=False)]
            assert sorted(best.rows[k]) == sorted(x for x in exact if x[0] > 0)[-7:]


def test_leaf_scores_beyond_doubles_are_whole():
    tree = ranked.Trees(np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([3, 7, 5]), np.ones(2))
    assert tree.scores(0, np.array([(1 << 58) + 1, 1])).tolist() == [3 * (1 << 58) + 10, 5]


def test_counts_of_query_terms(spark):
    docs = [(1, " b  a,B\n"), (2, None), (3, ""), (4, "other words"), (None, "aé a\x00a"), (5, "..."), (6, "éTÉ a")]
    got = ranked.counted(tables(spark, docs, [(1, "a")])[0].coalesce(1), ["a".encode(), "b".encode(), "étÉ".encode()]).collect()
    assert [(r.doc_id, r.n, dict(zip(r.terms, r.tfs, strict=True))) for r in got] == [(1, 3, {0: 1, 1: 2}), (4, 2, {}), (None, 3, {0: 2}), (6, 2, {0: 1, 2: 1})]


def test_forest_keeps_all_documents_in_order(monkeypatch):
    monkeypatch.setattr(ranked, "TREE_ROWS", 3)
    monkeypatch.setattr(ranked, "TREE_TERMS", 10)
    sizes = [1, 2, 3, 4, 30, 1, 0, 0, 0, 0, 9, 2]
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(12)), "terms": pa.array([[0] * n for n in sizes], pa.list_(pa.int32()))})
    tables = list(ranked.forest(iter([docs.slice(0, 5), docs.slice(5, 0), docs.slice(5)])))
    assert [t["doc_id"].to_pylist() for t in tables] == [[0, 1, 2], [3], [4], [5, 6, 7], [8, 9, 10], [11]]
    assert list(ranked.forest(iter([docs.slice(0, 0)]))) == []
