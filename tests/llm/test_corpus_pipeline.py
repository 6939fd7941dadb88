"""Each stage of the pipeline against a plain version over its own input."""

from collections import Counter

import pytest
from test_text_operators import brute_leaks, brute_near

import corpus_pipeline as P
from barlab.llm import pack, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Documents before every stage and after the last."""
    docs = P.read(spark, SF, "documents")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(P.written(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(steps):
    assert len(P.STAGES) == 5 and all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxicity_takes_whole_rows(spark, steps):
    scores = {r.doc_id: r.predicted for r in queries.op7_toxicity(spark, SF).collect()}
    assert {r.doc_id for r in steps[1].collect()} == {i for i, p in scores.items() if not p}


def test_lines_only_get_fewer(steps):
    before = dict(texts(steps[1]))
    for r in steps[2].collect():
        rest = iter(before[r.doc_id].split("\n"))
        assert r.text == "" or all(any(x == y for y in rest) for x in r.text.split("\n"))
        assert r.n_chars == len(r.text)
    after = Counter(x for _, t in texts(steps[2]) for x in set(t.split("\n")) if len(x.split()) >= 8)
    assert max(after.values()) == 1 and steps[1].count() == steps[2].count()


def test_one_of_each_group_stays(steps):
    rows = texts(steps[2])
    assert {i for i, _ in texts(steps[3])} == {c for _, c, _, _ in brute_near(rows)}


def test_leaking_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in P.read(spark, SF, "benchmark").collect()]
    assert {i for i, _ in texts(steps[4])} == {r[0] for r in brute_leaks(texts(steps[3]), items) if not r[5]}


def test_all_that_is_left_is_packed(spark, steps):
    e = pack.Encoder(queries.tokenizer_path())
    want = {i: len(e.plain(t)) // 4 + 1 for i, t in texts(steps[4])}
    got = Counter()
    for r in steps[5].collect():
        got[r.doc_id] += r.length
    assert got == want
    assert P.run(spark, SF).count() == steps[5].count()


ODD = [(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta eta"), (4, "one two"), (4, "one two"), (4, "other text here"), (None, None), (5, "a line\n" * 3000)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, rows):
    """Nulls, repeated rows, ids that are shared, a long text, clashing names and an empty table go through every stage."""
    docs = spark.createDataFrame([(i, t, "x", 7, 8, "y") for i, t in rows], "doc_id long, text string, whole string, n_lines int, n_dropped int, _row string")
    for _, stage in P.STAGES[:-1]:
        out = P.written(stage(spark, docs, SF))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = Counter((r.doc_id, r.text) for r in out.collect())
        assert {i for i, _ in got} <= {i for i, _ in rows} and {(r.whole, r.n_lines, r.n_dropped, r._row) for r in out.collect()} <= {("x", 7, 8, "y")}
        docs = out
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
