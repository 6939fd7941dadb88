"""Queries on small tables with odd rows, against their SQL."""

import random
import shutil

import pyarrow.parquet as pq
import pytest

from barlab.catalog import load_all
from barlab.catalog.search_q import spec_board
from barlab.llm import pack, queries
from barlab.operators import search as SE
from barlab.registry import ORACLES, QUERIES
from check import TABLES, compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    load_all()
    return tmp_path


def replace(folder, table, df):
    (folder / f"{table}.parquet").unlink()
    pq.write_table(df.toArrow(), folder / f"{table}.parquet")


def test_literature_groups_odd_rows(spark, folder, capfd):
    """Null texts point to nothing, and rows that share a doc_id point together."""
    texts = [(1, "VIX and Credit"), (1, "plain words"), (2, None), (3, ""), (4, None), (4, "Sector"), (5, "trend"), (None, "macro"), (6, "x" * 9 + "ÉYIELD")]
    replace(folder, "documents", spark.createDataFrame(texts, "doc_id long, text string"))
    got = QUERIES["literature_groups"](spark, str(folder))
    err, _ = compare(got, connect(str(folder)), ORACLES["literature_groups"])
    assert err is None, err
    assert {r.doc_id for r in got.collect()} >= {1, 3, 5}
    capfd.readouterr()
    got.explain(True)
    assert "lower(text" not in capfd.readouterr().out  # texts are read once, before the plan of the result


def test_overfit_penalty_by_kind(spark, capfd):
    """Equal candidates are judged once, and repeated rows of a candidate do not add up."""
    cands = [(1, "m", "f", ["a", "b"]), (1, "m", "f", ["a", "b"]), (2, "m", "f", ["b", "a", "a"]), (3, "n", None, ["c", "a"]), (4, "m", "g", None), (5, None, "g", ["d", "e"]), (None, "n", "g", ["c"])]
    ledger = [(1, "m", "g", False, ["a", "c"]), (2, "n", "f", True, ["d", "e", "f", "g"]), (3, "m", "f", False, ["a", "x", "b"])]
    df = spark.createDataFrame(cands, "candidate_id long, model string, family string, features array<string>")
    got = SE.overfit_penalty(df, spark.createDataFrame(ledger, "pattern_id long, model string, family string, failed_locked boolean, features array<string>"))
    want = []
    for c, model, family, fs in cands:
        best = 0.0
        for _, pm, pf, locked, ps in ledger:
            j = len({*(fs or ())} & {*ps}) / len({*(fs or ())} | {*ps})
            if c is not None and j >= 0.5:
                best = max(best, j + 0.25 * (model == pm) + 0.25 * (family == pf) + 0.5 * locked)
        want.append((c, best))
    assert sorted(((r.candidate_id, r.penalty) for r in got.collect()), key=str) == sorted(want, key=str)
    capfd.readouterr()
    got.explain()
    assert "keys=[candidate_id" not in capfd.readouterr().out


def test_board_of_searches_is_narrow(spark, folder):
    assert set(spec_board(spark, str(folder)).columns) == {"candidate_id", "row_id", "method", "stage", "points", "specs"}


def test_encoder_looks_up_words_and_keeps_the_last_seen(monkeypatch):
    monkeypatch.setattr(pack, "CACHE_WORDS", 60)
    e, taken = pack.Encoder(queries.tokenizer_path()), []
    rng = random.Random(5)
    for _ in range(600):
        text = " ".join("".join(rng.choice("aBé's.,1Ⱥ\x1c\x85<") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 9)))
        assert e.encode(text) == e.plain(text), text
        assert len(e.known) < 300 and len(e.before) < 300
    e = pack.Encoder(queries.tokenizer_path())
    e.encode("first, second")
    learn = e.learn_pieces
    monkeypatch.setattr(e, "learn_pieces", lambda pieces: (taken.extend(pieces), learn(pieces)))
    assert e.encode("Second first, second,") == e.plain("Second first, second,")
    assert taken == []  # all pieces were known
