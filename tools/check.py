"""Run registered queries and their oracles side by side and report mismatches.

usage: python tools/check.py [sf] [name-prefix-or-name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)
    return names, body


def _cell(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v!r}"


def compare(spark_df, con, sql):
    rows = [tuple(r) for r in spark_df.collect()]
    got = canonical(spark_df.columns, rows)
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(rows)
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(rows)
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if diff:
        return f"{len(diff)} rows differ of {len(rows)}; spark {diff[0][0]} | sql {diff[0][1]}", len(rows)
    return None, len(rows)


def main(argv):
    from barlab.catalog import load_all
    from barlab.registry import ORACLES, QUERIES
    from barlab.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    load_all()
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) or fn.__module_tag__ == w for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                err, n = compare(df, con, ORACLES[name])
            else:
                err, n = None, len(df.collect())
        except Exception as e:  # noqa: BLE001
            err, n = "ERROR " + str(e)[:1500].replace("\n", " "), -1
        el = time.time() - t0
        tag = "sql" if name in ORACLES else "rows"
        if err:
            bad += 1
            print(f"BAD  {name} [{tag}] {el:.1f}s: {err[:1200]}", flush=True)
        elif n == 0 or el > 6:
            print(f"warn {name} [{tag}] rows={n} {el:.1f}s", flush=True)
        elif wanted:
            print(f"ok   {name} [{tag}] rows={n} {el:.1f}s", flush=True)
    print("failures:", bad, flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
