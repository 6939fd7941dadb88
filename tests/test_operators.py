"""Small-fixture checks against plain loops and pandas definitions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions import rolling as R
from barlab.operators import align as A
from barlab.operators import backtest as B
from barlab.operators import examples as E
from barlab.operators import leaderboard as LB
from barlab.operators import quality as Q
from barlab.operators import recursive as RC
from barlab.operators import robust as RB
from barlab.operators import search as SE
from barlab.operators import signals as SG
from barlab.operators import specs as SP
from barlab.operators import votes as V
from barlab.operators.pairs import similar_pairs
from barlab.sources import files as FS
from barlab.sources import store as ST
from barlab.sources import vendor as VD


def days(n, start="2010-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def walk(n=400, seed=3):
    rng = np.random.default_rng(seed)
    return 100 * np.cumprod(1 + rng.normal(0.0003, 0.012, n))


@pytest.fixture(scope="module")
def bars(spark):
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": days(400), "close": walk(400, i)}) for i, s in enumerate("AB")])
    return spark.createDataFrame(pdf), pdf


def frame(df, cols):
    return df.toPandas().sort_values(["symbol", "ts"])[cols].to_numpy(dtype=float)


def test_wide_window_zscore_equals_pandas(spark, bars):
    df, pdf = bars
    got = frame(R.zscores(df, ["close"], 120, 60, ddof=1), ["close"])[:, 0]
    want = np.concatenate([((g - g.rolling(120, 60).mean()) / g.rolling(120, 60).std()).to_numpy() for _, g in pdf.groupby("symbol")["close"]])
    np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-9)


def test_percentile_rank_and_quantile_equal_pandas(spark, bars):
    df, pdf = bars
    x = df.withColumn("v", F.round("close", 0))
    got = frame(x.withColumns({"p": R.percentile_rank("v", 60, 20), "q": R.quantile("v", 60, 0.9, 20)}), ["p", "q"])
    v = pdf.assign(v=pdf["close"].round(0)).groupby("symbol")["v"]
    np.testing.assert_allclose(got[:, 0], np.concatenate([g.rolling(60, 20).rank(pct=True) for _, g in v]), equal_nan=True)
    np.testing.assert_allclose(got[:, 1], np.concatenate([g.rolling(60, 20).quantile(0.9) for _, g in v]), equal_nan=True)


def test_features_do_not_look_ahead(spark, bars):
    """Values at t stay the same when later rows are removed."""
    from barlab.operators import features as X

    df, _ = bars
    cut = days(400)[250]
    full = X.daily_features(df).where(F.col("ts") <= F.lit(cut)).drop("close")
    part = X.daily_features(df.where(F.col("ts") <= F.lit(cut))).drop("close")
    a = full.toPandas().sort_values(["symbol", "ts"]).drop(columns=["symbol", "ts"]).to_numpy(float)
    b = part.toPandas().sort_values(["symbol", "ts"]).drop(columns=["symbol", "ts"]).to_numpy(float)
    np.testing.assert_allclose(a, b, equal_nan=True)


def test_long_cash_matches_event_loop(spark, bars):
    df, pdf = bars
    run = B.long_cash(SG.ma_crossover(df, 5, 20), "signal", 0.001)
    got = run.toPandas().sort_values(["symbol", "ts"])
    trades = B.long_cash_trades(run).toPandas()
    for s, g in got.groupby("symbol"):
        close, sig = g["close"].to_numpy(), g["signal"].to_numpy()
        cash, units, eq, n = 10000.0, 0.0, [], 0
        for i, c in enumerate(close):
            target = sig[i - 1] if i else 0
            if target == 1 and units == 0:
                units, cash = cash / (c * 1.001), 0.0
            elif target == 0 and units > 0:
                cash, units, n = units * c * 0.999, 0.0, n + 1
            eq.append(cash + units * c)
        if units:
            eq[-1], n = units * close[-1] * 0.999, n + 1
        np.testing.assert_allclose(g["equity"], eq, rtol=1e-9)
        t = trades[trades["symbol"] == s]
        assert len(t) == n
        np.testing.assert_allclose(t["pnl"].sum(), eq[-1] - 10000.0, rtol=1e-9)


def test_single_asset_backtest_charges_first_turnover(spark):
    pdf = pd.DataFrame({"symbol": "S", "ts": days(4), "close": [100.0, 110.0, 99.0, 99.0], "signal": [1, -1, 0, 0]})
    out = B.returns_backtest(spark.createDataFrame(pdf), cost=0.01).orderBy("ts").toPandas()
    np.testing.assert_allclose(out["position"], [0, 1, -1, 0])
    np.testing.assert_allclose(out["strategy_return"], [0, 0.1 - 0.01, 0.1 - 0.02, -0.01])


def test_position_memory_rules():
    want = np.array([1, -1, 1, -1, -1, -1, 1, 1, 1, 1])
    assert RC.remember(want, 2, 1).tolist() == [1, 1, 1, 1, -1, -1, -1, 1, 1, 1]
    assert RC.remember(np.array([-1] * 3), 1, 5).tolist() == [-1, -1, -1]
    assert RC.remember(np.array([-1, 1, 1, 1, 1]), 1, 3).tolist() == [-1, -1, -1, 1, 1]


def test_recursions_equal_pandas(spark, bars):
    df, pdf = bars
    x = RC.technical(df.withColumn("r", R.pct_change("close")))
    got = frame(x, ["macd_line", "ewma_vol_20"])
    line = np.concatenate([(g.ewm(span=12, adjust=False, min_periods=12).mean() - g.ewm(span=26, adjust=False, min_periods=26).mean()) for _, g in pdf.groupby("symbol")["close"]])
    vol = np.concatenate([g.pct_change().ewm(span=20, adjust=False, min_periods=20).std() for _, g in pdf.groupby("symbol")["close"]])
    np.testing.assert_allclose(got[:, 0], line, equal_nan=True)
    np.testing.assert_allclose(got[:, 1], vol, equal_nan=True)


def test_bootstrap_paths_match_a_plain_loop(spark):
    n, samples = 70, 12
    v = np.random.default_rng(1).normal(0.002, 0.02, n)
    pdf = pd.DataFrame({"candidate_id": "c", "timestamp": days(n), "frequency": "weekly", "strategy_return": v})
    got = RB.bootstrap_samples(spark.createDataFrame(pdf), samples, batch=5).orderBy("sample").toPandas()
    import zlib

    key = zlib.crc32(b"c")
    for s in range(samples):
        path = []
        b = 0
        while len(path) < n:
            st = int(RB.starts(42, key, s, b, n))
            path += [v[(st + i) % n] for i in range(13)]
            b += 1
        path = np.array(path[:n])
        eq = np.cumprod(1 + path)
        assert got["cagr"][s] == pytest.approx(eq[-1] ** (52 / n) - 1)
        assert got["sharpe"][s] == pytest.approx(path.mean() / path.std(ddof=1) * math.sqrt(52))
        assert got["mdd"][s] == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())


def test_bootstrap_short_series_is_not_resampled(spark):
    pdf = pd.DataFrame({"candidate_id": "c", "timestamp": days(10), "frequency": "daily", "strategy_return": np.linspace(-0.01, 0.02, 10)})
    got = RB.bootstrap_samples(spark.createDataFrame(pdf), 5).toPandas()
    assert got["cagr"].nunique() == 1


def test_sharpe_confidence_formula(spark):
    from statistics import NormalDist

    v = np.random.default_rng(5).normal(0.001, 0.01, 300)
    pdf = pd.DataFrame({"candidate_id": "c", "timestamp": days(300), "source_method": "beam", "n_trials": 40, "strategy_return": v})
    got = RB.sharpe_confidence(spark.createDataFrame(pdf)).head()
    s = pd.Series(v)
    sr, sk, ku, n = s.mean() / s.std(), s.skew(), s.kurt() + 3, 300
    var = (1 - sk * sr + (ku - 1) / 4 * sr**2) / (n - 1)
    nd, g = NormalDist(), float(np.euler_gamma)
    emax = (1 - g) * nd.inv_cdf(1 - 1 / 40) + g * nd.inv_cdf(1 - 1 / (40 * math.e))
    assert got["psr"] == pytest.approx(round(nd.cdf(sr / math.sqrt(var)), 4))
    assert got["dsr"] == pytest.approx(round(nd.cdf((sr - emax) / math.sqrt(var)), 4))


def test_similar_pairs_across_tiles_equal_pandas(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.01, 60)
    series = {f"s{i}": base * (1 if i % 3 == 0 else 0) + rng.normal(0, 0.001 if i % 3 == 0 else 0.01, 60) for i in range(12)}
    wide = pd.DataFrame(series, index=days(60))
    wide.iloc[:20, 3] = np.nan
    long = wide.stack().rename("strategy_return").reset_index().set_axis(["ts", "candidate_id", "strategy_return"], axis=1)
    got = {(r.left_id, r.right_id) for r in similar_pairs(spark.createDataFrame(long), tile=4, min_jaccard=2.0).collect()}
    corr = wide.corr(min_periods=30)
    want = {tuple(sorted((a, b))) for a in corr for b in corr if a < b and abs(corr.loc[a, b]) >= 0.98}
    assert got == want and want


def test_components_follow_long_chains(spark):
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(30)], "candidate_id string")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)], "left_id string, right_id string")
    roots = {r.candidate_id: r.root for r in RB.components(nodes, edges).collect()}
    assert {roots[f"n{i:02d}"] for i in range(21)} == {"n00"}
    assert roots["n25"] == "n25"


def test_exact_duplicates_are_a_star(spark):
    f = spark.createDataFrame([(c, "x" if c in "abcd" else c) for c in "abcdef"], "candidate_id string, fingerprint string")
    assert sorted((r.left_id, r.right_id) for r in RB.exact_edges(f).collect()) == [("a", "b"), ("a", "c"), ("a", "d")]


def test_mean_pvalue_of_flat_series(spark):
    pdf = pd.DataFrame({"candidate_id": ["up"] * 4 + ["zero"] * 4, "x": [0.1] * 4 + [0.0] * 4})
    got = {r.candidate_id: r.mean_pvalue for r in RB.mean_pvalue(spark.createDataFrame(pdf), "x").collect()}
    assert got == {"up": 0.0, "zero": 1.0}


def test_numbered_is_dense_and_sorted(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("hot"))
    rows = SP.numbered(df, [F.col("hot"), F.col("v").desc()]).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(1000))
    assert [r["v"] for r in rows] == list(range(999, -1, -1))


def test_stage_shards_cover_the_grid(spark):
    df = spark.range(100).select(F.col("id").alias("v"))
    parts = [{r["v"] for r in SP.stage_shard(df, [F.col("v")], k, 8).collect()} for k in range(8)]
    assert set().union(*parts) == set(range(100)) and sum(map(len, parts)) == 100


def test_parallelism_counts_starts_before_ends(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    jobs = spark.createDataFrame([("a", t(0), t(10)), ("a", t(10), t(20)), ("b", t(5), t(6))], "method string, start timestamp, end timestamp")
    assert LB.max_parallel(jobs).head()["max_parallel"] == 2
    assert {r.method: r.max_parallel for r in LB.max_parallel(jobs, ("method",)).collect()} == {"a": 2, "b": 1}


def test_publication_lag_equals_business_days(spark):
    d = [x.date() for x in pd.date_range("2024-01-01", periods=14)]
    df = spark.createDataFrame([(x,) for x in d], "ts date")
    for n in (1, 5):
        got = [r[0] for r in df.select(A.business_day_shift("ts", n)).collect()]
        assert got == [(pd.Timestamp(x) + pd.offsets.BDay(n)).date() for x in d]


def test_align_drops_off_calendar_observations(spark):
    cal = spark.createDataFrame([("S", x) for x in days(4, "2024-01-04")], "symbol string, ts date")
    obs = spark.createDataFrame([(dt.date(2024, 1, 4), 1.0), (dt.date(2024, 1, 6), 9.0)], "ts date, value double")
    assert [r.value for r in A.align_ffill(cal, obs, ["value"]).orderBy("ts").collect()] == [1.0] * 4


def test_week_label_and_locked_rows(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),)], "ts date")
    assert [r[0] for r in df.select(E.week_end("ts")).collect()] == [dt.date(2024, 1, 5), dt.date(2024, 1, 12)]
    assert E.without_locked(df, "ts", "2024-01-06").count() == 1


def test_reversed_range_counts_missing_as_vote(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (None,)], "v double")
    vote = V.annual_vote(F.col("v"), F.lit("range"), F.lit(0.2), F.lit(0.8), F.lit(-1))
    assert [r[0] for r in df.select(vote).collect()] == [1.0, 0.0, 1.0]


def test_exposure_is_clipped_and_smoothed(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.0],)], "p array<double>")
    assert df.select(V.smooth(F.col("p"), F.lit(0.5))).head()[0] == [1.0, 0.0, 0.5]
    assert df.select(V.smooth(F.col("p"), F.lit(0.0))).head()[0] == [1.0, -1.0, 1.0]


def test_loader_rejects_bad_rows(spark, tmp_path):
    good = pd.DataFrame({"symbol": "S", "ts": days(3), "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 10.0})
    spark.createDataFrame(good).coalesce(1).write.option("header", True).csv(str(tmp_path / "good"))
    assert FS.read_bars(spark, str(tmp_path / "good")).count() == 3
    bad = good.assign(close=[1.5, -1.0, 1.5])
    spark.createDataFrame(bad).coalesce(1).write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="price_not_positive"):
        FS.read_bars(spark, str(tmp_path / "bad")).count()
    with pytest.raises(ValueError, match="missing columns"):
        Q.require_columns(spark.createDataFrame(good.drop(columns="close")), Q.BAR_COLUMNS)


def test_quotes_are_adjusted(spark):
    doc = '{"timestamp":[86400],"indicators":{"quote":[{"open":[100],"high":[110],"low":[90],"close":[100],"volume":[5]}],"adjclose":[{"adjclose":[50]}]}}'
    r = VD.bars_from_quotes(spark.createDataFrame([("S", doc)], "symbol string, payload string")).head()
    assert (r.open, r.high, r.low, r.close) == (50.0, 55.0, 45.0, 50.0)


def test_store_versions_and_tombstones(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("px", "S", v, d, 1.0) for v in ("v1", "v2") for d in days(3)], "library string, symbol string, version string, ts date, close double")
    ST.put(rows, root)
    with pytest.raises(ValueError, match="version exists"):
        ST.put(rows, root)
    assert {r.version for r in ST.read_latest(spark, root).collect()} == {"v2"}
    ST.tombstone(spark, root, "px", "S", "v2", "test")
    assert {r.version for r in ST.read_latest(spark, root, "px", "S").collect()} == {"v1"}
    assert ST.versions(spark, root).count() == 1 and ST.records(spark, root).count() == 2
    ST.put(rows.where("version = 'v2'"), root, replace=True)
    assert {r.version for r in ST.read_latest(spark, root).collect()} == {"v2"}


def test_search_proposals_are_reproducible_and_bounded(spark):
    cat = spark.range(40).select(F.col("id").alias("index"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit("|threshold|0.5|1|1")).alias("spec"))
    uni = F.array(F.lit("A"), F.lit("B"))
    one = SE.with_id(SE.random_candidates(cat, uni, 50, 3))
    two = SE.with_id(SE.random_candidates(cat.repartition(7), uni, 50, 3))
    assert {r.candidate_id for r in one.collect()} == {r.candidate_id for r in two.collect()}
    kids = SE.mutate(one, cat, 4, 9)
    r = kids.agg(F.max("intercept"), F.min("intercept"), F.max("scale"), F.min("scale"), F.max("smoothing"), F.min("smoothing"), F.max(F.size("specs"))).head()
    assert -0.95 <= r[1] <= r[0] <= 0.95 and 0.05 <= r[3] <= r[2] <= 1.75 and 0 <= r[5] <= r[4] <= 0.8 and r[6] <= 5
    assert SE.unseen(one, one).count() == 0


def test_weighted_draw_prefers_heavy_items(spark):
    w = spark.range(20).select(F.col("id").alias("index"), F.col("id").cast("string").alias("spec"), F.when(F.col("id") == 7, 1000.0).otherwise(1.0).alias("weight"))
    c = SE.random_candidates(w, F.array(F.lit("A")), 60, 3, weight="weight")
    assert c.where(F.array_contains("specs", "7")).count() > 50


def test_diversity_keeps_the_first_of_equals(spark):
    from barlab.operators import gates as GT

    rows = [("r", "a", 3.0, ["x", "y"], ["f"], 0.5, 10.0, 1.2, "01"), ("r", "b", 2.0, ["x", "y"], ["g"], 0.9, 90.0, 2.2, "10"), ("r", "c", 1.0, ["p", "q"], ["h"], 0.1, 60.0, 1.9, "11")]
    df = spark.createDataFrame(rows, "run string, candidate_id string, score double, features array<string>, families array<string>, long_fraction double, trades_per_year double, final_nav double, signature string")
    got = {r.candidate_id: r.verdict for r in GT.diversity(df).collect()}
    assert got == {"a": "accepted", "b": "feature_duplicate", "c": "accepted"}


def plain_diversity(rows, min_distance=0.15, min_behavior=0.02):
    """One loop over the rows of each run in score order."""
    kept, out = {}, {}
    for run, i, _, feats, fams, share, trades, nav, sig in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        mine, feats, fam, why = kept.setdefault(run, []), set(feats), tuple(sorted(set(fams))), "accepted"
        if any(1 - len(feats & f) / max(1, len(feats | f)) < min_distance for f, *_ in mine):
            why = "feature_duplicate"
        elif any(fam == g for _, g, *_ in mine):
            why = "feature_family_duplicate"
        elif any(sig == t or abs(share - a) + abs(trades - b) / 150 + abs(math.log(nav) - math.log(n)) / 5 < min_behavior for _, _, a, b, n, t in mine):
            why = "behavior_duplicate"
        else:
            mine.append((feats, fam, share, trades, nav, sig))
        out[i] = why
    return out


def test_diversity_equals_a_plain_loop(spark, monkeypatch):
    from barlab.operators import gates as GT

    monkeypatch.setattr(GT, "RUN_ROWS", 60)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(500):
        feats = sorted(rng.choice(list("abcdefgh"), rng.integers(1, 5), replace=False).tolist())
        fams = sorted({"xyzw"["abcdefgh".index(f) % 4] for f in feats})
        rows.append(("big" if k % 3 else f"run{k % 4}", f"c{k:03d}", float(rng.integers(0, 60)), feats, fams, float(rng.integers(0, 20)) / 20, float(rng.integers(1, 8) * 15), float(rng.integers(1, 5)), str(rng.integers(0, 40))))
    df = spark.createDataFrame(rows, "run string, candidate_id string, score double, features array<string>, families array<string>, long_fraction double, trades_per_year double, final_nav double, signature string")
    out = GT.diversity(df)
    assert out.columns == [*df.columns, "verdict"]
    got = {r.candidate_id: r.verdict for r in out.collect()}
    assert got == plain_diversity(rows) and len(set(got.values())) == 4
    assert GT.diversity(df.limit(0)).count() == 0


def test_recursions_equal_pandas(spark):
    """Long series, slow and fast decays, leading gaps, and a decay for each series."""
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": pd.bdate_range("2000-01-03", periods=n), "close": 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), "a": a}) for s, a in (("x", 0.9), ("y", 0.0), ("z", 0.05))])
    df = spark.createDataFrame(pdf)
    for span in (2, 20, 500):
        got = RC.ema(df, "close", span, out="e").orderBy("symbol", "ts").toPandas()["e"]
        want = pdf.groupby("symbol")["close"].transform(lambda v: v.ewm(span=span, adjust=False, min_periods=span).mean())  # noqa: B023
        np.testing.assert_allclose(got, want, rtol=1e-9)
    got = RC.ewma_vol(df.withColumn("r", R.pct_change("close")), "r", 20).orderBy("symbol", "ts").toPandas()["ewma_vol_20"]
    want = pdf.groupby("symbol")["close"].transform(lambda v: v.pct_change().ewm(span=20, adjust=False, min_periods=20).std())
    np.testing.assert_allclose(got, want, rtol=1e-7)
    got = RC.exposure_smoothing(df.withColumn("v", F.sin("close")), "v", "a", ("symbol",)).orderBy("symbol", "ts").toPandas()["smoothed"]
    want = []
    for _, g in pdf.groupby("symbol"):
        s = None
        for x, a in zip(np.sin(g["close"]), g["a"]):
            s = x if s is None else a * s + (1 - a) * x
            want.append(min(1.0, max(-1.0, s)))
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_daily_scores_equal_plain_backtests(spark):
    """Walk-forward rows of the search against a row-by-row walk in pandas."""
    from barlab.plans import daily as DL

    rng = np.random.default_rng(12)
    ts = pd.bdate_range("1995-01-02", "2000-12-29")
    pdf = pd.DataFrame({"symbol": "N", "ts": ts, "close": 50 * np.exp(np.cumsum(rng.normal(0.0025, 0.01, len(ts)))), "f1": rng.normal(size=len(ts)).cumsum() / 9, "f2": rng.normal(size=len(ts))})
    study = DL.Study(spark.createDataFrame(pdf), ("f1", "f2"))
    rows = [("spy_long_short_score", 2, 2, 5, "f1|zscore|0.00000000|60|-1;f2|threshold|0.10000000|0|1", 0.25, None, None, None, None),
            ("spy_long_short_always", 2, 1, 3, None, None, "f1|threshold|0.20000000|0|1", "f2|zscore|0.50000000|20|1", 1, 1),
            ("spy_long_short_always", 3, 3, 10, None, None, "f1|threshold|-0.10000000|0|-1", "f2|zscore|-0.50000000|20|-1;f1|zscore|0.00000000|60|1", 1, 1)]
    types = "rule string, combo_size int, confirm_days int, min_hold_days int, feature_specs string, score_threshold double, long_specs string, short_specs string, long_min_votes int, short_min_votes int"
    got = {(r.rule, r.combo_size): r for r in study.evaluate(spark.createDataFrame(rows, types)).collect()}

    def z(v, w):
        roll = v.rolling(w, min_periods=max(20, w // 4))
        return (v - roll.mean()) / roll.std(ddof=0).replace(0, np.nan)

    def votes(data, specs):
        out = 0
        for name, kind, level, w, way in (x.split("|") for x in specs.split(";")):
            v = data[name] if kind == "threshold" else z(data[name], int(w))
            out = out + ((v > float(level)) if int(way) > 0 else (v < float(level))).astype(int)
        return out

    def walk(data, r):
        if r[0] == "spy_long_short_score":
            parts = [x.split("|") for x in r[4].split(";")]
            score = sum(int(p[4]) * z(data[p[0]], int(p[3]) or 120) for p in parts) / math.sqrt(len(parts))
            want = np.where(score < -abs(r[5]), -1, 1)
        else:
            want = np.where((votes(data, r[7]) >= r[9]) & ~(votes(data, r[6]) >= r[8]), -1, 1)
        side = pd.Series(RC.remember(want, r[2], r[3]), index=data.index).shift(1).fillna(1)
        x = side * data["close"].pct_change().fillna(0) - side.diff().abs().fillna(side.abs()) * 0.0002
        nav = (1 + x).cumprod()
        mdd, years = (nav / nav.cummax() - 1).min(), len(data) / 252
        cagr = nav.iloc[-1] ** (1 / years) - 1
        return {"cagr": cagr, "mdd": mdd, "calmar": cagr / abs(mdd) if mdd < 0 else 0.0, "trades": (1 + (side.diff().abs() > 0).sum()) / years, "long": (side > 0).mean()}

    parts = {"train": pdf[pdf.ts <= "1998-12-31"], "validation": pdf[pdf.ts >= "1999-01-01"]}
    ran = 0
    for r in rows:
        row, m = got[r[0], r[1]], {p: walk(x.set_index("ts"), r) for p, x in parts.items()}
        for p in parts:
            assert [row[f"{p}_{c}"] for c in ("calmar", "cagr", "mdd")] == pytest.approx([m[p][c] for c in ("calmar", "cagr", "mdd")])
        assert (row.trades_per_year, row.long_fraction) == pytest.approx((m["train"]["trades"], m["train"]["long"]))
        early = m["train"]["calmar"] < 0.5 or m["train"]["mdd"] < -0.45 or not 4 <= m["train"]["trades"] <= 150
        low = {p: -999.0 if early else min(walk(x.iloc[k].set_index("ts"), r)["calmar"] for k in np.array_split(np.arange(len(x)), 6)) for p, x in parts.items()}
        ran += not early
        assert [row[f"{p}_block_min_calmar"] for p in parts] == pytest.approx(list(low.values()))
        want = 3 * m["train"]["calmar"] + m["validation"]["calmar"] + 0.8 * low["train"] + 0.4 * low["validation"] + row.robust_passes
        assert row.score == pytest.approx(want)
    assert ran


def test_audit_by_shuffles_equals_plain_loops(spark):
    """Permutation test, overfitting share and bootstrap summary of daily rows, one shuffle or sample at a time."""
    rng = np.random.default_rng(6)
    n, k = 260, 12
    pdf = pd.concat([pd.DataFrame({"candidate_id": c, "timestamp": pd.bdate_range("2000-01-03", periods=n), "position": rng.choice([-1.0, 0.0, 1.0], n), "next_return": rng.normal(0.001, 0.01, n)}) for c in "ab"])
    pdf["strategy_return"], pdf["frequency"] = pdf.position * pdf.next_return, "daily"
    df = spark.createDataFrame(pdf)

    def calmar(x):
        nav = np.cumprod(1 + x)
        mdd = min(0.0, (nav / np.maximum.accumulate(nav) - 1).min())
        return (nav[-1] ** (252 / len(x)) - 1) / abs(mdd) if mdd < -1e-12 else 999.0 if nav[-1] > 1 else 0.0

    def order(seed, j):
        keys = [((i * 7919 + j * 104729 + seed * 1299709) % 2147483647) * 48271 % 2147483647 * 48271 % 2147483647 for i in range(1, n + 1)]
        return sorted(range(n), key=lambda i: (keys[i], i)) if j else range(n)

    for c, g in pdf.groupby("candidate_id"):
        p, r = g.position.to_numpy(), g.next_return.to_numpy()
        scores = [round(calmar(p[list(order(101, j))] * r), 9) for j in range(k + 1)]
        got = RB.permutation_pvalue(df, k, 101).where(F.col("candidate_id") == c).head()
        assert got.pvalue == pytest.approx((sum(s >= scores[0] for s in scores[1:]) + 1) / (k + 1))
        lost = []
        for t in range(4):
            sides = []
            for j in range(k + 1):
                b = np.array_split(p[list(order(202, j))] * r, 4)
                b = b[t:] + b[:t]
                sides.append((round(calmar(np.concatenate(b[:2])), 9), round(calmar(np.concatenate(b[2:])), 9)))
            best = max(range(k + 1), key=lambda j: (sides[j][0], -j))
            lost.append(np.mean([o <= sides[best][1] for _, o in sides]) <= 0.5)
        assert RB.pbo(df, k, 4, 202).where(F.col("candidate_id") == c).head().pbo == pytest.approx(np.mean(lost))
    samples = RB.bootstrap_samples(df, 30, batch=7).toPandas()
    got = RB.bootstrap_summary(RB.bootstrap_samples(df, 30, batch=7)).toPandas().set_index("candidate_id")
    for c, g in samples.groupby("candidate_id"):
        assert got.loc[c, "bootstrap_cagr_p05"] == pytest.approx(np.quantile(g.cagr, 0.05)) and got.loc[c, "bootstrap_prob_cagr_positive"] == pytest.approx((g.cagr > 0).mean())


def test_ridge_matches_numpy(spark):
    from barlab.operators import ml as M

    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    y = x @ [0.5, -1.0, 2.0] + rng.normal(size=50) * 0.1
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y, id=range(50))
    out = M.ridge(spark.createDataFrame(pdf), list("abc"), "y", F.col("id") < 40, 1.0).orderBy("id").toPandas()
    w = np.linalg.solve(x[:40].T @ x[:40] + np.eye(3), x[:40].T @ y[:40])
    np.testing.assert_allclose(out["score"], x @ w, rtol=1e-9)
