"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.quality import MANIFEST_SQL, manifest
from barlab.functions import rolling as R
from barlab.operators import features as X
from barlab.operators import quality as Q
from barlab.plans import inputs as I
from barlab.plans import strategies as S
from barlab.registry import oracle, query
from barlab.sources import files as FS
from barlab.sources import store as ST
from barlab.sources import vendor as V


@query("bars_load", oracle("s:symbol d:ts f:open f:high f:low f:close f:volume", I.RAW_BARS, "SELECT * FROM raw_bars"))
def bars_load(spark, d):
    """Bars written as CSV and read back through the strict loader."""
    path = FS.scratch(spark, "bars")
    I.raw_bars(spark, d).select("symbol", "ts", *Q.BAR_COLUMNS).write.option("header", True).csv(path)
    return FS.read_bars(spark, path)


@query("bars_from_quotes", oracle("s:symbol d:ts f:open f:high f:low f:close f:volume", I.RAW_BARS,
    "SELECT symbol, ts, open * 0.5 AS open, high * 0.5 AS high, low * 0.5 AS low, close * 0.5 AS close, volume FROM raw_bars WHERE day(ts) <> 9"))
def bars_from_quotes(spark, d):
    b = I.raw_bars(spark, d)
    items = b.groupBy("symbol", F.year("ts").alias("y")).agg(F.array_sort(F.collect_list(F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "open", "high", "low", "close", "volume",
        F.when(F.dayofmonth("ts") != 9, F.col("close") * 0.5).alias("adj")))).alias("z"))
    z = lambda k: F.col(f"z.{k}").alias({"t": "timestamp"}.get(k, k))
    quote = F.struct(*[z(k) for k in ("open", "high", "low", "close", "volume")])
    ind = F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.col("z.adj").alias("adjclose"))).alias("adjclose"))
    payload = F.to_json(F.struct(F.col("z.t").alias("timestamp"), ind.alias("indicators")), {"ignoreNullFields": "false"})
    return V.bars_from_quotes(items.select("symbol", payload.alias("payload")))


@query("bars_from_vendor_csv", oracle("s:symbol s:timestamp f:open f:high f:low f:close f:volume", I.RAW_BARS,
    "SELECT symbol, strftime(ts, '%Y-%m-%d') AS timestamp, open, high, low, close, volume FROM raw_bars"))
def bars_from_vendor_csv(spark, d):
    b = I.raw_bars(spark, d).select(F.col("symbol").alias("Symbol"), F.col("ts").alias("Date"), F.col("open").alias("OPEN"),
        F.col("high").alias("High"), F.col("low").alias("LOW"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    return V.bars_from_vendor_csv(b)


@query("ratio_csv_parse", oracle("s:file d:ts f:ratio f:call f:put f:total", """
o AS (SELECT year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS ts, COUNT(*) FILTER (o_orderkey % 2 = 0) AS c, COUNT(*) FILTER (o_orderkey % 2 = 1) AS p, COUNT(*) AS n FROM orders GROUP BY 1, 2)""",
    "SELECT CAST(y AS VARCHAR) AS file, ts, CASE WHEN c > 0 THEN CAST(CAST(p AS DOUBLE) * 1000 / c AS BIGINT) / 1000.0 END AS ratio, c AS call, p AS put, n AS total FROM o"))
def ratio_csv_parse(spark, d):
    k = F.col("o_orderkey") % 2
    o = I.table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("string").alias("file"), F.to_date("o_orderdate").alias("ts")).agg(
        F.count_if(k == 0).alias("c"), F.count_if(k == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col("c") > 0, F.rint(F.col("p") * 1000.0 / F.col("c")).cast("bigint") / 1000.0)
    row = F.concat_ws(",", F.date_format("ts", "MM/dd/yyyy"), F.col("c").cast("string"), F.col("p").cast("string"), F.col("n").cast("string"),
                      F.coalesce(ratio.cast("string"), F.lit("")))
    body = o.select("file", (F.dayofyear("ts") + 10).alias("line_no"), row.alias("line"))
    head = o.select("file").distinct().select("file", F.inline(F.array(
        F.struct(F.lit(1).alias("line_no"), F.lit("volume and put/call report").alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.lit("Trade_date, Call ,PUT,Total,P/C Ratio").alias("line")))))
    return V.ratio_csv(head.unionByName(body))


@query("epu_date_build", oracle("d:ts i:n", "SELECT CAST(o_orderdate AS DATE) AS ts, COUNT(*) AS n FROM orders GROUP BY 1"))
def epu_date_build(spark, d):
    o = I.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return V.date_from_parts(o, "n")


@query("fred_series_parse", oracle("d:ts f:value", I.MACRO, "SELECT ts, value FROM macro WHERE month(ts) % 5 <> 0"))
def fred_series_parse(spark, d):
    m = I.macro_monthly(spark, d)
    text = F.when(F.month("ts") % 5 == 0, ".").otherwise(F.col("value").cast("string"))
    return V.series_values(m.select("ts", text.alias("value")), "value")


@query("valuation_build", oracle("d:ts f:cape f:earnings_yield f:pe_ttm f:eps_ttm f:dividend_yield", I.MACRO,
    "v AS (SELECT ts, value AS p, CASE WHEN month(ts) <> 6 THEN value / 20 END AS e, CASE WHEN month(ts) <> 6 THEN value / 50 END AS dv, CASE WHEN month(ts) <> 6 THEN value / 1e6 END AS c FROM macro)",
    "SELECT ts, c AS cape, e / p AS earnings_yield, p / nullif(e, 0) AS pe_ttm, e AS eps_ttm, dv / p AS dividend_yield FROM v WHERE month(ts) <> 6"))
def valuation_build(spark, d):
    ok = F.month("ts") != 6
    v = I.macro_monthly(spark, d).select("ts", F.col("value").alias("sp500"), F.when(ok, F.col("value") / 20).alias("earnings"),
        F.when(ok, F.col("value") / 50).alias("dividend"), F.when(ok, F.col("value") / 1e6).alias("cape"))
    return V.valuation(v)


@query("seed_json_load", oracle("s:spec s:feature i:position f:score",
    "s AS (SELECT p_brand || '|threshold|' || p_size AS spec, p_brand AS feature, p_partkey AS position, p_retailprice AS score FROM part)",
    "k AS (SELECT p_brand AS feature FROM part GROUP BY 1 HAVING 2 * SUM(p_size) >= 51 * COUNT(*))",
    "SELECT * FROM s WHERE feature IN (SELECT feature FROM k) QUALIFY row_number() OVER (PARTITION BY spec ORDER BY position) = 1"))
def seed_json_load(spark, d):
    part = I.table(spark, d, "part")
    path = FS.scratch(spark, "seeds")
    part.select(F.concat_ws("|", "p_brand", F.lit("threshold"), F.col("p_size").cast("string")).alias("spec"),
                F.col("p_partkey").alias("position"), F.col("p_retailprice").alias("score")).write.json(path)
    seeds = spark.read.schema("spec string, position bigint, score double").json(path)
    known = part.groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_size").alias("sizes"), F.count(F.lit(1)).alias("rows")).where("2 * sizes >= 51 * rows").select("feature")
    return FS.first_seed_per_spec(seeds, known).select("spec", "feature", "position", "score")


@query("manifest_load", oracle("s:feature s:source s:free", MANIFEST_SQL, "SELECT * FROM manifest"))
def manifest_load(spark, d):
    path = FS.scratch(spark, "manifest")
    manifest(spark, d).write.option("header", True).option("sep", ";").csv(path)
    return FS.read_manifest(spark, path).select("feature", "source", "free")


@query("leaderboard_files_read", oracle("s:stage i:rows f:best", "SELECT CAST(o_orderkey % 16 AS VARCHAR) AS stage, COUNT(*) AS rows, MAX(o_totalprice) AS best FROM orders GROUP BY 1"))
def leaderboard_files_read(spark, d):
    path = FS.scratch(spark, "boards")
    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 16).alias("stage"))
    FS.write_leaderboard(o, path, by="stage")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("candidate_id", T.LongType()), T.StructField("score", T.DoubleType())])
    b = FS.read_leaderboards(spark, path, schema)
    stage = F.regexp_extract("source_file", "stage=(\\d+)", 1)
    return b.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("rows"), F.max("score").alias("best"))


def _store(spark, d):
    """Store with v1 (to 1999) and v2 (all rows); v2 of symbol A is tombstoned."""
    root = FS.scratch(spark, "store")
    b = I.bars(spark, d).withColumn("library", F.lit("px"))
    v1 = b.where("year(ts) <= 1999").withColumn("version", F.lit("v1"))
    ST.put(v1.unionByName(b.withColumn("version", F.lit("v2"))), root)
    ST.tombstone(spark, root, "px", "A", "v2", "bad feed")
    return root


STORE_SQL = ["stored AS (SELECT 'px' AS library, symbol, 'v1' AS version, ts, close FROM bars WHERE year(ts) <= 1999 UNION ALL SELECT 'px', symbol, 'v2', ts, close FROM bars)",
    "recs AS (SELECT library, symbol, version, COUNT(*) AS n_rows, symbol = 'A' AND version = 'v2' AS tombstone FROM stored GROUP BY 1, 2, 3)"]


@query("series_put", oracle("s:library s:symbol s:version i:n_rows", I.BARS, STORE_SQL, "SELECT library, symbol, version, n_rows FROM recs"))
def series_put(spark, d):
    root = _store(spark, d)
    data = spark.read.parquet(f"{root}/data")
    return data.groupBy("library", "symbol", "version").agg(F.count(F.lit(1)).alias("n_rows"))


@query("series_read_latest", oracle("s:symbol s:version d:ts f:close", I.BARS, STORE_SQL,
    "SELECT symbol, version, ts, close FROM stored WHERE version = CASE symbol WHEN 'A' THEN 'v1' ELSE 'v2' END AND ts BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'"))
def series_read_latest(spark, d):
    return ST.read_latest(spark, _store(spark, d), "px", None, "1996-01-01", "2000-06-30").select("symbol", "version", "ts", "close")


@query("series_list_versions", oracle("s:library s:symbol s:version i:n_rows", I.BARS, STORE_SQL, "SELECT library, symbol, version, n_rows FROM recs WHERE NOT tombstone"))
def series_list_versions(spark, d):
    return ST.versions(spark, _store(spark, d)).select("library", "symbol", "version", "n_rows")


@query("series_list_records", oracle("s:library s:symbol s:version i:n_rows b:tombstone", I.BARS, STORE_SQL, "SELECT * FROM recs"))
def series_list_records(spark, d):
    return ST.records(spark, _store(spark, d)).select("library", "symbol", "version", "n_rows", "tombstone")


@query("series_tombstone", oracle("s:symbol s:version s:metadata", I.BARS, STORE_SQL, """SELECT symbol, version, '{"tombstone_reason":"bad feed"}' AS metadata FROM recs WHERE tombstone"""))
def series_tombstone(spark, d):
    return ST.records(spark, _store(spark, d)).where("tombstone").select("symbol", "version", "metadata")


@query("series_content_hash", oracle("s:symbol i:n_rows s:content_hash", I.BARS,
    "c AS (SELECT symbol, year(ts) AS y, COUNT(*) AS n, sha256(string_agg(strftime(ts, '%Y-%m-%d') || '=' || CAST(CAST(round(close * 1000000) AS BIGINT) AS VARCHAR), '|' ORDER BY ts)) AS h FROM bars GROUP BY 1, 2)",
    "SELECT symbol, SUM(n) AS n_rows, sha256(symbol || '/' || string_agg(h, '|' ORDER BY y)) AS content_hash FROM c GROUP BY 1"))
def series_content_hash(spark, d):
    return ST.content_hash(I.bars(spark, d), ("symbol",))


@query("backtest_sink")
def backtest_sink(spark, d):
    from barlab.operators import backtest as B

    path = FS.scratch(spark, "backtest")
    pos = X.add(I.bars(spark, d), {"signal": F.when(R.mean("close", 5) > R.mean("close", 20), 1).otherwise(0)})
    run = B.long_cash(pos, "signal", 0.0002)
    FS.write_backtest(B.metrics_basic(run, B.long_cash_trades(run)), B.long_cash_trades(run), run.select("symbol", "ts", "equity"), path)
    return spark.read.json(f"{path}/metrics")


@query("robustness_bundle_sink")
def robustness_bundle_sink(spark, d):
    from barlab.catalog.quality import universal_returns

    path = FS.scratch(spark, "bundle")
    q = Q.returns_quality(universal_returns(spark, d).withColumn("seq", F.col("timestamp")))
    summary = q.agg(F.count(F.lit(1)).alias("rows"), F.count_if("data_quality_pass").alias("passed"))
    names = FS.write_bundle({"data_quality": q, "pass": q.where("data_quality_pass"), "summary": summary}, path)
    return spark.read.option("header", True).csv(f"{path}/{names[1]}")
