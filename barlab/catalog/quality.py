"""Validation and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.features import BASE, DAILY_SQL
from barlab.functions import text as TX
from barlab.operators import align as A
from barlab.operators import examples as E
from barlab.operators import quality as Q
from barlab.plans import decisions as D
from barlab.plans import inputs as I
from barlab.plans import strategies as S
from barlab.registry import oracle
from barlab.registry import sharing_query as query


def dirty_bars(spark, d):
    """Raw bars with planted faults: negative closes, missing volumes and repeated days."""
    b = I.raw_bars(spark, d).withColumn("copy", F.lit(0))
    b = b.withColumns({
        "close": F.when(F.dayofyear("ts") % 97 == 0, -F.col("close")).otherwise(F.col("close")),
        "volume": F.when(F.dayofyear("ts") % 89 == 0, F.lit(None)).when(F.dayofyear("ts") % 83 == 0, -F.col("volume")).otherwise(F.col("volume")),
    })
    again = b.where(F.dayofmonth("ts") == 13).withColumns({"copy": F.lit(1), "close": F.col("close") * 1.01})
    return b.unionByName(again)


DIRTY = ["""dirty AS (
  WITH b AS (SELECT symbol, ts, open, high, low, CASE WHEN dayofyear(ts) % 97 = 0 THEN -close ELSE close END AS close,
     CASE WHEN dayofyear(ts) % 89 = 0 THEN NULL WHEN dayofyear(ts) % 83 = 0 THEN -volume ELSE volume END AS volume FROM raw_bars)
  SELECT *, 0 AS copy FROM b UNION ALL SELECT symbol, ts, open, high, low, close * 1.01, volume, 1 AS copy FROM b WHERE day(ts) = 13)"""]
REASON = """CASE WHEN COUNT(*) OVER (PARTITION BY symbol, ts) > 1 THEN 'duplicate_timestamp' WHEN volume IS NULL THEN 'not_numeric'
  WHEN close <= 0 THEN 'price_not_positive' WHEN volume < 0 THEN 'volume_negative' END"""


@query("bars_validate", oracle("i:rows i:bad_timestamp i:duplicate_timestamp i:not_numeric i:price_not_positive i:volume_negative", I.RAW_BARS, DIRTY,
    "x AS (SELECT *, COUNT(*) OVER (PARTITION BY symbol, ts) AS n FROM dirty)",
    """SELECT COUNT(*) AS rows, 0 AS bad_timestamp, COUNT(*) FILTER (n > 1) AS duplicate_timestamp, COUNT(*) FILTER (volume IS NULL) AS not_numeric,
       COUNT(*) FILTER (volume IS NOT NULL AND close <= 0) AS price_not_positive, COUNT(*) FILTER (close > 0 AND volume < 0) AS volume_negative FROM x"""))
def bars_validate(spark, d):
    return Q.validate(dirty_bars(spark, d))


@query("bars_quarantine", oracle("s:symbol d:ts i:copy f:close s:reason", I.RAW_BARS, DIRTY,
    f"SELECT symbol, ts, copy, close, {REASON} AS reason FROM dirty"))
def bars_quarantine(spark, d):
    return Q.quarantine(dirty_bars(spark, d)).select("symbol", "ts", "copy", "close", "reason")


@query("bars_adjust", oracle("s:symbol d:ts f:open f:high f:low f:close f:volume", I.RAW_BARS, DIRTY,
    "k AS (SELECT * FROM dirty QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY copy DESC) = 1)",
    "a AS (SELECT *, CASE WHEN day(ts) % 7 <> 0 THEN close * 0.5 END AS adj FROM k)",
    "SELECT symbol, ts, open * (adj / close) AS open, high * (adj / close) AS high, low * (adj / close) AS low, close * (adj / close) AS close, coalesce(volume, 0) AS volume FROM a WHERE adj IS NOT NULL"))
def bars_adjust(spark, d):
    x = dirty_bars(spark, d).withColumn("adj_close", F.when(F.dayofmonth("ts") % 7 != 0, F.col("close") * 0.5))
    return Q.adjust(x, ["copy"])


@query("columns_guard", oracle("s:symbol i:rows", I.RAW_BARS, "SELECT symbol, COUNT(*) AS rows FROM raw_bars GROUP BY 1"))
def columns_guard(spark, d):
    """Schema guard over raw bars; the guard itself fails on column names before any job runs."""
    b = I.raw_bars(spark, d)
    Q.require_columns(b, Q.BAR_COLUMNS, (*Q.BAR_COLUMNS, "symbol", "ts", "adj_close"), ("locked", "future"))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


def universal_returns(spark, d):
    """Strategy returns in the audit layout."""
    return I.shared(f"universal:{d}", lambda: _universal_returns(spark, d))


def _universal_returns(spark, d):
    r = S.strategy_returns(spark, d)
    base = I.returns(I.bars(spark, d)).where("symbol = 'N'").select("ts", F.col("r").alias("benchmark_return"))
    from barlab.functions import rolling as R

    by = ("candidate_id",)
    prev = F.coalesce(R.lag("exposure", 1, by), F.lit(0.0))
    return (
        r.join(base, "ts", "left")
        .withColumn("turnover", F.abs(F.col("exposure") - prev))
        .select(
            "candidate_id",
            F.lit("run_1").alias("run_id"),
            F.when(F.col("symbol") == "A", "beam").when(F.col("symbol") == "R", "manual").otherwise("genetic").alias("source_method"),
            F.col("ts").alias("timestamp"),
            F.lit("daily").alias("frequency"),
            "strategy_return",
            (F.col("symbol") == "R").alias("returns_are_net"),
            E.period_label(F.col("ts"), I.TRAIN_END, I.VALIDATION_END).alias("_p"),
            F.when(F.col("symbol") == "A", 50).when(F.col("symbol") == "R", 1).alias("n_trials"),
            "benchmark_return", "exposure", "turnover",
        )
        .withColumn("sample_role", F.when(F.col("_p") == "train", "is").when(F.col("_p") == "validation", "oos").otherwise("locked"))
        .drop("_p")
    )


UNI_SQL = [I.BARS, I.RETS, S.POS_SQL, S.SRET_SQL, ["""uni AS (SELECT s.candidate_id, 'run_1' AS run_id, s.symbol,
   CASE s.symbol WHEN 'A' THEN 'beam' WHEN 'R' THEN 'manual' ELSE 'genetic' END AS source_method, s.ts AS timestamp, 'daily' AS frequency,
   s.strategy_return, s.symbol = 'R' AS returns_are_net, CASE WHEN s.ts <= DATE '1998-12-31' THEN 'is' WHEN s.ts <= DATE '2000-12-31' THEN 'oos' ELSE 'locked' END AS sample_role,
   CASE s.symbol WHEN 'A' THEN 50 WHEN 'R' THEN 1 END AS n_trials, b.r AS benchmark_return, s.exposure,
   abs(s.exposure - coalesce(lag(s.exposure) OVER (PARTITION BY s.candidate_id ORDER BY s.ts), 0)) AS turnover
   FROM sret AS s LEFT JOIN rets AS b ON b.symbol = 'N' AND b.ts = s.ts)"""]]
UNI_SQL = [c for part in UNI_SQL for c in part]


@query("returns_quality", oracle("s:candidate_id s:frequency i:rows i:active_periods f:std f:max_single_period_profit_contribution b:data_quality_pass s:fail_reasons s:warnings", UNI_SQL,
    "u AS (SELECT *, CASE WHEN symbol = 'A' THEN 'weekly' WHEN symbol = 'R' THEN 'hourly' ELSE frequency END AS fr, CASE WHEN symbol = 'A' AND month(timestamp) > 2 THEN 0 WHEN symbol = 'R' AND day(timestamp) = 5 THEN -1.5 ELSE strategy_return END AS v FROM uni WHERE symbol <> 'A' OR year(timestamp) <= 1997)",
    """g AS (SELECT candidate_id, fr AS frequency, COUNT(v) AS rows, COUNT(*) FILTER (abs(v) > 1e-12) AS active_periods, stddev_samp(v) AS std,
        CASE WHEN SUM(v) FILTER (v > 0) > 0 THEN MAX(v) / SUM(v) FILTER (v > 0) ELSE 0 END AS c, COUNT(*) FILTER (v < -1) AS below, MIN(v) AS mn FROM u GROUP BY 1, 2)""",
    """SELECT candidate_id, frequency, rows, active_periods, std, c AS max_single_period_profit_contribution, fr = '' AS data_quality_pass, fr AS fail_reasons,
        CASE WHEN mn > 0 THEN 'all_returns_positive' ELSE '' END AS warnings FROM (SELECT *, array_to_string(list_filter([
         CASE WHEN frequency = 'hourly' THEN 'unknown_frequency:hourly' END, CASE WHEN below > 0 THEN 'return_below_minus_100pct' END,
         CASE WHEN frequency = 'daily' AND rows < 504 THEN 'too_few_periods:' || rows || '<504' WHEN frequency = 'weekly' AND rows < 156 THEN 'too_few_periods:' || rows || '<156' END,
         CASE WHEN frequency = 'daily' AND active_periods < 100 THEN 'too_few_active_periods:' || active_periods || '<100' WHEN frequency = 'weekly' AND active_periods < 40 THEN 'too_few_active_periods:' || active_periods || '<40' END,
         CASE WHEN rows > 1 AND std <= 1e-12 THEN 'zero_return_std' END,
         CASE WHEN c > 0.4 THEN 'single_period_profit_concentration:' || printf('%.6f', c) || '>0.400000' END], lambda x: x IS NOT NULL), ';') AS fr FROM g)"""))
def returns_quality(spark, d):
    u = universal_returns(spark, d).where("source_method <> 'beam' OR year(timestamp) <= 1997")
    u = u.withColumns({
        "frequency": F.when(F.col("source_method") == "beam", "weekly").when(F.col("source_method") == "manual", "hourly").otherwise(F.col("frequency")),
        "strategy_return": F.when((F.col("source_method") == "beam") & (F.month("timestamp") > 2), 0.0)
            .when((F.col("source_method") == "manual") & (F.dayofmonth("timestamp") == 5), -1.5).otherwise(F.col("strategy_return")),
        "seq": F.col("timestamp"),
    })
    return Q.returns_quality(u)


RATIO_LONG = ["ratio_long AS (SELECT symbol AS asset, ts, CASE WHEN year(ts) > 1995 OR symbol = 'N' THEN close END AS value FROM bars)"]


def ratio_long(spark, d):
    return I.bars(spark, d).select(F.col("symbol").alias("asset"), "ts",
        F.when((F.year("ts") > 1995) | (F.col("symbol") == "N"), F.col("close")).alias("value"))


@query("series_coverage", oracle("s:asset d:first_date d:last_date i:n", I.BARS, RATIO_LONG,
    "SELECT asset, MIN(ts) FILTER (value IS NOT NULL) AS first_date, MAX(ts) FILTER (value IS NOT NULL) AS last_date, COUNT(value) AS n FROM ratio_long GROUP BY 1"))
def series_coverage(spark, d):
    return Q.coverage(ratio_long(spark, d))


@query("assets_available", oracle("s:asset i:n", I.BARS, D.ASSETS_SQL,
    "SELECT symbol AS asset, COUNT(next_return) AS n FROM weekly_assets GROUP BY 1 HAVING COUNT(next_return) >= 104"))
def assets_available(spark, d):
    a = D.weekly_assets(spark, d).groupBy(F.col("symbol").alias("asset")).agg(F.count("next_return").alias("n"))
    return a.where("n >= 104")


FEATS = D.SPEC_FEATURES
WK_LONG = ["wk_long AS (" + " UNION ALL ".join(
    f"SELECT decision_date, period, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM weekly WHERE period <> 'locked'" for c in FEATS) + ")"]


@query("feature_usable", oracle("s:feature i:rows i:n i:u b:usable", I.BARS, I.RETS, DAILY_SQL, D.WEEKLY_SQL, WK_LONG,
    """SELECT feature, COUNT(*) AS rows, COUNT(value) AS n, COUNT(DISTINCT value) AS u,
       COUNT(value) >= greatest(52, floor(COUNT(*) * 0.2)) AND COUNT(DISTINCT value) >= 2 AS usable FROM wk_long WHERE period = 'train' GROUP BY 1"""))
def feature_usable(spark, d):
    w = D.weekly(spark, d).where("period = 'train'")
    return Q.usable_features(Q.melt(w, ["decision_date"], FEATS), 52, 2, 0.20)


@query("feature_columns", oracle("s:feature i:n", I.BARS, I.RETS, DAILY_SQL, " UNION ALL ".join(f"SELECT '{c}' AS feature, COUNT({c}) AS n FROM daily_features WHERE symbol = 'N'" for c in D.FEATURES)))
def feature_columns(spark, d):
    """Numeric columns outside the bar contract, with their value counts."""
    x = D.featured(spark, d)
    return Q.melt(x, ["ts"], Q.numeric_columns(x)).groupBy("feature").agg(F.count("value").alias("n"))


def manifest(spark, d):
    """Feature manifest derived from parts: names, source and notes."""
    p = I.table(spark, d, "part").groupBy("p_brand").agg(F.min("p_type").alias("t"), F.min("p_size").alias("z"))
    feats = F.array(*[F.lit(f) for f in D.FEATURES])
    n = F.pmod(F.regexp_extract("p_brand", "(\\d+)", 1).cast("int"), F.lit(8))
    return p.select(
        F.when(n < len(D.FEATURES), F.get(feats, n)).otherwise(F.lower(F.regexp_replace("p_brand", "#", "_"))).alias("feature"),
        F.when(n == 6, "no free public series").otherwise("daily").alias("source"),
        F.when(n == 1, "proxy").when(n == 2, "no").otherwise("si").alias("free"),
        F.lit("").alias("note"),
    ).distinct()


MANIFEST_SQL = [f"""manifest AS (SELECT DISTINCT CASE n WHEN 0 THEN '{D.FEATURES[0]}' WHEN 1 THEN '{D.FEATURES[1]}' WHEN 2 THEN '{D.FEATURES[2]}' WHEN 3 THEN '{D.FEATURES[3]}'
   WHEN 4 THEN '{D.FEATURES[4]}' WHEN 5 THEN '{D.FEATURES[5]}' ELSE lower(replace(p_brand, '#', '_')) END AS feature,
   CASE WHEN n = 6 THEN 'no free public series' ELSE 'daily' END AS source, CASE n WHEN 1 THEN 'proxy' WHEN 2 THEN 'no' ELSE 'si' END AS free
   FROM (SELECT p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 8 AS n FROM part))"""]
AN_LONG = ["an_long AS (" + " UNION ALL ".join(
    f"SELECT target_year, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM annual WHERE symbol = 'N'" for c in D.FEATURES) + ")"]
# training values and different ones from which an annual feature is usable (fixed values)
LEAST_VALUES, LEAST_DISTINCT = 8, 4
AUDIT_SQL = ["""audit AS (SELECT m.feature, m.source, m.free, COUNT(a.value) AS non_null_years, COUNT(a.value) / CAST((SELECT COUNT(*) FROM annual WHERE symbol = 'N') AS DOUBLE) AS coverage,
   MIN(a.target_year) FILTER (a.value IS NOT NULL) AS first_year, MAX(a.target_year) FILTER (a.value IS NOT NULL) AS last_year,
   COUNT(a.value) FILTER (a.target_year <= 1998) AS train_n, COUNT(a.value) FILTER (a.target_year IN (1999, 2000)) AS validation_n,
   COUNT(DISTINCT a.value) FILTER (a.target_year <= 1998) AS unique_train FROM manifest AS m LEFT JOIN an_long AS a ON a.feature = m.feature GROUP BY 1, 2, 3)""",
   """audit_q AS (SELECT *, CASE WHEN non_null_years = 0 THEN CASE WHEN source LIKE '%no free public series%' THEN 'sin_datos_publicos_fiables' ELSE 'sin_datos' END
   WHEN free LIKE '%proxy%' THEN 'proxy' WHEN free LIKE '%no%' OR first_year > 1996 THEN 'parcial' ELSE 'buena' END AS quality,
   train_n >= 8 AND unique_train >= 4 AS usable FROM audit)"""]


def feature_audit(spark, d):
    """Manifest against examples: coverage, spans, quality label and usability."""
    an = D.annual(spark, d).where("symbol = 'N'")
    long = Q.melt(an, ["target_year"], D.FEATURES)
    y, has = F.col("target_year"), F.col("value").isNotNull()
    g = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.count(F.lit(1)).alias("total"),
        F.min(F.when(has, y)).alias("first_year"), F.max(F.when(has, y)).alias("last_year"),
        F.count_if(has & (y <= 1998)).alias("train_n"), F.count_if(has & y.between(1999, 2000)).alias("validation_n"),
        F.count_distinct(F.when(y <= 1998, F.col("value"))).alias("unique_train"))
    j = manifest(spark, d).join(F.broadcast(g), "feature", "left").fillna(0, ["n", "train_n", "validation_n", "unique_train"])
    return j.select(
        "feature", F.col("n").alias("non_null_years"), F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("coverage"),
        "first_year", "last_year", "train_n", "validation_n", "unique_train",
        Q.feature_quality(F.col("n"), F.col("first_year"), F.col("free"), F.col("note"), F.col("source"), 1996).alias("quality"),
        ((F.col("train_n") >= LEAST_VALUES) & (F.col("unique_train") >= LEAST_DISTINCT)).alias("usable"))


@query("feature_coverage_audit", oracle("s:feature i:non_null_years f:coverage i:first_year i:last_year i:train_n i:validation_n i:unique_train s:quality b:usable",
    I.BARS, I.RETS, DAILY_SQL, D.ANNUAL_SQL, MANIFEST_SQL, AN_LONG, AUDIT_SQL, "SELECT * FROM audit_q"))
def feature_coverage_audit(spark, d):
    return feature_audit(spark, d)


@query("feature_audit_summary", oracle("s:quality i:features i:usable", I.BARS, I.RETS, DAILY_SQL, D.ANNUAL_SQL, MANIFEST_SQL, AN_LONG, AUDIT_SQL,
    "SELECT quality, COUNT(*) AS features, COUNT(*) FILTER (usable) AS usable FROM audit_q GROUP BY 1"))
def feature_audit_summary(spark, d):
    return feature_audit(spark, d).groupBy("quality").agg(F.count(F.lit(1)).alias("features"), F.count_if("usable").alias("usable"))


@query("feature_catalog_audit", oracle("s:family i:features i:specs",
    "f AS (SELECT p_brand, p_type, lower(p_name) || '_ret_' || p_size AS feature FROM part)",
    "g AS (SELECT feature, COUNT(*) AS specs FROM f GROUP BY 1)",
    f"SELECT {TX.PANEL_FAMILY_SQL.format(x='feature')} AS family, COUNT(*) AS features, SUM(specs) AS specs FROM g GROUP BY 1"))
def feature_catalog_audit(spark, d):
    f = I.table(spark, d, "part").select(F.concat(F.lower("p_name"), F.lit("_ret_"), F.col("p_size").cast("string")).alias("feature"))
    g = f.groupBy("feature").agg(F.count(F.lit(1)).alias("specs"))
    return g.groupBy(TX.panel_family(F.col("feature")).alias("family")).agg(F.count(F.lit(1)).alias("features"), F.sum("specs").alias("specs"))


@query("panel_audit", oracle("i:rows_daily i:rows_weekly i:assets b:enough_assets", I.BARS, BASE,
    f"SELECT COUNT(DISTINCT ts) AS rows_daily, COUNT(DISTINCT {D.WEEK_END}) AS rows_weekly, COUNT(DISTINCT symbol) FILTER (symbol <> 'N') AS assets, COUNT(DISTINCT symbol) FILTER (symbol <> 'N') >= 2 AS enough_assets FROM ratios"))
def panel_audit(spark, d):
    r = A.benchmark_ratio(I.bars(spark, d), I.BENCHMARK)
    other = F.when(F.col("symbol") != I.BENCHMARK, F.col("symbol"))
    return r.agg(F.count_distinct("ts").alias("rows_daily"), F.count_distinct(E.week_end("ts")).alias("rows_weekly"),
                 F.count_distinct(other).alias("assets")).withColumn("enough_assets", F.col("assets") >= 2)


@query("split_train_validation", oracle("s:symbol s:part i:rows d:first_ts d:last_ts", I.BARS,
    "x AS (SELECT *, CASE WHEN ts <= DATE '1998-12-31' THEN 'train' WHEN ts BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' THEN 'validation' END AS part FROM bars)",
    "SELECT symbol, part, COUNT(*) AS rows, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM x WHERE part IS NOT NULL GROUP BY 1, 2"))
def split_train_validation(spark, d):
    x = S.split_periods(I.bars(spark, d))
    return x.groupBy("symbol", F.col("period").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("label_period", oracle("s:period i:rows", I.BARS, I.RETS, DAILY_SQL, D.WEEKLY_SQL, "SELECT period, COUNT(*) AS rows FROM weekly GROUP BY 1"))
def label_period(spark, d):
    return D.weekly(spark, d).groupBy("period").agg(F.count(F.lit(1)).alias("rows"))


@query("without_locked", oracle("d:decision_date d:target_end s:period", I.BARS, I.RETS, DAILY_SQL, D.WEEKLY_SQL,
    "SELECT decision_date, target_end, period FROM weekly WHERE target_end < DATE '2001-01-01'"))
def without_locked(spark, d):
    return E.without_locked(D.weekly(spark, d), "target_end", I.LOCKED_START).select("decision_date", "target_end", "period")


@query("result_nonempty", oracle("s:symbol i:rows", I.BARS, "SELECT symbol, COUNT(*) AS rows FROM bars GROUP BY 1"))
def result_nonempty(spark, d):
    return Q.nonempty(I.bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")), "bars")


@query("panel_split", oracle("s:symbol d:ts f:close f:adj_close f:feature_count_nonnull", I.BARS, I.RETS, DAILY_SQL,
    "SELECT symbol, ts, close, close AS adj_close, " + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in D.FEATURES) + " AS feature_count_nonnull FROM daily_features WHERE symbol = 'N'"))
def panel_split(spark, d):
    x = D.featured(spark, d)
    prices, feats = Q.split_columns(x)
    if "adj_close" not in prices:
        x = x.withColumn("adj_close", F.col("close"))
    n = sum((F.col(c).isNotNull().cast("int") for c in feats), F.lit(0)).cast("double")
    return x.select("symbol", "ts", *prices, "adj_close", n.alias("feature_count_nonnull"))
