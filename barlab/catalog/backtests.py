"""Backtests, metrics and candidate evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.catalog.features import CUM, G, O, PCT
from barlab.catalog.quality import UNI_SQL, WK_LONG, universal_returns
from barlab.catalog.recursions import recursive
from barlab.catalog.signals_q import AN_ALL, AV_SQL, CEXP, FEAT, REGIME_SQL, VOTE_SQL, annual_predictions, day_votes, regime
from barlab.catalog.specs_q import MO_LONG
from barlab.functions import rolling as R
from barlab.operators import backtest as B
from barlab.operators import examples as E
from barlab.operators import gates as GT
from barlab.operators import signals as SG
from barlab.operators import specs as SP
from barlab.plans import decisions as D
from barlab.plans import inputs as I
from barlab.plans import rulebook as RB
from barlab.plans import strategies as S
from barlab.plans import sweeps as SW
from barlab.registry import oracle
from barlab.registry import sharing_query as query

COST = 0.0002
SIG_SQL = [f"sg AS (SELECT symbol, ts, close, CASE WHEN {G('AVG(close) {w}', 'close', 5)} > {G('AVG(close) {w}', 'close', 20)} THEN 1 ELSE 0 END AS signal FROM bars)"]


def crossing(spark, d):
    return SG.ma_crossover(I.bars(spark, d), 5, 20)


LC_SQL = [*I.BARS, *SIG_SQL,
    f"lc1 AS (SELECT *, coalesce(lag(signal) OVER {O}, 0) AS position, lead(ts) OVER {O} IS NULL AS fin FROM sg)",
    f"lc2 AS (SELECT *, coalesce(lag(position) OVER {O}, 0) AS prev, close / lag(close) OVER {O} AS mv FROM lc1)",
    f"""lc3 AS (SELECT *, (CASE WHEN position = 1 AND prev = 0 THEN 1 / (1 + {COST}e0) WHEN position = 1 THEN mv WHEN prev = 1 THEN mv * (1 - {COST}e0) ELSE 1e0 END)
       * (CASE WHEN fin AND position = 1 THEN 1 - {COST}e0 ELSE 1e0 END) AS step FROM lc2)""",
    f"lc AS (SELECT *, 10000 * product(step) OVER {CUM} AS equity, CASE WHEN position = 1 OR prev = 1 THEN SUM(CASE WHEN position = 1 AND prev = 0 THEN 1 ELSE 0 END) OVER {CUM} END AS trade_id FROM lc3)",
    f"""lct0 AS (SELECT symbol, trade_id, MIN(ts) AS entry_time, MAX(ts) AS exit_time, arg_min(close, ts) * (1 + {COST}e0) AS entry_price, arg_max(close, ts) * (1 - {COST}e0) AS exit_price, arg_max(equity, ts) AS exit_equity
       FROM lc WHERE trade_id IS NOT NULL GROUP BY 1, 2)""",
    "lct AS (SELECT *, (exit_price / entry_price - 1) * 100 AS return_pct, exit_equity - coalesce(lag(exit_equity) OVER (PARTITION BY symbol ORDER BY trade_id), 10000) AS pnl, exit_equity - 10000 AS cum_pnl FROM lct0)",
]


@query("backtest_long_cash", oracle("s:symbol d:ts i:position f:equity", LC_SQL, "SELECT * FROM lc"))
def backtest_long_cash(spark, d):
    return B.long_cash(crossing(spark, d), "signal", COST).select("symbol", "ts", "position", "equity")


@query("long_cash_trades", oracle("s:symbol i:trade_id d:entry_time d:exit_time f:entry_price f:exit_price f:return_pct f:pnl f:cum_pnl f:exit_equity", LC_SQL, "SELECT * FROM lct"))
def long_cash_trades(spark, d):
    return B.long_cash_trades(B.long_cash(crossing(spark, d), "signal", COST)).select(
        "symbol", "trade_id", "entry_time", "exit_time", "entry_price", "exit_price", "return_pct", "pnl", "cum_pnl", "exit_equity")


RB_SQL = [*I.BARS, *SIG_SQL,
    f"rb1 AS (SELECT symbol, ts, close, signal, CAST(coalesce(lag(CASE WHEN signal = 1 THEN 1 ELSE -1 END) OVER {O}, 0) AS DOUBLE) AS position, coalesce(close / lag(close) OVER {O} - 1, 0) AS r FROM sg)",
    f"rb2 AS (SELECT *, coalesce(abs(position - lag(position) OVER {O}), abs(position)) AS turnover FROM rb1)",
    f"rb3 AS (SELECT *, position * r - turnover * {COST}e0 AS strategy_return FROM rb2)",
    f"rb AS (SELECT *, 10000 * product(1 + strategy_return) OVER {CUM} AS equity FROM rb3)",
]


def long_short_run(spark, d):
    x = crossing(spark, d).withColumn("signal", F.when(F.col("signal") == 1, 1).otherwise(-1))
    return B.returns_backtest(x, cost=COST)


@query("backtest_returns", oracle("s:symbol d:ts f:position f:turnover f:strategy_return f:equity", RB_SQL, "SELECT * FROM rb"))
def backtest_returns(spark, d):
    return long_short_run(spark, d).select("symbol", "ts", "position", "turnover", "strategy_return", "equity")


RG_SQL = [*FEAT, *VOTE_SQL, *REGIME_SQL,
    f"ar AS (SELECT symbol, ts, coalesce(close / lag(close) OVER {O} - 1, 0) AS r FROM bars)",
    "rgr AS (SELECT 'book' AS symbol, g.ts, g.asset, coalesce(a.r, 0) AS ar FROM regime AS g LEFT JOIN ar AS a ON a.symbol = g.asset AND a.ts = g.ts)",
    f"""rgx AS (SELECT *, coalesce(lag(ar) OVER {O}, 0) - (CASE WHEN lag(asset) OVER {O} = asset THEN 0 ELSE 1 END) * {COST}e0 AS strategy_return FROM rgr)""",
    f"rge AS (SELECT *, 10000 * product(1 + strategy_return) OVER {CUM} AS equity FROM rgx)",
]


def regime_run(spark, d):
    r = I.returns(I.bars(spark, d)).select("ts", F.col("symbol").alias("asset"), F.col("r"))
    g = regime(spark, d).join(r, ["ts", "asset"], "left").select(F.lit("book").alias("symbol"), "ts", "asset", F.coalesce("r", F.lit(0.0)).alias("ar"))
    return B.regime_backtest(g, "asset", "ar", COST)


@query("backtest_regime", oracle("s:symbol d:ts s:asset f:strategy_return f:equity", RG_SQL, "SELECT * FROM rge"))
def backtest_regime(spark, d):
    return regime_run(spark, d).select("symbol", "ts", "asset", "strategy_return", "equity")


def tp_sql(src, out, key="symbol"):
    o = f"(PARTITION BY {key} ORDER BY ts)"
    return [
        f"{out}1 AS (SELECT *, CAST(sign(position) AS INTEGER) AS st, lead(ts) OVER {o} AS nt, lead(close) OVER {o} AS nc FROM {src})",
        f"{out}2 AS (SELECT *, CASE WHEN lag(st) OVER {o} = st THEN 0 ELSE 1 END AS chg FROM {out}1)",
        f"{out}3 AS (SELECT *, SUM(chg) OVER (PARTITION BY {key} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM {out}2)",
        f"""{out}4 AS (SELECT {key}, isl, MIN(st) AS side, MIN(ts) AS entry_time, arg_min(close, ts) AS entry_price, arg_max(coalesce(nt, ts), ts) AS exit_time, arg_max(coalesce(nc, close), ts) AS exit_price FROM {out}3 WHERE st <> 0 GROUP BY {key}, isl)""",
        f"""{out} AS (SELECT *, side * (exit_price / entry_price - 1) AS ret, 10000 * product(1 + side * (exit_price / entry_price - 1)) OVER (PARTITION BY {key} ORDER BY entry_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS exit_equity FROM {out}4)""",
    ]


@query("trades_from_position", oracle("s:symbol i:side d:entry_time d:exit_time f:entry_price f:exit_price f:pnl f:return_pct f:exit_equity", RB_SQL, tp_sql("rb", "tp"),
    "SELECT *, exit_equity - 10000 AS pnl, ret * 100 AS return_pct FROM tp"))
def trades_from_position(spark, d):
    return B.trades_from_position(long_short_run(spark, d))


@query("trades_from_state", oracle("s:symbol s:state d:entry_time d:exit_time f:entry_price f:exit_price f:pnl f:return_pct", RG_SQL,
    f"t1 AS (SELECT *, lead(ts) OVER {O} AS nt, lead(equity) OVER {O} AS ne, CASE WHEN lag(asset) OVER {O} = asset THEN 0 ELSE 1 END AS chg FROM rge)",
    f"t2 AS (SELECT *, SUM(chg) OVER {CUM} AS isl FROM t1)",
    "t3 AS (SELECT symbol, isl, MIN(asset) AS state, MIN(ts) AS entry_time, arg_min(equity, ts) AS entry_price, arg_max(coalesce(nt, ts), ts) AS exit_time, arg_max(coalesce(ne, equity), ts) AS exit_price FROM t2 GROUP BY 1, 2)",
    "SELECT *, exit_price - entry_price AS pnl, (exit_price / entry_price - 1) * 100 AS return_pct FROM t3"))
def trades_from_state(spark, d):
    return B.trades_from_state(regime_run(spark, d), "asset")


@query("metrics_basic", oracle("s:symbol f:initial_cash f:final_equity f:total_return_pct f:max_drawdown_pct f:sharpe f:trade_count f:win_rate_pct f:profit_factor f:score", LC_SQL,
    f"e1 AS (SELECT symbol, ts, equity, equity / lag(equity) OVER {O} - 1 AS ret, equity / MAX(equity) OVER {CUM} - 1 AS dd FROM lc)",
    "e2 AS (SELECT symbol, arg_max(equity, ts) AS final_equity, MIN(dd) * 100 AS max_drawdown_pct, AVG(ret) / stddev_pop(ret) * sqrt(252.0) AS sharpe FROM e1 GROUP BY 1)",
    """tt AS (SELECT symbol, COUNT(*) AS trade_count, AVG(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) * 100 AS win_rate_pct, CASE WHEN COUNT(*) FILTER (pnl < 0) = 0 THEN coalesce(SUM(pnl) FILTER (pnl > 0), 0)
       ELSE coalesce(SUM(pnl) FILTER (pnl > 0), 0) / -SUM(pnl) FILTER (pnl < 0) END AS profit_factor FROM lct GROUP BY 1)""",
    "SELECT *, 10000 AS initial_cash, (final_equity / 10000 - 1) * 100 AS total_return_pct, (final_equity / 10000 - 1) * 100 + max_drawdown_pct + sharpe AS score FROM e2 JOIN tt USING (symbol)"))
def metrics_basic(spark, d):
    run = B.long_cash(crossing(spark, d), "signal", COST)
    return B.metrics_basic(run, B.long_cash_trades(run))


@query("metrics_survival", oracle("s:symbol i:rows f:final_equity f:mdd f:active_fraction f:cagr f:calmar f:trades_per_year", RB_SQL, tp_sql("rb", "tp"),
    f"e1 AS (SELECT symbol, ts, equity, coalesce(equity / lag(equity) OVER {O} - 1, 0) AS ret, equity / MAX(equity) OVER {CUM} - 1 AS dd FROM rb)",
    "e2 AS (SELECT symbol, COUNT(*) AS rows, arg_max(equity, ts) AS final_equity, MIN(dd) AS mdd, AVG(CASE WHEN ret <> 0 THEN 1e0 ELSE 0e0 END) AS active_fraction FROM e1 GROUP BY 1)",
    "e3 AS (SELECT *, pow(final_equity / 10000, 252e0 / rows) - 1 AS cagr FROM e2)",
    "SELECT e3.*, CASE WHEN mdd < 0 THEN cagr / abs(mdd) ELSE 0 END AS calmar, (SELECT COUNT(*) FROM tp WHERE tp.symbol = e3.symbol) / (rows / 252e0) AS trades_per_year FROM e3"))
def metrics_survival(spark, d):
    run = long_short_run(spark, d)
    return B.metrics_survival(run, B.trades_from_position(run))


WEEK_RET = [f"wr AS (SELECT symbol, {D.WEEK_END} AS ts, product(1 + coalesce(r, 0)) - 1 AS x FROM rets GROUP BY 1, 2)"]


def week_returns(spark, d):
    r = I.returns(I.bars(spark, d))
    return r.groupBy("symbol", E.week_end("ts").alias("ts")).agg((F.product(1.0 + F.coalesce("r", F.lit(0.0))) - 1.0).alias("x"))


@query("metrics_period", oracle("s:symbol i:periods f:mdd f:cagr f:calmar f:sharpe b:has_drawdown", I.BARS, I.RETS, WEEK_RET,
    f"n AS (SELECT *, product(1 + x) OVER {CUM} AS nav FROM wr)", f"dd AS (SELECT *, nav / MAX(nav) OVER {CUM} - 1 AS dd FROM n)",
    "g AS (SELECT symbol, COUNT(*) AS periods, arg_max(nav, ts) AS f, MIN(dd) AS mdd, AVG(x) AS m, stddev_samp(x) AS s FROM dd GROUP BY 1)",
    "h AS (SELECT *, CASE WHEN f > 0 THEN pow(f, 52e0 / periods) - 1 ELSE -1 END AS cagr FROM g)",
    "SELECT *, CASE WHEN mdd < 0 THEN cagr / abs(mdd) END AS calmar, CASE WHEN s > 1e-12 THEN m / s * sqrt(52e0) ELSE 0 END AS sharpe, mdd < 0 AS has_drawdown FROM h"))
def metrics_period(spark, d):
    return B.metrics_period(week_returns(spark, d), "x", ["symbol"], 52.0)


@query("metrics_next_returns", oracle("s:symbol i:periods f:final_nav f:mdd i:trades f:long_fraction f:cagr f:calmar f:sharpe", I.BARS, SIG_SQL,
    f"x AS (SELECT symbol, ts, CASE WHEN signal = 1 THEN 1e0 ELSE -1e0 END AS p, lead(close) OVER {O} / close - 1 AS nr FROM sg)",
    f"y AS (SELECT *, coalesce(p * nr, 0) AS v, CASE WHEN lag(p) OVER {O} <> p THEN 1 ELSE 0 END AS flip FROM x)",
    f"n AS (SELECT *, product(1 + v) OVER {CUM} AS nav FROM y)", f"dd AS (SELECT *, nav / MAX(nav) OVER {CUM} - 1 AS dd FROM n)",
    "g AS (SELECT symbol, COUNT(*) AS periods, arg_max(nav, ts) AS final_nav, MIN(dd) AS mdd, SUM(flip) AS trades, AVG(CASE WHEN p > 0 THEN 1e0 ELSE 0e0 END) AS long_fraction, AVG(v) AS m, stddev_pop(v) AS s FROM dd GROUP BY 1)",
    "h AS (SELECT *, CASE WHEN final_nav > 0 THEN pow(final_nav, 252e0 / periods) - 1 ELSE -1 END AS cagr FROM g)",
    "SELECT *, CASE WHEN mdd < -1e-12 THEN cagr / abs(mdd) ELSE 999 END AS calmar, m / s * sqrt(252e0) AS sharpe FROM h"))
def metrics_next_returns(spark, d):
    x = crossing(spark, d).withColumns({"p": F.when(F.col("signal") == 1, 1.0).otherwise(-1.0), "nr": R.ratio(R.lead("close"), "close") - 1.0})
    return B.metrics_next_returns(x, "p", "nr", ["symbol"])


@query("metrics_full", oracle("s:symbol i:n_periods_raw i:n_periods_finite f:cagr f:mdd f:calmar f:mar f:sharpe f:sortino f:skew f:kurtosis f:win_rate f:profit_factor f:final_nav", I.BARS, I.RETS,
    f"n AS (SELECT *, product(1 + coalesce(r, 0)) OVER {CUM} AS nav FROM rets)", f"dd AS (SELECT *, nav / MAX(nav) OVER {CUM} - 1 AS dd FROM n)",
    """g AS (SELECT symbol, COUNT(*) AS nr, COUNT(r) AS nf, arg_max(nav, ts) AS f, MIN(dd) AS mdd, AVG(r) AS m, stddev_pop(r) AS s, stddev_pop(r) FILTER (r < 0) AS ds,
       AVG(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END) AS w, SUM(r) FILTER (r > 0) AS gain, -SUM(r) FILTER (r < 0) AS loss FROM dd GROUP BY 1)""",
    "k AS (SELECT rets.symbol, AVG(pow((r - m) / s, 3)) AS sk, AVG(pow((r - m) / s, 4)) AS ku FROM rets JOIN g USING (symbol) GROUP BY 1)",
    "h AS (SELECT *, pow(f, 252e0 / nr) - 1 AS c FROM g JOIN k USING (symbol))",
    """SELECT symbol, nr AS n_periods_raw, nf AS n_periods_finite, round(c * 100, 4) AS cagr, round(mdd * 100, 4) AS mdd, round(c / abs(mdd), 4) AS calmar, round(c / abs(mdd), 4) AS mar,
       round(m / s * sqrt(252e0), 4) AS sharpe, round(m / ds * sqrt(252e0), 4) AS sortino, round(sk, 4) AS skew, round(ku, 4) AS kurtosis, round(w, 4) AS win_rate, round(gain / loss, 4) AS profit_factor, round(f, 6) AS final_nav FROM h"""))
def metrics_full(spark, d):
    return B.metrics_full(I.returns(I.bars(spark, d)), "r", ["symbol"])


@query("negative_years", oracle("s:symbol i:negative_years", RB_SQL,
    "y AS (SELECT symbol, year(ts) AS y, arg_min(equity, ts) AS a, arg_max(equity, ts) AS b FROM rb GROUP BY 1, 2)", "SELECT symbol, COUNT(*) FILTER (b < a) AS negative_years FROM y GROUP BY 1"))
def negative_years(spark, d):
    return B.negative_years(long_short_run(spark, d))


WKEV = [*CEXP, *D.ASSETS_SQL, *SW.PICK_SQL, *SW.POSW_SQL]


def weekly_positions(spark, d):
    ex = D.weekly(spark, d)
    long = SW.period_long(ex)
    return SW.rotation_positions(ex.where("period <> 'locked'"), long, SW.candidates(spark, d, long), D.weekly_assets(spark, d))


@query("year_by_year", recursive("s:candidate_id s:period i:target_year f:strategy_return f:base_return f:excess_return f:average_exposure f:min_exposure f:max_exposure i:periods b:down_year s:dominant_asset i:unique_assets_used b:positive_year b:down_year_pass",
    WKEV, SW.eval_sql("posw", 52), "yd AS (SELECT candidate_id, period, target_year, traded_asset, COUNT(*) AS n FROM posw GROUP BY 1, 2, 3, 4)",
    "yt AS (SELECT candidate_id, period, target_year, arg_min(traded_asset, (-n, traded_asset)) AS dominant_asset FROM yd GROUP BY 1, 2, 3)",
    "SELECT y.*, r AS strategy_return, r - base_return AS excess_return, down AS down_year, dominant_asset, r > 0 AS positive_year, down AND r >= 0.05 AS down_year_pass FROM ev_y AS y JOIN yt USING (candidate_id, period, target_year)"))
def year_by_year(spark, d):
    return B.year_by_year(weekly_positions(spark, d), ["candidate_id", "period"], down="sp500_down_year")


@query("exposure_profile", recursive("s:candidate_id f:average_exposure f:average_abs_exposure f:min_exposure f:max_exposure i:weeks_long i:weeks_cash_like i:weeks_short f:exposure_turnover s:most_used_asset i:unique_assets_used",
    WKEV, SW.eval_sql("posw", 52), "SELECT * FROM ev_p JOIN ev_t USING (candidate_id)"))
def exposure_profile(spark, d):
    return B.exposure_profile(weekly_positions(spark, d), ["candidate_id"])


CONF_SQL = ["""acf AS (SELECT p.candidate_id, p.sym, p.target_year, CASE WHEN p.target_year <= 1998 THEN 'train' WHEN p.target_year <= 2000 THEN 'validation' ELSE 'locked' END AS period,
   p.predicted, a.target_positive AS actual, a.return_next_year AS ret FROM apred AS p JOIN annual AS a ON a.symbol = p.sym AND a.target_year = p.target_year)"""]
CONF_AGG = """SELECT candidate_id, period, COUNT(*) FILTER (predicted = actual) AS hits, COUNT(*) AS total, AVG((predicted = actual)::INT::DOUBLE) AS accuracy, COUNT(*) FILTER (predicted = actual AND ret < 0) AS negative_hits,
  COUNT(*) FILTER (ret < 0) AS negative_total, COUNT(*) FILTER (NOT predicted AND actual) AS false_negative, COUNT(*) FILTER (NOT predicted AND actual AND ret > 0.1) AS false_negative_big,
  COUNT(*) FILTER (predicted AND NOT actual) AS false_positive, AVG(actual::INT::DOUBLE) AS always_positive_accuracy FROM acf WHERE period <> 'locked' GROUP BY 1, 2"""
CONF_OUT = "i:hits i:total f:accuracy i:negative_hits i:negative_total i:false_negative i:false_negative_big i:false_positive f:always_positive_accuracy"


def annual_scored(spark, d):
    a = D.annual(spark, d).select("symbol", "target_year", F.col("target_positive").alias("actual"), F.col("return_next_year").alias("ret"))
    p = annual_predictions(spark, d).join(a, ["symbol", "target_year"])
    return p.withColumn("period", SW.label_annual(F.col("target_year"))).where("period <> 'locked'")


@query("confusion_metrics", oracle(f"s:candidate_id s:period {CONF_OUT}", FEAT, D.ANNUAL_SQL, AN_ALL, AV_SQL, CONF_SQL, CONF_AGG))
def confusion_metrics(spark, d):
    return B.confusion(annual_scored(spark, d), ["candidate_id", "period"])


@query("walkforward_blocks", oracle("s:candidate_id f:train_block_min_calmar f:validation_block_min_calmar i:train_blocks_positive i:validation_blocks_positive i:walkforward_passes", I.BARS,
    "sp AS (SELECT *, CASE WHEN ts <= DATE '1998-12-31' THEN 'train' ELSE 'validation' END AS period FROM bars WHERE ts <= DATE '2000-12-31')",
    "bk AS (SELECT symbol AS s0, period AS p0, symbol || period || ntile(6) OVER (PARTITION BY symbol, period ORDER BY ts) AS symbol, ts, close FROM sp)",
    f"s1 AS (SELECT *, CASE WHEN {G('AVG(close) {w}', 'close', 5)} > {G('AVG(close) {w}', 'close', 20)} THEN 1 ELSE -1 END AS signal FROM bk)",
    f"s2 AS (SELECT *, CAST(coalesce(lag(signal) OVER {O}, 0) AS DOUBLE) AS position, coalesce(close / lag(close) OVER {O} - 1, 0) AS r FROM s1)",
    f"s3 AS (SELECT *, position * r - coalesce(abs(position - lag(position) OVER {O}), abs(position)) * {COST}e0 AS x FROM s2)",
    f"s4 AS (SELECT *, product(1 + x) OVER {CUM} AS nav FROM s3)", f"s5 AS (SELECT *, nav / MAX(nav) OVER {CUM} - 1 AS dd FROM s4)",
    "g AS (SELECT s0, p0, symbol, COUNT(*) AS n, arg_max(nav, ts) AS f, MIN(dd) AS mdd FROM s5 GROUP BY 1, 2, 3)",
    "h AS (SELECT s0, p0, CASE WHEN mdd < 0 THEN (pow(f, 252e0 / n) - 1) / abs(mdd) ELSE 0 END AS calmar FROM g)",
    "k AS (SELECT s0 AS candidate_id, MIN(calmar) FILTER (p0 = 'train') AS train_block_min_calmar, MIN(calmar) FILTER (p0 = 'validation') AS validation_block_min_calmar, COUNT(*) FILTER (p0 = 'train' AND calmar >= 0) AS train_blocks_positive, COUNT(*) FILTER (p0 = 'validation' AND calmar >= 0) AS validation_blocks_positive FROM h GROUP BY 1)",
    "SELECT *, (train_block_min_calmar >= 0.5)::INT + (validation_block_min_calmar >= 0.5)::INT + (train_blocks_positive = 6)::INT + (validation_blocks_positive = 6)::INT AS walkforward_passes FROM k"))
def walkforward_blocks(spark, d):
    """Six train and six validation blocks, indicators restarting in each, all in one job."""
    by = ("symbol", "period", "block")
    x = E.blocks(S.split_periods(I.bars(spark, d)), 6, ("symbol", "period"))
    x = SG.ma_crossover(x, 5, 20, by).withColumn("signal", F.when(F.col("signal") == 1, 1).otherwise(-1))
    run = B.returns_backtest(x, cost=COST, by=by)
    m = B.metrics_survival(run, B.trades_from_position(run, by), by)
    return B.walkforward(m, ("symbol",)).withColumnRenamed("symbol", "candidate_id")


@query("benchmark_corr_beta", oracle("s:candidate_id f:benchmark_corr f:benchmark_beta b:correlation_pass", UNI_SQL,
    "g AS (SELECT candidate_id, corr(strategy_return, benchmark_return) AS c, covar_samp(strategy_return, benchmark_return) / var_samp(benchmark_return) FILTER (strategy_return IS NOT NULL) AS b FROM uni WHERE benchmark_return IS NOT NULL GROUP BY 1)",
    "SELECT candidate_id, c AS benchmark_corr, b AS benchmark_beta, abs(c) <= 0.8 AND abs(b) <= 1.5 AS correlation_pass FROM g"))
def benchmark_corr_beta(spark, d):
    return B.benchmark_link(universal_returns(spark, d), ["candidate_id"])


@query("behavior_profile", oracle("s:candidate_id f:long_fraction f:trades_per_year f:final_nav s:bucket s:signature", UNI_SQL,
    "n AS (SELECT candidate_id, COUNT(*) AS n, AVG((exposure > 0)::INT::DOUBLE) AS lf, product(1 + strategy_return) AS nav FROM uni GROUP BY 1)",
    "fl AS (SELECT candidate_id, timestamp, exposure, row_number() OVER (PARTITION BY candidate_id ORDER BY timestamp) - 1 AS i, CASE WHEN lag(exposure) OVER (PARTITION BY candidate_id ORDER BY timestamp) <> exposure THEN 1 ELSE 0 END AS flip FROM uni)",
    "ft AS (SELECT candidate_id, SUM(flip) AS flips FROM fl GROUP BY 1)",
    "ix AS (SELECT n.candidate_id, k, CASE WHEN n.n <= 256 THEN k ELSE CAST(round_even(k * (n.n - 1) / 255e0, 0) AS BIGINT) END AS i FROM n, range(256) AS t(k) WHERE k < n.n)",
    "sg AS (SELECT x.candidate_id, string_agg(CASE WHEN f.exposure > 0 THEN '1' ELSE '0' END, '' ORDER BY k) AS signature FROM ix AS x JOIN fl AS f ON f.candidate_id = x.candidate_id AND f.i = x.i GROUP BY 1)",
    """SELECT candidate_id, lf AS long_fraction, flips / (n / 252e0) AS trades_per_year, nav AS final_nav,
       CASE WHEN lf < 0.02 THEN 'always_short' WHEN lf > 0.98 THEN 'always_long' WHEN lf < 0.4 THEN 'short_bias' WHEN lf > 0.6 THEN 'long_bias' ELSE 'balanced' END AS bucket, signature FROM n JOIN ft USING (candidate_id) JOIN sg USING (candidate_id)"""))
def behavior_profile(spark, d):
    from barlab.operators import ml as M

    return M.behavior_profile(universal_returns(spark, d), ("candidate_id",), "exposure", "strategy_return", "timestamp")


@query("long_fraction", oracle("s:symbol f:long_fraction", I.BARS, SIG_SQL, f"x AS (SELECT symbol, coalesce(lag(CASE WHEN signal = 1 THEN 1 ELSE -1 END) OVER {O}, 1) AS p FROM sg)",
    "SELECT symbol, AVG((p > 0)::INT::DOUBLE) AS long_fraction FROM x GROUP BY 1"))
def long_fraction(spark, d):
    x = crossing(spark, d).withColumn("signal", F.when(F.col("signal") == 1, 1).otherwise(-1))
    return SG.long_fraction(x, "signal")


@query("year_counts", recursive("s:candidate_id s:period i:years_positive i:years_total f:min_year_return i:down_years_ge_5pct i:down_years_total f:down_min_return", WKEV, SW.eval_sql("posw", 52), "SELECT * FROM ev_yc"))
def year_counts(spark, d):
    by = ["candidate_id", "period"]
    return B.year_counts(B.year_by_year(weekly_positions(spark, d), by, down="sp500_down_year"), by)


RULE_BASE = [*FEAT, "rsym AS (SELECT DISTINCT symbol FROM bars)", RB.grid_sql("rc", "rsym", SW.RULE_SPACE, SP.RULE_VALID)]
RULE_SQL = [*RULE_BASE,
    """rsp AS (SELECT symbol AS s0, symbol || CASE WHEN ts <= DATE '1998-12-31' THEN 'train' ELSE 'validation' END AS symbol, CASE WHEN ts <= DATE '1998-12-31' THEN 'train' ELSE 'validation' END AS period,
       ts, close, """ + ", ".join(D.FEATURES) + " FROM daily_features WHERE ts <= DATE '2000-12-31')",
    *RB.store_sql(RB.keys_of(SW.RULE_SPACE), "rsp", D.FEATURES), *RB.signal_sql("rc", "rsp"), *RB.equity_sql(COST),
    f"re1 AS (SELECT *, CASE WHEN lag(equity) OVER {O} IS NOT NULL THEN step - 1 END AS ret, equity / MAX(equity) OVER {CUM} - 1 AS dd, CASE WHEN position <> 0 AND sign(position) <> sign(prev) THEN 1 ELSE 0 END AS entry FROM rpos)",
    "re2 AS (SELECT candidate_id, period, COUNT(*) AS n, arg_max(equity, ts) AS f, MIN(dd) AS mdd, AVG((coalesce(ret, 0) <> 0)::INT::DOUBLE) AS af, SUM(entry) AS t FROM re1 GROUP BY 1, 2)",
    "re3 AS (SELECT *, pow(f / 10000, 252e0 / n) - 1 AS cagr, t / (n / 252e0) AS tpy FROM re2)",
    "re4 AS (SELECT *, CASE WHEN mdd < 0 THEN cagr / abs(mdd) ELSE 0 END AS calmar FROM re3)",
    "rny AS (SELECT candidate_id, COUNT(*) FILTER (b < a) AS ny FROM (SELECT candidate_id, year(ts) AS y, arg_min(equity, ts) AS a, arg_max(equity, ts) AS b FROM rpos WHERE period = 'validation' GROUP BY 1, 2) GROUP BY 1)",
    "rw AS (SELECT candidate_id, " + ", ".join(f"MAX({c}) FILTER (period = '{p}') AS {p}_{c}" for p in ("train", "validation") for c in ("calmar", "cagr", "mdd"))
    + ", MAX(tpy) FILTER (period = 'train') AS trades_per_year, MAX(af) FILTER (period = 'train') AS long_fraction FROM re4 GROUP BY 1)",
    "rrow AS (SELECT rw.*, rule, feature_count, coalesce(ny, 0) AS validation_negative_years FROM rw JOIN rc USING (candidate_id) LEFT JOIN rny USING (candidate_id))",
]
GATE_CHECKS = [
    ("train_calmar", "train_calmar < 1.25"), ("validation_calmar", "validation_calmar < 1.25"), ("train_calmar_too_high", "train_calmar > 8"),
    ("train_validation_gap", "(validation_calmar = 0 OR train_calmar / validation_calmar > 2.5)"), ("train_cagr", "train_cagr < 0.06"), ("validation_cagr", "validation_cagr < 0.06"),
    ("train_mdd", "abs(train_mdd) > 0.3"), ("validation_mdd", "abs(validation_mdd) > 0.3"), ("too_few_trades", "trades_per_year < 12"), ("too_many_trades", "trades_per_year > 90"),
    ("too_little_long", "long_fraction < 0.25"), ("too_much_long", "long_fraction > 0.75"), ("validation_negative_years", "validation_negative_years > 0"), ("too_many_features", "feature_count > 5")]


def gate_sql(src):
    n = " + ".join(f"(CASE WHEN {c} THEN 0 ELSE 1 END)" for _, c in GATE_CHECKS)
    r = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in GATE_CHECKS) + " ELSE '' END"
    return [f"gt1 AS (SELECT *, {n} AS robust_passes, {r} AS rejection_reason FROM {src})",
        """gt AS (SELECT *, 14 AS robust_total, rejection_reason = '' AS accepted, robust_passes * 10 + validation_calmar + 0.25 * train_calmar + validation_cagr + 0.5 * train_cagr
          - 0.35 * greatest(0, train_calmar - 2 * greatest(validation_calmar, 0)) - greatest(0, feature_count - 2) * 0.15 - greatest(0, train_calmar - 8)
          - greatest(0, 12 - trades_per_year) * 0.08 - greatest(0, trades_per_year - 90) * 0.02 - greatest(0, 0.25 - long_fraction) * 4 - greatest(0, long_fraction - 0.75) * 4
          - greatest(0, abs(train_mdd) - 0.3) * 3 - greatest(0, abs(validation_mdd) - 0.3) * 3 - validation_negative_years * 0.8 AS survival_score FROM gt1)"""]


GATE_OUT = "s:candidate_id f:train_calmar f:validation_calmar f:train_cagr f:validation_cagr f:train_mdd f:validation_mdd f:trades_per_year f:long_fraction i:validation_negative_years i:feature_count i:robust_passes i:robust_total s:rejection_reason b:accepted f:survival_score"
GATE_COLS = [x.split(":")[1] for x in GATE_OUT.split()]


@query("eval_rule_candidates", oracle("s:rule " + GATE_OUT, RULE_SQL, gate_sql("rrow"), "SELECT * FROM gt"))
def eval_rule_candidates(spark, d):
    """Sweep over all rule families and symbols in one job."""
    return SW.evaluate_rules(D.featured(spark, d, None), SW.rule_candidates(spark, d), COST).select("rule", *GATE_COLS)


@query("grid_sweep", oracle("s:candidate_id s:rule f:total_return_pct f:max_drawdown_pct f:sharpe f:score", [*RULE_BASE,
    f"rsp AS (SELECT symbol AS s0, symbol, 'all' AS period, ts, close, {', '.join(D.FEATURES)} FROM daily_features)",
    *RB.store_sql(RB.keys_of(SW.RULE_SPACE), "rsp", D.FEATURES), *RB.signal_sql("rc", "rsp"), *RB.equity_sql(COST),
    f"g6 AS (SELECT *, equity / lag(equity) OVER {O} - 1 AS ret, equity / MAX(equity) OVER {CUM} - 1 AS dd FROM rpos)"],
    "g7 AS (SELECT candidate_id, rule, (arg_max(equity, ts) / 10000 - 1) * 100 AS total_return_pct, MIN(dd) * 100 AS max_drawdown_pct, CASE WHEN stddev_pop(ret) > 1e-15 THEN AVG(ret) / stddev_pop(ret) * sqrt(252e0) ELSE 0 END AS sharpe FROM g6 GROUP BY 1, 2)",
    "SELECT *, total_return_pct + max_drawdown_pct + sharpe AS score FROM g7"))
def grid_sweep(spark, d):
    """Every parameter row of every rule backtested on its symbol's bars in one job."""
    rows = RB.signal_rows(D.featured(spark, d, None).withColumn("period", F.lit("all")), SW.rule_candidates(spark, d))
    run = RB.equity_rows(rows, COST)
    return B.metrics_equity(run, ("candidate_id", "rule")).select("candidate_id", "rule", "total_return_pct", "max_drawdown_pct", "sharpe", "score")


ANN_EV = ["acm AS (" + CONF_AGG + ")",
    "amap AS (SELECT candidate_id, predicted, AVG(ret) AS m FROM acf WHERE period = 'train' GROUP BY 1, 2)", "adef AS (SELECT candidate_id, AVG(ret) AS m FROM acf WHERE period = 'train' GROUP BY 1)",
    "amae AS (SELECT f.candidate_id, f.period, AVG(abs(coalesce(m.m, d.m) - f.ret)) AS mae FROM acf AS f LEFT JOIN amap AS m ON m.candidate_id = f.candidate_id AND m.predicted = f.predicted JOIN adef AS d ON d.candidate_id = f.candidate_id WHERE f.period <> 'locked' GROUP BY 1, 2)",
    "aw AS (SELECT candidate_id, 2 AS feature_count, " + ", ".join(f"MAX({c}) FILTER (period = '{p}') AS {p}_{c}" for p in ("train", "validation") for c in "hits total accuracy negative_hits negative_total false_negative false_negative_big".split())
    + ", MAX(always_positive_accuracy) FILTER (period = 'validation') AS base, MAX(mae) FILTER (period = 'train') AS train_mae, MAX(mae) FILTER (period = 'validation') AS validation_mae FROM acm JOIN amae USING (candidate_id, period) GROUP BY 1)",
    """asc1 AS (SELECT *, CASE WHEN train_mae = 0 THEN 1 ELSE train_mae END AS tm, CASE WHEN validation_mae = 0 THEN 1 ELSE validation_mae END AS vm FROM aw)""",
    """asc2 AS (SELECT *, validation_accuracy * 100 + train_accuracy * 30 + validation_negative_hits * 8 + train_negative_hits * 2 + greatest(0, validation_accuracy - base) * 20 - vm * 10 AS validation_score,
       CASE WHEN train_accuracy >= 1 THEN 5000 ELSE 0 END + train_accuracy * 1000 + train_hits * 10 + train_negative_hits * 35 + CASE WHEN train_negative_total > 0 AND train_negative_hits = train_negative_total THEN 250 ELSE 0 END - feature_count * 8 - tm * 10 AS train_only_score,
       train_accuracy * 1000 + train_negative_hits / greatest(1, train_negative_total)::DOUBLE * 600 + train_negative_hits * 30 - train_false_negative_big * 1500 - train_false_negative * 250 - feature_count * 80 - tm * 10 AS crisis_score,
       CASE WHEN validation_total < 8 THEN 'too_few_validation_years' WHEN validation_accuracy < 0.7 THEN 'validation_accuracy' WHEN train_accuracy < 0.7 THEN 'train_accuracy' WHEN validation_accuracy <= base THEN 'baseline'
         WHEN validation_negative_total > 0 AND validation_negative_hits < 1 THEN 'misses_validation_stress' ELSE '' END AS validation_reason,
       CASE WHEN train_total < 20 THEN 'too_few_train_years' WHEN train_accuracy < 1 THEN 'train_not_perfect' WHEN train_negative_total > 0 AND train_negative_hits < train_negative_total THEN 'misses_train_stress' ELSE '' END AS train_only_reason,
       CASE WHEN train_accuracy < 0.9 THEN 'train_accuracy' WHEN train_negative_total > 0 AND train_negative_hits / train_negative_total::DOUBLE < 0.8 THEN 'misses_train_stress' WHEN train_false_negative_big > 0 THEN 'train_false_negative_big'
         WHEN validation_accuracy < 0.9 THEN 'validation_accuracy' WHEN validation_accuracy <= base THEN 'baseline' WHEN validation_negative_total > 0 AND validation_negative_hits / validation_negative_total::DOUBLE < 2 / 3e0 THEN 'misses_validation_stress'
         WHEN validation_false_negative_big > 0 THEN 'validation_false_negative_big' ELSE '' END AS crisis_reason FROM asc1)"""]
ANN_OUT = "s:candidate_id f:train_accuracy f:validation_accuracy i:train_hits i:validation_total f:train_return_mae f:validation_return_mae f:validation_score f:train_only_score f:crisis_score s:validation_reason s:train_only_reason s:crisis_reason"


def annual_rows(spark, d):
    """Accuracy, mean-error and score columns per annual candidate."""
    p = annual_scored(spark, d)
    conf = B.confusion(p, ["candidate_id", "period"])
    train = F.col("period") == "train"
    cls = p.where(train).groupBy("candidate_id", "predicted").agg(F.avg("ret").alias("m"))
    all_ = p.where(train).groupBy("candidate_id").agg(F.avg("ret").alias("m0"))
    e = p.join(cls, ["candidate_id", "predicted"], "left").join(all_, "candidate_id")
    mae = e.groupBy("candidate_id", "period").agg(F.avg(F.abs(F.coalesce("m", "m0") - F.col("ret"))).alias("return_mae"))
    cols = ["hits", "total", "accuracy", "negative_hits", "negative_total", "false_negative", "false_negative_big", "always_positive_accuracy", "return_mae"]
    w = SW.period_wide(conf.join(mae, ["candidate_id", "period"]), "candidate_id", cols)
    w = w.withColumnRenamed("validation_always_positive_accuracy", "always_positive_validation_accuracy").withColumn("feature_count", F.lit(2))
    return GT.annual_scores(w)


@query("eval_annual_candidates", oracle(ANN_OUT, FEAT, D.ANNUAL_SQL, AN_ALL, AV_SQL, CONF_SQL, ANN_EV, "SELECT *, train_mae AS train_return_mae, validation_mae AS validation_return_mae FROM asc2"))
def eval_annual_candidates(spark, d):
    return annual_rows(spark, d).select([x.split(":")[1] for x in ANN_OUT.split()])


MOEV = [*FEAT, *D.MONTHLY_SQL, *MO_LONG, *SW.cand_sql("mo_long", SP.MONTHLY_QUANTILES), *SW.POSM_SQL]
MO_OUT = SW.EVAL_OUT + " i:train_years_ge_10pct f:monthly_score s:rejection_reason b:accepted"


def mo_score(multi=False, pos="posm"):
    extra = " + least(unique_assets_used, 10) * 3" if multi else ""
    return [f"m10 AS (SELECT candidate_id, COUNT(*) FILTER (r >= 0.1) AS train_years_ge_10pct FROM ev_y WHERE period = 'train' GROUP BY 1)",
        f"""msc AS (SELECT *, CASE WHEN train_min_year_return = 0 THEN -1 ELSE train_min_year_return END AS tmin FROM ev JOIN m10 USING (candidate_id))""",
        f"""mfin AS (SELECT *, CASE WHEN train_years_ge_10pct = greatest(1, train_years_total) AND tmin >= 0.1 THEN 10000 ELSE 0 END + train_years_ge_10pct * 120 + tmin * 2000 + train_cagr * 500 - greatest(0, abs(train_mdd) - 0.25) * 600
         - exposure_turnover * 120 - greatest(0, average_abs_exposure - 0.75) * 80{extra} AS monthly_score,
         CASE WHEN train_years_total = 0 THEN 'no_train_years' WHEN train_years_ge_10pct < train_years_total THEN 'train_year_below_10pct' ELSE '' END AS rejection_reason,
         train_years_total > 0 AND train_years_ge_10pct >= train_years_total AS accepted FROM msc)"""]


def monthly_rows(pos, multi=False):
    ev = SW.evaluate_positions(pos, 12.0).withColumnRenamed("train_years_ge_floor", "train_years_ge_10pct")
    return GT.monthly_score(ev.withColumn("feature_count", F.lit(2)), multi_asset=multi).drop("feature_count", "validation_years_ge_floor")


@query("eval_monthly_candidates", recursive(MO_OUT, MOEV, SW.eval_sql("posm", 12), mo_score(), "SELECT * FROM mfin"))
def eval_monthly_candidates(spark, d):
    ex = D.monthly(spark, d)
    long = SW.period_long(ex)
    pos = SW.benchmark_positions(ex.where("period <> 'locked'"), long, SW.candidates(spark, d, long, SP.MONTHLY_QUANTILES))
    return monthly_rows(pos)


MA_SEL = ("mom_3", "mom_6", "mom_12", "low_vol_3m")
MONTH_ASSETS = [
    "ma_c AS (SELECT symbol, last_day(ts) AS period_end, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)",
    "ma_r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY period_end) - 1 AS r FROM ma_c)",
    """ma AS (SELECT symbol, period_end, lead(close) OVER w / close - 1 AS next_return, close / lag(close, 3) OVER w - 1 AS mom_3, close / lag(close, 6) OVER w - 1 AS mom_6, close / lag(close, 12) OVER w - 1 AS mom_12,
       CASE WHEN COUNT(r) OVER w3 >= 3 THEN stddev_samp(r) OVER w3 * sqrt(12.0) END AS vol FROM ma_r WINDOW w AS (PARTITION BY symbol ORDER BY period_end), w3 AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
    "mpsc AS (" + " UNION ALL ".join(f"SELECT symbol, period_end, next_return, '{s}' AS selector, {'-vol' if s.startswith('low') else s} AS score FROM ma" for s in MA_SEL) + ")",
    "mprk AS (SELECT *, row_number() OVER (PARTITION BY selector, period_end ORDER BY score IS NULL, score DESC, symbol) AS k, COUNT(score) OVER (PARTITION BY selector, period_end) AS n FROM mpsc)",
    """mpicks AS (SELECT selector, period_end AS decision_date, coalesce(MAX(CASE WHEN n > 0 AND k = 1 THEN symbol WHEN n = 0 AND symbol = 'N' THEN symbol END), 'N') AS traded_asset,
       coalesce(MAX(CASE WHEN n > 0 AND k = 1 THEN next_return WHEN n = 0 AND symbol = 'N' THEN next_return END), 0) AS asset_return FROM mprk GROUP BY 1, 2)""",
    """posr AS (SELECT e.candidate_id, e.decision_date, w.target_end AS ts, w.target_year, w.period, false AS sp500_down_year, coalesce(w.next_return, 0) AS spy_return, p.traded_asset, e.exposure, e.exposure * p.asset_return AS strategy_return
       FROM cexp AS e JOIN monthly AS w ON w.decision_date = e.decision_date
       JOIN mpicks AS p ON p.decision_date = e.decision_date AND p.selector = CASE e.selector WHEN 'mom_4' THEN 'mom_3' WHEN 'mom_13' THEN 'mom_6' WHEN 'mom_26' THEN 'mom_12' WHEN 'mom_52' THEN 'mom_12' ELSE 'low_vol_3m' END)""",
]


@query("eval_monthly_rotation", recursive(MO_OUT, [*FEAT, *D.MONTHLY_SQL, *MO_LONG, *SW.cand_sql("mo_long", SP.MONTHLY_QUANTILES), *MONTH_ASSETS], SW.eval_sql("posr", 12), mo_score(True, "posr"), "SELECT * FROM mfin"))
def eval_monthly_rotation(spark, d):
    ex = D.monthly(spark, d).withColumn("sp500_down_year", F.lit(False))
    long = SW.period_long(ex)
    m = E.resample_last(I.bars(spark, d), E.month_end("ts"), ["close"])
    assets = E.asset_momentum(E.spine(m, "month"), (3, 6, 12), 3, 12.0)
    e = SW.exposure_rows(long, SW.candidates(spark, d, long, SP.MONTHLY_QUANTILES))
    sel = F.col("selector")
    e = e.withColumn("selector", F.when(sel == "mom_4", "mom_3").when(sel == "mom_13", "mom_6").when(sel.isin("mom_26", "mom_52"), "mom_12").otherwise("low_vol_3m"))
    picks = SW.ranked_assets(assets, MA_SEL)
    base = ex.where("period <> 'locked'").select("decision_date", F.col("target_end").alias("ts"), "target_year", "period", "sp500_down_year", F.coalesce("next_return", F.lit(0.0)).alias("spy_return"))
    pos = e.join(picks, ["selector", "decision_date"]).join(F.broadcast(base), "decision_date").withColumn("strategy_return", F.col("exposure") * F.col("asset_return"))
    return monthly_rows(pos, multi=True)


@query("eval_weekly_rotation", recursive(SW.EVAL_OUT, WKEV, SW.eval_sql("posw", 52), "SELECT * FROM ev"))
def eval_weekly_rotation(spark, d):
    return SW.evaluate_positions(weekly_positions(spark, d), 52.0).drop("train_years_ge_floor", "validation_years_ge_floor")


@query("eval_unique_and_stamp", oracle("i:candidate_id s:method i:stage i:wave f:score s:run_stamp", """
k AS (SELECT o_custkey AS candidate_id, o_orderpriority AS method, o_orderkey % 16 AS stage, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)""",
    "SELECT candidate_id, method, stage, 1 AS wave, score, method || '/1/' || stage AS run_stamp FROM k WHERE rn = 1"))
def eval_unique_and_stamp(spark, d):
    from barlab.operators import leaderboard as LB

    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderpriority").alias("method"), (F.col("o_orderkey") % 16).alias("stage"), F.col("o_totalprice").alias("score"), "o_orderkey")
    u = LB.best_per(o, ["candidate_id"], [F.col("score"), -F.col("o_orderkey")])
    return LB.stamp(u, wave=1).select("candidate_id", "method", "stage", "wave", "score", "run_stamp")
