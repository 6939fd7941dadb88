"""Backtests, trades and performance metrics as windows and aggregations.

``by`` names the series (candidate and symbol, optionally a period or block). All metrics use the
conventions spelled out per function; Calmar without a drawdown is a parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import rolling as R

CASH = 10_000.0


def returns_backtest(df: DataFrame, signal: str = "signal", cost: float = 0.0, initial=0, by=("symbol",), cash: float = CASH) -> DataFrame:
    """Previous bar's signal earns this bar's return; turnover pays ``cost``; equity compounds."""
    start = F.lit(float(initial)) if not isinstance(initial, Column) else initial.cast("double")
    x = df.withColumns({
        "position": F.coalesce(R.lag(F.col(signal).cast("double"), 1, by), start),
        "r": F.coalesce(R.pct_change("close", 1, by), F.lit(0.0)),
    })
    move = F.coalesce(F.abs(R.diff("position", 1, by)), F.abs(F.col("position")))
    x = x.withColumn("turnover", move)
    x = x.withColumn("strategy_return", F.col("position") * F.col("r") - F.col("turnover") * F.lit(cost))
    return x.withColumn("equity", cash * R.cumulative_product(1.0 + F.col("strategy_return"), by))


def long_cash(df: DataFrame, signal: str, cost: float, by=("symbol",), cash: float = CASH) -> DataFrame:
    """Fully invested or in cash; entries buy at close * (1 + cost), exits sell at close * (1 - cost),
    an open trade is closed on the last bar. One multiplicative step per bar."""
    pos = F.coalesce(R.lag(F.col(signal).cast("int"), 1, by), F.lit(0))
    x = df.withColumn("position", pos)
    x = x.withColumns({
        "_prev": F.coalesce(R.lag("position", 1, by), F.lit(0)),
        "_move": F.coalesce(R.ratio("close", R.lag("close", 1, by)), F.lit(1.0)),
        "_end": R.lead("ts", 1, by).isNull(),
    })
    p, q = F.col("position"), F.col("_prev")
    step = (
        F.when((p == 1) & (q == 0), F.lit(1.0 / (1.0 + cost)))
        .when((p == 1) & (q == 1), F.col("_move"))
        .when((p == 0) & (q == 1), F.col("_move") * (1.0 - cost))
        .otherwise(F.lit(1.0))
    )
    step = step * F.when(F.col("_end") & (p == 1), F.lit(1.0 - cost)).otherwise(F.lit(1.0))
    x = x.withColumn("_step", step)
    entries = F.sum(F.when((p == 1) & (q == 0), 1).otherwise(0)).over(R.running(by))
    x = x.withColumns({
        "equity": cash * R.cumulative_product("_step", by),
        "trade_id": F.when((p == 1) | (q == 1), entries),
        "cost_rate": F.lit(float(cost)),
    })
    return x.drop("_prev", "_move", "_end", "_step")


def long_cash_trades(run: DataFrame, by=("symbol",), cash: float = CASH) -> DataFrame:
    """One row per trade of ``long_cash``: pnl of the trade alone and against the initial cash."""
    c = F.first("cost_rate")
    g = run.where("trade_id IS NOT NULL").groupBy(*by, "trade_id").agg(
        F.min("ts").alias("entry_time"), F.max("ts").alias("exit_time"),
        (F.min_by("close", "ts") * (1.0 + c)).alias("entry_price"),
        (F.max_by("close", "ts") * (1.0 - c)).alias("exit_price"),
        F.max_by("equity", "ts").alias("exit_equity"),
    )
    prior = F.coalesce(R.lag("exit_equity", 1, by, "trade_id"), F.lit(cash))
    return g.withColumns({
        "return_pct": (R.ratio("exit_price", "entry_price") - 1.0) * 100.0,
        "pnl": F.col("exit_equity") - prior,
        "cum_pnl": F.col("exit_equity") - cash,
    })


def _islands(df: DataFrame, state: Column, by, order: str = "ts") -> DataFrame:
    x = df.withColumn("_st", state)
    change = F.when(R.lag("_st", 1, by, order).eqNullSafe(F.col("_st")), 0).otherwise(1)
    x = x.withColumn("_chg", change)
    return x.withColumn("island", F.sum("_chg").over(R.running(by, order))).drop("_chg")


def trades_from_position(run: DataFrame, by=("symbol",), position: str = "position", cash: float = CASH) -> DataFrame:
    """Long and short islands; a flip closes and opens on the same bar, the last island on the last bar."""
    x = run.withColumns({"_nt": R.lead("ts", 1, by), "_nc": R.lead("close", 1, by)})
    x = _islands(x, F.signum(position).cast("int"), by).where("_st <> 0")
    g = x.groupBy(*by, "island").agg(
        F.first("_st").alias("side"), F.min("ts").alias("entry_time"), F.min_by("close", "ts").alias("entry_price"),
        F.max_by(F.coalesce("_nt", "ts"), "ts").alias("exit_time"), F.max_by(F.coalesce("_nc", "close"), "ts").alias("exit_price"),
    )
    ret = F.col("side") * (R.ratio("exit_price", "entry_price") - 1.0)
    g = g.withColumn("_ret", ret)
    g = g.withColumn("exit_equity", cash * R.cumulative_product(1.0 + F.col("_ret"), by, "entry_time"))
    return g.select(
        *by, "side", "entry_time", "exit_time", "entry_price", "exit_price",
        (F.col("exit_equity") - cash).alias("pnl"), (F.col("_ret") * 100.0).alias("return_pct"), "exit_equity",
    )


def trades_from_state(run: DataFrame, state: str, by=("symbol",)) -> DataFrame:
    """Islands of a categorical state, priced by the equity curve at their bounds."""
    x = run.withColumns({"_nt": R.lead("ts", 1, by), "_ne": R.lead("equity", 1, by)})
    x = _islands(x, F.col(state), by)
    g = x.groupBy(*by, "island").agg(
        F.first("_st").alias("state"), F.min("ts").alias("entry_time"), F.min_by("equity", "ts").alias("entry_price"),
        F.max_by(F.coalesce("_nt", "ts"), "ts").alias("exit_time"), F.max_by(F.coalesce("_ne", "equity"), "ts").alias("exit_price"),
    )
    return g.withColumns({
        "pnl": F.col("exit_price") - F.col("entry_price"),
        "return_pct": F.coalesce((R.ratio("exit_price", "entry_price") - 1.0) * 100.0, F.lit(0.0)),
    }).drop("island")


def regime_backtest(df: DataFrame, asset: str, asset_return: str, cost: float, by=("symbol",), cash: float = CASH, causal: bool = False) -> DataFrame:
    """Rotation between assets. Reference timing shifts the same-day return of the chosen asset by one
    bar; ``causal`` instead lets the previous bar's choice earn today's return of that asset."""
    earned = F.col(asset_return) if causal else R.lag(asset_return, 1, by)
    moved = F.when(R.lag(asset, 1, by).eqNullSafe(F.col(asset)), 0.0).otherwise(1.0)
    x = df.withColumns({"_e": F.coalesce(earned, F.lit(0.0)), "_m": moved})
    x = x.withColumn("strategy_return", F.col("_e") - F.col("_m") * F.lit(cost)).drop("_e", "_m")
    return x.withColumn("equity", cash * R.cumulative_product(1.0 + F.col("strategy_return"), by))


def sharpe(mean: Column, std: Column, ppy: float, floor: float = 1e-12) -> Column:
    return F.coalesce(F.when(std > floor, mean / std * math.sqrt(ppy)), F.lit(0.0))


def calmar(cagr: Column, mdd: Column, no_drawdown, floor: float = 0.0) -> Column:
    """CAGR over the size of the drawdown; ``no_drawdown`` (a value or column) where there is none."""
    alt = no_drawdown if isinstance(no_drawdown, Column) else F.lit(no_drawdown).cast("double")
    return F.when(mdd < -floor, cagr / F.nullif(F.abs(mdd), F.lit(0.0))).otherwise(alt)


def annualised(final: Column, periods: Column, ppy: float) -> Column:
    """final ** (ppy / periods) - 1, or -1 once capital is gone."""
    years = F.greatest(periods.cast("double") / ppy, F.lit(1e-9))
    return F.when(final > 0, F.pow(final, 1.0 / years) - 1.0).otherwise(F.lit(-1.0))


def curve(df: DataFrame, x: str, by, order: str = "ts") -> DataFrame:
    """Compounded value and drawdown of a return column."""
    y = df.withColumn("nav", R.cumulative_product(1.0 + F.col(x), by, order))
    return y.withColumn("drawdown", R.ratio("nav", F.max("nav").over(R.running(by, order))) - 1.0)


def metrics_equity(run: DataFrame, by=("symbol",), cash: float = CASH) -> DataFrame:
    """Total return, drawdown, Sharpe (population deviation, 252) and score of an equity curve."""
    x = run.withColumns({"_ret": R.pct_change("equity", 1, by), "_dd": R.drawdown("equity", by=by)})
    e = x.groupBy(*by).agg(
        F.max_by("equity", "ts").alias("final_equity"), (F.min("_dd") * 100.0).alias("max_drawdown_pct"),
        F.avg("_ret").alias("_m"), F.stddev_pop("_ret").alias("_s"),
    )
    e = e.withColumns({
        "initial_cash": F.lit(cash),
        "total_return_pct": (F.col("final_equity") / cash - 1.0) * 100.0,
        "sharpe": sharpe(F.col("_m"), F.col("_s"), 252.0, 1e-15),
    })
    return e.withColumn("score", F.col("total_return_pct") + F.col("max_drawdown_pct") + F.col("sharpe")).drop("_m", "_s")


def metrics_basic(run: DataFrame, trades: DataFrame, by=("symbol",), cash: float = CASH) -> DataFrame:
    """Equity metrics together with trade count, win rate and profit factor."""
    pnl = F.col("pnl")
    t = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg((pnl > 0).cast("double")).alias("_w"),
        F.sum(F.when(pnl > 0, pnl)).alias("_win"), F.sum(F.when(pnl < 0, -pnl)).alias("_loss"),
    )
    j = metrics_equity(run, by, cash).join(t, list(by), "left")
    win = F.coalesce("_win", F.lit(0.0))
    return j.withColumns({
        "trade_count": F.coalesce("trade_count", F.lit(0)).cast("double"),
        "win_rate_pct": F.coalesce(F.col("_w") * 100.0, F.lit(0.0)),
        "profit_factor": F.when(F.col("_loss").isNull(), win).otherwise(win / F.nullif("_loss", F.lit(0.0))),
    }).drop("_w", "_win", "_loss")


def metrics_survival(run: DataFrame, trades: DataFrame, by=("symbol",), cash: float = CASH) -> DataFrame:
    """CAGR on rows / 252, Calmar (0 without drawdown), trades a year, share of bars that moved equity."""
    x = run.withColumns({"_ret": R.pct_change("equity", 1, by), "_dd": R.drawdown("equity", by=by)})
    e = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("equity", "ts").alias("final_equity"), F.min("_dd").alias("mdd"),
        F.avg((F.coalesce("_ret", F.lit(0.0)) != 0).cast("double")).alias("active_fraction"),
    )
    t = trades.groupBy(*by).agg(F.count(F.lit(1)).alias("_t"))
    j = e.join(t, list(by), "left").withColumn("_y", F.greatest(F.col("rows") / 252.0, F.lit(1 / 252.0)))
    j = j.withColumn("cagr", F.when(F.col("final_equity") > 0, F.pow(F.col("final_equity") / cash, 1.0 / F.col("_y")) - 1.0).otherwise(-1.0))
    return j.withColumns({
        "calmar": calmar(F.col("cagr"), F.col("mdd"), 0.0),
        "trades_per_year": F.coalesce("_t", F.lit(0)) / F.col("_y"),
    }).drop("_t", "_y")


def metrics_period(df: DataFrame, x: str, by, ppy: float, order: str = "ts", no_drawdown=None) -> DataFrame:
    """CAGR, drawdown, Calmar and Sharpe (sample deviation) of period returns.

    Without a drawdown Calmar is NULL unless ``no_drawdown`` is given; ``has_drawdown`` tells them apart.
    """
    c = curve(df.withColumn("_x", F.coalesce(x, F.lit(0.0))), "_x", by, order)
    g = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), F.max_by("nav", order).alias("_f"), F.min("drawdown").alias("mdd"),
        F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"),
    )
    g = g.withColumn("cagr", annualised(F.col("_f"), F.col("periods"), ppy))
    return g.withColumns({
        "calmar": calmar(F.col("cagr"), F.col("mdd"), no_drawdown),
        "sharpe": sharpe(F.col("_m"), F.col("_s"), ppy),
        "has_drawdown": F.col("mdd") < 0,
    }).drop("_f", "_m", "_s")


def metrics_next_returns(df: DataFrame, position: str, next_return: str, by, order: str = "ts") -> DataFrame:
    """Position times next return: Calmar 999 without drawdown, trades as flips, long share, final value."""
    x = df.withColumn("_x", F.coalesce(F.col(position) * F.col(next_return), F.lit(0.0)))
    x = x.withColumn("_flip", F.when(R.lag(position, 1, by, order) != F.col(position), 1).otherwise(0))
    c = curve(x, "_x", by, order)
    g = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"), F.max_by("nav", order).alias("final_nav"), F.min("drawdown").alias("mdd"),
        F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), F.sum("_flip").alias("trades"),
        F.avg((F.col(position) > 0).cast("double")).alias("long_fraction"),
    )
    g = g.withColumn("cagr", annualised(F.col("final_nav"), F.col("periods"), 252.0))
    return g.withColumns({
        "calmar": calmar(F.col("cagr"), F.col("mdd"), 999.0, 1e-12), "sharpe": sharpe(F.col("_m"), F.col("_s"), 252.0),
    }).drop("_m", "_s")


def metrics_full(df: DataFrame, x: str, by, ppy: float = 252.0, order: str = "ts") -> DataFrame:
    """Whole metric suite in percent and rounded: annualised on all rows, moments on known rows only."""
    known = F.when(~F.isnan(x), F.col(x))
    y = df.withColumn("_v", known)
    c = curve(y.withColumn("_x", F.coalesce("_v", F.lit(0.0))), "_x", by, order)
    v = F.col("_v")
    down = F.when(v < 0, v)
    g = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods_raw"), F.count(v).alias("n_periods_finite"), F.max_by("nav", order).alias("f"),
        F.min("drawdown").alias("dd"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.stddev_pop(down).alias("ds"), F.count(down).alias("dn"),
        F.skewness(v).alias("sk"), F.kurtosis(v).alias("ku"), F.avg((v > 0).cast("double")).alias("win"),
        F.sum(F.when(v > 0, v)).alias("gain"), F.sum(F.when(v < 0, -v)).alias("loss"),
    )
    cagr = annualised(F.col("f"), F.col("n_periods_raw"), ppy)
    g = g.withColumns({"cg": cagr, "dstd": F.when(F.col("dn") > 1, F.col("ds")).otherwise(F.col("s"))})
    enough = F.col("n_periods_finite") >= 2
    moving = F.col("s") > 1e-12
    flat = F.when(F.col("cg") > 0, F.lit(float("inf"))).when(F.col("cg") < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    cal = F.when(F.abs("dd") < 1e-9, flat).otherwise(F.col("cg") / F.nullif(F.abs("dd"), F.lit(0.0)))
    out = {
        "cagr": (F.col("cg") * 100.0, 4), "mdd": (F.col("dd") * 100.0, 4), "calmar": (cal, 4), "mar": (cal, 4),
        "sharpe": (sharpe(F.col("m"), F.col("s"), ppy), 4), "sortino": (sharpe(F.col("m"), F.col("dstd"), ppy), 4),
        "skew": (F.when(moving & (F.col("n_periods_finite") > 2), F.col("sk")).otherwise(0.0), 4),
        "kurtosis": (F.when(moving & (F.col("n_periods_finite") > 3), F.col("ku") + 3.0).otherwise(0.0), 4),
        "win_rate": (F.col("win"), 4),
        "profit_factor": (F.coalesce(F.coalesce("gain", F.lit(0.0)) / F.nullif("loss", F.lit(0.0)), F.lit(0.0)), 4),
        "final_nav": (F.col("f"), 6),
    }
    cols = [F.when(enough, F.round(c, d)).alias(k) for k, (c, d) in out.items()]
    return g.select(*by, "n_periods_raw", "n_periods_finite", *cols)


def negative_years(run: DataFrame, by=("symbol",)) -> DataFrame:
    y = run.groupBy(*by, F.year("ts").alias("_y")).agg(F.min_by("equity", "ts").alias("a"), F.max_by("equity", "ts").alias("b"))
    return y.groupBy(*by).agg(F.count_if(F.col("b") < F.col("a")).alias("negative_years"))


def year_by_year(pos: DataFrame, by, base: str = "spy_return", year: str = "target_year", down: str | None = None, floor: float = 0.05) -> DataFrame:
    """Compounded returns and exposure profile per candidate, period and year; mode ties pick the first name."""
    g = pos.groupBy(*by, year).agg(
        (F.product(1.0 + F.col("strategy_return")) - 1.0).alias("strategy_return"),
        (F.product(1.0 + F.col(base)) - 1.0).alias("base_return"),
        F.avg("exposure").alias("average_exposure"), F.min("exposure").alias("min_exposure"), F.max("exposure").alias("max_exposure"),
        F.count(F.lit(1)).alias("periods"),
        (F.bool_or(down) if down else F.max(F.lit(False))).alias("down_year"),
        F.mode("traded_asset", True).alias("dominant_asset"), F.size(F.collect_set("traded_asset")).alias("unique_assets_used"),
    )
    return g.withColumns({
        "excess_return": F.col("strategy_return") - F.col("base_return"),
        "positive_year": F.col("strategy_return") > 0,
        "down_year_pass": F.col("down_year") & (F.col("strategy_return") >= floor),
    })


def exposure_profile(pos: DataFrame, by, order: str = "ts", edge: float = 0.05) -> DataFrame:
    e = F.col("exposure")
    x = pos.withColumn("_d", F.abs(R.diff("exposure", 1, by, order)))
    return x.groupBy(*by).agg(
        F.avg(e).alias("average_exposure"), F.avg(F.abs(e)).alias("average_abs_exposure"), F.min(e).alias("min_exposure"), F.max(e).alias("max_exposure"),
        F.count_if(e > edge).alias("weeks_long"), F.count_if(F.abs(e) <= edge).alias("weeks_cash_like"), F.count_if(e < -edge).alias("weeks_short"),
        F.coalesce(F.avg("_d"), F.lit(0.0)).alias("exposure_turnover"),
        F.mode("traded_asset", True).alias("most_used_asset"), F.size(F.collect_set("traded_asset")).alias("unique_assets_used"),
    )


def confusion(df: DataFrame, by) -> DataFrame:
    """Counts of hits and misses of ``predicted`` against ``actual``, with the size of missed gains."""
    p, a, r = F.col("predicted"), F.col("actual"), F.col("ret")
    hit = p == a
    return df.groupBy(*by).agg(
        F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total"), F.avg(hit.cast("double")).alias("accuracy"),
        F.count_if(hit & (r < 0)).alias("negative_hits"), F.count_if(r < 0).alias("negative_total"),
        F.count_if(~p & a).alias("false_negative"), F.count_if(~p & a & (r > 0.10)).alias("false_negative_big"),
        F.count_if(p & ~a).alias("false_positive"), F.avg(a.cast("double")).alias("always_positive_accuracy"),
    )


def benchmark_link(df: DataFrame, by, x: str = "strategy_return", base: str = "benchmark_return", max_corr: float = 0.80, max_beta: float = 1.50) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(base).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(base))
    g = df.groupBy(*by).agg(
        F.count(a).alias("n"), F.corr(a, b).alias("c"), F.covar_samp(a, b).alias("cov"), F.var_samp(b).alias("var")
    )
    few = F.col("n") < 3
    corr = F.when(~few, F.col("c"))
    beta = F.when(~few & (F.col("var") > 1e-12), F.col("cov") / F.col("var"))
    ok = few | ((F.abs(corr) <= max_corr) & (beta.isNull() | (F.abs(beta) <= max_beta)))
    return g.select(*by, corr.alias("benchmark_corr"), beta.alias("benchmark_beta"), F.coalesce(ok, F.lit(False)).alias("correlation_pass"))


def year_counts(years: DataFrame, by) -> DataFrame:
    r = F.col("strategy_return")
    return years.groupBy(*by).agg(
        F.count_if(r > 0).alias("years_positive"), F.count(F.lit(1)).alias("years_total"), F.min(r).alias("min_year_return"),
        F.count_if(F.col("down_year") & (r >= 0.05)).alias("down_years_ge_5pct"), F.count_if("down_year").alias("down_years_total"),
        F.min(F.when(F.col("down_year"), r)).alias("down_min_return"),
    )


def walkforward(blocks: DataFrame, by, floor: float = 0.50, n: int = 6) -> DataFrame:
    """Worst Calmar and non-negative count over train and validation blocks; four pass marks."""
    k = F.col("calmar")
    aggs = []
    for p in ("train", "validation"):
        here = F.col("period") == p
        aggs += [F.min(F.when(here, k)).alias(f"{p}_block_min_calmar"), F.count_if(here & (k >= 0)).alias(f"{p}_blocks_positive")]
    marks = [F.col(f"{p}_block_min_calmar") >= floor for p in ("train", "validation")] + [F.col(f"{p}_blocks_positive") == n for p in ("train", "validation")]
    passes = sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks), F.lit(0))
    return blocks.groupBy(*by).agg(*aggs).withColumn("walkforward_passes", passes)
