"""Rule families over one indicator store: every distinct indicator once, candidates by key, one signal for all rules.

The store has a row for each series and period with its days, closes and a map from indicator key to values in day order; its
size is bounded by the trading calendar. A candidate joins the row of its symbol and takes the few arrays that its rule
names, so bars are not repeated for candidates before the join, and the rows that follow are dealt out by candidate once.
A rule is what it reads, which parameters are its levels, and the conditions that switch it on and off.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions import rolling as R
from barlab.operators import backtest as B

BY = ("symbol", "period")
#: Candidates of one symbol that are joined in a task.
PER_TASK = 512
#: Rows of the rolling distributions behind quantiles and scores (fixed values).
LONG, LEAST = 252, 63


class Rule(NamedTuple):
    """``reads``: indicator keys with parameters in braces; ``levels``: parameters compared with; ``on`` and ``off``: conditions on
    a row (close, the indicators as a, b, c, d, the levels as p, q). Without ``off`` the rule is on exactly while ``on`` holds;
    with it, rows that say neither keep the state."""

    reads: tuple[str, ...]
    levels: tuple[str, ...]
    on: str
    off: str | None
    features: int


RULES = {
    "ma_crossover": Rule(("sma:{fast_window}", "sma:{slow_window}"), (), "a > b", None, 2),
    "momentum_threshold": Rule(("ret:{momentum_window}",), ("threshold",), "a > p", None, 1),
    "mean_reversion": Rule(("z:{reversion_window}",), ("entry_zscore", "exit_zscore"), "a <= -p", "a >= q", 2),
    "rsi_reversion": Rule(("rsi:{rsi_window}",), ("rsi_buy", "rsi_sell"), "a <= p", "a >= q", 1),
    "breakout": Rule(("high:{breakout_window}", "low:{exit_window}"), (), "close > a", "close < b", 2),
    "volatility_momentum": Rule(("ret:{momentum_window}", "vol:{volatility_window}", "volq:{volatility_window}:{volatility_quantile}"), (), "a > 0 AND b < c", None, 2),
    "linear_score": Rule(("zret:{fast_return_window}", "zret:{slow_return_window}", "zvol:{risk_window}", "zdd:{risk_window}"), ("score_threshold",), "a + b - c + d > p", None, 4),
    "feature_threshold": Rule(("feat:{feature_name}",), ("feature_threshold",), "a > p", None, 1),
    "feature_zscore": Rule(("featz:{feature_name}:{feature_z_window}",), ("feature_z_threshold",), "a > p", None, 1),
}
SLOTS = ("a", "b", "c", "d")


def _key(text: str) -> Column:
    """An indicator key with the candidate's parameters filled in."""
    parts = re.split(r"[{}]", text)
    return F.concat(*[F.col(x).cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts) if x])


def with_keys(grid: DataFrame) -> DataFrame:
    """Adds the indicator keys a to d, the levels p and q and feature_count to the rows of a rule grid."""

    def by_rule(value: Callable[[Rule], Column | None]) -> Column:
        out = F.lit(None)
        for name, rule in RULES.items():
            v = value(rule)
            if v is not None and all(c in grid.columns for c in _parameters(rule)):
                out = F.when(F.col("rule") == name, v).otherwise(out)
        return out

    keys = {s: by_rule(lambda r, k=k: _key(r.reads[k]) if k < len(r.reads) else None).cast("string") for k, s in enumerate(SLOTS)}
    levels = {n: by_rule(lambda r, k=k: F.col(r.levels[k]) if k < len(r.levels) else None).cast("double") for k, n in enumerate("pq")}
    return grid.withColumns(keys | levels | {"feature_count": by_rule(lambda r: F.lit(r.features)).cast("int")})


def _parameters(rule: Rule) -> list[str]:
    return [*re.findall(r"{(\w+)}", " ".join(rule.reads)), *rule.levels]


def identity(grid: DataFrame) -> Column:
    """symbol, rule and the rule's parameters; numbers with decimals in thousandths."""
    types = dict(grid.dtypes)
    text = lambda c: (F.round(F.col(c) * 1000).cast("long") if types[c] == "double" else F.col(c)).cast("string")
    out = F.lit(None).cast("string")
    for name, rule in RULES.items():
        names = [c for c in dict.fromkeys(_parameters(rule)) if c in types]
        out = F.when(F.col("rule") == name, F.concat_ws("_", "symbol", "rule", *[text(c) for c in names])).otherwise(out)
    return out


# Indicators that read closes, and those that read another indicator: (its kind, column).
_FIRST: dict[str, Callable[..., Column]] = {
    "sma": lambda n: R.mean("close", int(n), by=BY),
    "ret": lambda n: R.pct_change("close", int(n), BY),
    "z": lambda n: R.zscore("close", int(n), by=BY),
    "rsi": lambda n: 100.0 - 100.0 / (1.0 + R.ratio(R.mean("_up", int(n), by=BY), R.mean("_down", int(n), by=BY))),
    "high": lambda n: R.high("_before", int(n), by=BY),
    "low": lambda n: R.low("_before", int(n), by=BY),
    "vol": lambda n: R.std("_r", int(n), by=BY),
    "dd": lambda n: R.drawdown("close", int(n), by=BY),
    "feat": lambda name: F.col(name).cast("double"),
}
_SECOND: dict[str, tuple[str, Callable[..., Column]]] = {
    "volq": ("vol", lambda x, n, q: R.quantile(x, LONG, float(q), int(n), by=BY)),
    "zret": ("ret", lambda x, n: R.zscore(x, LONG, LEAST, by=BY)),
    "zvol": ("vol", lambda x, n: R.zscore(x, LONG, LEAST, by=BY)),
    "zdd": ("dd", lambda x, n: R.zscore(x, LONG, LEAST, by=BY)),
    "featz": ("feat", lambda x, name, n: R.zscore(x, int(n), max(20, int(n) // 4), by=BY)),
}


def store(bars: DataFrame, keys: list[str]) -> DataFrame:
    """(symbol, period, days, closes, values): one row for each series and period; values maps each key to its array.

    ``bars`` has symbol, period, ts, close and the feature columns that keys name. Windows restart with each period.
    """
    split = {k: k.split(":") for k in keys}
    base = {k: f"{_SECOND[kind][0]}:{p[0]}" for k, (kind, *p) in split.items() if kind in _SECOND}
    first = dict.fromkeys([*base.values(), *(k for k in keys if k not in base)])
    x = bars.withColumns({"_r": R.pct_change("close", 1, BY), "_before": R.lag("close", 1, BY), "_d": R.diff("close", 1, BY)})
    x = x.withColumns({"_up": F.greatest("_d", F.lit(0.0)) + F.col("_d") * 0, "_down": F.greatest(-F.col("_d"), F.lit(0.0)) + F.col("_d") * 0})  # null stays null
    x = x.withColumns({k: _FIRST[k.split(":")[0]](*k.split(":")[1:]) for k in first})
    x = x.withColumns({k: _SECOND[split[k][0]][1](F.col(f"`{b}`"), *split[k][1:]) for k, b in base.items()})
    row = F.struct("ts", "close", *[F.col(f"`{k}`").alias(f"v{i}") for i, k in enumerate(keys)])
    g = x.groupBy(*BY).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # as many as the calendar has days
    values = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(f"rows.v{i}") for i in range(len(keys))]))
    return g.select(*BY, F.col("rows.ts").alias("days"), F.col("rows.close").alias("closes"), values.alias("values"))


def series_rows(bars: DataFrame, cands: DataFrame, slots) -> DataFrame:
    """The rows of its symbol for every candidate: its own columns, period, ts, close and the indicators named by its ``slots``.

    The keys that candidates name are values of the parameter lists, so they are few however many candidates there are. A slot
    without a key reads the close.
    """
    keys = [r[0] for r in cands.select(F.explode(F.array_compact(F.array(*slots))).alias("k")).distinct().orderBy("k").collect()]
    sizes = cands.groupBy("symbol").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("_salts"))
    c = cands.join(sizes, "symbol").withColumn("_salt", F.pmod(F.xxhash64("candidate_id"), F.col("_salts")).cast("int"))
    s = store(bars, keys).join(sizes, "symbol").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    own = [x for x in cands.columns if x not in (*slots, "symbol")]
    taken = [F.coalesce(F.element_at("values", F.col(k)), "closes").alias(k) for k in slots]
    j = c.drop("_salts").join(s.drop("_salts"), ["symbol", "_salt"])
    j = j.select(*own, "period", F.arrays_zip(F.col("days").alias("ts"), F.col("closes").alias("close"), *taken).alias("rows"))
    return j.repartition("candidate_id", "period").select(*own, "period", F.inline("rows").alias("ts", "close", *slots))


def signal_rows(bars: DataFrame, cands: DataFrame) -> DataFrame:
    """(candidate_id, rule, period, ts, close, signal) of every candidate; ``cands`` come from ``with_keys``."""
    rows = series_rows(bars, cands.select("candidate_id", "symbol", "rule", *SLOTS, "p", "q"), SLOTS)
    mark = F.lit(None).cast("int")
    for name, rule in RULES.items():
        on = F.expr(rule.on)
        off = F.lit(True) if rule.off is None else F.expr(rule.off)
        mark = F.when(F.col("rule") == name, F.when(on, 1).when(off, 0)).otherwise(mark)
    latch = F.coalesce(F.last("_mark", ignorenulls=True).over(R.running(("candidate_id", "period"))), F.lit(0))
    return rows.withColumn("_mark", mark).select("candidate_id", "rule", "period", "ts", "close", latch.alias("signal"))


def equity_rows(rows: DataFrame, cost: float, cash: float = B.CASH) -> DataFrame:
    """Adds position and equity. Crossovers trade in and out of the asset at prices with costs and close at the end; all other
    rules earn the previous signal times the return, and turnover pays."""
    by = ("candidate_id", "period")
    x = rows.withColumns({"position": F.coalesce(R.lag(F.col("signal").cast("double"), 1, by), F.lit(0.0)), "_move": F.coalesce(R.ratio("close", R.lag("close", 1, by)), F.lit(1.0)), "_end": R.lead("ts", 1, by).isNull()})
    x = x.withColumn("_prev", F.coalesce(R.lag("position", 1, by), F.lit(0.0)))
    p, q, move = F.col("position"), F.col("_prev"), F.col("_move")
    traded = F.when((p == 1) & (q == 0), F.lit(1.0 / (1.0 + cost))).when(p == 1, move).when(q == 1, move * (1.0 - cost)).otherwise(F.lit(1.0))
    traded = traded * F.when(F.col("_end") & (p == 1), F.lit(1.0 - cost)).otherwise(F.lit(1.0))
    earned = 1.0 + p * (move - 1.0) - F.abs(p - q) * cost
    step = F.when(F.col("rule") == "ma_crossover", traded).otherwise(earned)
    x = x.withColumn("_step", step)
    return x.withColumn("equity", cash * R.cumulative_product("_step", by)).drop("_move", "_end", "_prev", "_step")


# --- SQL of the same rules --------------------------------------------------------------------


def store_sql(keys: list[str], source: str, features) -> list[str]:
    """CTE ``ind`` (symbol, period, ts, close, key, v) over ``source`` (s0, symbol, period, ts, close and features)."""
    o, cum = "(PARTITION BY symbol ORDER BY ts)", lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"
    over = lambda agg, x, n, least=None: f"CASE WHEN COUNT({x}) OVER {cum(n)} >= {int(least or n)} THEN {agg} OVER {cum(n)} END"
    z = lambda x, n, least=None: f"({x} - ({over(f'AVG({x})', x, n, least)})) / CASE WHEN ({over(f'stddev_pop({x})', x, n, least)}) > 1e-12 THEN ({over(f'stddev_pop({x})', x, n, least)}) END"
    first = {
        "sma": lambda n: over("AVG(close)", "close", n), "ret": lambda n: f"close / nullif(lag(close, {n}) OVER {o}, 0) - 1", "z": lambda n: z("close", n),
        "rsi": lambda n: f"100 - 100 / (1 + ({over('AVG(up)', 'up', n)}) / nullif({over('AVG(down)', 'down', n)}, 0))",
        "high": lambda n: over("MAX(before)", "before", n), "low": lambda n: over("MIN(before)", "before", n), "vol": lambda n: over("stddev_pop(r)", "r", n),
        "dd": lambda n: f"close / ({over('MAX(close)', 'close', n)}) - 1", "feat": lambda name: f"CAST({name} AS DOUBLE)",
    }
    second = {"volq": ("vol", lambda x, n, q: over(f"quantile_cont({x}, {q})", x, LONG, n)), "zret": ("ret", lambda x, n: z(x, LONG, LEAST)), "zvol": ("vol", lambda x, n: z(x, LONG, LEAST)),
              "zdd": ("dd", lambda x, n: z(x, LONG, LEAST)), "featz": ("feat", lambda x, name, n: z(x, n, max(20, int(n) // 4)))}
    base = {k: f"{second[k.split(':')[0]][0]}:{k.split(':')[1]}" for k in keys if k.split(":")[0] in second}
    ones = dict.fromkeys([*base.values(), *(k for k in keys if k not in base)])
    return [
        f"in0 AS (SELECT *, close / lag(close) OVER {o} - 1 AS r, lag(close) OVER {o} AS before, CASE WHEN lag(close) OVER {o} IS NOT NULL THEN greatest(close - lag(close) OVER {o}, 0e0) END AS up, CASE WHEN lag(close) OVER {o} IS NOT NULL THEN greatest(lag(close) OVER {o} - close, 0e0) END AS down FROM {source})",
        "in1 AS (SELECT *, " + ", ".join(f'{first[k.split(":")[0]](*k.split(":")[1:])} AS "{k}"' for k in ones) + " FROM in0)",
        "in2 AS (SELECT *, " + (", ".join(f'{second[k.split(":")[0]][1](chr(34) + b + chr(34), *k.split(":")[1:])} AS "{k}"' for k, b in base.items()) or "1 AS one") + " FROM in1)",
        "ind AS (" + " UNION ALL ".join(f"SELECT s0, period, ts, close, '{k}' AS key, \"{k}\" AS v FROM in2" for k in keys) + ")",
    ]


def signal_sql(candidates: str, source: str) -> list[str]:
    """CTE ``rsig`` (symbol = candidate and period, candidate_id, rule, period, ts, close, signal) from candidates with keys and levels."""
    case = "CASE rule " + " ".join(f"WHEN '{n}' THEN CASE WHEN {r.on} THEN 1 WHEN {r.off or 'true'} THEN 0 END" for n, r in RULES.items()) + " END"
    joins = " ".join(f"LEFT JOIN ind AS i{s} ON i{s}.s0 = x.s0 AND i{s}.period = x.period AND i{s}.ts = x.ts AND i{s}.key = c.{s}" for s in SLOTS)
    return [
        f"rrows AS (SELECT c.candidate_id || '/' || x.period AS symbol, c.candidate_id, c.rule, x.period, x.ts, x.close, c.p, c.q, {', '.join(f'i{s}.v AS {s}' for s in SLOTS)} FROM {candidates} AS c JOIN {source} AS x ON x.s0 = c.symbol {joins})",
        f"rmark AS (SELECT *, {case} AS mark FROM rrows)",
        "rsig AS (SELECT symbol, candidate_id, rule, period, ts, close, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS signal FROM rmark)",
    ]


def equity_sql(cost: float) -> list[str]:
    o = "(PARTITION BY symbol ORDER BY ts)"
    return [
        f"rq1 AS (SELECT *, CAST(coalesce(lag(signal) OVER {o}, 0) AS DOUBLE) AS position, coalesce(close / lag(close) OVER {o}, 1) AS move, lead(ts) OVER {o} IS NULL AS fin FROM rsig)",
        f"rq2 AS (SELECT *, coalesce(lag(position) OVER {o}, 0) AS prev FROM rq1)",
        f"""rq3 AS (SELECT *, CASE WHEN rule = 'ma_crossover' THEN (CASE WHEN position = 1 AND prev = 0 THEN 1 / (1 + {cost}e0) WHEN position = 1 THEN move WHEN prev = 1 THEN move * (1 - {cost}e0) ELSE 1e0 END) * (CASE WHEN fin AND position = 1 THEN 1 - {cost}e0 ELSE 1e0 END)
          ELSE 1 + position * (move - 1) - abs(position - prev) * {cost}e0 END AS step FROM rq2)""",
        "rpos AS (SELECT *, 10000 * product(step) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM rq3)",
    ]


def grid_sql(name: str, symbols: str, space: dict[str, tuple], valid: dict[str, str]) -> str:
    """CTE of the candidates of every rule over a parameter space (name -> values)."""
    parts = []
    for rule, r in RULES.items():
        names = list(dict.fromkeys(_parameters(r)))
        real = {n for n in names if isinstance(space[n][0], float)}
        text = lambda n: f"CAST(CAST(round({n} * 1000) AS BIGINT) AS VARCHAR)" if n in real else f"CAST({n} AS VARCHAR)"
        key = lambda t: " || ".join(f"CAST({x} AS VARCHAR)" if k % 2 else f"'{x}'" for k, x in enumerate(re.split(r"[{}]", t)) if x)
        lists = ", ".join(f"(SELECT unnest([{', '.join(repr(v) + ('e0' if isinstance(v, float) else '') for v in space[n])}]) AS {n})" for n in names)
        cells = [f"{key(r.reads[k])} AS {s}" if k < len(r.reads) else f"NULL AS {s}" for k, s in enumerate(SLOTS)]
        cells += [f"CAST({r.levels[k]} AS DOUBLE) AS {n}" if k < len(r.levels) else f"CAST(NULL AS DOUBLE) AS {n}" for k, n in enumerate("pq")]
        ident = " || '_' || ".join(["symbol", f"'{rule}'", *map(text, names)])
        parts.append(f"SELECT {ident} AS candidate_id, symbol, '{rule}' AS rule, {r.features} AS feature_count, {', '.join(cells)} FROM {symbols}, {lists}" + (f" WHERE {valid[rule]}" if rule in valid else ""))
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def keys_of(space: dict[str, tuple]) -> list[str]:
    """All indicator keys that the rules can name over a parameter space."""
    out: list[str] = []
    for r in RULES.values():
        for t in r.reads:
            found = [t]
            for n in re.findall(r"{(\w+)}", t):
                found = [f.replace("{" + n + "}", str(v)) for f in found for v in space[n]]
            out += found
    return sorted(set(out))
