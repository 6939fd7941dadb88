"""Recursions over ordered series: smoothing, exponential and Wilder averages, position memory.

An affine recursion is computed in chunks: inside a chunk the state is a running sum of scaled steps, a chunk as a whole maps the
state before it to the state after it by one factor and one offset, and the few chunks before it that still matter are
composed from their offsets. All of it is windows over (series, chunk) and over the small table of chunks.

Position memory walks its series row by row in Python: its state after a row depends on when it last flipped. A group holds
one row per calendar period, so groups stay bounded while their number scales out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.functions import rolling as R

#: A chunk is as long as it takes a state to fade to this share, and states fade out of sight at the second.
FADED, GONE = 1e-8, 1e-18


def affine(df: DataFrame, steps: dict[str, tuple[float | Column, Column]], by=("symbol",), order: str = "ts") -> DataFrame:
    """Adds a column for every name: s_t = decay * s_(t-1) + step_t, NULL before the first step; steps are (decay, step).

    Decays lie in [0, 1). They are numbers, or one column, constant within a series, for all names. A NULL step after the first
    counts as zero. Chunks are as long as the fastest decay fades, so scaled steps never grow by more than 1 / FADED.
    """
    kinds = [a for a, _ in steps.values()]
    if isinstance(kinds[0], Column):
        size = F.when(kinds[0] > 0, F.least(F.ceil(math.log(FADED) / F.ln(kinds[0])), F.lit(1 << 20))).otherwise(1)
        back = {n: math.ceil(math.log(GONE) / math.log(FADED)) for n in steps}
    else:
        fade = [math.log(a) if a > 0 else -math.inf for a in kinds]
        length = max(1, math.ceil(math.log(FADED) / min(fade))) if min(fade) > -math.inf else 1
        size = F.lit(length)
        back = {n: max(1, math.ceil(math.log(GONE) / (f * length))) if f > -math.inf else 1 for n, f in zip(steps, fade, strict=True)}
    x = df.withColumns({"_rn": F.row_number().over(R.ordered(by, order)) - 1, "_size": size})
    x = x.withColumn("_chunk", F.floor(F.col("_rn") / F.col("_size"))).withColumn("_at", F.col("_rn") - F.col("_chunk") * F.col("_size"))
    decay = {n: a if isinstance(a, Column) else F.lit(float(a)) for n, (a, _) in steps.items()}
    x = x.withColumns({f"_b_{n}": b for n, (_, b) in steps.items()} | {f"_a_{n}": a for n, a in decay.items()})
    chunk = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = {n: F.sum(F.coalesce(f"_b_{n}", F.lit(0.0)) * F.pow(f"_a_{n}", -F.col("_at"))).over(chunk) for n in steps}
    x = x.withColumns({f"_s_{n}": F.pow(f"_a_{n}", "_at") * g for n, g in grown.items()} | {f"_k_{n}": F.count(f"_b_{n}").over(R.running(by, order)) for n in steps})
    ends = x.groupBy(*by, "_chunk").agg(*[F.max_by(f"_s_{n}", "_at").alias(f"_e_{n}") for n in steps], *[F.pow(F.first(f"_a_{n}"), F.first("_size")).alias(f"_f_{n}") for n in steps])
    past = Window.partitionBy(*by).orderBy("_chunk")
    carried = {n: sum((F.pow(f"_f_{n}", F.lit(j - 1)) * F.coalesce(F.lag(f"_e_{n}", j).over(past), F.lit(0.0)) for j in range(1, back[n] + 1)), F.lit(0.0)) for n in steps}
    x = x.join(ends.select(*by, "_chunk", *[c.alias(f"_c_{n}") for n, c in carried.items()]), [*by, "_chunk"])
    value = {n: F.when(F.col(f"_k_{n}") > 0, F.col(f"_s_{n}") + F.pow(f"_a_{n}", F.col("_at") + 1) * F.col(f"_c_{n}")) for n in steps}
    return x.select(*[F.col(c) for c in df.columns if c not in steps], *[v.alias(n) for n, v in value.items()])


def exposure_smoothing(df: DataFrame, x: str, alpha, by, out: str = "smoothed", order: str = "ts") -> DataFrame:
    """s0 = x0, s = a * s_prev + (1 - a) * x; the published value is clipped to [-1, 1].

    ``alpha`` is a number or a column constant within the series, clipped to [0, 0.95].
    """
    if isinstance(alpha, str):
        a = F.least(F.greatest(F.col(alpha).cast("double"), F.lit(0.0)), F.lit(0.95))
    else:
        a = min(max(float(alpha), 0.0), 0.95)
    first = R.lag(F.lit(1), 1, by, order).isNull()
    y = affine(df.withColumn("_x", F.when(first, F.col(x)).otherwise((1.0 - a) * F.col(x))), {out: (a, F.col("_x"))}, by, order)
    return y.withColumn(out, F.greatest(F.least(out, F.lit(1.0)), F.lit(-1.0))).drop("_x")


def _mean_steps(x: str, span: int, by, order: str = "ts") -> tuple[float, Column]:
    """Decay and step of an exponential mean (no bias adjustment): the first value, then its share of each; gaps repeat the last value."""
    a = 2.0 / (span + 1)
    known = R.forward_fill(x, by, order)
    return 1.0 - a, F.when(F.count(x).over(R.running(by, order)) == 1, F.when(F.col(x).isNotNull(), F.col(x)).otherwise(a * known)).otherwise(a * known)


def _after(value, x: str, n: int, by, order: str = "ts") -> Column:
    """``value`` from the n-th value of ``x`` on."""
    return F.when(F.count(x).over(R.running(by, order)) >= n, value)


def ema(df: DataFrame, x: str, span: int, by=("symbol",), out: str | None = None) -> DataFrame:
    """Exponential mean (no bias adjustment), NULL before ``span`` observations."""
    name = out or f"ema_{span}"
    y = affine(df, {name: _mean_steps(x, span, by)}, by)
    return y.withColumn(name, _after(F.col(name), x, span, by))


def _macd_ready(y: DataFrame, x: str, fast: int, slow: int, signal: int, by) -> DataFrame:
    """Lines from the means ``_fast`` and ``_slow``."""
    y = y.withColumn("macd_line", _after(F.col("_fast") - F.col("_slow"), x, max(fast, slow), by)).drop("_fast", "_slow")
    y = affine(y, {"macd_signal": _mean_steps("macd_line", signal, by)}, by)
    y = y.withColumn("macd_signal", _after(F.col("macd_signal"), "macd_line", signal, by))
    return y.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, by=("symbol",)) -> DataFrame:
    """Fast minus slow exponential mean, its signal line and their difference."""
    return _macd_ready(affine(df, {"_fast": _mean_steps(x, fast, by), "_slow": _mean_steps(x, slow, by)}, by), x, fast, slow, signal, by)


def _wilder(df: DataFrame, x: str, n: int, by) -> tuple[DataFrame, dict]:
    """``df`` with moves, and the steps of their means: that of the first n moves, then the 1/n recursion."""
    y = df.withColumn("_move", R.diff(x, 1, by))
    y = y.withColumns({"_gain": F.greatest("_move", F.lit(0.0)), "_loss": F.greatest(-F.col("_move"), F.lit(0.0)), "_moves": F.count("_move").over(R.running(by))})
    y = y.withColumns({k: F.when(F.col("_moves") > 0, F.col(k)) for k in ("_gain", "_loss")})
    step = lambda c: F.when(F.col("_moves") == n, R.mean(c, n, by=by)).when(F.col("_moves") > n, F.col(c) / n)
    return y, {"_up": (1.0 - 1.0 / n, step("_gain")), "_down": (1.0 - 1.0 / n, step("_loss"))}


def _index(name: str) -> Column:
    return F.when(F.col("_down") > 0, 100.0 - 100.0 / (1.0 + F.col("_up") / F.col("_down"))).when(F.col("_down").isNotNull(), 100.0).alias(name)


def rsi_wilder(df: DataFrame, x: str = "close", n: int = 14, by=("symbol",)) -> DataFrame:
    """Wilder's index: plain mean of the first n moves, then the 1/n recursion; 100 without losses."""
    y, steps = _wilder(df, x, n, by)
    return affine(y, steps, by).select(*df.columns, _index(f"rsi_{n}"))


def _variance_steps(x: str, span: int, by) -> dict:
    """Means of the values, of their squares, and of the squared weights that correct the variance."""
    a = 2.0 / (span + 1)
    mean, square = _mean_steps(x, span, by), _mean_steps("_square", span, by)
    k = F.count(x).over(R.running(by))
    return {"_m1": mean, "_m2": square, "_w": ((1.0 - a) ** 2, F.when(k == 1, 1.0).when(k > 1, a * a))}


def _deviation(x: str, span: int, by) -> Column:
    value = F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)) / F.nullif(1.0 - F.col("_w"), F.lit(0.0)))
    return _after(value, x, max(span, 2), by).alias(f"ewma_vol_{span}")


def ewma_vol(df: DataFrame, x: str = "r", span: int = 20, by=("symbol",)) -> DataFrame:
    """Exponentially weighted standard deviation, NULL before ``span`` observations."""
    y = affine(df.withColumn("_square", F.col(x) * F.col(x)), _variance_steps(x, span, by), by)
    return y.select(*df.columns, _deviation(x, span, by))


def technical(df: DataFrame, by=("symbol",)) -> DataFrame:
    """Wilder index, convergence lines and exponential volatility; their means share one chunking."""
    y, steps = _wilder(df.withColumn("_square", F.col("r") * F.col("r")), "close", 14, by)
    y = affine(y, steps | {"_fast": _mean_steps("close", 12, by), "_slow": _mean_steps("close", 26, by)} | _variance_steps("r", 20, by), by)
    y = _macd_ready(y.withColumns({"rsi_14": _index("rsi_14"), "ewma_vol_20": _deviation("r", 20, by)}), "close", 12, 26, 9, by)
    return y.select(*df.columns, "rsi_14", "macd_line", "macd_signal", "macd_hist", "ewma_vol_20")


def per_series(df: DataFrame, by, fn, added: dict[str, T.DataType], order: str = "ts") -> DataFrame:
    """Apply ``fn`` to every sorted series; it returns the new columns as arrays in row order."""
    schema = T.StructType(df.schema.fields + [T.StructField(k, t) for k, t in added.items()])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(**fn(pdf))[schema.names]

    return df.groupBy(*by).applyInPandas(run, schema)


def remember(want: np.ndarray, confirm: int, hold: int) -> np.ndarray:
    """Walk one series of +1/-1 wishes through the confirm-and-hold rule."""
    confirm, hold = max(1, int(confirm)), max(1, int(hold))
    state, run, held = 1, 0, hold
    path = np.empty(len(want), dtype=np.int32)
    for i, w in enumerate(want):
        run = run + 1 if w != state else 0
        if run >= confirm and held >= hold:
            state, run, held = w, 0, 1
        else:
            held += 1
        path[i] = state
    return path


def position_memory(df: DataFrame, signal: str, by, confirm: str | int = 1, hold: str | int = 1, out: str = "position") -> DataFrame:
    """Long/short state that flips only after ``confirm`` opposite signals in a row and ``hold`` bars held.

    The state starts long with the hold already served. Missing signals count as long. ``confirm`` and
    ``hold`` are numbers or columns constant within the series.
    """

    def run(p: pd.DataFrame) -> dict:
        pick = lambda v: int(p[v].iloc[0]) if isinstance(v, str) else int(v)
        want = np.where(p[signal].fillna(1).to_numpy() >= 0, 1, -1)
        return {out: remember(want, pick(confirm), pick(hold))}

    return per_series(df, by, run, {out: T.IntegerType()})
