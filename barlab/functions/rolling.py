"""Column builders for row-count windows over ordered series.

A series is one value of the ``by`` columns ordered by ``order``. Bars have daily grain (one row per
series and trading day), so a window partition is bounded by the trading calendar - about 252 rows a
year - whatever the size of the raw table behind it. Missing values are NULL; a statistic is NULL
unless at least ``mp`` non-null values are in its frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("symbol",)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(by=SERIES, order="ts"):
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*by).orderBy(*order)


def frame(n: int, by=SERIES, order="ts"):
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def running(by=SERIES, order="ts"):
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def ratio(a, b) -> Column:
    """a / b with NULL for a zero divisor."""
    return _c(a) / F.nullif(_c(b), F.lit(0.0))


def guarded(value: Column, x, w, mp: int) -> Column:
    return F.when(F.count(_c(x)).over(w) >= mp, value)


def lag(x, n=1, by=SERIES, order="ts") -> Column:
    return F.lag(_c(x), n).over(ordered(by, order))


def lead(x, n=1, by=SERIES, order="ts") -> Column:
    return F.lead(_c(x), n).over(ordered(by, order))


def pct_change(x, n=1, by=SERIES, order="ts") -> Column:
    return ratio(x, lag(x, n, by, order)) - F.lit(1.0)


def diff(x, n=1, by=SERIES, order="ts") -> Column:
    return _c(x) - lag(x, n, by, order)


def mean(x, n, mp=None, by=SERIES, order="ts") -> Column:
    w = frame(n, by, order)
    return guarded(F.avg(_c(x)).over(w), x, w, n if mp is None else mp)


def std(x, n, mp=None, ddof=0, by=SERIES, order="ts") -> Column:
    w = frame(n, by, order)
    fn = F.stddev_pop if ddof == 0 else F.stddev_samp
    return guarded(fn(_c(x)).over(w), x, w, n if mp is None else mp)


def low(x, n, mp=None, by=SERIES, order="ts") -> Column:
    w = frame(n, by, order)
    return guarded(F.min(_c(x)).over(w), x, w, n if mp is None else mp)


def high(x, n, mp=None, by=SERIES, order="ts") -> Column:
    w = frame(n, by, order)
    return guarded(F.max(_c(x)).over(w), x, w, n if mp is None else mp)


def zscore(x, n, mp=None, ddof=0, by=SERIES, order="ts") -> Column:
    """(x - mean) / std; a zero deviation (up to rounding noise) gives NULL."""
    return _safe_z(x, mean(x, n, mp, by, order), std(x, n, mp, ddof, by, order))


def _safe_z(x, mu, sd) -> Column:
    return (_c(x) - mu) / F.when(sd > 1e-12, sd)


def expanding_zscore(x, mp=30, ddof=1, by=SERIES, order="ts") -> Column:
    w = running(by, order)
    fn = F.stddev_pop if ddof == 0 else F.stddev_samp
    return guarded(_safe_z(x, F.avg(_c(x)).over(w), fn(_c(x)).over(w)), x, w, mp)


def skew(x, n, mp=None, by=SERIES, order="ts") -> Column:
    """Bias-corrected sample skewness G1."""
    w = frame(n, by, order)
    k = F.count(_c(x)).over(w).cast("double")
    g1 = F.skewness(_c(x)).over(w)
    return guarded(F.when(k > 2, F.sqrt(k * (k - 1)) / (k - 2) * g1), x, w, n if mp is None else mp)


def kurt(x, n, mp=None, by=SERIES, order="ts") -> Column:
    """Bias-corrected excess kurtosis G2."""
    w = frame(n, by, order)
    k = F.count(_c(x)).over(w).cast("double")
    g2 = F.kurtosis(_c(x)).over(w)
    value = (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * g2 + 6)
    return guarded(F.when(k > 3, value), x, w, n if mp is None else mp)


def quantile(x, n, q, mp=None, by=SERIES, order="ts") -> Column:
    w = frame(n, by, order)
    return guarded(F.percentile(_c(x), q).over(w), x, w, n if mp is None else mp)


def percentile_rank(x, n, mp=None, by=SERIES, order="ts") -> Column:
    """Share of the frame at or below the current value, ties counted at their average rank."""
    w = frame(n, by, order)
    return guarded(_rank_share(x, w), x, w, n if mp is None else mp)


def expanding_percentile(x, mp=20, by=SERIES, order="ts") -> Column:
    """percentile_rank over all rows so far; the frame is bounded by the series' calendar."""
    w = running(by, order)
    return guarded(_rank_share(x, w), x, w, mp)


def _rank_share(x, w) -> Column:
    x = _c(x)
    values = F.collect_list(x).over(w)
    less = F.size(F.filter(values, lambda v: v < x))
    same = F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull(), (less + (same + 1) / 2.0) / F.size(values))


def forward_fill(x, by=SERIES, order="ts") -> Column:
    return F.last(_c(x), ignorenulls=True).over(running(by, order))


def drawdown(x, n=None, mp=None, by=SERIES, order="ts") -> Column:
    """x over its rolling (or running) maximum, minus one."""
    top = F.max(_c(x)).over(running(by, order)) if n is None else high(x, n, mp, by, order)
    return ratio(x, top) - F.lit(1.0)


def cumulative_product(x, by=SERIES, order="ts") -> Column:
    """Running product; factors may be zero or negative, so no logarithms."""
    return F.product(_c(x)).over(running(by, order))


def prefix_sums(df: DataFrame, columns, n: int, powers=(1, 2), by=SERIES, order="ts") -> DataFrame:
    """Rolling sums of powers over n rows in linear time, for wide frames over many columns.

    A plain ROWS frame re-reads all n rows at every step; here each column keeps running sums and the
    frame is a difference of two of them. Adds ``_n_<col>`` (non-null count) and ``_p<k>_<col>``. Values
    are shifted by the series mean, kept in ``_c_<col>``, so the sums stay well conditioned.
    """
    whole = Window.partitionBy(*by)
    x = df.withColumns({f"_c_{c}": F.coalesce(F.avg(c).over(whole), F.lit(0.0)) for c in columns})
    run = running(by, order)
    sums = {}
    for c in columns:
        v = F.col(c) - F.col(f"_c_{c}")
        sums[f"_n_{c}"] = F.count(c).over(run)
        for k in powers:
            t = v
            for _ in range(k - 1):
                t = t * v
            sums[f"_p{k}_{c}"] = F.coalesce(F.sum(t).over(run), F.lit(0.0))
    x = x.withColumns(sums)
    past = ordered(by, order)
    return x.withColumns({k: F.col(k) - F.coalesce(F.lag(k, n).over(past), F.lit(0)) for k in sums})


def zscores(df: DataFrame, columns, n: int, mp: int | None = None, ddof: int = 0, by=SERIES, order="ts") -> DataFrame:
    """Replace many columns by their rolling z-scores in linear time: running sums of all of them over one sort of each series."""
    x = prefix_sums(df.withColumns({c: F.col(c).cast("double") for c in columns}), columns, n, (1, 2), by, order)

    def z(c: str) -> Column:
        k, s1, s2 = F.col(f"_n_{c}").cast("double"), F.col(f"_p1_{c}"), F.col(f"_p2_{c}")
        mu = s1 / F.nullif(k, F.lit(0.0))
        var = (s2 - s1 * mu) / F.when(k > ddof, k - ddof)
        # a variance at the level of rounding noise counts as zero
        sd = F.when(var > F.greatest(F.lit(1e-24), 1e-13 * s2 / F.nullif(k, F.lit(0.0))), F.sqrt(var))
        return F.when(k >= (n if mp is None else mp), (F.col(c) - F.col(f"_c_{c}") - mu) / sd)

    return x.select(*[z(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def bars_since(cond: Column, by=SERIES, order="ts", rn="rn") -> Column:
    """Rows since ``cond`` was last true (NULL before the first time); ``rn`` numbers the series' rows."""
    return _c(rn) - F.last(F.when(cond, _c(rn)), ignorenulls=True).over(running(by, order))


def hysteresis(enter: Column, leave: Column, by=SERIES, order="ts") -> Column:
    """Two-state latch: 1 after ``enter``, 0 after ``leave``, otherwise the previous state."""
    mark = F.when(enter, F.lit(1)).when(leave, F.lit(0))
    return F.coalesce(F.last(mark, ignorenulls=True).over(running(by, order)), F.lit(0))


PARKINSON = 4.0 * math.log(2.0)
GARMAN_KLASS = 2.0 * math.log(2.0) - 1.0
