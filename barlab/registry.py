"""Query registry: every operator registers a runnable query and, where SQL can say it, an oracle.

The wrapper gives results a stable surface: doubles rounded to six places (no negative zero, NaN as
NULL), dates and timestamps as text, integers as BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def publish(df: DataFrame) -> DataFrame:
    cols = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.round(F.when(~F.isnan(c), c), 6) + F.lit(0.0)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(field.name))
    return df.select(cols)


def query(name: str, sql: str | None = None, share: bool = False):
    """Register ``fn`` as a query; ``share`` materialises the derived base tables it uses in several places."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            if not share:
                return publish(fn(spark, sf_dir))
            from barlab.plans.inputs import sharing

            with sharing():
                return publish(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__module_tag__ = fn.__module__.rsplit('.', 1)[-1]
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_FORMS = {
    "s": "{c}",
    "f": "round(CAST({c} AS DOUBLE), 6) + 0.0",
    "i": "CAST({c} AS BIGINT)",
    "b": "CAST({c} AS BOOLEAN)",
    "d": "strftime({c}, '%Y-%m-%d')",
    "t": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
}


def oracle(out: str, *parts: str) -> str:
    """Build oracle SQL from CTE texts and a final SELECT; ``out`` lists ``form:column`` items."""
    *ctes, final = parts
    flat: list[str] = []
    for cte in ctes:
        for item in cte if isinstance(cte, (list, tuple)) else [cte]:
            if item not in flat:
                flat.append(item)
    cols = []
    for item in out.split():
        form, name = item.split(":")
        cols.append(f"{_FORMS[form].format(c=name)} AS {name}")
    head = "WITH " + ",\n".join(flat) + "\n" if flat else ""
    return f"{head}SELECT {', '.join(cols)} FROM (\n{final}\n) AS final_rows"


def sharing_query(name: str, sql: str | None = None):
    return query(name, sql, share=True)
