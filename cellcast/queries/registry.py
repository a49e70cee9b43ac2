"""Query registry: a name, a Spark function and, where SQL can say it, the same in SQL.

``cols`` fixes the output of both sides: name:kind with i (integer), f (float, rounded),
d (date as text), s (text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _spark_column(name: str, kind: str, digits: int):
    c = F.col(name)
    if kind == "i":
        out = c.cast("long")
    elif kind == "f":
        # Adding zero turns a negative zero into zero.
        out = F.round(c.cast("double"), digits) + F.lit(0.0)
    else:
        out = c.cast("string")
    return out.alias(name)


def _sql_column(name: str, kind: str, digits: int) -> str:
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "f":
        return f'round(CAST("{name}" AS DOUBLE), {digits}) + 0.0 AS "{name}"'
    return f'CAST("{name}" AS VARCHAR) AS "{name}"'


def query(name: str, cols: str, sql: str | None = None, digits: int = 6):
    """Register a query; ``sql`` is the oracle (omit for draws and iterative fits)."""
    spec = [tuple(c.split(":")) for c in cols.split()]

    def add(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[_spark_column(n, k, digits) for n, k in spec])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            picked = ", ".join(_sql_column(n, k, digits) for n, k in spec)
            ORACLES[name] = f"SELECT {picked} FROM ({sql}) AS result"
        return fn

    return add
