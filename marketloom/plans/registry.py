"""Registry of runnable queries.

A query is registered with a column specification that fixes its output
types: ``i`` bigint, ``d`` double, ``dN`` double rounded to N places, ``s``
string, ``t`` date, ``z`` timestamp, ``b`` boolean.  The specification is applied to the Spark result
and to the SQL used to check it, so both have one schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.plans.commerce_sql import with_tables
from marketloom.sources.commerce import Commerce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK_TYPES = {"i": "bigint", "s": "string", "t": "date", "z": "timestamp_ntz", "b": "boolean", "d": "double"}
_SQL_TYPES = {"i": "BIGINT", "s": "VARCHAR", "t": "DATE", "z": "TIMESTAMP", "b": "BOOLEAN", "d": "DOUBLE"}
#: Relative guard that keeps values sitting on a rounding tie on one side of it.
_TIE_GUARD = 1 + 1e-12


def _parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _spark_column(name: str, kind: str) -> Column:
    col = F.col(name)
    if len(kind) > 1:
        return F.round(col.cast("double") * _TIE_GUARD, int(kind[1:])).alias(name)
    return col.cast(_SPARK_TYPES[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if len(kind) > 1:
        return f"ROUND(CAST({name} AS DOUBLE) * {_TIE_GUARD!r}, {kind[1:]}) AS {name}"
    return f"CAST({name} AS {_SQL_TYPES[kind]}) AS {name}"


def query(name: str, spec: str, oracle: str | None = None):
    """Register ``fn(commerce) -> DataFrame`` and, if given, the SQL that must agree with it."""
    columns = _parse(spec)

    def register(fn: Callable[[Commerce], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Commerce(spark, sf_dir))
            return out.select(*[_spark_column(n, k) for n, k in columns])

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            inner = with_tables(oracle)
            ORACLES[name] = "SELECT " + ", ".join(_sql_column(n, k) for n, k in columns) + f" FROM ({inner}) q"
        return fn

    return register
