"""Small column helpers used across the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.sources.commerce import NET_STATUSES, VALID_STATUSES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column, scale: float = 1.0) -> Column:
    """``scale * num / den`` in double arithmetic, null when the denominator is 0 or null."""
    return F.try_divide(col(num).cast("double") * F.lit(float(scale)), col(den).cast("double"))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def is_valid(status: str | Column = "order_status") -> Column:
    return col(status).isin(*VALID_STATUSES)


def is_net(status: str | Column = "order_status") -> Column:
    return col(status).isin(*NET_STATUSES)


def sum_if(cond: Column, value: str | Column) -> Column:
    """Conditional sum that is 0, not null, when nothing qualifies."""
    return F.coalesce(F.sum(F.when(cond, col(value))), F.lit(0))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(col(later), col(earlier))


def with_one_row(df: DataFrame, stats: DataFrame, name: str) -> DataFrame:
    """Attach a one-row aggregate as a struct column.

    The row is evaluated once as a scalar subquery and becomes a constant in
    the outer plan, so no join and no shuffle of ``df`` takes place.
    """
    return df.withColumn(name, stats.select(F.struct("*").alias(name)).scalar())


def n_rows() -> Column:
    return F.count(F.lit(1))


def with_lookup(df: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """Attach the row of a bounded table (features, tests, segments) as a struct column.

    The table becomes one map constant through a scalar subquery, so a key with
    few values never shuffles the rows of ``df``.
    """
    values = F.struct(*[c for c in table.columns if c != key])
    lookup = table.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), values)))).scalar()
    return df.withColumn("_lookup", lookup).withColumn(name, F.col("_lookup")[F.col(key)]).drop("_lookup")


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over the pairs without nulls; null where a side does not vary.

    The built-in aggregate raises a division error for a constant side.
    """
    a, b = col(x).cast("double"), col(y).cast("double")
    pair = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(pair, a)) * F.stddev_pop(F.when(pair, b)))
