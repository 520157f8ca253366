"""Row ranges. A distributed table has no order of its own, so each takes the order that it means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _columns(order: tuple) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows by order, or any n without one; n = 0 keeps the schema."""
    return (df.orderBy(*[c.asc_nulls_last() for c in _columns(order)]) if order else df).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows by order, in order. Only n rows of each task reach the last step."""
    last = df.orderBy(*[F.col(c).desc_nulls_first() for c in order]).limit(n)
    return last.orderBy(*[F.col(c).asc_nulls_last() for c in order])


def page(df: DataFrame, offset: int, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).offset(offset).limit(n)
