"""Registration of queries, each with the SQL that it is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, text: str, oracle: str | None = None, by: dict[str, list[str]] | None = None) -> None:
    """Register Spark SQL whose tables are written as {name}; oracle: where DuckDB needs other words for the same.

    by: the keys by which large tables that are joined and grouped by the same keys are dealt out, to tasks of bounded size.
    """
    tables = sorted(set(_TABLE.findall(text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = {t: table(spark, sf_dir, t) for t in tables}
        return spark.sql(text, **read | (dealt({t: (read[t], keys) for t, keys in by.items()}) if by else {}))

    QUERIES[name] = run
    ORACLES[name] = _TABLE.sub(r"\1", oracle or text)


def frame(oracle: str) -> Callable[[Query], Query]:
    """Register a function that builds its result with the DataFrame API."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register
