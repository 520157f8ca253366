"""Equi-joins with one column for each key, and the interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}

#: Rows of one table that a task joins, about, where tables are dealt out by their sizes.
DEALT = 1 << 19


def dealt(tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Tables, each with its keys, dealt out by hash of these to as many tasks as the largest needs; as they are if that is one.

    For joins whose result is grouped by the same keys. The number of tasks that Spark takes is the session's or comes from
    compressed bytes, so that what a task sorts grows with the input, and where a grouping follows it splits no partition.
    """
    tasks = -(-max(df.count() for df, _ in tables.values()) // DEALT)
    if tasks < 2:
        return {name: df for name, (df, _) in tables.items()}
    tasks = max(tasks, next(iter(tables.values()))[0].sparkSession.sparkContext.defaultParallelism)
    return {name: df.repartition(tasks, *keys) for name, (df, keys) in tables.items()}


def equi_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, each key once in the result. Other columns of right whose names left has too are left out.

    Spark picks the strategy: it broadcasts a side whose size it knows to be small and shuffles both otherwise,
    and splits large partitions at run time.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    clash = [c for c in right.columns if c in left.columns and c not in on]
    return left.join(right.drop(*clash), on, HOW[how])


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of the columns as 0, false or the empty string, as an unmatched row of an outer join is shown by some engines."""
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c] != "string" and kinds[c] != "boolean"]
    df = df.fillna(0, subset=numbers) if numbers else df
    text = [c for c in columns if kinds[c] == "string"]
    df = df.fillna("", subset=text) if text else df
    flags = [c for c in columns if kinds[c] == "boolean"]
    return df.fillna(False, subset=flags) if flags else df


def interval_join(left: DataFrame, right: DataFrame, time: str, keys: list[str], lo: int, hi: int, aggs: dict[str, Column]) -> DataFrame:
    """For each row of left, aggregates over the rows of right with equal keys and time in [left.time + lo, left.time + hi].

    lo and hi are in microseconds for timestamps and in units otherwise; both ends belong to the interval. Every
    row of left stays, also one without any match, whose counts are 0 and other aggregates null. aggs are
    expressions over columns of right, which do not clash with left's.

    Time is cut into buckets as wide as the interval, so an interval touches two at most. The join is on keys and
    bucket and is dealt out by hash; a busy key is spread over its buckets, whatever part of the rows it has. Equal
    rows of left are met once and repeated at the end, so no row number is needed that a repeated task could change.
    """
    if hi < lo:
        raise ValueError("hi must not be less than lo")
    stamp = dict(left.dtypes)[time].startswith(("timestamp", "date"))
    ticks = (lambda c: F.unix_micros(c.cast("timestamp"))) if stamp else (lambda c: c.cast("bigint"))
    width = max(1, hi - lo)
    own = [c for c in right.columns if c not in (*keys, time)]
    probe = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("__times")).withColumn("__t", ticks(F.col(time)))
    first = F.floor((F.col("__t") + lo) / F.lit(width))
    probe = probe.withColumn("__bucket", F.explode_outer(F.array(first, first + 1)))
    build = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], ticks(F.col(time)).alias("__u"), *own).withColumn("__at", F.floor(F.col("__u") / F.lit(width)))
    same = (F.col("__bucket") == F.col("__at")) & F.col("__u").between(F.col("__t") + lo, F.col("__t") + hi)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    found = probe.join(build, same, "left").groupBy(*left.columns, "__times").agg(*[a.alias(n) for n, a in aggs.items()])
    return found.select("*", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")).drop("__times", "__copy")
