"""Tables kept as Parquet: single directories, and databases cut into partitions by date or another key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_parted(df: DataFrame, root: str, table: str, key: str = "date") -> None:
    """One directory for each value of the key. Rows are dealt by key, and Spark splits a busy key's by their size, so files stay few and none grows without bound."""
    dealt = df.sparkSession.sql(f"SELECT /*+ REBALANCE(`{key}`) */ * FROM {{rows}}", rows=df)
    dealt.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy(key).parquet(f"{root}/{table}")


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a directory of any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of any store that match a pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [s.getPath().toString() for s in found or []]


def read_parted(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A partitioned table with its key as first column, so that filters on the key prune directories.

    Two layouts are read: root/table/key=value, and root/value/table, where the key is named date if all values
    are days written YYYY.MM.DD and part otherwise; whole numbers are BIGINT, anything else is text.
    """
    keyed = [n for n in _children(spark, f"{root}/{table}") if "=" in n]
    if keyed:
        key = keyed[0].partition("=")[0]
        df = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
        return df.select(key, *[c for c in df.columns if c != key])
    found = _matching(spark, f"{root}/*/{table}")
    values = sorted(p.rstrip("/").split("/")[-2] for p in found)
    values = [v for v in values if not v.startswith((".", "_"))]
    if not values:
        raise ValueError(f"{root} has no partitions of {table}")
    days = all(re.fullmatch(r"\d{4}\.\d\d\.\d\d", v) for v in values)
    whole = all(re.fullmatch(r"-?\d+", v) for v in values)
    name = "date" if days else "part"
    # one scan over all partitions; a filter on the key is one on files' paths, which drops files before they are read
    df = spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{v}/{table}" for v in values])
    value = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"/([^/]+)/{re.escape(table)}/[^/]*$", 1)
    mark = F.to_date(value, "yyyy.MM.dd") if days else value.cast("bigint") if whole else value
    return df.select(mark.alias(name), *[F.col(f"`{c}`") for c in df.columns])


def load_parts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All partitions' rows without the key."""
    df = read_parted(spark, root, table)
    return df.drop(df.columns[0])
