"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, written


def _apart(least: DataFrame) -> DataFrame:
    """An aggregate as a table of its own. Joined with it, a hub's rows can be split or met by a broadcast, as its size is known;
    straight from the aggregate they would all stay in the task that their key was dealt to."""
    return written(least, "least")


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node passes the least node around it to its greater neighbours. edges: distinct (u, v) with u > v. Also the table of least nodes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node passes its least smaller neighbour to the other smaller ones. Also the table of least nodes."""
    least = _apart(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: each upper node has one link and is nobody's lower node. A lower node is then the least of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.max("up").alias("up"), F.count(F.lit(1)).alias("n")).filter("up = 1 and n > 1").isEmpty()


def stars(links: DataFrame, most: int = 60) -> DataFrame:
    """(u, v): every linked node u but the least of its component, with that least node v.

    links: two columns of one integer type; order, repeats, loops and nulls do not matter. Hubs are met by
    aggregates with partial sums and by joins whose large partitions Spark splits; nothing is collected, and
    each round ends in shared storage, from which the round before is deleted. Links that are stars already take
    no round, as every query costs the driver memory and time, however small. An empty table gives an empty one.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    edges = written(edges, "links")
    for _ in range(most):
        if _settled(edges):
            return edges
        large, least = _large(edges)
        small, least2 = _small(large)
        after = written(small, "links")
        discard(edges, least, least2)
        edges = after
    raise RuntimeError(f"no end after {most} rounds")
