"""Frames and window helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows that one task sorts for a number, about; the most pieces that a table is cut into for that; sampled rows for each cut.
PIECE, PIECES, SAMPLED = 1 << 20, 1024, 100


def window(partition: list, order: list | None = None) -> WindowSpec:
    """Rows of a partition in order; nulls come last going up and first going down unless the column says otherwise."""
    w = Window.partitionBy(*partition)
    return w.orderBy(*order) if order else w


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running(w: WindowSpec) -> WindowSpec:
    """Row by row, peers one after another."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rows(w: WindowSpec, before: int, after: int) -> WindowSpec:
    """From `before` rows ahead of the current one to `after` rows behind it."""
    return w.rowsBetween(-before, after)


def ntile_compat(n: int, partition: list, order: list) -> Column:
    """Bucket floor((row - 1) * n / rows) + 1: sizes are spread evenly, where NTILE puts the larger buckets first."""
    w = window(partition, order)
    return (F.floor((F.row_number().over(w) - 1) * F.lit(n) / F.count(F.lit(1)).over(whole(window(partition)))) + 1).cast("bigint")


def lag_compat(c: Column, partition: list, order: list, by: int = 1) -> Column:
    """LAG with 0 instead of null before the first row."""
    return F.coalesce(F.lag(c, by).over(window(partition, order)), F.lit(0))


def _piece(key: Column, cuts: list[Column], first: int = 0) -> Column:
    """The number of cuts up to the key, by halving. Whatever the cuts are, a larger key is in no earlier piece, and equal keys are in one."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(key < cuts[k], _piece(key, cuts[:k], first)).otherwise(_piece(key, cuts[k + 1 :], first + k + 1))


def _literal(row: tuple, kinds: list) -> Column:
    return F.struct(*[F.lit(v).cast(kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(row, kinds, strict=True))])


def numbered(df: DataFrame, partition: list[str], order: list[str], name: str, number: str = "row_number") -> DataFrame:
    """df with ROW_NUMBER or RANK as a long, going up, nulls last, where a partition may be the whole table.

    A window puts each partition into one task. Here the table is cut in the order of partition and order columns into pieces of
    about PIECE rows. A row's number in its piece is added to the rows that its partition has in earlier pieces: at most one
    partition goes on from one piece to the next, so these sums are few. A sample of the keys places the cuts, which change the
    sizes of the pieces and no number. Rows equal in all these columns stay in one piece.
    """
    up = [F.col(c).asc_nulls_last() for c in order]
    made = getattr(F, number)()
    n = df.count()
    pieces = min(PIECES, -(-n // PIECE))
    if pieces < 2:
        return df.withColumn(name, made.over(window(partition, up)).cast("bigint"))
    key = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(y for c in (*partition, *order) for y in (F.col(c).isNull(), F.col(c)))])
    keys = df.select(key.alias("__key"))
    kinds = [f.dataType for f in keys.schema["__key"].dataType]
    found = keys.sample(min(1.0, SAMPLED * pieces / n), seed=7).orderBy("__key").collect()
    cuts = dict.fromkeys(tuple(found[len(found) * i // pieces][0]) for i in range(1, pieces)) if found else {}
    placed = df.withColumn("__key", key).withColumn("__piece", _piece(F.col("__key"), [_literal(c, kinds) for c in cuts])).drop("__key")
    counts = placed.groupBy("__piece", *partition).agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(window(partition, [F.col("__piece")]).rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("__piece").alias("__at"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(partition)], earlier.alias("__before")).filter("__before > 0")
    same = F.col("__piece") == F.col("__at")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    within = placed.repartitionById(len(cuts) + 1, F.col("__piece")).withColumn(name, made.over(window(["__piece", *partition], up)))
    return within.join(F.broadcast(before), same, "left").select(*df.columns, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("bigint").alias(name))
