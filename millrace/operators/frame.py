"""A fluent lazy frame: `engine.read_csv(p).filter(col("v") > 1).group_by("k").agg(col("v").sum()).collect()`."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import csv, tables
from . import rows
from .joins import equi_join

#: The suffix that each aggregate gives to its result's name.
SUFFIX = {"sum": "sum", "mean": "mean", "min": "min", "max": "max", "count": "count", "first": "first", "last": "last", "std": "stddev", "std_pop": "stddev_pop", "var": "var", "var_pop": "var_pop", "prod": "prod", "count_distinct": "count_distinct"}
_AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "last": F.last, "std": F.stddev_samp, "std_pop": F.stddev_pop,
    "var": F.var_samp, "var_pop": F.var_pop, "prod": F.product, "count_distinct": F.count_distinct,
}


def _column(x: Any) -> Column:
    return x.column if isinstance(x, Expr) else x if isinstance(x, Column) else F.lit(x)


class Expr:
    """A column expression with the name that results take from it."""

    def __init__(self, column: Column, name: str | None = None, aggregate: bool = False) -> None:
        self.column, self.name, self.aggregate = column, name, aggregate

    def _binary(self, other: Any, op) -> Expr:
        return Expr(op(self.column, _column(other)))

    def __add__(self, o): return self._binary(o, lambda a, b: a + b)  # noqa: E704
    def __sub__(self, o): return self._binary(o, lambda a, b: a - b)  # noqa: E704
    def __mul__(self, o): return self._binary(o, lambda a, b: a * b)  # noqa: E704
    def __truediv__(self, o): return self._binary(o, lambda a, b: F.try_divide(a, b))  # noqa: E704
    def __mod__(self, o): return self._binary(o, lambda a, b: F.try_mod(a, b))  # noqa: E704
    def __radd__(self, o): return self._binary(o, lambda a, b: b + a)  # noqa: E704
    def __rsub__(self, o): return self._binary(o, lambda a, b: b - a)  # noqa: E704
    def __rmul__(self, o): return self._binary(o, lambda a, b: b * a)  # noqa: E704
    def __rtruediv__(self, o): return self._binary(o, lambda a, b: F.try_divide(b, a))  # noqa: E704
    def __eq__(self, o): return self._binary(o, lambda a, b: a == b)  # noqa: E704
    def __ne__(self, o): return self._binary(o, lambda a, b: a != b)  # noqa: E704
    def __lt__(self, o): return self._binary(o, lambda a, b: a < b)  # noqa: E704
    def __le__(self, o): return self._binary(o, lambda a, b: a <= b)  # noqa: E704
    def __gt__(self, o): return self._binary(o, lambda a, b: a > b)  # noqa: E704
    def __ge__(self, o): return self._binary(o, lambda a, b: a >= b)  # noqa: E704
    def __and__(self, o): return self._binary(o, lambda a, b: a & b)  # noqa: E704
    def __or__(self, o): return self._binary(o, lambda a, b: a | b)  # noqa: E704
    def __invert__(self): return Expr(~self.column)  # noqa: E704
    def __neg__(self): return Expr(-self.column)  # noqa: E704
    __hash__ = None

    def abs(self) -> Expr:
        return Expr(F.abs(self.column))

    def alias(self, name: str) -> Expr:
        return Expr(self.column, name, self.aggregate)

    def _aggregate(self, kind: str) -> Expr:
        return Expr(_AGGREGATES[kind](self.column), f"{self.name}_{SUFFIX[kind]}" if self.name else None, True)

    def named(self, at: int) -> Column:
        return self.column.alias(self.name or f"_e{at}")


for _kind in SUFFIX:
    setattr(Expr, _kind, lambda self, k=_kind: self._aggregate(k))


def col(name: str) -> Expr:
    return Expr(F.col(name), name)


def lit(value: float | int | str | bool) -> Expr:
    return Expr(F.lit(value))


class Series:
    """One column, brought to the client when it is asked for."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.name = df, df.columns[0]

    def __len__(self) -> int:
        return self.df.count()

    def to_list(self) -> list:
        return [r[0] for r in self.df.collect()]

    def to_numpy(self):
        return self.df.toPandas()[self.name].to_numpy()

    def __repr__(self) -> str:
        some = [r[0] for r in self.df.limit(11).collect()]
        return f"Series({self.name}: {', '.join(map(str, some[:10]))}{', ...' if len(some) > 10 else ''})"


class Grouped:
    def __init__(self, df: DataFrame, keys: tuple[str, ...]) -> None:
        self._df, self._keys = df, keys

    def agg(self, *exprs: Expr) -> Frame:
        """One row a group: the keys, then each aggregate, named column_kind unless it has an alias."""
        bad = [e for e in exprs if not e.aggregate]
        if bad or not exprs:
            raise TypeError("agg takes aggregates, like col('v').sum()")
        made = [e.column.alias(e.name or f"_e{k}_agg") for k, e in enumerate(exprs)]
        return Frame(self._df.groupBy(*self._keys).agg(*made))


class Frame:
    """A lazy table. Every method but the last group only adds to its plan."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def filter(self, predicate: Expr) -> Frame:
        return Frame(self.df.filter(predicate.column))

    def select(self, *exprs: str | Expr) -> Frame:
        return Frame(self.df.select(*[F.col(e) if isinstance(e, str) else e.named(k) for k, e in enumerate(exprs)]))

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(self.df, keys)

    def sort(self, *columns: str, descending: bool | list[bool] = False) -> Frame:
        down = descending if isinstance(descending, list) else [descending] * len(columns)
        if len(down) != len(columns):
            raise ValueError("descending needs a value for each column")
        return Frame(self.df.orderBy(*[F.col(c).desc_nulls_first() if d else F.col(c).asc_nulls_last() for c, d in zip(columns, down, strict=True)]))

    def join(self, right: Frame, on: str | list[str], how: str = "inner") -> Frame:
        return Frame(equi_join(self.df, right.df, [on] if isinstance(on, str) else on, how))

    def head(self, n: int = 5) -> Frame:
        return Frame(self.df.limit(n))

    def tail(self, n: int, *order: str) -> Frame:
        """The last n rows by order."""
        return Frame(rows.tail(self.df, n, *order))

    def distinct(self) -> Frame:
        return Frame(self.df.distinct())

    def union(self, other: Frame, all: bool = True) -> Frame:
        out = self.df.union(other.df)
        return Frame(out if all else out.distinct())

    def intersect(self, other: Frame, all: bool = False) -> Frame:
        return Frame(self.df.intersectAll(other.df) if all else self.df.intersect(other.df))

    def subtract(self, other: Frame, all: bool = False) -> Frame:
        return Frame(self.df.exceptAll(other.df) if all else self.df.subtract(other.df))

    def rename(self, *names: str) -> Frame:
        return Frame(self.df.toDF(*names))

    def cast(self, **types: str) -> Frame:
        return Frame(self.df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()}))

    def window(self, partition: list[str], order: list[str], before: int | None = None, after: int | None = 0, **made: Column) -> Frame:
        """Further columns computed over each partition in order, in frames of rows from `before` ahead to `after` behind (None: all)."""
        w = Window.partitionBy(*partition)
        if order:
            w = w.orderBy(*[F.col(c).asc_nulls_last() for c in order])
        framed = w.rowsBetween(Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after)
        whole = {"row_number", "rank", "dense_rank", "ntile", "lag", "lead", "percent_rank", "cume_dist"}
        ranks = {n for n, c in made.items() if str(c).removeprefix("Column<'").split("(")[0].lower() in whole}
        return Frame(self.df.withColumns({n: c.over(w if n in ranks else framed) for n, c in made.items()}))

    def materialize(self) -> Frame:
        """A barrier: the plan so far is computed once, to the checkpoint folder if one is set and to memory and disk otherwise."""
        return Frame(self.df.checkpoint() if self.df.sparkSession.sparkContext.getCheckpointDir() else self.df.persist())

    # results: these run the plan and bring its rows to the client
    def __len__(self) -> int:
        return self.df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    def __getitem__(self, name: str) -> Series:
        return Series(self.df.select(name))

    def collect(self) -> Frame:
        """The same table, held in memory or on disk once it has been computed."""
        return Frame(self.df.persist())

    def to_dict(self) -> dict[str, list]:
        found = self.df.collect()
        return {c: [r[k] for r in found] for k, c in enumerate(self.columns)}

    def to_pandas(self):
        return self.df.toPandas()

    def text(self, n: int = 10) -> str:
        """The first n rows in a box, with each column's type."""
        body = [[("" if v is None else str(v)) for v in r] for r in self.df.limit(n).collect()]
        head = [[c for c, _ in self.df.dtypes], [k for _, k in self.df.dtypes]]
        widths = [max(map(len, x)) for x in zip(*head, *body, strict=True)]
        rule = "+".join("-" * (w + 2) for w in widths)
        lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in (*head, *body)]
        return "\n".join([*(f" {x} " for x in lines[:2]), rule, *(f" {x} " for x in lines[2:])])

    __str__ = text


class Engine:
    """Entry to frames: reading, writing and partitioned tables."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing of a shared Spark session is closed here."""

    def frame(self, rows: list, schema) -> Frame:
        return Frame(self.spark.createDataFrame(rows, schema))

    def read_csv(self, path: str, **options) -> Frame:
        return Frame(csv.read_csv(self.spark, path, **options))

    def write_csv(self, frame: Frame, path: str, **options) -> None:
        csv.write_csv(frame.df, path, **options)

    def save(self, frame: Frame, path: str) -> None:
        tables.save_table(frame.df, path)

    def load(self, path: str) -> Frame:
        return Frame(tables.load_table(self.spark, path))

    splay_save, splay_load = save, load

    def mem_stats(self) -> dict[str, int]:
        """Bytes that the driver's JVM uses and may use."""
        r = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        return {"used": r.totalMemory() - r.freeMemory(), "most": r.maxMemory()}

    def part_load(self, root: str, table: str) -> Frame:
        return Frame(tables.read_parted(self.spark, root, table))
