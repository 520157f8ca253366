"""Delimited text: types inferred from all rows in one distributed pass, then read in parallel with a fixed schema."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 100  # lines that the delimiter and the header are looked for in
_TESTS = (
    ("boolean", re.compile(r"true|false|TRUE|FALSE")),
    ("bigint", re.compile(r"[+-]?\d{1,19}")),
    ("double", re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(nan|NaN|NAN|inf|Inf|INF|infinity)")),
    ("date", re.compile(r"\d{4}-\d\d-\d\d")),
    ("timestamp", re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?")),
    ("time", re.compile(r"\d\d:\d\d:\d\d(\.\d{1,6})?")),
)
#: What two kinds of values in one column make; any other mixture is text.
_JOINED = {frozenset(x): y for *x, y in (("boolean", "bigint", "bigint"), ("boolean", "double", "double"), ("bigint", "double", "double"), ("date", "timestamp", "timestamp"))}


def kind_of(value: str) -> str:
    return next((k for k, test in _TESTS if test.fullmatch(value)), "string")


def joined(kinds: list[str]) -> str:
    """The kind of a column whose values are of these kinds; a column without any is text."""
    return reduce(lambda a, b: a if a == b else _JOINED.get(frozenset((a, b)), "string"), sorted(kinds)) if kinds else "string"


def _kind(name: str) -> Column:
    """The kind of each value, null for empty ones. What only looks like a number, day or time of its kind is of the next that fits."""
    c = F.col(f"`{name}`")
    out = F.lit("string")
    for kind, test in reversed(_TESTS):
        fits = c.rlike(f"^(?:{test.pattern})\\z")
        if kind in ("bigint", "date", "timestamp"):
            fits = fits & c.try_cast("timestamp_ntz" if kind == "timestamp" else kind).isNotNull()
        out = F.when(fits, kind).otherwise(out)
    return F.when(c != "", out)


def infer(text: DataFrame) -> list[list[str]]:
    """The kinds of values that each column has, over all rows."""
    found = text.agg(*[F.collect_set(_kind(n)).alias(f"k{k}") for k, n in enumerate(text.columns)]).first()
    return [list(x) for x in found]


def _typed(name: str, kind: str, flags: bool = False) -> Column:
    """flags: whether true and false stand among a column of numbers, as 1 and 0."""
    c = F.col(f"`{name}`")
    if flags and kind in ("bigint", "double"):
        c = F.when(F.lower(c) == "true", "1").when(F.lower(c) == "false", "0").otherwise(c)
    if kind == "time":  # microseconds of the day
        parts = F.split(c, ":")
        seconds = parts.getItem(0).try_cast("bigint") * 3600 + parts.getItem(1).try_cast("bigint") * 60
        return (seconds * 1_000_000 + F.round(parts.getItem(2).try_cast("decimal(18,6)") * 1_000_000)).cast("bigint").alias(name)
    if kind == "timestamp":
        return c.try_cast("timestamp_ntz").alias(name)
    return c.alias(name) if kind == "string" else c.try_cast(kind).alias(name)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, types: list[str] | None = None, zero_fill: bool = False, multiline: bool | None = None) -> DataFrame:
    """A table from delimited text.

    delimiter: a comma, or a tab if the first line has more of these. types: a Spark type, or `time`, for each
    column; otherwise they are inferred from all rows, in a pass of its own, so that every value fits: a column whose
    values have no kind in common is text. Without a header columns are V1, V2, ... Empty values are null, as are those
    that do not fit given types; with zero_fill they are 0 or the empty string. Quoted fields may hold delimiters and
    doubled quotes; line ends too if multiline, which by default is found out from all lines. A file with line ends
    in fields can't be split between tasks.
    """
    raw = spark.read.text(path)
    lines = [r["value"] for r in raw.limit(HEAD).collect()]
    if not lines:
        raise ValueError(f"{path} is empty")
    if delimiter is None:
        delimiter = "\t" if lines[0].count("\t") > lines[0].count(",") else ","
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = not raw.filter(quotes % 2 == 1).isEmpty()
    first = next(csv.reader(iter("\n".join(lines).splitlines(keepends=True)) if multiline else lines, delimiter=delimiter))
    names = first if header else [f"V{k + 1}" for k in range(len(first))]
    text = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names), sep=delimiter, header=header, quote='"', escape='"', multiLine=multiline, enforceSchema=True)
    seen = [[]] * len(names) if types else infer(text)
    kinds = types or list(map(joined, seen))
    if len(kinds) != len(names):
        raise ValueError(f"{len(kinds)} types for {len(names)} columns")
    df = text.select(*[_typed(n, k, "boolean" in own) for n, k, own in zip(names, kinds, seen, strict=True)])
    if zero_fill:
        df = df.fillna(0).fillna("").fillna(False)
    return df


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    """RFC 4180 text, one file a task: fields are quoted where they need it, quotes doubled, nulls left empty."""
    writer = df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    writer.csv(path, header=header, sep=delimiter, quote='"', escape='"', nullValue="", emptyValue="")
