"""Scalar helpers where this engine's meaning and Spark's built-in one differ. Each is one column expression."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def safe_div(a: Column, b: Column) -> Column:
    """a / b as a double; 0.0 where b is 0, null where either is null."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def safe_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of a; 0 where b is 0."""
    return F.when(b == 0, F.when(a.isNotNull(), F.lit(0))).otherwise(F.try_mod(a, b))


def exp(c: Column) -> Column:
    """e to the power of c by the C library, whose last bit is not always that of the JVM's own; infinite where it is too large."""

    def by_batch(c: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.exp(c)

    return F.arrow_udf(by_batch, DoubleType())(c.cast("double"))


def round_double(c: Column, digits: int) -> Column:
    """A double scaled, rounded to a whole number, half away from zero, and scaled back, all in doubles; itself where that is too large."""
    scaled = c.cast("double") * F.lit(10.0**digits)
    whole = F.when(F.abs(scaled) < F.lit(2.0**52), F.round(scaled)).otherwise(scaled) / F.lit(10.0**digits)
    return F.when(F.isnan(whole) | (F.abs(whole) == F.lit(float("inf"))), c).otherwise(whole)


def trim_ws(s: Column) -> Column:
    """s without white space of any kind at either end."""
    return F.regexp_replace(s, r"^[\s\x0B]+|[\s\x0B]+$", "")


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("bigint")


def substr(s: Column, start: int, length: int | None = None) -> Column:
    """From the 1-based start, 1 if it is less; a negative length or none takes the rest."""
    start = max(start, 1)
    return F.substring(s, start, length if length is not None and length >= 0 else 2**31 - 1)


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a date or timestamp, zoneless ones as they stand."""
    return F.unix_micros(t.cast("timestamp"))


def extract(field: str, t: Column) -> Column:
    """A part of a date or timestamp as BIGINT: dow counts from Monday = 1, seconds are whole, epoch is in microseconds."""
    field = field.lower()
    made = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
        "doy": F.dayofyear, "dow": lambda c: F.weekday(c) + 1, "epoch": micros,
    }
    if field not in made:
        raise ValueError(f"no such part: {field}")
    return made[field](t).cast("bigint")


def date_trunc(unit: str, t: Column) -> Column:
    """t with what is finer than the unit set to its beginning, as a zoneless timestamp."""
    return F.date_trunc(unit, t).cast("timestamp_ntz")


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """From a to b. Seconds to days: elapsed time, rounded down. Months and years: boundaries crossed."""
    unit = unit.lower()
    if unit in MICROS:
        return F.floor((micros(b) - micros(a)) / F.lit(float(MICROS[unit]))).cast("bigint")
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit == "month":
        return months.cast("bigint")
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    raise ValueError(f"no such unit: {unit}")
