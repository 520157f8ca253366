"""Scalar functions: arithmetic, conditions, strings, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .registry import ORACLES, QUERIES, sql, table

_K = "o_orderkey"


def _orders(name: str, expr: str, oracle: str | None = None) -> None:
    sql(name, f"SELECT {_K}, {expr} AS v FROM {{orders}}", f"SELECT {_K}, {oracle or expr} AS v FROM orders")


def _column(name: str, source: str, key: str, made: Callable[[], Column], oracle: str) -> None:
    """A query that applies a helper of the library to one table. The column is made when the query runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, made().alias("v"))

    QUERIES[name], ORACLES[name] = run, f"SELECT {key}, {oracle} AS v FROM {source}"


# arithmetic
_orders("fn_arith", "o_custkey * 3 + o_orderkey - 7")
_orders("fn_div", "o_orderkey / 8")
_orders("fn_mod", "(o_orderkey - 500) % 7")
_orders("fn_neg", "-o_totalprice")
_orders("fn_abs", "ABS(o_custkey - 700)")
_orders("fn_sqrt", "ROUND(SQRT(o_totalprice), 9)")
_orders("fn_ln", "ROUND(LN(o_totalprice), 9)")
_column("fn_exp", "orders", _K, lambda: S.round_double(S.exp(F.col("o_custkey") / 1000), 9), "ROUND(EXP(o_custkey / 1000), 9)")
_orders("fn_ceil", "CAST(CEIL(o_totalprice / 7) AS DOUBLE)", "CEIL(o_totalprice / 7)")
_orders("fn_floor", "CAST(FLOOR(o_totalprice / 7) AS DOUBLE)", "FLOOR(o_totalprice / 7)")
_orders("fn_round", "ROUND(o_totalprice)")
_orders("fn_round_n", "ROUND(o_totalprice, 1)")
_orders("fn_round_neg", "ROUND(o_totalprice, -3)")
_orders("fn_least", "LEAST(o_custkey, 500, o_orderkey)")
_orders("fn_greatest", "GREATEST(o_custkey, 500, o_orderkey)")
_orders("fn_least_null", "LEAST(NULLIF(o_custkey, 10), 300)")
_orders("fn_cast_int_double", "CAST(o_custkey AS DOUBLE)")
_orders("fn_cast_double_int", "CAST(o_totalprice / 3 AS BIGINT)", "CAST(TRUNC(o_totalprice / 3) AS BIGINT)")
_orders("fn_cast_int_string", "CAST(o_custkey AS STRING)", "CAST(o_custkey AS VARCHAR)")
_orders("fn_cast_string_int", "CAST(SUBSTRING(o_orderpriority, 1, 1) AS BIGINT)")
_orders("fn_cast_int_bool", "CAST(o_custkey % 2 AS BOOLEAN)")
_orders("fn_try_cast", "TRY_CAST(SUBSTRING(o_orderpriority, 3, 4) AS BIGINT)")
_orders("fn_power", "ROUND(POWER(o_custkey, 2), 3)")
_orders("fn_sign", "CAST(SIGN(o_custkey - 700) AS INT)", "CAST(SIGN(o_custkey - 700) AS INT)")
_column("fn_safe_div", "orders", _K, lambda: S.safe_div(F.col("o_totalprice"), F.col("o_custkey") % 5), "CASE WHEN o_custkey % 5 = 0 THEN 0.0 ELSE o_totalprice / (o_custkey % 5) END")
_column("fn_safe_mod", "orders", _K, lambda: S.safe_mod(F.col("o_orderkey"), F.col("o_custkey") % 5), "CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_orderkey % (o_custkey % 5) END")
_orders("fn_div_null", "TRY_DIVIDE(o_totalprice, o_custkey % 5)", "CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice / (o_custkey % 5) END")

# conditions
_orders("fn_case_searched", "CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END")
_orders("fn_case_simple", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END")
_orders("fn_case_no_else", "CASE WHEN o_orderstatus = 'F' THEN o_custkey END")
_orders("fn_case_nested", "CASE WHEN o_custkey > 500 THEN CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END ELSE 'c' END")
_orders("fn_coalesce", "COALESCE(NULLIF(o_orderstatus, 'F'), NULLIF(o_orderpriority, '1-URGENT'), 'none')")
_orders("fn_nullif", "NULLIF(o_custkey, 10)")
_orders("fn_if", "IF(o_totalprice > 100000, o_custkey, -1)", "CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE -1 END")

# strings
_orders("fn_upper", "UPPER(o_orderpriority)")
_orders("fn_lower", "LOWER(o_orderpriority)")
_orders("fn_length", "CAST(LENGTH(o_orderpriority) AS BIGINT)")
_orders("fn_substr2", "SUBSTRING(o_orderpriority, 3)")
_orders("fn_substr3", "SUBSTRING(o_orderpriority, 2, 4)")
_orders("fn_substr_from_for", "SUBSTRING(o_orderpriority FROM 3 FOR 2)")
_orders("fn_replace", "REPLACE(o_orderpriority, 'O', '00')")
_orders("fn_concat", "CONCAT(o_orderstatus, '-', o_orderpriority)")
_orders("fn_concat_op", "o_orderstatus || ':' || o_orderpriority")
_orders("fn_trim_spaces", "TRIM('  ' || o_orderstatus || ' ')")
_orders("fn_reverse", "REVERSE(o_orderpriority)")
_orders("fn_position", "CAST(POSITION('E' IN o_orderpriority) AS BIGINT)")
_column("fn_octet_length", "documents", "doc_id", lambda: S.byte_length(F.col("text")), "CAST(strlen(text) AS BIGINT)")
_column("fn_char_length", "documents", "doc_id", lambda: F.length("text").cast("bigint"), "CAST(length(text) AS BIGINT)")
_column("fn_trim", "orders", _K, lambda: S.trim_ws(F.concat(F.lit("\t \n"), F.col("o_orderpriority"), F.lit(" \r\n"))), "o_orderpriority")
_column("fn_substr_clamp", "orders", _K, lambda: S.substr(F.col("o_orderpriority"), -2, 4), "SUBSTRING(o_orderpriority, 1, 4)")
_column("fn_substr_rest", "orders", _K, lambda: S.substr(F.col("o_orderpriority"), 3, -1), "SUBSTRING(o_orderpriority, 3)")


# dates and times
def _events(name: str, made: Callable[[], Column], oracle: str) -> None:
    _column(name, "events", "event_id", made, oracle)


for _name, _part in {"year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "dow": "isodow", "doy": "doy"}.items():
    _events(f"fn_{_name}", lambda name=_name: S.extract(name, F.col("ts")), f"CAST(EXTRACT({_part} FROM ts) AS BIGINT)")
_events("fn_second", lambda: S.extract("second", F.col("ts")), "CAST(FLOOR(EXTRACT(SECOND FROM ts)) AS BIGINT)")
_events("fn_epoch", lambda: S.extract("epoch", F.col("ts")), "epoch_us(ts)")
for _unit in ("second", "minute", "hour", "day", "month", "year"):
    _events(f"fn_trunc_{_unit}", lambda unit=_unit: S.date_trunc(unit, F.col("ts")), f"CAST(date_trunc('{_unit}', ts) AS TIMESTAMP)")
_SINCE = "2024-01-15 10:30:30"
for _unit, _micros in {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}.items():
    _events(f"fn_datediff_{_unit}", lambda unit=_unit: S.date_diff(unit, F.lit(_SINCE).cast("timestamp_ntz"), F.col("ts")), f"CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{_SINCE}')) / {_micros}) AS BIGINT)")
for _unit in ("month", "year"):
    _events(f"fn_datediff_{_unit}", lambda unit=_unit: S.date_diff(unit, F.lit(_SINCE).cast("timestamp_ntz"), F.col("ts")), f"date_diff('{_unit}', TIMESTAMP '{_SINCE}', ts)")
_events("fn_timestamp_plus", lambda: F.col("ts") + F.expr("INTERVAL 90 MINUTES"), "ts + INTERVAL 90 MINUTE")
_events("fn_timestamp_compare", lambda: F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "ts >= TIMESTAMP '2024-01-10 00:00:00'")
_events("fn_current_date_order", lambda: F.current_date() >= F.to_date(F.col("ts")), "current_date >= CAST(ts AS DATE)")
_events("fn_current_timestamp_order", lambda: F.current_timestamp() > F.col("ts").cast("timestamp"), "now()::TIMESTAMP > ts")
