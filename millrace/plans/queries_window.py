"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows
from .registry import ORACLES, QUERIES, frame, sql, table

_BY = "PARTITION BY o_custkey ORDER BY o_orderkey"
_TIES = "PARTITION BY o_custkey ORDER BY o_orderpriority"
_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
for _name, _expr in {
    "win_row_number": f"CAST(ROW_NUMBER() OVER ({_BY}) AS BIGINT)",
    "win_rank": f"CAST(RANK() OVER ({_TIES}) AS BIGINT)",
    "win_dense_rank": f"CAST(DENSE_RANK() OVER ({_TIES}) AS BIGINT)",
    "win_percent_rank": f"ROUND(PERCENT_RANK() OVER ({_TIES}), 9)",
    "win_cume_dist": f"ROUND(CUME_DIST() OVER ({_TIES}), 9)",
    "win_ntile": f"CAST(NTILE(4) OVER ({_BY}) AS BIGINT)",
    "win_count": "COUNT(*) OVER (PARTITION BY o_custkey)",
    "win_running_count": f"COUNT(*) OVER ({_BY} {_ROWS})",
    "win_running_sum": f"ROUND(SUM(o_totalprice) OVER ({_BY} {_ROWS}), 2)",
    "win_partition_sum": "ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2)",
    "win_avg": "ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey), 8)",
    "win_running_avg": f"ROUND(AVG(o_totalprice) OVER ({_BY} {_ROWS}), 8)",
    "win_min": "MIN(o_totalprice) OVER (PARTITION BY o_custkey)",
    "win_max": "MAX(o_totalprice) OVER (PARTITION BY o_custkey)",
    "win_running_minmax": f"MAX(o_totalprice) OVER ({_BY} {_ROWS}) - MIN(o_totalprice) OVER ({_BY} {_ROWS})",
    "win_lag": f"LAG(o_totalprice) OVER ({_BY})",
    "win_lead": f"LEAD(o_totalprice) OVER ({_BY})",
    "win_lag_offset": f"LAG(o_totalprice, 3) OVER ({_BY})",
    "win_lead_offset": f"LEAD(o_totalprice, 2) OVER ({_BY})",
    "win_lag_zero_compat": f"COALESCE(LAG(o_totalprice) OVER ({_BY}), 0.0)",
    "win_first_value": f"FIRST_VALUE(o_totalprice) OVER ({_BY})",
    "win_first_value_string": f"FIRST_VALUE(o_orderstatus) OVER ({_BY})",
    "win_last_value": f"LAST_VALUE(o_totalprice) OVER ({_BY} {_WHOLE})",
    "win_last_value_running": f"LAST_VALUE(o_totalprice) OVER ({_BY} {_ROWS})",
    "win_nth_value": f"NTH_VALUE(o_totalprice, 2) OVER ({_BY} {_WHOLE})",
    "win_rows_n_preceding": f"ROUND(SUM(o_totalprice) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2)",
    "win_rows_following": f"ROUND(AVG(o_totalprice) OVER ({_BY} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 8)",
    "win_range_peers": f"COUNT(*) OVER ({_TIES})",
    "win_range_offset": "COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)",
    "win_running_total_compat": f"ROUND(SUM(o_totalprice) OVER ({_BY} {_ROWS}), 2)",
    "win_stddev": "ROUND(STDDEV_SAMP(o_totalprice) OVER (PARTITION BY o_custkey), 6)",
    "win_expr_partition": "COUNT(*) OVER (PARTITION BY o_custkey % 10)",
    "win_order_desc": "CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT)",
}.items():
    sql(_name, f"SELECT o_orderkey, {_expr} AS v FROM {{orders}}")
sql("win_multi_spec", f"SELECT o_orderkey, CAST(ROW_NUMBER() OVER ({_BY}) AS BIGINT) AS rn, COUNT(*) OVER (PARTITION BY o_orderstatus) AS n, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS total FROM {{orders}}")
sql("win_named", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, LAG(o_orderkey) OVER w AS before FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("win_in_expression", f"SELECT o_orderkey, ROUND(o_totalprice - AVG(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS apart, CASE WHEN ROW_NUMBER() OVER ({_BY}) <= 3 THEN 'early' ELSE 'late' END AS age FROM {{orders}}")
sql("win_after_group", "SELECT o_orderstatus, o_orderpriority, n, CAST(RANK() OVER (PARTITION BY o_orderstatus ORDER BY n DESC) AS BIGINT) AS rk FROM (SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY o_orderstatus, o_orderpriority) g")
sql("topn_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM {orders}) t WHERE rn <= 3")
sql("distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM {orders}) t WHERE rn = 1")
sql("window_subquery_filter", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rn FROM {orders}) t WHERE o_custkey = 7")
# the window benchmark: id1 is the order's status, id4 its customer, v1 its price; keys are made unique
for _name, _expr in {
    "h2o_w3": "ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2)",
    "h2o_w4": "LAG(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey)",
    "h2o_w5": "ROUND(AVG(o_totalprice) OVER (PARTITION BY o_orderstatus), 4)",
}.items():
    sql(_name, f"SELECT o_orderkey, {_expr} AS w FROM {{orders}}")


def _numbered(name: str, number: str, partition: list[str], order: list[str], column: str) -> None:
    """A number over few partitions, any of which may be too large for one task."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select(*dict.fromkeys(("o_orderkey", *partition, *order)))
        return windows.numbered(orders, partition, order, column, number).select("o_orderkey", column)

    by = f"PARTITION BY {', '.join(partition)} " if partition else ""
    QUERIES[name], ORACLES[name] = run, f"SELECT o_orderkey, CAST({number.upper()}() OVER ({by}ORDER BY {', '.join(order)}) AS BIGINT) AS {column} FROM orders"


_numbered("win_row_number_global", "row_number", [], ["o_orderkey"], "v")
_numbered("h2o_w1", "row_number", ["o_orderstatus"], ["o_totalprice", "o_orderkey"], "w")
_numbered("h2o_w2", "rank", ["o_orderstatus"], ["o_custkey"], "w")
_numbered("h2o_w6", "row_number", ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_orderkey"], "w")


@frame("SELECT o_orderkey, ((rn - 1) * 4) // n + 1 AS v FROM (SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def win_ntile_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", windows.ntile_compat(4, ["o_custkey"], [F.col("o_orderkey")]).alias("v"))
