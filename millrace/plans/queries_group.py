"""Aggregation: keys, measures, distinct counts, and the usual group-by benchmark shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import frame, sql, table

sql("agg_global", "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS total, MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high, ROUND(AVG(l_discount), 6) AS mean FROM {lineitem}")
sql("agg_empty_input", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, MIN(o_custkey) AS low, AVG(o_totalprice) AS mean FROM {orders} WHERE o_orderkey < 0")
sql("group_sum", "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS l_quantity_sum FROM {lineitem} GROUP BY l_returnflag")
sql("group_sum_int", "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS l_linenumber_sum FROM {lineitem} GROUP BY l_returnflag")
sql("group_avg", "SELECT l_linestatus, ROUND(AVG(l_extendedprice), 4) AS mean FROM {lineitem} GROUP BY l_linestatus")
sql("group_minmax", "SELECT l_suppkey, MIN(l_quantity) AS low, MAX(l_extendedprice) AS high FROM {lineitem} GROUP BY l_suppkey")
sql("group_minmax_string", "SELECT n_regionkey, MIN(n_name) AS first_name, MAX(n_name) AS last_name FROM {nation} GROUP BY n_regionkey")
sql("group_count_star", "SELECT o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY o_orderpriority")
sql("group_count_col", "SELECT o_orderpriority, COUNT(NULLIF(o_orderstatus, 'F')) AS n FROM {orders} GROUP BY o_orderpriority")
sql("group_count_rows_compat", "SELECT o_orderpriority, COUNT(1) AS n FROM {orders} GROUP BY o_orderpriority")
sql("group_multi_key", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("group_null_key", "SELECT NULLIF(o_orderstatus, 'F') AS status, COUNT(*) AS n FROM {orders} GROUP BY NULLIF(o_orderstatus, 'F')")
sql(
    "group_multi_agg",
    """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice), 2) AS base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS disc,
    ROUND(AVG(l_quantity), 6) AS avg_qty, MIN(l_tax) AS low_tax, MAX(l_tax) AS high_tax, COUNT(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql("group_expr_input", "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 + l_tax)), 2) AS charged FROM {lineitem} GROUP BY l_returnflag")
sql("group_expr_key", "SELECT CAST(FLOOR(o_totalprice / 50000) AS BIGINT) AS bin, COUNT(*) AS n FROM {orders} GROUP BY CAST(FLOOR(o_totalprice / 50000) AS BIGINT)")
sql("group_case_key", "SELECT CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS size, COUNT(*) AS n FROM {orders} GROUP BY CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END")
sql("group_alias_key", "SELECT o_custkey % 7 AS bucket, COUNT(*) AS n FROM {orders} GROUP BY bucket")
sql("group_position_key", "SELECT o_orderstatus, COUNT(*) AS n FROM {orders} GROUP BY 1")
sql("group_by_all", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY ALL")
sql("group_post_agg_arith", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(o_orderkey), 4) AS per_order, COUNT(*) * 2 AS twice FROM {orders} GROUP BY o_orderstatus")
sql("group_limit", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
sql("having_agg", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 12")
sql("having_compound", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING (COUNT(*) > 5 AND MAX(o_totalprice) > 250000.0) OR NOT o_custkey > 50")
sql("count_distinct", "SELECT COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM {lineitem}")
sql("count_distinct_grouped", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
sql("count_distinct_having", "SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS kinds FROM {orders} GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderpriority) >= 5")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql("distinct_expr", "SELECT DISTINCT o_custkey % 5 AS k FROM {orders}")


@frame("SELECT user_id, arg_min(value, ts) AS value_first, arg_max(value, ts) AS value_last FROM events GROUP BY user_id")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each user's earliest and latest event."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", "ts").alias("value_first"), F.max_by("value", "ts").alias("value_last"))


@frame("SELECT n_regionkey, product(n_nationkey + 1) AS n_nationkey_prod FROM nation GROUP BY n_regionkey")
def product_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.product(F.col("n_nationkey") + 1).alias("n_nationkey_prod"))


for _name in ("stddev_samp", "stddev_pop", "var_samp", "var_pop", "stddev", "variance"):
    sql(f"agg_{_name}" if _name in ("stddev", "variance") else _name, f"SELECT l_returnflag, ROUND({_name}(l_quantity), 6) AS v FROM {{lineitem}} GROUP BY l_returnflag")
sql("stddev_single_row", "SELECT o_orderkey, STDDEV_SAMP(o_totalprice) AS v, VAR_POP(o_totalprice) AS p FROM {orders} GROUP BY o_orderkey")
sql("agg_filter_sum", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) FILTER (WHERE o_custkey < 300), 2) AS v FROM {orders} GROUP BY o_orderstatus")
sql("agg_filter_count", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000.0) AS n FROM {orders} GROUP BY o_orderstatus")
sql("agg_filter_count_float_compat", "SELECT o_orderstatus, CAST(COUNT(*) FILTER (WHERE o_totalprice > 100000.0) AS DOUBLE) AS n FROM {orders} GROUP BY o_orderstatus")
sql("agg_filter_minmax", "SELECT o_orderstatus, MIN(o_totalprice) FILTER (WHERE o_custkey > 700) AS low, MAX(o_totalprice) FILTER (WHERE o_custkey < 700) AS high FROM {orders} GROUP BY o_orderstatus")
sql("agg_filter_avg", "SELECT o_orderstatus, ROUND(AVG(o_totalprice) FILTER (WHERE o_custkey < 300), 4) AS v FROM {orders} GROUP BY o_orderstatus")
sql("group_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("group_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("group_grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")

# the usual group-by, sort and join benchmark, on lineitem and orders:
# id1 l_returnflag, id2 l_linestatus, id3 l_partkey, id4 l_suppkey, id6 l_orderkey, v1 l_quantity, v2 l_linenumber, v3 l_extendedprice
sql("h2o_q1", "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS v1_sum FROM {lineitem} GROUP BY l_returnflag")
sql("h2o_q2", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS v1_sum FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("h2o_q3", "SELECT l_partkey, ROUND(SUM(l_quantity), 2) AS v1_sum, ROUND(AVG(l_extendedprice), 8) AS v3_mean FROM {lineitem} GROUP BY l_partkey")
sql("h2o_q4", "SELECT l_suppkey, ROUND(AVG(l_quantity), 7) AS v1_mean, ROUND(AVG(l_linenumber), 7) AS v2_mean, ROUND(AVG(l_extendedprice), 7) AS v3_mean FROM {lineitem} GROUP BY l_suppkey")
sql("h2o_q5", "SELECT l_orderkey, ROUND(SUM(l_quantity), 2) AS v1_sum, CAST(SUM(l_linenumber) AS BIGINT) AS v2_sum, ROUND(SUM(l_extendedprice), 2) AS v3_sum FROM {lineitem} GROUP BY l_orderkey")
sql("h2o_q6", "SELECT l_partkey, MAX(l_quantity) AS v1_max, MIN(l_linenumber) AS v2_min FROM {lineitem} GROUP BY l_partkey")
_KEYS = "l_returnflag, l_linestatus, l_partkey, l_suppkey, l_linenumber, l_orderkey"
sql("h2o_q7", f"SELECT {_KEYS}, ROUND(SUM(l_extendedprice), 2) AS v3_sum, COUNT(l_quantity) AS v1_count FROM {{lineitem}} GROUP BY {_KEYS}")
for _name, _by in {"h2o_s1": "l_returnflag", "h2o_s2": "l_partkey", "h2o_s3": "l_suppkey", "h2o_s4": "l_extendedprice DESC", "h2o_s5": "l_returnflag, l_linestatus", "h2o_s6": "l_returnflag, l_linestatus, l_partkey"}.items():
    sql(_name, f"SELECT l_orderkey, {', '.join(dict.fromkeys(_by.replace(' DESC', '').split(', ')))} FROM {{lineitem}} ORDER BY {_by}, l_orderkey, l_linenumber")
_ON = "l.l_returnflag = r.l_returnflag AND l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey"
_RIGHT = "(SELECT l_returnflag, l_partkey, l_suppkey, MAX(l_extendedprice) AS price FROM {lineitem} WHERE l_quantity > 25 GROUP BY l_returnflag, l_partkey, l_suppkey)"
sql("h2o_j1", f"SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, r.price FROM {{lineitem}} l JOIN {_RIGHT} r ON {_ON}")
sql("h2o_j2", f"SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, r.price FROM {{lineitem}} l LEFT JOIN {_RIGHT} r ON {_ON}")
