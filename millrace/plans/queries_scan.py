"""Projection, row ranges, predicates, subqueries, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import frame, sql, table

sql(
    "flagship",
    """SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS l_quantity_sum, ROUND(AVG(l_extendedprice), 4) AS l_extendedprice_mean
    FROM {lineitem} WHERE l_discount > 0 GROUP BY l_returnflag ORDER BY l_quantity_sum DESC""",
)

# projection and row ranges
sql("scan_all_nation", "SELECT * FROM {nation}")
sql("project_cols", "SELECT o_orderkey, o_totalprice FROM {orders}")
sql("project_expr_alias", "SELECT o_orderkey, o_totalprice * 2 AS twice, o_custkey + 1 AS next_cust FROM {orders}")
sql("select_star_plus_expr", "SELECT *, s_acctbal * 10 AS tenfold FROM {supplier}")
sql("select_qualified_star", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")
sql("project_literal", "SELECT o_orderkey, 'x' AS tag, CAST(1 AS BIGINT) AS one FROM {orders}")
sql("select_without_from", "SELECT CAST(1 + 1 AS BIGINT) AS two, 'a' AS letter")
sql("limit_ordered", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("limit_zero", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderkey LIMIT 0")
sql("limit_offset", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 35")
sql("offset_only", "SELECT n_nationkey, n_name FROM {nation} ORDER BY n_nationkey OFFSET 20")


@frame("SELECT event_id, user_id, value FROM events ORDER BY ts DESC LIMIT 15")
def tail_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rows import tail

    return tail(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value"), 15, "ts").select("event_id", "user_id", "value")


@frame("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 7")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_custkey", "c_name").limit(7)


@frame('SELECT n_nationkey AS "key", n_name AS "name" FROM nation')
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toDF("key", "name")


# predicates
for _name, _where in {
    "filter_cmp": "o_totalprice >= 200000.0",
    "filter_eq_string": "o_orderstatus = 'F'",
    "filter_ne": "o_orderstatus <> 'F'",
    "filter_lt_string": "o_orderpriority < '3'",
    "filter_and_or_not": "(o_orderstatus = 'O' OR o_totalprice > 250000.0) AND NOT o_custkey < 500",
    "filter_between": "o_totalprice BETWEEN 100000.0 AND 120000.0",
    "filter_not_between": "o_totalprice NOT BETWEEN 1000.0 AND 300000.0",
    "filter_in": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "o_orderstatus NOT IN ('F', 'O')",
    "filter_like": "o_orderpriority LIKE '%H'",
    "filter_like_underscore": "o_orderpriority LIKE '_-H%'",
    "filter_not_like": "o_orderpriority NOT LIKE '%-%'",
    "filter_ilike": "o_orderpriority ILIKE '%hIgH%'",
    "filter_not_ilike": "o_orderpriority NOT ILIKE '%high%'",
    "filter_is_null": "NULLIF(o_orderstatus, 'F') IS NULL",
    "filter_is_not_null": "NULLIF(o_orderstatus, 'F') IS NOT NULL",
    "filter_expr": "o_totalprice / 2 + o_custkey > 60000",
    "filter_const_true": "TRUE",
    "filter_const_false": "FALSE",
    "filter_null_comparison": "NULLIF(o_custkey, 7) <> 8",
}.items():
    sql(_name, f"SELECT o_orderkey, o_totalprice FROM {{orders}} WHERE {_where}")
sql("filter_chained", "SELECT o_orderkey FROM (SELECT * FROM (SELECT * FROM {orders} WHERE o_totalprice > 50000.0) a WHERE o_orderstatus = 'O') b WHERE o_custkey % 2 = 0")
sql("filter_limit", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10")

# subqueries
sql("in_subquery_semi", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')")
sql("not_in_subquery_anti", "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0)")
sql("exists_uncorrelated", "SELECT n_name FROM {nation} WHERE EXISTS (SELECT 1 FROM {region} WHERE r_name = 'ASIA')")
sql("not_exists_uncorrelated", "SELECT n_name FROM {nation} WHERE NOT EXISTS (SELECT 1 FROM {region} WHERE r_name = 'NOWHERE')")
sql("exists_correlated", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000.0)")
sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM {orders})")
sql("derived_table", "SELECT status, n FROM (SELECT o_orderstatus AS status, COUNT(*) AS n FROM {orders} GROUP BY o_orderstatus) t WHERE n > 1")
sql("cte_chain", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 150000.0), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT n, COUNT(*) AS customers FROM per GROUP BY n")

# sorting; nulls come last going up and first going down unless the text says otherwise
sql("sort_asc", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice ASC NULLS LAST")
sql("sort_desc", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS FIRST")
sql("sort_multi", "SELECT o_orderstatus, o_totalprice, o_orderkey FROM {orders} ORDER BY o_orderstatus ASC NULLS LAST, o_totalprice DESC NULLS FIRST")
sql("sort_expr", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_custkey % 10, o_orderkey")
sql("sort_position", "SELECT o_custkey, o_orderkey FROM {orders} ORDER BY 1, 2")
sql("sort_alias", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM {orders} ORDER BY twice DESC, o_orderkey")
sql("sort_hidden_col", "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice, o_orderkey")
sql("sort_nulls_first", "SELECT o_orderkey, NULLIF(o_custkey, 1) AS k FROM {orders} ORDER BY k ASC NULLS FIRST, o_orderkey")
sql("sort_nulls_last", "SELECT o_orderkey, NULLIF(o_custkey, 1) AS k FROM {orders} ORDER BY k DESC NULLS LAST, o_orderkey DESC")
sql("sort_agg_input", "SELECT o_orderstatus, ROUND(AVG(o_totalprice), 3) AS mean FROM {orders} GROUP BY o_orderstatus ORDER BY AVG(o_totalprice) DESC")
sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")

# set operations
_A, _B = "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O'"
for _name, _op in {"union_all": "UNION ALL", "union_distinct": "UNION", "intersect_distinct": "INTERSECT", "intersect_all": "INTERSECT ALL", "except_distinct": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    sql(_name, f"{_A} {_op} {_B}")
sql("union_chain", f"{_A} UNION {_B} UNION ALL SELECT c_custkey AS k FROM {{customer}} WHERE c_acctbal < 0")
sql("set_op_order_limit", f"SELECT k FROM ({_A} UNION {_B}) u ORDER BY k LIMIT 12 OFFSET 3")


@frame("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


@frame("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def except_surplus_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXCEPT as the distinct rows of EXCEPT ALL: a row that occurs once more on the left stays."""
    o = table(spark, sf_dir, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").exceptAll(side("O")).distinct()
