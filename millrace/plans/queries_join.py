"""Joins of every kind, and the interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import frame, sql, table

sql("join_inner", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey")
sql(
    "join_inner_multikey",
    """SELECT a.l_orderkey, a.l_linenumber, COUNT(*) AS n FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
    GROUP BY a.l_orderkey, a.l_linenumber""",
    by={"lineitem": ["l_orderkey", "l_linenumber"]},
)
_F = "(SELECT * FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 200000.0)"
sql("join_left", f"SELECT c.c_custkey, o.o_orderkey FROM {{customer}} c LEFT JOIN {_F} o ON c.c_custkey = o.o_custkey")
sql("join_right", f"SELECT o.o_orderkey, c.c_custkey FROM {_F} o RIGHT JOIN {{customer}} c ON c.c_custkey = o.o_custkey")
sql(
    "join_full",
    f"SELECT COALESCE(c.c_custkey, o.o_custkey) AS k, c.c_name, o.o_orderkey FROM (SELECT * FROM {{customer}} WHERE c_acctbal > 5000) c FULL JOIN {_F} o ON c.c_custkey = o.o_custkey",
)
sql("join_left_zero_compat", f"SELECT c.c_custkey, COALESCE(o.o_orderkey, 0) AS o_orderkey, COALESCE(o.o_totalprice, 0.0) AS price FROM {{customer}} c LEFT JOIN {_F} o ON c.c_custkey = o.o_custkey")
sql("join_cross", "SELECT n.n_name, r.r_name FROM {nation} n CROSS JOIN {region} r")
sql("join_implicit_cross", "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey <> r.r_regionkey")
sql("join_in_comma_list", "SELECT r.r_name, n.n_name, s.s_name FROM {region} r, {nation} n JOIN {supplier} s ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = r.r_regionkey")
sql(
    "join_three_way",
    "SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 250000.0",
)
sql(
    "join_then_agg",
    """SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
    JOIN {nation} n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name""",
)
sql("join_string_payload", "SELECT s.s_name, n.n_name FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey")
sql("join_string_key", "SELECT a.n_name, b.n_regionkey FROM {nation} a JOIN {nation} b ON a.n_name = b.n_name")
sql("join_using", "SELECT l_orderkey, COUNT(*) AS n FROM {lineitem} JOIN (SELECT o_orderkey AS l_orderkey FROM {orders} WHERE o_orderstatus = 'P') p USING (l_orderkey) GROUP BY l_orderkey", by={"lineitem": ["l_orderkey"], "orders": ["o_orderkey"]})
sql("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_semi", "SELECT c_custkey FROM {customer} c LEFT SEMI JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000.0", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000.0)")
sql("join_anti", "SELECT c_custkey FROM {customer} c LEFT ANTI JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000.0", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000.0)")
sql("join_self_null_keys", "SELECT a.o_orderkey FROM {orders} a JOIN {customer} c ON NULLIF(a.o_custkey, 10) = c.c_custkey WHERE a.o_orderstatus = 'P'")


@frame("SELECT n_regionkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_single_key_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import equi_join

    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), "n_name")
    return equi_join(n, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name"), ["k"])


@frame(
    """SELECT l.event_id, COUNT(r.event_id) AS n, ROUND(SUM(r.value), 6) AS total, MAX(r.value) AS top FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    LEFT JOIN events r ON r.user_id = l.user_id AND r.ts BETWEEN l.ts - INTERVAL 6 HOUR AND l.ts GROUP BY l.event_id"""
)
def interval_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase, its user's events in the six hours up to it."""
    from ..operators.joins import interval_join

    e = table(spark, sf_dir, "events")
    left = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = e.select("user_id", "ts", "value")
    found = interval_join(left, right, time="ts", keys=["user_id"], lo=-6 * 3600 * 1_000_000, hi=0, aggs={"n": F.count("value"), "total": F.sum("value"), "top": F.max("value")})
    return found.select("event_id", "n", F.round("total", 6).alias("total"), "top")
