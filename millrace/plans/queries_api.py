"""Queries through the sources, the SQL session, the fluent frame and node pipelines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import frame, table


def _folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; of our own only where none is set and all is one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{top or 'file://' + tempfile.mkdtemp(prefix='millrace-')}/{uuid.uuid4().hex}"


# sources
@frame("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.csv import read_csv, write_csv

    path = _folder(spark)
    write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return read_csv(spark, path)


@frame("SELECT event_id, user_id, props FROM events")
def csv_quoted_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with quotes and commas (JSON text) survive."""
    from ..sources.csv import read_csv, write_csv

    path = _folder(spark)
    write_csv(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), path)
    return read_csv(spark, path, types=["bigint", "bigint", "string"])


@frame("SELECT o_orderkey, CASE WHEN o_orderkey > 150 THEN o_totalprice ELSE CAST(o_custkey AS DOUBLE) END AS late_double, CASE WHEN o_orderkey > 150 THEN 'two' || chr(10) || 'lines, ' || o_orderpriority ELSE '7' END AS late_text FROM orders")
def csv_late_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles, text and line ends in fields that come long after the first rows."""
    from ..sources.csv import read_csv, write_csv

    path, late = _folder(spark), F.col("o_orderkey") > 150
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(late, F.col("o_totalprice").cast("string")).otherwise(F.col("o_custkey").cast("string")).alias("late_double"),
        F.when(late, F.concat(F.lit("two\nlines, "), "o_orderpriority")).otherwise("7").alias("late_text"),
    )
    write_csv(rows.orderBy("o_orderkey"), path)
    return read_csv(spark, path)


@frame('SELECT n_nationkey AS "V1", n_name AS "V2" FROM nation')
def csv_headerless_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.csv import read_csv, write_csv

    path = _folder(spark)
    write_csv(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint"), "n_name"), path, header=False, delimiter="\t")
    return read_csv(spark, path, header=False).withColumn("V1", F.col("V1").cast("int"))


@frame("SELECT * FROM supplier")
def parquet_dir_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import load_table, save_table

    path = _folder(spark)
    save_table(table(spark, sf_dir, "supplier"), path)
    return load_table(spark, path)


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_parted, save_parted

    root = _folder(spark)
    save_parted(table(spark, sf_dir, "orders").withColumn("date", F.to_date(F.date_trunc("year", "o_orderdate"))), root, "orders")
    return read_parted(spark, root, "orders")


@frame("SELECT CAST(year(o_orderdate) AS INT) AS year, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def partitioned_read_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parted(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@frame("SELECT o_orderkey, o_totalprice FROM orders WHERE date_trunc('year', o_orderdate) = TIMESTAMP '1995-01-01 00:00:00'")
def partition_column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the directory of 1995 is read."""
    return _parted(spark, sf_dir).filter(F.col("date") == F.lit("1995-01-01").cast("date")).select("o_orderkey", "o_totalprice")


@frame("SELECT COUNT(*) AS n FROM orders")
def partition_load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parted(spark, sf_dir).drop("date").agg(F.count(F.lit(1)).alias("n"))


@frame("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_read_splayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "region")
    return s.execute(f"SELECT n.n_name, r.r_name FROM read_splayed('{sf_dir}/nation.parquet') n JOIN region r ON n.n_regionkey = r.r_regionkey")


# the SQL session
def _session(spark: SparkSession, sf_dir: str, *names: str):
    from .session import EngineSession

    s = EngineSession(spark)
    for n in names:
        s.register(n, table(spark, sf_dir, n))
    return s


@frame("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000.0 GROUP BY o_orderstatus")
def ctas_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "orders").script("CREATE TABLE big AS SELECT * FROM orders WHERE o_totalprice > 100000.0; SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY o_orderstatus")


@frame("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'one', CAST(1.5 AS DOUBLE)), (2, 'two', NULL), (3, NULL, 3.5)) t(id, name, val)")
def insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).script("CREATE TABLE t (id INTEGER, name VARCHAR, val REAL); INSERT INTO t VALUES (1, 'one', 1.5), (2, 'two', NULL); INSERT INTO t VALUES (3, NULL, 3.5); SELECT * FROM t ORDER BY id")


@frame("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey = 1")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "nation").script("CREATE TABLE t (id INTEGER, name VARCHAR); INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1; SELECT * FROM t")


@frame("SELECT * FROM (VALUES (CAST(7 AS BIGINT), CAST(NULL AS VARCHAR), CAST(2.5 AS DOUBLE))) t(id, name, val)")
def insert_column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).script("CREATE TABLE t (id INTEGER, name VARCHAR, val REAL); INSERT INTO t (val, id) VALUES (2.5, 7); SELECT * FROM t")


@frame("SELECT CAST(2 AS BIGINT) AS x")
def create_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).script("CREATE TABLE t (x INT); CREATE TABLE IF NOT EXISTS t (y INT); CREATE OR REPLACE TABLE t AS SELECT CAST(2 AS BIGINT) AS x; SELECT x FROM t")


@frame("SELECT COUNT(*) AS n FROM region")
def script_last_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, "region").script("SELECT * FROM region; CREATE TABLE a (x INT); DROP TABLE a; DROP TABLE IF EXISTS a; SELECT COUNT(*) AS n FROM region")


@frame("SELECT event_id, isodow(ts) AS dow, epoch_us(ts) AS us, date_trunc('hour', ts)::TIMESTAMP AS h, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0) AS BIGINT) AS days FROM events")
def sql_dialect_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir, "events")
    return s.execute(
        "SELECT event_id, EXTRACT(DOW FROM ts) AS dow, EXTRACT(EPOCH FROM ts) AS us, DATE_TRUNC('hour', ts) AS h, DATE_DIFF('day', CAST('2024-01-01 00:00:00' AS TIMESTAMP), ts) AS days FROM events"
    )


# the fluent frame
@frame("SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS l_quantity_sum, ROUND(AVG(l_extendedprice), 4) AS l_extendedprice_mean FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag")
def api_filter_group_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frame import Frame, col

    f = Frame(table(spark, sf_dir, "lineitem")).filter(col("l_discount") > 0).group_by("l_returnflag").agg(col("l_quantity").sum(), col("l_extendedprice").mean())
    out = f.sort("l_quantity_sum", descending=True).df
    return out.withColumn("l_quantity_sum", F.round("l_quantity_sum", 2)).withColumn("l_extendedprice_mean", F.round("l_extendedprice_mean", 4))


@frame("SELECT n_regionkey AS k, n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def api_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frame import Frame, col

    n = Frame(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), "n_name"))
    r = Frame(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name")).filter(col("k") < 3)
    return n.join(r, "k", "left").df


@frame("SELECT o_orderkey, o_totalprice * 2 - 1 AS _e1, abs(o_custkey - 100) AS apart FROM orders WHERE NOT (o_custkey % 3 = 0) AND o_totalprice >= 1000")
def api_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.frame import Frame, col

    f = Frame(table(spark, sf_dir, "orders")).filter(~(col("o_custkey") % 3 == 0) & (col("o_totalprice") >= 1000))
    return f.select("o_orderkey", 2 * col("o_totalprice") - 1, (col("o_custkey") - 100).abs().alias("apart")).df


# node pipelines
def _run(spark: SparkSession, nodes: list[tuple[str, str, dict]], edges: list | None = None) -> DataFrame:
    from .nodes import Pipeline

    ids = [n for n, _, _ in nodes]
    chain = edges or [{"source": a, "target": b} for a, b in zip(ids, ids[1:], strict=False)]
    out = Pipeline({"nodes": [{"id": n, "type": t, "config": c} for n, t, c in nodes], "edges": chain}).run(spark)
    if out.error:
        raise RuntimeError(out.error)
    return out.results[ids[-1]]["df"]


@frame("SELECT l_returnflag, SUM(l_quantity) AS l_quantity_sum, COUNT(l_tax) AS l_tax_count FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag")
def pipe_filter_groupby_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, [
        ("src", "table_source", {"path": f"{sf_dir}/lineitem.parquet"}), ("f", "filter", {"column": "l_discount", "operator": "ge", "value": "0.05"}),
        ("g", "groupby", {"keys": ["l_returnflag"], "aggs": [{"column": "l_quantity", "op": "sum"}, {"column": "l_tax", "op": "count"}]}),
        ("s", "sort", {"columns": [{"name": "l_quantity_sum", "descending": True}]}),
    ])


@frame("SELECT o_orderkey, (o_totalprice - o_custkey) * 2 / 4 AS score FROM orders")
def pipe_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, [
        ("src", "table_source", {"path": f"{sf_dir}/orders.parquet"}), ("f", "formula", {"expression": "(o_totalprice - o_custkey) * 2 / 4", "output_name": "score"}), ("d", "columns", {"pick": ["o_orderkey", "score"]}),
    ])


@frame("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000.5 GROUP BY o_orderstatus")
def pipe_query_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, [("src", "table_source", {"path": f"{sf_dir}/orders.parquet"}), ("q", "query", {"sql": "SELECT o_orderstatus, COUNT(*) AS n FROM data WHERE o_totalprice > 1000.5 GROUP BY o_orderstatus"})])


@frame("SELECT n_nationkey AS key, n_name AS name, n_regionkey FROM nation WHERE n_regionkey = 2")
def pipe_query_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, [
        ("src", "table_source", {"path": f"{sf_dir}/nation.parquet"}),
        ("q", "query", {"filter": {"column": "n_regionkey", "operator": "eq", "value": "2"}, "sort": {"columns": [{"name": "n_name"}]}}), ("d", "columns", {"rename": {"n_nationkey": "key", "n_name": "name"}}),
    ])


@frame("SELECT n_regionkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def pipe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(
        spark,
        [
            ("r", "table_source", {"path": f"{sf_dir}/region.parquet"}), ("rk", "columns", {"rename": {"r_regionkey": "k"}}), ("n", "table_source", {"path": f"{sf_dir}/nation.parquet"}),
            ("nk", "columns", {"rename": {"n_regionkey": "k"}}), ("j", "join", {"keys": ["k"]}), ("d", "columns", {"pick": ["k", "n_name", "r_name"]}),
        ],
        [{"source": "r", "target": "rk"}, {"source": "n", "target": "nk"}, {"source": "nk", "target": "j"}, {"source": "rk", "target": "j", "as": "right"}, {"source": "j", "target": "d"}],
    )


# extensions: event-time windows
@frame("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import tumbling

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = tumbling(e, "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@frame(
    """WITH marked AS (SELECT user_id, ts, value, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    numbered AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
    SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM numbered GROUP BY user_id, s"""
)
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import sessions

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1))}).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
