"""Every query of the library against DuckDB, over the smallest tables."""

from __future__ import annotations

import os
import random
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from millrace.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, (float, int)) and not isinstance(v, bool):
            return f"{float(v):.9g}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 250


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["sort_expr", "sort_position", "sort_alias", "sort_hidden_col", "sort_nulls_first", "sort_nulls_last", "sort_agg_input"])
def test_whole_sorts_hold_all_rows_in_order(name, spark, duck):
    got = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    want = duck.execute(ORACLES[name]).fetchall()
    assert len(got) == duck.execute(f"SELECT COUNT({'DISTINCT o_orderstatus' if name == 'sort_agg_input' else '*'}) FROM orders").fetchone()[0]
    assert [r[0] for r in got] == [r[0] for r in want]


def test_exp_of_large_keys_is_the_sql_result_to_the_last_bit(spark, tmp_path):
    keys = [None, -900_000, -1, 0, 1, *range(8_000, 60_000, 7), *range(700_000, 720_000, 11), 899_999]
    pd.DataFrame({"o_orderkey": range(len(keys)), "o_custkey": pd.array(keys, "Int64")}).to_parquet(tmp_path / "orders.parquet")
    want = duckdb.sql(ORACLES["fn_exp"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["fn_exp"](spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("name", ["win_row_number_global", "h2o_w1", "h2o_w2", "h2o_w6"])
def test_numbers_over_few_partitions_are_counted_in_pieces(name, spark, tmp_path, monkeypatch):
    from millrace.functions import windows

    draw = random.Random(name)
    pick = lambda *of: [draw.choice(of) for _ in range(3000)]
    keys = [None if k % 500 == 0 else k for k in draw.sample(range(10_000), 3000)]
    made = {"o_orderkey": pd.array(keys, "Int64"), "o_custkey": pd.array(pick(None, *range(40)), "Int64"), "o_orderstatus": pick(None, "F", "O", "O", "O"), "o_orderpriority": pick(None, "1", "2"), "o_totalprice": pick(None, -0.5, *map(float, range(900)))}
    pd.DataFrame(made).to_parquet(tmp_path / "orders.parquet")
    want = duckdb.sql(ORACLES[name].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet'")).fetchdf()
    monkeypatch.setattr(windows, "PIECE", 100, raising=False)
    got = QUERIES[name](spark, str(tmp_path))
    assert rows(got.toPandas()) == rows(want)
    assert "__piece" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, largest", [("join_inner_multikey", "lineitem"), ("join_using", "lineitem")])
def test_joins_that_are_grouped_by_their_keys_get_tasks_by_their_rows(name, largest, spark, tmp_path, monkeypatch):
    from millrace.operators import joins

    keys = [None, *range(400)]
    lines = pd.DataFrame([(k, n, n) for k in keys for n in (1, 2, 2, None)], columns=["l_orderkey", "l_linenumber", "l_suppkey"])
    lines.astype({"l_orderkey": "Int64", "l_linenumber": "Int32"}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": pd.array(keys + keys[:9], "Int64"), "o_orderstatus": [*"PFO"] * 136 + ["P"] * 2}).to_parquet(tmp_path / "orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    monkeypatch.setattr(joins, "DEALT", 100, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES[name](spark, str(tmp_path))
        assert got.rdd.getNumPartitions() == -(-len(lines) // 100)
        assert rows(got.toPandas()) == rows(con.execute(ORACLES[name]).fetchdf())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
