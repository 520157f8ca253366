"""The SQL session on small tables made in it."""

from __future__ import annotations

from decimal import Decimal

import pytest

from millrace.plans.session import EngineSession, SqlError

FIXTURE = """
CREATE TABLE t (id INTEGER, val REAL, name VARCHAR);
INSERT INTO t VALUES (1, 10.5, 'a'), (2, 20.0, 'b'), (3, NULL, 'a'), (4, 5.25, 'it''s'), (5, 20.0, NULL);
"""


@pytest.fixture
def session(spark):
    s = EngineSession(spark)
    s.script(FIXTURE)
    return s


def got(session, sql):
    return [tuple(r) for r in session.execute(sql).collect()]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT id FROM t WHERE val > 10 ORDER BY id", [(1,), (2,), (5,)]),
        ("SELECT id FROM t ORDER BY val", [(4,), (1,), (2,), (5,), (3,)]),
        ("SELECT id FROM t ORDER BY val DESC, id", [(3,), (2,), (5,), (1,), (4,)]),
        ("SELECT id FROM t ORDER BY val NULLS FIRST, id DESC LIMIT 2", [(3,), (4,)]),
        ("SELECT id FROM t ORDER BY id LIMIT 2 OFFSET 1", [(2,), (3,)]),
        ("SELECT id FROM t ORDER BY id LIMIT 0", []),
        ("SELECT name, COUNT(*) FROM t GROUP BY name HAVING COUNT(*) > 1", [("a", 2)]),
        ("SELECT COUNT(val), COUNT(DISTINCT val), SUM(val) FROM t", [(4, 3, 55.75)]),
        ("SELECT name FROM t WHERE id = 4", [("it's",)]),
        ("SELECT CONCAT('it''s ', TRIM(' x '), REPLACE(name, '''', '-'), '!') FROM t WHERE id = 4", [("it's xit-s!",)]),
        (
            "SELECT EXTRACT(YEAR FROM CAST('2024-05-06' AS DATE)), TRIM(BOTH ' ' FROM ' a '), CONCAT('a', DATE_TRUNC('day', CAST('2024-05-06 07:08:09' AS TIMESTAMP))) FROM t WHERE id = 1",
            [(2024, "a", "a2024-05-06 00:00:00")],
        ),
        ("SELECT id / 0, id % 0 FROM t WHERE id = 1", [(None, None)]),
        ("SELECT id FROM t WHERE name IS NULL", [(5,)]),
        ("SELECT COALESCE(name, 'none') FROM t WHERE id = 5", [("none",)]),
        ("SELECT TRIM('\t x \n'), LENGTH('héé'), UPPER('ab'), 'a' || 'b' FROM t WHERE id = 1", [("x", 5, "AB", "ab")]),
        ("SELECT id::DOUBLE, CAST(val AS INTEGER), CAST(id AS VARCHAR) FROM t WHERE id = 1", [(1.0, 10, "1")]),
        ("WITH a AS (SELECT * FROM t WHERE id < 3), b AS (SELECT MAX(val) AS m FROM a) SELECT m FROM b", [(20.0,)]),
        ("SELECT id FROM t WHERE id IN (SELECT id FROM t WHERE val = 20.0) ORDER BY id", [(2,), (5,)]),
        ("SELECT id FROM t WHERE val = (SELECT MIN(val) FROM t)", [(4,)]),
        ("SELECT id, ROW_NUMBER() OVER (PARTITION BY name ORDER BY id DESC) AS rn FROM t WHERE name = 'a' ORDER BY id", [(1, 2), (3, 1)]),
        ("SELECT name FROM t WHERE name LIKE '_' UNION SELECT 'z' ORDER BY name", [("a",), ("b",), ("z",)]),
        ("SELECT SUM(val) FILTER (WHERE id < 3) FROM t", [(30.5,)]),
        ("SELECT a.id, b.id FROM t a LEFT JOIN t b ON a.id = b.id AND b.id > 4 WHERE a.id >= 4 ORDER BY a.id", [(4, None), (5, 5)]),
        ("SELECT DATE_DIFF('day', CAST('2024-01-01 12:00:00' AS TIMESTAMP), CAST('2024-01-03 11:00:00' AS TIMESTAMP)) FROM t WHERE id = 1", [(1,)]),
        ("SELECT DATE_DIFF('month', CAST('2024-01-31' AS DATE), CAST('2024-02-01' AS DATE)), EXTRACT(DOW FROM CAST('2024-01-01' AS DATE)) FROM t WHERE id = 1", [(1, 1)]),
        ("SELECT CASE WHEN id > 1 THEN 'x' END FROM t WHERE id = 1", [(None,)]),
        ("SELECT STDDEV(val) FROM t WHERE id = 1", [(None,)]),
    ],
)
def test_select(session, sql, want):
    assert got(session, sql) == want


@pytest.mark.parametrize(
    ("sql", "names"),
    [
        ("SELECT SUM(val), COUNT(*), id + 1, t.id, 'x', id AS k, val v FROM t GROUP BY id, val", ["sum(val)", "count(*)", "id + 1", "id", "'x'", "k", "v"]),
        ("SELECT CASE WHEN id > 1 THEN 2 END, val IS NULL, ROW_NUMBER() OVER (ORDER BY id) FROM t", ["case when id > 1 then 2 end", "val is null", "row_number() over (order by id)"]),
        ("SELECT * FROM t a JOIN t b ON a.id = b.id", ["id", "val", "name"]),
        ("WITH a AS (SELECT id + 1 AS j FROM t) SELECT MAX(j) FROM a", ["max(j)"]),
        ("SELECT id * 2 FROM t UNION SELECT id FROM t", ["id * 2"]),
    ],
)
def test_names_of_columns(session, sql, names):
    assert session.execute(sql).columns == names


def test_order_by_an_aggregates_input(session):
    assert got(session, "SELECT name, SUM(val) FROM t WHERE name IS NOT NULL GROUP BY name ORDER BY val DESC LIMIT 2") == [("b", 20.0), ("a", 10.5)]


def test_show_and_describe(session):
    assert got(session, "SHOW TABLES") == [("t",)]
    assert got(session, "DESCRIBE t") == [("id", "bigint"), ("val", "double"), ("name", "string")]


def test_table_functions_over_partitions(session, tmp_path):
    from millrace.sources.tables import save_parted

    save_parted(session.spark.sql("SELECT id, CAST('2024-01-0' || (id % 2 + 1) AS DATE) AS date FROM range(10)"), str(tmp_path), "data")
    assert got(session, f"SELECT date, COUNT(*) AS n FROM read_parted('{tmp_path}', 'data') GROUP BY date ORDER BY date")[0][1] == 5


def test_script_and_names(session):
    assert session.script("CREATE TABLE u AS SELECT id FROM t WHERE id < 3; INSERT INTO u SELECT id + 10 FROM t WHERE id = 1; SELECT id FROM u ORDER BY id").collect() == [(1,), (2,), (11,)]
    assert session.table_names() == ["t", "u"]
    assert session.table_info("U") == (3, [("id", "bigint")])
    session.execute("DROP TABLE u")
    session.execute("DROP TABLE IF EXISTS u, v")
    assert session.table_names() == ["t"]


def test_many_inserts(session):
    session.script("CREATE TABLE n (x INT);" + "".join(f"INSERT INTO n VALUES ({k});" for k in range(30)))
    assert got(session, "SELECT COUNT(*), SUM(x) FROM n") == [(30, 435)]


@pytest.mark.parametrize("sql", ["UPDATE t SET id = 1", "CREATE TABLE t (x INT)", "DROP TABLE missing", "INSERT INTO missing VALUES (1)", "INSERT INTO t (nope) VALUES (1)", "INSERT INTO t VALUES (1)", "CREATE TABLE d (x DATE)", ""])
def test_refused(session, sql):
    with pytest.raises(SqlError):
        session.execute(sql)


def test_sessions_do_not_share_tables(spark, session):
    assert EngineSession(spark).table_names() == []


def test_read_csv_function(session, tmp_path):
    (tmp_path / "f.csv").write_text("k,v\na,1\nb,2\n")
    assert got(session, f"SELECT k, v FROM read_csv('{tmp_path}/f.csv') ORDER BY k") == [("a", 1), ("b", 2)]


GOLDEN = [
    ("SELECT CAST(x AS NUMERIC(10,2)) AS v FROM t WHERE k = 1", [1.25]),
    ("SELECT x::VARCHAR(10) AS v FROM t WHERE k = 1", ["1.25"]),
    ("SELECT g FROM t GROUP BY g HAVING SUM(k) > 0 ORDER BY g", ["a", "b"]),
    ("SELECT g, SUM(k) FROM t GROUP BY g HAVING SUM(k) > 0 ORDER BY k DESC", ["b", "a"]),
    ("SELECT TRIM(BOTH 'x' FROM 'xxaxx') AS v", ["a"]),
    ("SELECT TRIM(LEADING 'x' FROM 'xxaxx') AS v", ["axx"]),
    ("SELECT BTRIM('xyaxy', 'xy') AS v", ["a"]),
    ("SELECT TRIM('  a ') AS v", ["a"]),
    ("SELECT CHAR_LENGTH('é') AS v", [1]),
    ("SELECT LENGTH('é') AS v", [2]),
    ("SELECT DATE_DIFF('month', DATE '2024-01-31', DATE '2024-03-01') AS v", [2]),
    ("SELECT 1 AS v; SELECT 2 AS v", [2]),
]


@pytest.mark.parametrize(("text", "want"), GOLDEN)
def test_golden_statements(spark, text, want):
    s = EngineSession(spark)
    s.script("CREATE TABLE t (k BIGINT, g VARCHAR, x DOUBLE); INSERT INTO t VALUES (1, 'a', 1.25), (2, 'b', 2.5), (3, 'b', NULL)")
    assert [float(r[0]) if isinstance(r[0], Decimal) else r[0] for r in s.execute(text).collect()] == want


def test_statements_that_are_refused(spark):
    s = EngineSession(spark)
    s.script("CREATE TABLE t (k BIGINT, g VARCHAR)")
    for bad in ("INSERT INTO t VALUES ('zz', 'a')", "SELECT DATE_DIFF('week', DATE '2024-01-01', DATE '2024-02-01')", ";"):
        with pytest.raises(SqlError):
            s.execute(bad)
    assert s.execute("SELECT COUNT(*) FROM t").first()[0] == 0
    s.execute("INSERT INTO t VALUES ('7', 'a')")
    assert s.execute("SELECT k FROM t").first()[0] == 7
