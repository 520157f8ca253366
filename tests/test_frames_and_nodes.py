from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators.frame import Engine, col, lit
from millrace.operators.joins import equi_join, interval_join, zero_fill
from millrace.operators.rows import head, page, tail
from millrace.plans.nodes import NODES, NodeError, Pipeline, formula_column, metadata


@pytest.fixture
def people(spark):
    return Engine(spark).frame([("a", 1, 2.0), ("b", 2, 4.0), ("a", 3, 6.0), (None, 4, None)], "k string, v long, w double")


def test_frame(people):
    out = people.filter((col("v") > 1) & ~(col("v") == 2)).group_by("k").agg(col("v").sum(), col("w").mean(), col("v").count().alias("n")).sort("k")
    assert out.to_dict() == {"k": ["a", None], "v_sum": [3, 4], "w_mean": [6.0, None], "n": [1, 1]}
    assert people.shape == (4, 3) and people["v"].to_list()[:1] == [1] and len(people["v"]) == 4 and people["v"].to_numpy()[3] == 4 and "v: 1, 2" in repr(people["v"]) and len(people.head(2)) == 2
    assert people.select("k", col("v") * 2 + 1, (-col("v")).abs().alias("z"), 1 / col("v")).columns == ["k", "_e1", "z", "_e3"]
    assert people.sort("w", descending=True)["v"].to_list() == [4, 3, 2, 1]
    assert people.select(lit(1) / (col("v") - 1)).collect().to_dict()["_e0"][0] is None
    assert "bigint" in str(people)
    with pytest.raises(TypeError):
        people.group_by("k").agg(col("v"))


def test_engine_storage(people, spark, tmp_path):
    from millrace.sources.tables import save_parted

    with Engine(spark) as e:
        e.splay_save(people, str(tmp_path / "t"))
        assert len(e.splay_load(str(tmp_path / "t"))) == 4 and e.mem_stats()["used"] > 0
        e.write_csv(people, str(tmp_path / "c"))
        assert sorted(e.read_csv(str(tmp_path / "c"))["v"].to_list()) == [1, 2, 3, 4]
        save_parted(people.df.withColumn("part", F.col("v") % 2), str(tmp_path / "p"), "t", key="part")
        assert e.part_load(str(tmp_path / "p"), "t").columns == ["part", "k", "v", "w"]


def test_frame_sets_and_windows(people):
    a = people.select("k")
    assert len(a.union(a)) == 8 and len(a.union(a, all=False)) == 3 and len(a.intersect(a)) == 3 and len(a.subtract(a.filter(col("k") == "a"))) == 2
    assert people.tail(2, "v")["v"].to_list() == [3, 4] and people.rename("x", "y", "z").columns == ["x", "y", "z"]
    assert people.cast(v="string").df.dtypes[1] == ("v", "string")
    w = people.window(["k"], ["v"], rn=F.row_number(), run=F.sum("v"), before_it=F.lag("v")).sort("v").to_dict()
    assert w["rn"] == [1, 1, 2, 1] and w["run"] == [1, 2, 4, 4] and w["before_it"] == [None, None, 1, None]
    assert people.window(["k"], [], after=None, n=F.count("v")).sort("v")["n"].to_list() == [2, 1, 2, 1]
    assert len(people.materialize()) == 4


def test_joins(people, spark):
    right = Engine(spark).frame([("a", "x"), ("c", "y")], "k string, u string")
    assert sorted(people.join(right, "k").to_dict()["v"]) == [1, 3]
    left = people.join(right, "k", "left")
    assert left.columns == ["k", "v", "w", "u"] and len(left) == 4
    assert set(zero_fill(left.df, ["u"]).select("u").toPandas()["u"]) == {"x", ""}
    assert equi_join(people.df, right.df, ["k"], "full").count() == 5
    with pytest.raises(ValueError, match="how"):
        people.join(right, "k", "sideways")


def test_interval_join_against_brute_force(spark):
    left = [("a", t) for t in (0, 5, 5, 17)] + [("b", 3), (None, 1), ("c", None)]
    right = [("a", t, t * 1.0) for t in range(0, 30, 2)] + [("b", 100, 1.0), ("a", 5, None), (None, 1, 9.0)]
    for lo, hi in ((-3, 0), (0, 0), (-10, 10), (2, 3)):
        out = interval_join(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, t long, x double"), "t", ["k"], lo, hi, {"n": F.count("x"), "s": F.sum("x")})
        want = []
        for k, t in left:
            hit = [x for kk, u, x in right if k is not None and t is not None and k == kk and t + lo <= u <= t + hi and x is not None]
            want.append((str(k), str(t), len(hit), sum(hit) if hit else None))
        assert sorted((str(r["k"]), str(r["t"]), r["n"], r["s"]) for r in out.collect()) == sorted(want, key=lambda r: r[:3])
    with pytest.raises(ValueError):
        interval_join(spark.range(1).toDF("t"), spark.range(1).toDF("t"), "t", [], 1, 0, {})


def test_row_ranges(spark):
    df = spark.range(10)
    assert [r[0] for r in tail(df, 3, "id").collect()] == [7, 8, 9]
    assert [r[0] for r in head(df, 2, "id").collect()] == [0, 1] and head(df, 0).columns == ["id"]
    assert [r[0] for r in page(df, 4, 2, "id").collect()] == [4, 5]


def _csv(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_pipeline(spark, tmp_path):
    left, right = _csv(tmp_path, "l.csv", "id,val\na,1\nb,2\na,3\n"), _csv(tmp_path, "r.csv", "id,score\na,10\nb,20\n")
    spec = {
        "nodes": [
            {"id": "src", "type": "csv_source", "config": {"file_path": left}},
            {"id": "flt", "type": "filter", "config": {"column": "val", "operator": "ge", "value": "2"}},
            {"id": "jn", "type": "join", "config": {"right_file": right, "keys": ["id"]}},
            {"id": "fx", "type": "formula", "config": {"expression": "-val * 2 + score / 4", "output_name": "z"}},
            {"id": "srt", "type": "sort", "config": {"columns": [{"name": "id", "descending": True}]}},
            {"id": "out", "type": "grid", "config": {"page_size": 1}},
        ],
        "edges": [{"source": a, "target": b} for a, b in (("src", "flt"), ("flt", "jn"), ("jn", "fx"), ("fx", "srt"), ("srt", "out"))],
    }
    p = Pipeline(spec)
    seen = []
    out = p.run(spark, on_event=lambda k, s: seen.append((k, s)))
    assert out.error is None and out.results["out"]["total"] == 2 and out.results["out"]["rows"] == [{"id": "b", "val": 2, "score": 20, "z": 1.0}]
    assert seen[0] == ("src", "started") and p.run(spark, resume_from="out").results["out"]["total"] == 2
    spec["nodes"][1]["config"]["column"] = "nope"
    bad = Pipeline(spec).run(spark)
    assert bad.failed == "flt" and "nope" in bad.error and "jn" not in bad.results


def test_cycle_and_unknown_type():
    two = [{"id": "a", "type": "grid"}, {"id": "b", "type": "grid"}]
    with pytest.raises(NodeError, match="cycle"):
        Pipeline({"nodes": two, "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}]}).order()
    with pytest.raises(NodeError, match="type"):
        Pipeline({"nodes": [{"id": "a", "type": "ai"}]})


def test_other_nodes(spark, tmp_path, people):
    data = {"df": people.df}
    assert NODES["query"](spark, {"sql": "WHERE v > 2 ORDER BY v DESC"}, data)["df"].collect()[0]["v"] == 4
    assert NODES["query"](spark, {"filter": {"column": "k", "operator": "eq", "value": "a"}, "groupby": {"keys": ["k"], "aggs": [{"column": "v", "op": "avg"}]}}, data)["df"].collect() == [("a", 2.0)]
    assert NODES["conditional"](spark, {"field": "n", "operator": "gt", "value": "3"}, {"n": 5})["branch"] == "true"
    assert NODES["columns"](spark, {"drop": ["w"], "rename": {"k": "key"}}, data)["df"].columns == ["key", "v"]
    assert NODES["groupby"](spark, {"keys": ["k"], "aggs": [{"column": "v", "op": "avg"}]}, data)["df"].columns == ["k", "v_mean"]
    with pytest.raises(NodeError):
        NODES["conditional"](spark, {"field": "m", "operator": "gt", "value": "3"}, {"n": 5})
    assert NODES["script"](spark, {"code": "output = {'m': input['n'] + 1}"}, {"n": 1}) == {"m": 2}
    assert NODES["dict_transform"](spark, {"drop": ["x"], "rename": {"y": "z"}}, {"x": 1, "y": 2}) == {"z": 2}
    assert NODES["script"](spark, {"code": "output = {'n': sum([1, 2])}"}, {})["n"] == 3
    with pytest.raises(NameError):
        NODES["script"](spark, {"code": "open('x')"}, {})
    for kind in ("bar", "line", "scatter", "pie"):
        assert NODES["chart"](spark, {"x_column": "k", "y_column": "v", "chart_type": kind}, data)["options"]["series"][0]["type"] == kind
    assert NODES["stat_card"](spark, {"column": "v", "op": "max"}, data)["value"] == 4
    for kind in ("csv", "json"):
        NODES["export"](spark, {"output_path": str(tmp_path / kind), "format": kind}, data)
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    assert {m["id"] for m in metadata()} >= {"filter", "groupby", "join"}


@pytest.mark.parametrize("text", ["__import__('os')", "v ** 2", "nope + 1", "'a' + v", "v if v else 1"])
def test_formula_refuses(text):
    with pytest.raises(NodeError):
        formula_column(text, ["v"])


def test_streaming_windows(spark, tmp_path):
    from millrace.streaming.windows import tumbling

    src = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT), 0) AS ts, id FROM range(150)")
    src.write.parquet(str(tmp_path / "in"))
    agg = {"n": F.count(F.lit(1))}
    batch = {(r["start"], r["n"]) for r in tumbling(src, "ts", "1 hour", [], agg).collect()}
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream, "ts", "1 hour", [], agg).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["start"], r["n"]) for r in spark.table("windows").collect()} == batch


def test_dashboard_and_pdf(spark, tmp_path):
    from millrace.plans.nodes import refresh

    path = _csv(tmp_path, "d.csv", "id,val\n" + "".join(f"r{k},{k}\n" for k in range(20)))
    p = Pipeline({"nodes": [{"id": "s", "type": "csv_source", "config": {"file_path": path}}]})
    assert len(refresh(spark, p, [{"id": "w", "node": "s"}], most=7)["w"]) == 7
    pdf = NODES["pdf_render"](spark, {"title": "A (b)"}, p.cache["s"])["pdf"]
    assert pdf.startswith(b"%PDF-1.4") and pdf.rstrip().endswith(b"%%EOF") and b"(A \\(b\\)) Tj" in pdf and b"r19" in pdf


def test_shell(spark, tmp_path):
    from millrace.cli import Shell
    from millrace.plans.session import EngineSession

    shell = Shell(EngineSession(spark))
    assert shell.feed("CREATE TABLE t (a INT);") == "" and shell.feed("INSERT INTO t") == "" and shell.feed("VALUES (1), (NULL);") == ""
    assert shell.feed(".tables") == "t" and ".quit" in shell.feed(".help") and "MB" in shell.feed(".mem")
    shell.feed(".mode csv")
    assert shell.feed("SELECT a FROM t ORDER BY a;").splitlines()[:2] == ["a", "1"]
    shell.feed(".mode json")
    assert shell.feed("SELECT a FROM t WHERE a = 1;") == '{"a": 1}'
    shell.feed(".timer on")
    assert shell.feed("SELECT a FROM t WHERE a = 1;").endswith(" s") and shell.feed("SELECT nope FROM t;").startswith("error")
    assert shell.feed(".quit") is None
