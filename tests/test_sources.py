from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.sources.csv import joined, kind_of, read_csv, write_csv
from millrace.sources.tables import load_parts, read_parted, save_parted


@pytest.mark.parametrize(
    ("value", "kind"),
    [("1", "bigint"), ("-2.5e3", "double"), ("nan", "double"), ("true", "boolean"), ("2024-01-02", "date"), ("2024-01-02T03:04:05.5", "timestamp"), ("03:04:05", "time"), ("x", "string")],
)
def test_kinds(value, kind):
    assert kind_of(value) == kind


def test_lattice():
    assert [joined(x) for x in (["bigint", "double"], ["timestamp", "date"], ["bigint", "boolean"], [], ["string", "bigint"], ["date", "bigint"])] == ["double", "timestamp", "bigint", "string", "string", "string"]


def test_types_fit_every_row(spark, tmp_path):
    rows = [f"{k},{k},{k},true,2024-01-01" for k in range(150)]
    rows += ['1.5,x,99999999999999999999,7,2024-13-45', '2,"two\nlines",3,false,2024-01-02']
    (tmp_path / "late.csv").write_text("a,b,c,d,e\n" + "\n".join(rows) + "\n")
    df = read_csv(spark, str(tmp_path / "late.csv"))
    assert [k for _, k in df.dtypes] == ["double", "string", "double", "bigint", "string"] and df.count() == 152
    assert df.filter("a = 1.5").first()[1:] == ("x", 1e20, 7, "2024-13-45") and df.filter("b like 'two%'").first()[:4] == (2.0, "two\nlines", 3.0, 0)
    assert df.filter(" or ".join(f"{c} is null" for c in df.columns)).count() == 0
    (tmp_path / "only.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "only.csv")).count() == 0


def test_dates_and_times(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,time,timestamp,value\n1970-01-01,00:00:01,1970-01-01T00:00:00,1\n2024-02-29,23:59:59.25,2024-02-29 23:59:59.250000,\n")
    df = read_csv(spark, str(tmp_path / "d.csv"))
    assert [k for _, k in df.dtypes] == ["date", "bigint", "timestamp_ntz", "bigint"]
    assert [tuple(r) for r in df.collect()] == [
        (dt.date(1970, 1, 1), 1_000_000, dt.datetime(1970, 1, 1), 1),
        (dt.date(2024, 2, 29), 86_399_250_000, dt.datetime(2024, 2, 29, 23, 59, 59, 250_000), None),
    ]
    assert read_csv(spark, str(tmp_path / "d.csv"), zero_fill=True).collect()[1]["value"] == 0


def test_quotes_line_ends_and_tabs(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x ""y"", z",1\n"two\nlines",2\n')
    assert {tuple(r) for r in read_csv(spark, str(tmp_path / "q.csv")).collect()} == {('x "y", z', 1), ("two\nlines", 2)}
    (tmp_path / "t.csv").write_text("1\tx\n2\ty\n")
    df = read_csv(spark, str(tmp_path / "t.csv"), header=False)
    assert df.columns == ["V1", "V2"] and df.count() == 2


def test_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1, True, 'a"b,c', None), (2, -1e300, False, "", "z")], "i bigint, f double, b boolean, s string, n string")
    write_csv(df, str(tmp_path / "r"))
    back = {r["i"]: r for r in read_csv(spark, str(tmp_path / "r"), types=["bigint", "double", "boolean", "string", "string"]).collect()}
    assert back[1]["f"] == 0.1 and back[1]["s"] == 'a"b,c' and back[1]["n"] is None and back[2]["f"] == -1e300 and back[2]["b"] is False


def test_both_partition_layouts(spark, tmp_path):
    df = spark.range(20).select("id", F.when(F.col("id") < 8, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("date").alias("date"))
    save_parted(df, str(tmp_path / "new"), "data")
    new = read_parted(spark, str(tmp_path / "new"), "data")
    for day in ("2024-01-01", "2024-01-02"):
        df.filter(F.col("date") == day).drop("date").write.parquet(str(tmp_path / "old" / day.replace("-", ".") / "data"))
    old = read_parted(spark, str(tmp_path / "old"), "data")
    for got in (new, old):
        assert got.columns == ["date", "id"] and dict(got.dtypes)["date"] == "date"
        assert got.filter(F.col("date") == F.lit("2024-01-01").cast("date")).count() == 8
        assert got.agg(F.sum("id")).first()[0] == 190
    assert load_parts(spark, str(tmp_path / "old"), "data").columns == ["id"]
    plan = new.filter(F.col("date") == F.lit("2024-01-01").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
