"""Declarative pipelines: nodes joined by edges, run as one lazy plan where they can be.

A node is a function of its settings and of a dictionary that upstream nodes have filled; frames travel in it
under `df`. Only output nodes run a Spark job.
"""

from __future__ import annotations

import ast
import json
import operator
import re
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import equi_join
from ..sources.csv import read_csv, write_csv
from . import dialect

Data = dict[str, Any]
NODES: dict[str, Callable[[SparkSession, dict, Data], Data]] = {}
COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "lt": operator.lt, "ge": operator.ge, "le": operator.le}
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


class NodeError(ValueError):
    """A node whose settings or inputs don't fit."""


def node(f: Callable[[SparkSession, dict, Data], Data]) -> Callable[[SparkSession, dict, Data], Data]:
    NODES[f.__name__.removesuffix("_node")] = f
    return f


def metadata() -> list[dict]:
    return [{"id": name, "doc": (f.__doc__ or "").strip()} for name, f in sorted(NODES.items())]


def _df(data: Data) -> DataFrame:
    if not isinstance(data.get("df"), DataFrame):
        raise NodeError("this node needs a table from upstream")
    return data["df"]


def _with(data: Data, df: DataFrame) -> Data:
    return {**data, "df": df, "columns": df.columns}


def _value(df: DataFrame, column: str, value: Any) -> Any:
    """Text settings as numbers where the column is one."""
    if column not in df.columns:
        raise NodeError(f"there is no column {column}")
    if isinstance(value, str) and dict(df.dtypes)[column] not in ("string", "date", "timestamp", "timestamp_ntz", "boolean"):
        return float(value) if re.search(r"[.eE]", value) else int(value)
    return value


@node
def csv_source(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Load a delimited file."""
    return _with(data, read_csv(spark, settings["file_path"], settings.get("delimiter"), settings.get("header", True)))


@node
def table_source(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Load a Parquet table."""
    return _with(data, spark.read.parquet(settings["path"]))


@node
def filter_node(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Keep rows whose column compares with a value."""
    df = _df(data)
    if settings["operator"] not in COMPARE:
        raise NodeError(f"no such comparison: {settings['operator']}")
    return _with(data, df.filter(COMPARE[settings["operator"]](F.col(settings["column"]), F.lit(_value(df, settings["column"], settings["value"])))))


@node
def groupby(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Group by keys and aggregate columns; results are named column_kind, averages column_mean."""
    made = []
    for a in settings["aggs"]:
        if a["op"] not in AGGREGATES:
            raise NodeError(f"no such aggregate: {a['op']}")
        made.append(AGGREGATES[a["op"]](a["column"]).alias(f"{a['column']}_{'mean' if a['op'] == 'avg' else a['op']}"))
    return _with(data, _df(data).groupBy(*settings["keys"]).agg(*made))


@node
def join(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Join with a second table, from upstream or a file."""
    right = data.get("right") or read_csv(spark, settings["right_file"])
    return _with(data, equi_join(_df(data), right, settings["keys"], settings.get("how", "inner")))


@node
def sort(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Sort by columns, nulls last going up and first going down."""
    order = [F.col(c["name"]).desc_nulls_first() if c.get("descending") else F.col(c["name"]).asc_nulls_last() for c in settings["columns"]]
    return _with(data, _df(data).orderBy(*order))


_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Mod: F.try_mod}


def formula_column(text: str, columns: list[str]) -> Column:
    """Arithmetic over columns and numbers as a column expression; anything else is refused."""

    def of(n: ast.AST) -> Column:
        if isinstance(n, ast.BinOp) and type(n.op) in _ARITHMETIC:
            return _ARITHMETIC[type(n.op)](of(n.left), of(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -of(n.operand) if isinstance(n.op, ast.USub) else of(n.operand)
        if isinstance(n, ast.Name):
            if n.id not in columns:
                raise NodeError(f"there is no column {n.id}")
            return F.col(n.id)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(n.value)
        raise NodeError(f"a formula can't hold {type(n).__name__}")

    return of(ast.parse(text, mode="eval").body)


@node
def formula(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Add a column computed by arithmetic."""
    df = _df(data)
    return _with(data, df.withColumn(settings.get("output_name", "result"), formula_column(settings["expression"], df.columns)))


@node
def query(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Filter, join, group and sort by a form, or by SQL over the table `data`, whose clauses may stand alone."""
    if settings.get("sql"):
        df = _df(data)
        text = settings["sql"].strip().rstrip(";")
        if not re.match(r"(?i)(select|with)\b", text):
            text = f"SELECT * FROM data {text}"
        ts = dialect.statements(text)
        if len(ts) != 1:
            raise NodeError("one statement is expected")
        out = df.sparkSession.sql(re.sub(r"(?i)\b(from|join)\s+data\b", r"\1 {data}", dialect.text(dialect.spark_query(ts[0]))), data=df)
        return _with(data, out)
    for step in ("filter", "join", "groupby", "sort"):
        if settings.get(step):
            data = NODES[step](spark, settings[step], data)
    return data


#: What scripts may call. Scripts come from the pipeline's author, as any Python code of theirs does.
_ALLOWED = {f.__name__: f for f in (abs, all, any, bool, dict, enumerate, float, int, len, list, max, min, range, round, set, sorted, str, sum, tuple, zip)}


@node
def script(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Run the author's Python over a copy of the dictionary, `input`; it leaves its result in `output`. Frames stay lazy."""
    scope = {"__builtins__": dict(_ALLOWED), "input": dict(data), "output": {}, "F": F}
    exec(compile(settings["code"], "<script>", "exec"), scope)  # noqa: S102
    out = scope["output"]
    if not isinstance(out, dict):
        raise NodeError("a script leaves a dictionary")
    return out


@node
def conditional(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Mark the branch that a value of the dictionary takes."""
    value, other = data.get(settings["field"]), settings["value"]
    if value is None:
        raise NodeError(f"there is no {settings['field']}")
    if settings["operator"] not in COMPARE:
        raise NodeError(f"no such comparison: {settings['operator']}")
    if isinstance(other, str) and isinstance(value, (int, float)):
        other = float(other)
    met = bool(COMPARE[settings["operator"]](value, other))
    return {**data, "branch": "true" if met else "false", "condition_met": met}


@node
def dict_transform(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Drop, then pick, then rename entries of the dictionary."""
    drop, pick, rename = settings.get("drop", []), settings.get("pick"), settings.get("rename", {})
    out = {k: v for k, v in data.items() if k not in drop and (not pick or k in pick)}
    return {rename.get(k, k): v for k, v in out.items()}


@node
def columns(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Drop, then pick, then rename columns of the table."""
    df = _df(data).drop(*settings.get("drop", []))
    df = df.select(*settings["pick"]) if settings.get("pick") else df
    return _with(data, df.withColumnsRenamed(settings.get("rename", {})))


@node
def grid(spark: SparkSession, settings: dict, data: Data) -> Data:
    """The first page of rows, and how many rows there are."""
    df = _df(data)
    return {**data, "rows": [r.asDict() for r in df.limit(settings.get("page_size", 100)).collect()], "total": df.count()}


@node
def chart(spark: SparkSession, settings: dict, data: Data) -> Data:
    """The options of a bar, line, pie or scatter chart of at most max_points points."""
    kind, df = settings.get("chart_type", "bar"), _df(data)
    if kind not in ("bar", "line", "pie", "scatter"):
        raise NodeError(f"no such chart: {kind}")
    x, y = settings.get("x_column") or df.columns[0], settings.get("y_column") or df.columns[-1]
    points = [(r[0], r[1]) for r in df.select(x, y).limit(settings.get("max_points", 500)).collect()]
    options: dict[str, Any] = {"title": {"text": settings.get("title", "")}}
    if kind == "pie":
        options["series"] = [{"type": kind, "data": [{"name": a, "value": b} for a, b in points]}]
    elif kind == "scatter":
        options |= {"xAxis": {"type": "value"}, "yAxis": {"type": "value"}, "series": [{"type": kind, "data": [list(p) for p in points]}]}
    else:
        options |= {"xAxis": {"type": "category", "data": [a for a, _ in points]}, "yAxis": {"type": "value"}, "series": [{"type": kind, "data": [b for _, b in points]}]}
    return {**data, "chart_type": kind, "options": options}


@node
def stat_card(spark: SparkSession, settings: dict, data: Data) -> Data:
    """One number: first, sum, avg, count, min or max of a column."""
    made = {"first": F.first, **AGGREGATES}[settings.get("op", "first")](settings["column"])
    return {**data, "value": _df(data).agg(made).first()[0]}


@node
def export(spark: SparkSession, settings: dict, data: Data) -> Data:
    """Write the table as CSV or JSON, one file a task."""
    df, kind = _df(data), settings.get("format", "csv")
    if kind == "csv":
        write_csv(df, settings["output_path"])
    elif kind == "json":
        df.write.mode("overwrite").json(settings["output_path"])
    else:
        raise NodeError(f"no such format: {kind}")
    return {**data, "path": settings["output_path"], "format": kind}


@dataclass
class Outcome:
    results: dict[str, Data] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    error: str | None = None
    failed: str | None = None


class Pipeline:
    """{"nodes": [{"id", "type", "config"}], "edges": [{"source", "target", "as"?}]}, run in topological order.

    An edge with `"as": "right"` hands its table on under that name. Results are kept by node, so a later run can
    resume behind any of them.
    """

    def __init__(self, spec: dict | str) -> None:
        spec = json.loads(spec) if isinstance(spec, str) else spec
        self.nodes = {n["id"]: n for n in spec["nodes"]}
        self.edges = spec.get("edges", [])
        for n in self.nodes.values():
            if n["type"] not in NODES:
                raise NodeError(f"no such node type: {n['type']}")
        self.cache: dict[str, Data] = {}

    def order(self) -> list[str]:
        waiting = {k: 0 for k in self.nodes}
        for e in self.edges:
            waiting[e["target"]] += 1
        ready, out = deque(k for k, n in waiting.items() if n == 0), []
        while ready:
            out.append(k := ready.popleft())
            for e in self.edges:
                if e["source"] == k:
                    waiting[e["target"]] -= 1
                    if waiting[e["target"]] == 0:
                        ready.append(e["target"])
        if len(out) < len(self.nodes):
            raise NodeError("the nodes form a cycle")
        return out

    def run(self, spark: SparkSession, resume_from: str | None = None, on_event: Callable[[str, str], None] | None = None) -> Outcome:
        """Stops at the first node that fails. With resume_from nodes before it come from the cache, if they are there."""
        out, tell = Outcome(order=self.order()), on_event or (lambda *_: None)
        fresh = resume_from is None
        for k in out.order:
            fresh = fresh or k == resume_from
            if not fresh and k in self.cache:
                out.results[k] = self.cache[k]
                continue
            data: Data = {}
            for e in self.edges:
                if e["target"] == k:
                    up = out.results[e["source"]]
                    data |= {e["as"]: up.get("df")} if e.get("as") else up
            try:
                tell(k, "started")
                out.results[k] = self.cache[k] = NODES[self.nodes[k]["type"]](spark, self.nodes[k].get("config", {}), data)
                tell(k, "done")
            except Exception as e:  # noqa: BLE001  whatever a node raises ends the run and is reported
                out.error, out.failed = f"{type(e).__name__}: {e}", k
                tell(k, "failed")
                break
        return out


def refresh(spark: SparkSession, pipeline: Pipeline, widgets: list[dict], most: int = 500) -> dict[str, list[dict]]:
    """Run a dashboard's source pipeline and give each widget {"id", "node"} the first rows of its node, at most `most`."""
    out = pipeline.run(spark)
    if out.error:
        raise NodeError(f"{out.failed}: {out.error}")
    return {w["id"]: [r.asDict() for r in _df(out.results[w["node"]]).limit(most).collect()] for w in widgets}


def _pdf_text(value: str) -> bytes:
    return value.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


@node
def pdf_render(spark: SparkSession, settings: dict, data: Data) -> Data:
    """The first max_rows rows of some or all columns as a plain table in a PDF document, under `pdf`."""
    df, size, step = _df(data), 8, 11
    if chosen := [c.strip() for c in settings.get("columns", "").split(",") if c.strip()]:
        df = df.select(*chosen)
    rows = [[str(v) if v is not None else "" for v in r] for r in df.limit(settings.get("max_rows", 1000)).collect()]
    widths = [min(30, max(map(len, c))) for c in zip(df.columns, *rows, strict=True)]
    lines = ["  ".join(v[:w].ljust(w) for v, w in zip(r, widths, strict=True)) for r in (df.columns, *rows)]
    per_page = (792 - 100) // step
    pages = [lines[k : k + per_page] for k in range(0, len(lines), per_page)]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    for k, page in enumerate(pages):
        title = [_pdf_text(settings.get("title", "Report"))] if k == 0 else [b""]
        body = b"BT /F1 %d Tf %d TL 40 750 Td " % (size, step) + b" ".join(b"(%s) Tj T*" % t for t in [*title, *map(_pdf_text, page)]) + b" ET"
        objects += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k), b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)]
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k + 1, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
    return {**data, "pdf": out}
