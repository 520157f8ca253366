"""A command line over a SQL session: `python -m millrace.cli [-c SQL] [--mode table|csv|json] [file.csv ...]`."""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.frame import Frame
from .plans.session import EngineSession
from .sources.csv import read_csv

HELP = ".mode table|csv|json   .timer on|off   .tables   .mem   .help   .quit"
SHOWN = 1000  # rows of a table that are printed


def render(df: DataFrame, mode: str) -> str:
    if mode == "table":
        return Frame(df).text(SHOWN)
    rows = (r.asDict() for r in df.toLocalIterator())  # all of them: csv and json are read by programs
    if mode == "json":
        return "\n".join(json.dumps(r, default=str) for r in rows)
    out = io.StringIO()
    w = csv.DictWriter(out, df.columns, lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue().rstrip("\n")


class Shell:
    """Statements end with a semicolon; lines that begin with a point are commands."""

    def __init__(self, session: EngineSession, mode: str = "table") -> None:
        self.session, self.mode, self.timer, self.pending = session, mode, False, ""

    def run(self, sql: str) -> str:
        start = time.perf_counter()
        df = self.session.script(sql)
        text = render(df, self.mode) if df is not None else ""
        return text + (f"\n{time.perf_counter() - start:.3f} s" if self.timer else "")

    def feed(self, line: str) -> str | None:
        """What a line prints; None ends the shell."""
        if not self.pending and line.startswith("."):
            return self._command(line.split())
        self.pending += line + "\n"
        if not line.rstrip().endswith(";"):
            return ""
        sql, self.pending = self.pending, ""
        try:
            return self.run(sql)
        except Exception as e:  # noqa: BLE001  a failed statement is shown and the shell goes on
            return f"error: {str(e).splitlines()[0]}"

    def _command(self, words: list[str]) -> str | None:
        name, arg = words[0], words[1] if len(words) > 1 else ""
        if name in (".quit", ".exit"):
            return None
        if name == ".mode" and arg in ("table", "csv", "json"):
            self.mode = arg
            return ""
        if name == ".timer":
            self.timer = arg != "off"
            return ""
        if name == ".tables":
            return "\n".join(self.session.table_names())
        if name == ".mem":
            used = self.session.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
            return f"{(used.totalMemory() - used.freeMemory()) >> 20} MB used on the driver"
        return HELP


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("files", nargs="*", help="delimited files, each a table named as its file")
    p.add_argument("-c", "--command")
    p.add_argument("--mode", default="table", choices=("table", "csv", "json"))
    o = p.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    session = EngineSession(spark)
    for f in o.files:
        session.register(Path(f).stem, read_csv(session.spark, f))
    shell = Shell(session, o.mode)
    if o.command:
        print(shell.run(o.command))
        return
    for line in sys.stdin:
        out = shell.feed(line.rstrip("\n"))
        if out is None:
            return
        if out:
            print(out)


if __name__ == "__main__":
    main()
