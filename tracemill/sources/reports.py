"""Reports as Markdown, JSON and HTML: Columns that render a row's report, and a sink that writes one file a row on the executors.

The sink is a Python data source. A task writes each file under a name of its own attempt and then renames it, so a file is whole or
absent, a task that runs again replaces its files by equal ones, and no list of files goes through the driver: tasks report counts,
and the last thing that is written is `_SUCCESS` with their sum. The folder must be one that the executors share.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .ship import ship

NAME = re.compile(r"[A-Za-z0-9_=-][A-Za-z0-9._=-]*").fullmatch


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class ReportWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        files = size = 0
        for row in iterator:
            name, content = row["name"], (row["content"] or "").encode()
            if not name or not NAME(name):
                raise ValueError(f"not a file name: {name!r}")
            draft = os.path.join(self.path, f".{name}.{uuid.uuid4().hex}")
            try:
                with open(draft, "wb") as f:
                    f.write(content)
                os.replace(draft, os.path.join(self.path, name))
            finally:
                if os.path.exists(draft):
                    os.remove(draft)
            files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        done = [m for m in messages if m is not None]
        with open(os.path.join(self.path, "_SUCCESS"), "w") as f:
            json.dump({"files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}, f)

    def abort(self, messages: list) -> None:
        """Files that are there are whole; without _SUCCESS they are not all."""


class Reports(DataSource):
    """Format `reports`: rows of (name, content) as files of the folder in option path."""

    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        path = self.options["path"].removeprefix("file://")
        if "://" in path:
            raise ValueError("the folder must be mounted on driver and executors")
        if os.path.exists(os.path.join(path, "_SUCCESS")) and not overwrite:
            os.remove(os.path.join(path, "_SUCCESS"))
        return ReportWriter(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """reports: name, content; names are unique file names."""
    spark: SparkSession = reports.sparkSession
    ship(spark)
    spark.dataSource.register(Reports)
    reports.select("name", "content").write.format("reports").mode("append").option("path", path).save()


def escaped(text: Column) -> Column:
    """For HTML."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def lines(items: Column, render) -> Column:
    """A line for each item, each with its end."""
    return F.concat(F.array_join(F.transform(items, render), "\n"), F.when(F.size(items) > 0, "\n").otherwise(""))


def run_reports(runs: DataFrame, most: int = 500) -> DataFrame:
    """runs: graph, node, layer, status, reason (as of `reach.run`). (graph, risk, markdown, html, json): the first `most` skills by layer and
    name are listed, all are counted."""
    from ..operators import graph as G
    from ..operators.dashboard import JSON, gathered

    count = lambda *s: F.count_if(F.col("status").isin(*s))
    n = runs.groupBy("graph").agg(F.count("*").alias("total"), count("ok").alias("ok"), count("skipped").alias("skipped"), count("failed", "timed_out").alias("failed"), F.count_distinct("layer").alias("n_layers"))
    n = n.withColumn("risk", G.run_risk(F.col("failed"), F.col("skipped")))
    shown = gathered(runs, ["graph"], [F.col("layer"), F.col("node")], F.struct("layer", "node", "status", F.coalesce("reason", F.lit("")).alias("reason")), "skills", most)
    r = n.join(shown.drop("n_skills"), "graph")
    counts = [("Skills", "total"), ("OK", "ok"), ("Skipped", "skipped"), ("Failed", "failed"), ("Layers", "n_layers"), ("Risk", "risk")]
    cell = lambda c: F.col(c).cast("string")
    table = F.concat(*(x for label, c in counts for x in (F.lit(f"| {label} | "), cell(c), F.lit(" |\n"))))
    why = lambda s: F.when(s["reason"] != "", F.concat(F.lit(" ("), s["reason"], F.lit(")"))).otherwise("")
    item = lambda s: F.concat(F.lit("- "), s["layer"].cast("string"), F.lit(" "), s["node"], F.lit(": "), s["status"], why(s))
    markdown = F.concat(F.lit("# Run of "), F.col("graph"), F.lit("\n\n| Metric | Value |\n|-|-|\n"), table, F.lit("\n## Skills\n\n"), lines(F.col("skills"), item))
    rows = F.concat(*(x for label, c in counts for x in (F.lit(f"<tr><th>{label}</th><td>"), escaped(cell(c)), F.lit("</td></tr>"))))
    entry = lambda s: F.concat(F.lit('<li class="'), escaped(s["status"]), F.lit('">'), escaped(s["node"]), F.lit("</li>"))
    html = F.concat(F.lit("<!DOCTYPE html><title>"), escaped(F.col("graph")), F.lit("</title><table>"), rows, F.lit("</table><ul>"), F.array_join(F.transform("skills", entry), ""), F.lit("</ul>"))
    doc = F.to_json(F.struct("graph", F.struct("total", "ok", "skipped", "failed", "risk").alias("summary"), "skills"), JSON)
    return r.select("graph", "risk", markdown.alias("markdown"), html.alias("html"), doc.alias("json"))


def files_of(reports: DataFrame, key: str, formats: dict[str, str] | None = None) -> DataFrame:
    """(name, content): a file of each format for each row, named after its key."""
    formats = formats or {"markdown": "md", "html": "html", "json": "json"}
    each = F.array(*(F.struct(F.concat_ws(".", F.col(key).cast("string"), F.lit(ext)).alias("name"), F.col(c).alias("content")) for c, ext in formats.items()))
    return reports.select(F.inline(each))


def mermaid(edges: DataFrame, by: str, a: str, b: str, weight: str, most: int = 100) -> DataFrame:
    """(by, mermaid): a graph of the `most` strongest edges of each `by`, the strongest first."""
    from ..operators.dashboard import gathered

    label = F.round(weight, 3).cast("string")
    drawn = gathered(edges, [by], [F.desc(weight), F.col(a), F.col(b)], F.concat(F.lit("  "), F.col(a), F.lit(" -- "), label, F.lit(" --> "), F.col(b)), "edges", most)
    return drawn.select(by, F.concat(F.lit("graph LR\n"), F.array_join("edges", "\n")).alias("mermaid"))
