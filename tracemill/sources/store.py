"""Tables of traces and evaluations as Parquet: append, latest version, filters, listing, soft delete and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import prefix
from .scratch import stash, unstash


@dataclass(frozen=True)
class TraceFilter:
    """All given conditions hold. substring: tool, tag and capability match as parts of the JSON text, not as members."""

    session: str | None = None
    tool: str | None = None
    tag: str | None = None
    capability: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    source_type: str | None = None
    substring: bool = False

    def condition(self) -> Column:
        def member(col: str, value: str) -> Column:
            return F.to_json(col).contains(value) if self.substring else F.array_contains(col, value)

        out = F.lit(True)
        for value, cond in (
            (self.session, lambda v: F.col("session_id") == v),
            (self.tool, lambda v: member("tools", v)),
            (self.tag, lambda v: member("tags", v)),
            (self.capability, lambda v: member("capability_ids", v)),
            (self.date_from, lambda v: F.col("started_at") >= F.lit(v).cast("timestamp")),
            (self.date_to, lambda v: F.col("started_at") < F.lit(v).cast("timestamp") + F.expr("INTERVAL 1 DAY")),
            (self.source_type, lambda v: F.col("source_type") == v),
        ):
            if value is not None:
                out = out & cond(value)
        return out


def append(rows: DataFrame, path: str, date_col: str = "started_at", most: int = 1_000_000) -> None:
    """By date, with a bounded number of rows a file."""
    rows.withColumn("date", F.to_date(date_col)).write.mode("append").option("maxRecordsPerFile", most).partitionBy("date").parquet(path)


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregate that combines before the shuffle; ties go to the greatest row."""
    rest = [c for c in rows.columns if c not in key + version]
    top = F.max(F.struct(*version, *rest)).alias("_t")
    return rows.groupBy(*key).agg(top).select(*key, *(F.col(f"_t.{c}").alias(c) for c in rows.columns if c not in key))


def live(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Latest rows that aren't deleted; deletion appends a row with deleted = true."""
    return latest(rows, key, version).where(~F.coalesce("deleted", F.lit(False)))


def lookup(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows with one of the ids; for a few ids the planner sends them to the rows."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def by_session(rows: DataFrame, order: str = "started_at") -> DataFrame:
    """Rows with their position in their session, by time and then id."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(order, "trace_id")))


def listing(rows: DataFrame, order: str = "started_at", limit: int = 0, offset: int = 0, where: TraceFilter | None = None) -> DataFrame:
    """Newest first with the id as tie-break; limit 0 is all, and offset works without a limit."""
    out = (rows.where(where.condition()) if where else rows).orderBy(F.desc(order), "trace_id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def link(rows: DataFrame, capability: str, on: bool = True) -> DataFrame:
    change = F.array_union("capability_ids", F.array(F.lit(capability))) if on else F.array_remove("capability_ids", capability)
    return rows.withColumn("capability_ids", change)


def allocate_ids(rows: DataFrame, order: list[str], date_col: str = "started_at", taken: int = 0) -> DataFrame:
    """trace_{date}_{number within the date}."""
    day = F.date_format(date_col, "yyyyMMdd")
    n = F.row_number().over(Window.partitionBy(F.to_date(date_col)).orderBy(*order)) + taken
    return rows.withColumn("id", F.concat(F.lit("trace_"), day, F.lit("_"), F.format_string("%03d", n)))


def append_lines(rows: DataFrame, path: str, date_col: str = "started_at", most_bytes: int = 100 << 20, most_files: int = 999) -> None:
    """A JSON line a row, in folders by date and file number: a file ends with the row by which `most_bytes` have passed since the last end, counted
    in order of time and line. Numbers go on after those that are there; more than `most_files` a date are an error, before anything is written."""
    spark = rows.sparkSession
    lines = stash(rows.select(F.date_format(date_col, "yyyy-MM-dd").alias("date"), F.col(date_col).alias("at"), F.to_json(F.struct(*rows.columns)).alias("value")), "lines")
    there = spark.createDataFrame([], "date string, last bigint")
    if not_empty(spark, path):
        old = spark.read.option("basePath", path).text(path).select(F.col("date").cast("string").alias("date"), "file_no").distinct()
        there = old.groupBy("date").agg(F.max("file_no").cast("bigint").alias("last"))
    numbered = prefix.rolled(lines, ["at", "value"], F.octet_length("value") + 1, most_bytes, by=["date"])
    out = stash(numbered.join(there, "date", "left").select("date", (F.col("file_no") + F.coalesce("last", F.lit(0))).alias("file_no"), "value"), "numbered")
    if not out.where(F.col("file_no") > most_files).isEmpty():
        raise ValueError(f"more than {most_files} files of a date")
    out.repartition("date", "file_no").write.mode("append").partitionBy("date", "file_no").text(path)
    unstash(lines, out)


def not_empty(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0
