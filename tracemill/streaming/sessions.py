"""Streaming form of idle-gap segments: event-time sessions with a watermark, and append-only ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idle_sessions(calls: DataFrame, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """calls: trace_id, ts. A session ends where no call comes for `gap`; calls later than `late` are left out. Works on streams and tables."""
    c = calls.withWatermark("ts", late) if calls.isStreaming else calls
    s = c.groupBy("trace_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_calls"))
    return s.select("trace_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), "n_calls")


def ingest(stream: DataFrame, path: str, checkpoint: str, date_col: str = "ts"):
    """Append a stream to a table by date, all that is there now; returns the running query."""
    out = stream.withColumn("date", F.to_date(date_col)).writeStream.format("parquet").partitionBy("date")
    return out.option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
