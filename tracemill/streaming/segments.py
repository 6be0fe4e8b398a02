"""Segments of a stream of calls, with all reasons for a cut, kept in state from batch to batch.

A trace's calls wait until the watermark has passed them and are then taken in order, so that calls may come out of order within
the watermark's delay; later ones are left out. The state of a trace is its last call, its open segment and its waiting calls; it
ends when no call has come for `close_after`. Categories, folders and failures are Columns, computed before the state is met.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import exprs as X
from ..sources.ship import ship

CALL = "idx bigint, us bigint, category string, failed boolean, scope string"
OPEN = "segment_idx int, first_idx bigint, n_calls bigint, category string, idx bigint, us bigint, failed boolean, scope string"
OUT = ["segment_idx", "first_idx", "last_idx", "n_calls", "category", "boundary_reason"]


def reason(before: tuple, call: tuple, gap_ms: int) -> str | None:
    """Why a segment ends between two calls of (us, category, failed, scope), or None."""
    us, category, failed, scope = call
    if before[1] == "verify" and category == "modify" and before[2]:
        return "failure_loop"
    if before[1] != category:
        return "tool_type_change"
    gap = int((us - before[0]) / 1000)
    if gap < 0 or gap > gap_ms:
        return "idle_gap"
    return "file_scope_jump" if scope and before[3] and scope != before[3] else None


class Segmenter(StatefulProcessor):
    def __init__(self, gap_ms: int, close_ms: int):
        self.gap_ms, self.close_ms = gap_ms, close_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.waiting = handle.getListState("waiting", CALL)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        calls = [(r.idx, r.us, r.category, r.failed, r.scope) for r in rows]
        if calls and key[0] is not None:
            self.waiting.appendList(calls)
            self.handle.registerTimer(min(c[1] for c in calls) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        calls = sorted(tuple(c) for c in self.waiting.get()) if self.waiting.exists() else []
        ready = [c for c in calls if c[1] // 1000 < mark]
        held = calls[len(ready) :] if ready == calls[: len(ready)] else [c for c in calls if c not in set(ready)]
        now = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for idx, us, category, failed, scope in ready:
            if now is None:
                now = (0, idx, 1, category, idx, us, failed, scope)
                continue
            number, first, n, kind, last, *before = now
            why = reason((before[0], kind, *before[1:]), (us, category, failed, scope), self.gap_ms)
            if why:
                out.append((number, first, last, n, kind, why))
                number, first, n = number + 1, idx, 0
            now = (number, first, n + 1, category, idx, us, failed, scope)
        if now and not held and now[5] // 1000 + self.close_ms < mark:
            out.append((now[0], now[1], now[4], now[2], now[3], "start"))
            self.open.clear()
        elif now:
            if ready:
                self.open.update(now)
            self.handle.registerTimer(now[5] // 1000 + self.close_ms)
        if ready:
            self.waiting.put(held) if held else self.waiting.clear()
        if held:
            self.handle.registerTimer(min(c[1] for c in held) // 1000)
        for r in out:
            yield Row(trace_id=key[0], **dict(zip(OUT, r, strict=True)))

    def close(self) -> None:
        pass


def segments(calls: DataFrame, idle_gap_ms: int = 10_000, late: str = "1 minute", close_after_ms: int = 86_400_000) -> DataFrame:
    """calls: a stream of trace_id, idx, ts, tool_name, path. Rows as those of `states.segments`, each once it has ended. The state store must be
    RocksDB's, see `use_state`. Calls without trace or time only move the watermark, or not even that."""
    ship(calls.sparkSession)
    # Rows without a trace are dropped by the state only: a filter would be pushed below the watermark, which they move.
    c = calls.withWatermark("ts", late)
    name = F.col("tool_name")
    c = c.select("trace_id", F.col("idx").cast("bigint").alias("idx"), "ts", F.unix_micros("ts").alias("us"), X.tool_category(name).alias("category"), name.rlike("test|check|lint").alias("failed"), F.coalesce(X.file_scope(F.col("path")), F.lit("")).alias("scope"))
    schema = f"trace_id {dict(calls.dtypes)['trace_id']}, segment_idx int, first_idx bigint, last_idx bigint, n_calls bigint, category string, boundary_reason string"
    return c.groupBy("trace_id").transformWithState(Segmenter(idle_gap_ms, close_after_ms), schema, "Append", "EventTime")


def use_state(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def to_table(rows: DataFrame, path: str, checkpoint: str):
    """Append all that is there now, batch by batch, and wait."""
    q = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
