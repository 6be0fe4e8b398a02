import datetime as dt

import pytest
from pyspark.sql import Row

from tracemill.operators import states
from tracemill.streaming import segments

SCHEMA = "trace_id string, idx bigint, ts timestamp, tool_name string, path string"
START = dt.datetime(2024, 5, 6)
TOOLS = ["read", "grep", "edit", "test", "edit", "write", "cargo", "edit", "commit", "push", "ask", "read", "read", "read", "check", "write"]


def calls(trace, n, step=3, shift=0):
    return [(trace, k, START + dt.timedelta(seconds=shift + step * k + 60 * ((k + 4) // 9)), TOOLS[(k + shift) % len(TOOLS)], f"src/m{k // 2 % 3}/f{k}.rs" if k % 5 < 4 else None) for k in range(n)]


@pytest.fixture(scope="module", autouse=True)
def state(spark):
    segments.use_state(spark)


def run(spark, tmp_path, parts, **settings):
    """Each part is a file of its own, in this order, and a batch."""
    folder = f"{tmp_path}/in"
    for k, rows in enumerate([*parts, [(None, None, START + dt.timedelta(days=900), None, None)], [(None, None, START + dt.timedelta(days=901), None, None)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        segments.to_table(segments.segments(stream, **settings), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        del k
    return spark.read.parquet(f"{tmp_path}/out")


def expected(spark, rows, gap=10_000):
    return sorted(map(tuple, states.segments(states.cuts(spark.createDataFrame(rows, SCHEMA), gap)).collect()))


def test_parts_of_a_folder_give_the_rows_of_the_whole(spark, tmp_path):
    rows = sorted(calls("a", 60) + calls("b", 45, step=7, shift=20) + calls("c", 1) + calls("d", 30, step=1, shift=100), key=lambda r: r[2])
    want = expected(spark, rows)
    assert {r[-1] for r in want} == {"start", "failure_loop", "tool_type_change", "idle_gap", "file_scope_jump"}
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    # Within the delay, the last calls of a part come in the next one, before others.
    parts[1], parts[0] = parts[0][-3:] + parts[1], parts[0][:-3]
    out = run(spark, tmp_path, [p[::-1] for p in parts], late="2 minutes")
    assert sorted(map(tuple, out.select(want and ["trace_id", *segments.OUT]).collect())) == want


def test_late_calls_are_left_out_and_a_pause_does_not_end_a_trace(spark, tmp_path):
    rows = calls("a", 12)
    far = [("a", 20 + k, START + dt.timedelta(hours=2, seconds=k), "read", "src/m0/f.rs") for k in range(3)]
    later = [("a", 30, START + dt.timedelta(hours=4), "read", "src/m0/f.rs")]
    late = [("a", 13, START + dt.timedelta(seconds=50), "edit", None)]
    out = run(spark, tmp_path, [rows, far, later, late], late="1 minute")
    assert sorted(map(tuple, out.select("trace_id", *segments.OUT).collect())) == expected(spark, rows + far + later)


class Handle:
    """State of one trace, in memory."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], []

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return self

    def appendList(self, rows):
        self.rows += rows

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_calls_reach_the_state_as_rows():
    s, handle = segments.Segmenter(10_000, 1), Handle()
    s.init(handle)
    rows = [Row(idx=k, us=9_000 - 1_000 * k, category="locate", failed=False, scope="") for k in range(2)]
    assert list(s.handleInputRows(("a",), iter(rows), None)) == []
    assert handle.rows == [(0, 9_000, "locate", False, ""), (1, 8_000, "locate", False, "")] and handle.timers == [8]
