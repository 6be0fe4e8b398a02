"""Alignments against their definitions, for short runs and for those that are too long for them."""

from functools import lru_cache

import numpy as np
import pytest

from tracemill.operators import align


def random_calls(g, n, tools=3, args=3):
    return [(f"t{g.integers(tools)}", f"t{g.integers(tools)}|{g.integers(args)}") for _ in range(n)]


def way_back(a, b):
    """By a recursion on the edit distance of the beginnings of both."""

    @lru_cache(None)
    def cost(i, j):
        return i + j if not i or not j else min(cost(i - 1, j) + 1, cost(i, j - 1) + 1, cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    i, j, out = len(a), len(b), []
    while (i, j) != (0, 0):
        if i and j and a[i - 1] == b[j - 1]:
            step = (b[j - 1][0], "unchanged", i - 1, j - 1)
        elif i and j and a[i - 1][0] == b[j - 1][0]:
            step = (b[j - 1][0], "args_changed", i - 1, j - 1)
        elif not i or j and cost(i, j - 1) <= cost(i - 1, j):
            step = (b[j - 1][0], "added", None, j - 1)
        else:
            step = (a[i - 1][0], "deleted", i - 1, None)
        out.append(step)
        i, j = (i if step[2] is None else step[2]), (j if step[3] is None else step[3])
    return out[::-1]


def test_short_runs():
    g = np.random.default_rng(1)
    for _ in range(200):
        a, b = (random_calls(g, g.integers(0, 12)) for _ in "ab")
        got = align.edit_align(a, b)
        assert got == way_back(tuple(a), tuple(b))
        assert [i for _, _, i, _ in got if i is not None] == list(range(len(a))) and [j for *_, j in got if j is not None] == list(range(len(b)))


def first_free(a, b):
    """For each call of b, look through all of a."""
    used, out = set(), []
    for j, y in enumerate(b):
        equal = [i for i, x in enumerate(a) if i not in used and x == y]
        alike = [i for i, x in enumerate(a) if i not in used and x[0] == y[0]]
        if equal or alike:
            i = (equal or alike)[0]
            used.add(i)
            out.append((y[0], "unchanged" if equal else "args_changed", i, j))
        else:
            out.append((y[0], "added", None, j))
    return out + [(x[0], "deleted", i, None) for i, x in enumerate(a) if i not in used]


def test_long_runs():
    g = np.random.default_rng(2)
    for _ in range(100):
        a, b = (random_calls(g, g.integers(0, 40), args=5) for _ in "ab")
        assert align.greedy_align(a, b) == first_free(a, b)


@pytest.mark.parametrize("n", [200, 201, 450])
def test_runs_at_and_over_the_limit(spark, n):
    """Runs of reading calls, one of each trace: up to 200 calls are aligned, longer ones matched one by one."""
    g = np.random.default_rng(n)
    rows = [(t, k, "read" if g.random() < 0.7 else "grep", f'{{"path": "f{g.integers(20)}"}}') for t, size in ((1, n), (2, n - 30)) for k in range(size)]
    calls = spark.createDataFrame(rows, "trace_id bigint, idx bigint, tool_name string, args string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id bigint, trace_a bigint, trace_b bigint")
    m = align.match_segments(pairs, calls)
    out = sorted((r.position, r.tool_name, r.kind, r.index_a, r.index_b) for r in align.align_calls(m, pairs, calls).collect())
    a, b = ([(tool, f"{tool}|{args}") for t, _, tool, args in rows if t == k] for k in (1, 2))
    want = (first_free if n > 200 else way_back)(a, b)
    assert [x[1:] for x in out] == want


def test_runs_reach_python_in_batches(spark):
    from tracemill.plans.record_queries import QUERIES
    from tracemill.sources import views

    sf = "/root/testdata/sf0.001"
    calls = views.tool_calls(spark, sf)
    pairs = calls.select("trace_id").distinct().selectExpr("trace_id AS pair_id", "trace_id AS trace_a", "trace_id + 1 AS trace_b")
    plan = align.align_calls(align.match_segments(pairs, calls), pairs, calls)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "tool_align" in QUERIES


def test_long_runs_by_edit_distance():
    g = np.random.default_rng(3)
    for n in (1, 64, 150, 230):
        a, b = random_calls(g, n), random_calls(g, max(0, n - g.integers(-40, 40)))
        assert align.edit_align(a, b) == way_back(tuple(a), tuple(b))
    a, b = random_calls(g, 20_000, 9, 50), random_calls(g, 15_000, 9, 50)  # a table of costs would have 300 million cells
    got = align.edit_align(a, b)
    assert [i for _, _, i, _ in got if i is not None] == list(range(len(a))) and [j for *_, j in got if j is not None] == list(range(len(b)))


def test_queries_align_runs_of_any_length_as_their_sql(spark, tmp_path):
    """Two traces of failing checks only: one run each, longer than the reference's limit."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tracemill.plans.record_oracles import ORACLES
    from tracemill.plans.record_queries import QUERIES

    g = np.random.default_rng(4)
    users = [1] * 240 + [2] * 215
    like = pq.read_schema("/root/testdata/sf0.001/events.parquet")
    n = len(users)
    columns = {"event_id": [*range(n)], "user_id": users, "ts": [1_700_000_000_000_000 + k * 1_000_000 for k in range(n)], "event_type": ["error"] * n, "value": [1.0] * n, "props": [f'{{"k": {g.integers(20)}}}' for _ in users]}
    pq.write_table(pa.table([pa.array(columns[f.name]).cast(f.type) for f in like], schema=like), f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    rows = lambda df: df.astype(object).where(df.notna(), -1).sort_values(["pair_id", "match_id", "position"]).to_numpy().tolist()
    want = con.execute(ORACLES["tool_align"]).df()
    got = QUERIES["tool_align"](spark, str(tmp_path)).toPandas()[[*want.columns]]
    assert len(want) >= 240 and rows(got) == rows(want)
