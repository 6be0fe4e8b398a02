from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import reach


def test_impact_is_a_breadth_first_search(spark):
    g = np.random.default_rng(8)
    edges = [(k % 3, f"n{a}", f"n{b}") for k, (a, b) in enumerate(g.integers(0, 40, (130, 2)).tolist())] + [(0, f"m{k}", f"m{k + 1}") for k in range(25)]
    edges += [edges[0], (1, None, "n1"), (1, "n1", None), (2, "n5", "n5")]
    starts = [(k, f"n{j}") for k in range(3) for j in range(0, 40, 4)] + [(0, "m0"), (0, "m0"), (9, "n1")]
    out = reach.impact(spark.createDataFrame(edges, "graph int, source string, target string"), spark.createDataFrame(starts, "graph int, node string")).collect()
    want = set()
    for graph, start in set(starts):
        far, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for k, a, b in edges:
                if k == graph and a == at and b is not None and b not in far:
                    far[b] = far[at] + 1
                    queue.append(b)
        want |= {(graph, start, n, h) for n, h in far.items() if h}
    assert sorted(map(tuple, out)) == sorted(want) and max(r.hops for r in out) == 25


@pytest.mark.parametrize(("small", "shuffles"), [(1000, 0), (0, 2)])
def test_what_was_found_is_not_shuffled_again(spark, monkeypatch, small, shuffles):
    plans, deal = [], reach.deal

    def seen(df, *how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return deal(df, *how)

    monkeypatch.setattr(reach, "deal", seen)
    monkeypatch.setattr(reach, "SMALL_GRAPH", small)
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition"
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "-1")
    try:
        edges = [("g", f"n{k}", f"n{k + 1}") for k in range(10)] * 2 + [("g", "n10", "n0")]
        out = reach.impact(spark.createDataFrame(edges, "graph string, source string, target string"), spark.createDataFrame([("g", "n0")], "graph string, node string"))
        assert sorted((r.node, r.hops) for r in out.collect()) == sorted((f"n{k}", k) for k in range(1, 11))
    finally:
        spark.conf.set(names[0], before[0])
    assert spark.conf.get(names[1]) == before[1]
    # A round meets up to eight tables of what was found; it shuffles at most the rows to step from and those of the step.
    assert plans[9].count("LeftAnti") == 8 and plans[9].count("Exchange hashpartitioning") == shuffles


def test_nothing_is_downstream_of_nothing(spark):
    e = spark.createDataFrame([(1, "a", "b")], "graph int, source string, target string")
    s = spark.createDataFrame([], "graph int, node string")
    assert reach.impact(e, s).count() == 0 and reach.impact(e.limit(0), spark.createDataFrame([(1, "a")], "graph int, node string")).count() == 0


def test_ways_back_end_at_origins_gaps_and_cycles(spark):
    rows = [("a", 1, None, None), ("a", 2, "a", 1), ("b", 3, "a", 2), ("b", 4, "b", 3), ("c", 5, "gone", 1), ("x", 1, "y", 1), ("y", 1, "x", 1), ("z", 9, "x", 1), ("s", 1, "s", 1)]
    out = {(r.id, r.version): (r.steps, r.path, r.ended) for r in reach.evolution(spark.createDataFrame(rows, "id string, version int, from_id string, from_version int")).collect()}
    assert out == {
        ("a", 1): (0, "a@1", "origin"), ("a", 2): (1, "a@2<a@1", "origin"), ("b", 3): (2, "b@3<a@2<a@1", "origin"), ("b", 4): (3, "b@4<b@3<a@2<a@1", "origin"), ("c", 5): (1, "c@5<gone@1", "missing"),
        ("x", 1): (1, "x@1<y@1", "cycle"), ("y", 1): (1, "y@1<x@1", "cycle"), ("z", 9): (2, "z@9<x@1<y@1", "cycle"), ("s", 1): (0, "s@1", "cycle"),
    }


def test_long_ways_are_whole_and_the_row_limit_comes_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    links = spark.range(60).selectExpr("1 AS id", "id AS version", "CASE WHEN id > 0 THEN 1 END AS from_id", "id - 1 AS from_version")
    out = {r.version: r.steps for r in reach.evolution(links).collect()}
    assert out == {k: k for k in range(60)} and spark.conf.get("spark.sql.cteRecursionRowLimit", None) == before


def run_plain(nodes, edges, needs, core):
    """One skill after the other, in any order that works."""
    out, left = {}, dict(nodes)
    while True:
        ready = [n for n in left if all(d in out for d in edges.get(n, ()))]
        if not ready:
            break
        for n in ready:
            outcome, own = left.pop(n)
            ups = [out[d] for d in edges.get(n, ())]
            values = [u[2] for u in ups if u[2] is not None]
            if any(u[0] != "ok" for u in ups):
                out[n] = ("skipped", "upstream_skip", None, len(values))
            elif any(core.get(i) != v for i, v in needs.get(n, ())):
                out[n] = ("skipped", "no_compat_path", None, len(values))
            else:
                out[n] = (outcome, None, own + sum(values) if outcome == "ok" else None, len(values))
    return out | {n: ("skipped", "upstream_skip", None, 0) for n in left}


def test_values_go_from_layer_to_layer(spark):
    g = np.random.default_rng(5)
    nodes = {f"n{k}": (("ok", "ok", "ok", "ok", "failed", "timed_out")[g.integers(6)] if k > 9 else "ok", int(g.integers(100))) for k in range(80)}
    edges = {f"n{k}": sorted({f"n{j}" for j in g.integers(0, k, g.integers(0, 4))}) for k in range(1, 80)}
    edges["n70"].append("gone")
    edges["n60"].append("n75")
    edges["n75"].append("n60")
    needs = {f"n{k}": [("tree", "1.0"), ("calls", ("1.0", "2.0")[k % 7 == 3])] for k in range(20, 80)}
    core = {"tree": "1.0", "calls": "1.0"}
    out = reach.run(
        spark.createDataFrame([(1, n, o, v) for n, (o, v) in nodes.items()], "graph int, node string, outcome string, own bigint"),
        spark.createDataFrame([(1, n, d) for n, ds in edges.items() for d in ds], "graph int, node string, dep string"),
        spark.createDataFrame([(1, n, i, v) for n, ns in needs.items() for i, v in ns], "graph int, node string, input string, version string"),
        spark.createDataFrame(list(core.items()), "input string, version string"),
        gather={"inputs": F.sum("value")},
        make={"value": F.col("own") + F.coalesce("inputs", F.lit(0))},
    ).collect()
    got = {r.node: (r.status, r.reason, r.value, r.n_inputs) for r in out}
    assert got == run_plain(nodes, edges, needs, core)
    assert {r.status for r in out} == {"ok", "failed", "timed_out", "skipped"} and {r.reason for r in out} == {None, "upstream_skip", "no_compat_path"}
    assert max(r.layer for r in out) > 5


def test_a_graph_without_nodes(spark):
    none = spark.createDataFrame([], "graph int, node string, outcome string, own bigint")
    out = reach.run(none, spark.createDataFrame([], "graph int, node string, dep string"), spark.createDataFrame([], "graph int, node string, input string, version string"), spark.createDataFrame([("a", "1")], "input string, version string"), {"inputs": F.sum("value")}, {"value": F.col("own")})
    assert out.count() == 0
