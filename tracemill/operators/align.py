"""Differences between two traces: matched phase runs, aligned calls, summaries and scores."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.ship import ship
from .states import phase_runs

EDIT_LIMIT = 200  # calls; the reference matches longer runs greedily
DIFFS = "pair_id bigint, match_id int, position int, tool_name string, kind string, index_a bigint, index_b bigint"
DIFF_TYPES = {"pair_id": pa.int64(), "match_id": pa.int32(), "position": pa.int32(), "tool_name": pa.string(), "kind": pa.string(), "index_a": pa.int64(), "index_b": pa.int64()}


def match_segments(pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """pairs: pair_id, trace_a, trace_b. The n-th run of a label in A meets its n-th in B; match_id orders by place in B, then A."""
    runs = phase_runs(calls)
    nth = F.row_number().over(Window.partitionBy("trace_id", "label").orderBy("run_idx"))
    runs = runs.withColumn("nth", nth)
    side = lambda s: pairs.select("pair_id", F.col(f"trace_{s}").alias("trace_id")).join(runs, "trace_id").select("pair_id", "label", "nth", F.col("run_idx").alias(f"run_{s}"), F.col("first_idx").alias(f"first_{s}"), F.col("last_idx").alias(f"last_{s}"))
    m = side("a").join(side("b"), ["pair_id", "label", "nth"], "full")
    kind = X.case((F.col("run_a").isNull(), "added"), (F.col("run_b").isNull(), "deleted"), otherwise="matched")
    order = Window.partitionBy("pair_id").orderBy(F.coalesce("run_b", "run_a"), F.col("run_b").isNull(), "run_a", "label")
    return m.withColumns({"kind": kind, "match_id": F.row_number().over(order) - 1})


def cost_row(equal: int, up: int, down: int, whole: int) -> tuple[int, int, int]:
    """The next row of edit costs in bits, a bit a call of b: where costs rise and fall along it, and where the gap in a is the cheaper one or as cheap.

    equal: calls of b that equal this call of a; up, down: the row before; whole: a bit for each call of b."""
    diagonal = ((equal & up) + up ^ up) | equal | down
    more = ((down | whole & ~(diagonal | up)) << 1 | 1) & whole
    less = (diagonal & up) << 1 & whole
    return less | whole & ~(diagonal | more), diagonal & more, up | whole & ~(down | more) | less


def edit_align(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[str, str, int | None, int | None]]:
    """Aligned (tool, kind, place in a, place in b). Walking back from the end, equal calls pair first, then equal tools, then the cheaper gap.

    Costs are held as bits, and only each `step`-th row is kept; the rows between are made again on the way back. So runs of any length fit."""
    i, j, whole, step = len(a), len(b), (1 << len(b)) - 1, isqrt(2 * len(a)) + 1
    places: dict[tuple, int] = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    kept, up, down = [], whole, 0
    for k, x in enumerate(a):
        if k % step == 0:
            kept.append((up, down))
        up, down, _ = cost_row(places.get(x, 0), up, down, whole)
    out, first, added = [], i, []
    while i or j:
        if i and j and i <= first:
            first = (i - 1) // step * step
            (up, down), added = kept[first // step], []
            for x in a[first:i]:
                up, down, bits = cost_row(places.get(x, 0), up, down, whole)
                added.append(bits)
        if i and j and a[i - 1][0] == b[j - 1][0]:
            kind = "unchanged" if a[i - 1] == b[j - 1] else "args_changed"
            i, j = i - 1, j - 1
            out.append((b[j][0], kind, i, j))
        elif j and (not i or added[i - 1 - first] >> j - 1 & 1):
            j -= 1
            out.append((b[j][0], "added", None, j))
        else:
            i -= 1
            out.append((a[i][0], "deleted", i, None))
    return out[::-1]


def greedy_align(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> list[tuple[str, str, int | None, int | None]]:
    """Each call of b takes the first free equal call of a, else the first free one of the same tool."""
    free: dict[tuple, dict[int, None]] = {}
    for i, x in enumerate(a):
        free.setdefault(x, {})[i] = None
        free.setdefault(x[:1], {})[i] = None
    out, used = [], set()
    for j, x in enumerate(b):
        for key, kind in ((x, "unchanged"), (x[:1], "args_changed")):
            if free.get(key):
                i = next(iter(free[key]))
                del free[a[i]][i], free[a[i][:1]][i]
                used.add(i)
                out.append((x[0], kind, i, j))
                break
        else:
            out.append((x[0], "added", None, j))
    return out + [(x[0], "deleted", i, None) for i, x in enumerate(a) if i not in used]


def align_calls(matches: DataFrame, pairs: DataFrame, calls: DataFrame, limit: int | None = EDIT_LIMIT) -> DataFrame:
    """Tool differences of all matches: matched runs are aligned, a task holding one run of each side; others are listed.

    limit: runs of more calls are matched greedily, as the reference does; None aligns all runs by edit distance, which the queries ask for."""
    ship(calls.sparkSession)
    call = calls.select("trace_id", "idx", F.struct(F.col("tool_name").alias("tool"), X.canonical_call(F.col("tool_name"), F.col("args")).alias("call")).alias("c"))
    m = matches.join(pairs, "pair_id").select("pair_id", "match_id", "kind", *(c for s in "ab" for c in (f"trace_{s}", f"first_{s}", f"last_{s}")))
    sides = []
    for s in "ab":
        at = m.where(f"first_{s} is not null").select("pair_id", "match_id", "kind", F.col(f"trace_{s}").alias("trace_id"), F.explode(F.sequence(f"first_{s}", f"last_{s}")).alias("idx"))
        sides.append(at.join(call, ["trace_id", "idx"]).select("pair_id", "match_id", "kind", F.lit(s).alias("side"), "idx", "c.tool", "c.call"))
    rows = sides[0].unionByName(sides[1])

    # A row a matched run with the calls of both sides in order: Python gets many runs in a batch instead of a table each.
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("idx", "tool", "call")))).alias(s)
    runs = rows.where("kind = 'matched'").groupBy("pair_id", "match_id").agg(of("a"), of("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for pair, match, *sides in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                seq = [[(c["tool"], c["call"]) for c in x] for x in sides]
                align = edit_align if limit is None or max(map(len, seq)) <= limit else greedy_align
                for at, (tool, kind, i, j) in enumerate(align(*seq)):
                    out.append((pair, match, at, tool, kind, None if i is None else sides[0][i]["idx"], None if j is None else sides[1][j]["idx"]))
            columns = zip(*out, strict=True) if out else [()] * len(DIFF_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, DIFF_TYPES.values(), strict=True)], names=[*DIFF_TYPES])

    aligned = runs.select("pair_id", "match_id", "a", "b").mapInArrow(run, DIFFS)
    lone = rows.where("kind <> 'matched'")
    place = (F.row_number().over(Window.partitionBy("pair_id", "match_id").orderBy("idx")) - 1).alias("position")
    lone = lone.select("pair_id", "match_id", place, F.col("tool").alias("tool_name"), "kind", F.when(F.col("side") == "a", F.col("idx")).alias("index_a"), F.when(F.col("side") == "b", F.col("idx")).alias("index_b"))
    return aligned.unionByName(lone)


def segment_kinds(matches: DataFrame, diffs: DataFrame) -> DataFrame:
    """matches with 'unchanged' or 'modified' in place of 'matched'."""
    changed = diffs.groupBy("pair_id", "match_id").agg(F.max((F.col("kind") != "unchanged").cast("int")).alias("changed"))
    kind = F.when(F.col("kind") != "matched", F.col("kind")).when(F.col("changed") == 1, "modified").otherwise("unchanged")
    return matches.join(changed, ["pair_id", "match_id"], "left").withColumn("kind", kind).drop("changed")


def summary(segs: DataFrame, diffs: DataFrame, pairs: DataFrame, traces: DataFrame) -> DataFrame:
    """Counts by kind, and the changes in tokens and duration."""
    count = lambda k: F.sum((F.col("kind") == k).cast("bigint"))
    s = segs.groupBy("pair_id").agg(*(count(k).alias(f"segments_{k}") for k in ("unchanged", "modified", "added", "deleted")))
    d = diffs.groupBy("pair_id").agg(*(count(k).alias(f"calls_{n}") for k, n in (("unchanged", "unchanged"), ("args_changed", "modified"), ("added", "added"), ("deleted", "deleted"))))
    side = lambda x: traces.select(F.col("trace_id").alias(f"trace_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("tokens", "duration_ms", "n_calls")))
    j = pairs.join(side("a"), "trace_a").join(side("b"), "trace_b").join(s, "pair_id").join(d, "pair_id")
    return j.withColumns({"token_delta": F.col("tokens_b") - F.col("tokens_a"), "duration_delta_ms": F.col("duration_ms_b") - F.col("duration_ms_a")})


def analysis(summ: DataFrame) -> DataFrame:
    """Churn, shift and reorder scores."""
    calls = F.col("n_calls_a") + F.col("n_calls_b")
    phases = F.col("segments_unchanged") + F.col("segments_modified") + F.col("segments_added") + F.col("segments_deleted")
    return summ.select("pair_id", X.ratio(F.col("calls_added") + F.col("calls_deleted"), calls).alias("tool_churn"), X.ratio(F.col("calls_modified"), calls).alias("capability_shift"), X.ratio(F.col("segments_added") + F.col("segments_deleted"), phases).alias("phase_reorder"))


def phase_changes(segs: DataFrame, diffs: DataFrame) -> DataFrame:
    """Added, deleted and modified phases with their tools in order and counts before and after."""
    d = diffs.withColumnRenamed("kind", "tool_kind").join(segs.where("kind <> 'unchanged'").select("pair_id", "match_id", "label", "kind"), ["pair_id", "match_id"])
    names = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("tool_kind") == k, F.struct("position", "tool_name")))), lambda x: x["tool_name"])
    n = lambda k: F.sum((F.col("tool_kind") != k).cast("bigint"))
    return d.groupBy("pair_id", "match_id", "label", "kind").agg(n("added").alias("calls_before"), n("deleted").alias("calls_after"), names("added").alias("added_tools"), names("deleted").alias("deleted_tools"))


def positional_states(pairs: DataFrame, states: DataFrame) -> DataFrame:
    """States of both traces met by position."""
    side = lambda s: pairs.select("pair_id", F.col(f"trace_{s}").alias("trace_id")).join(states, "trace_id").select("pair_id", "state_idx", F.col("primary_phase").alias(f"phase_{s}"), F.col("stability").alias(f"stability_{s}"))
    j = side("a").join(side("b"), ["pair_id", "state_idx"], "full")
    kind = X.case((F.col("phase_a").isNull(), "added"), (F.col("phase_b").isNull(), "deleted"), (F.col("phase_a") != F.col("phase_b"), "modified"), otherwise="unchanged")
    return j.withColumn("kind", kind)
