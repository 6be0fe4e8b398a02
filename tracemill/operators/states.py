"""From tool calls to behaviour states: segments, sliding candidates, features, merged states and transitions.

Every step partitions by trace, so that one shuffle by trace serves the windows that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

MERGE_WEIGHTS = {"tool": 0.30, "file": 0.15, "edit": 0.15, "control": 0.25, "fail": 0.15}
ALIGN_WEIGHTS = {"tool": 0.35, "file": 0.20, "edit": 0.10, "control": 0.20, "fail": 0.15}
TOOL_COLS = [f"tool_{c}" for c in X.CATEGORIES]
FILE_COLS = [f"file_{c}" for c in X.CLUSTERS]
SCALARS = ["edit_density", "read_write_ratio", "loop_intensity", "failure_rate"]
FEATURES = [*TOOL_COLS, *FILE_COLS, *SCALARS]
# The tool that stands for a phase as a trigger.
TRIGGERS = {"locate": "read", "modify": "edit", "verify": "test", "commit": "commit"}


def by_trace() -> Window:
    return Window.partitionBy("trace_id").orderBy("idx")


def cuts(calls: DataFrame, idle_gap_ms: int = 10_000) -> DataFrame:
    """calls (trace_id, idx, ts, tool_name, path) with category and the reason for a cut before the call, or null."""
    w = by_trace()
    c = calls.withColumn("category", X.tool_category(F.col("tool_name")))
    prev = {n: F.lag(n).over(w) for n in ("category", "tool_name", "ts", "path")}
    c = c.withColumns({f"_p_{n}": v for n, v in prev.items()})
    gap = F.timestamp_diff("MILLISECOND", F.col("_p_ts"), F.col("ts"))
    here, before = X.file_scope(F.col("path")), X.file_scope(F.col("_p_path"))
    failed = F.col("_p_tool_name").rlike("test|check|lint")
    reason = X.case(
        (F.col("_p_category").isNull(), F.lit(None).cast("string")),
        ((F.col("_p_category") == "verify") & (F.col("category") == "modify") & failed, "failure_loop"),
        (F.col("_p_category") != F.col("category"), "tool_type_change"),
        ((gap < 0) | (gap > idle_gap_ms), "idle_gap"),
        ((here != "") & (before != "") & (here != before), "file_scope_jump"),
        otherwise=F.lit(None).cast("string"),
    )
    return c.withColumn("cut", reason).drop(*(f"_p_{n}" for n in prev))


def number_segments(cut_calls: DataFrame) -> DataFrame:
    w = by_trace()
    seg = F.sum(F.col("cut").isNotNull().cast("int")).over(w).cast("int")
    return cut_calls.withColumns({"segment_idx": seg, "next_cut": F.lead("cut").over(w)})


def segments(cut_calls: DataFrame) -> DataFrame:
    """trace_id, segment_idx, first_idx, last_idx, n_calls, category, boundary_reason (why it ended; 'start' for the last)."""
    g = number_segments(cut_calls).groupBy("trace_id", "segment_idx")
    return g.agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_calls"), F.min("category").alias("category"), F.coalesce(F.max_by("next_cut", "idx"), F.lit("start")).alias("boundary_reason"))


def candidates(segs: DataFrame, least: int = 3, most: int = 8, stride: int = 2) -> DataFrame:
    """Sliding windows within segments: trace_id, segment_idx, candidate_idx, first_idx, last_idx (inclusive)."""
    n = F.col("n_calls").cast("int")
    starts = F.when(n < least, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - least, F.lit(stride)))
    c = segs.select("trace_id", "segment_idx", "category", "first_idx", n.alias("n"), F.explode(starts).alias("start"))
    c = c.select("trace_id", "segment_idx", (F.col("first_idx") + F.col("start")).alias("first_idx"), (F.col("first_idx") + F.least(F.col("start") + most, F.col("n")) - 1).alias("last_idx"))
    order = Window.partitionBy("trace_id").orderBy("segment_idx", "first_idx")
    return c.withColumn("candidate_idx", F.row_number().over(order) - 1)


def features(cands: DataFrame, calls: DataFrame) -> DataFrame:
    """Candidates with FEATURES. Windows are short, so each is exploded to its calls and met by an equi-join."""
    n_all = calls.groupBy("trace_id").agg(F.count("*").alias("n_trace"))
    c = calls.select("trace_id", "idx", X.tool_category(F.col("tool_name")).alias("category"), F.col("tool_name").alias("_t"), X.file_cluster(F.col("path")).alias("cluster"))
    c = c.withColumn("same", F.lag("category").over(by_trace()) == F.col("category"))
    at = cands.select("*", F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    j = at.join(c, ["trace_id", "idx"])
    share = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("double")) / F.count("*")
    aggs = [share(F.col("category") == k).alias(f"tool_{k}") for k in X.CATEGORIES]
    aggs += [share(F.col("cluster") == k).alias(f"file_{k}") for k in X.CLUSTERS]
    loops = F.sum(F.coalesce((F.col("idx") > F.col("first_idx")) & F.col("same"), F.lit(False)).cast("double"))
    aggs += [share(X.is_edit(F.col("_t"))).alias("edit_density"), share(X.is_read(F.col("_t"))).alias("read_write_ratio")]
    aggs += [X.ratio(loops, F.count("*") - 1).alias("loop_intensity"), F.sum(X.is_check(F.col("_t")).cast("double")).alias("_checks")]
    g = j.groupBy("trace_id", "segment_idx", "candidate_idx", "first_idx", "last_idx").agg(F.count("*").alias("n_calls"), *aggs)
    return g.join(n_all, "trace_id").withColumn("failure_rate", X.ratio(F.col("_checks"), F.col("n_trace"))).drop("_checks", "n_trace")


def similarity(prefix_a: str, prefix_b: str, weights: dict[str, float]) -> Column:
    """Weighted likeness of two feature rows whose columns have the given prefixes."""
    a, b = (lambda n: F.col(prefix_a + n)), (lambda n: F.col(prefix_b + n))
    parts = {
        "tool": X.fuzzy_jaccard([a(n) for n in TOOL_COLS], [b(n) for n in TOOL_COLS]),
        "file": X.histogram_cosine([a(n) for n in FILE_COLS], [b(n) for n in FILE_COLS]),
        "edit": 1.0 - F.abs(a("edit_density") - b("edit_density")),
        "control": 1.0 - F.abs(a("read_write_ratio") - b("read_write_ratio")),
        "fail": 1.0 - F.abs(a("failure_rate") - b("failure_rate")),
    }
    return X.total([F.lit(w) * parts[k] for k, w in weights.items()])


def merge(feats: DataFrame, threshold: float = 0.85) -> DataFrame:
    """States: runs of candidates in which each resembles the one before; features are means over candidates."""
    w = Window.partitionBy("trace_id").orderBy("candidate_idx")
    f = feats.withColumns({f"p_{n}": F.lag(n).over(w) for n in FEATURES})
    apart = F.when(F.col("p_edit_density").isNull(), 0).when(similarity("p_", "", MERGE_WEIGHTS) >= threshold, 0).otherwise(1)
    f = f.withColumn("_apart", apart).withColumn("state_idx", F.sum("_apart").over(w).cast("int"))
    means = [F.avg(n).alias(n) for n in FEATURES]
    s = f.groupBy("trace_id", "state_idx").agg(F.count("*").alias("n_candidates"), F.min("first_idx").alias("first_idx"), F.max_by("last_idx", "candidate_idx").alias("last_idx"), *means)
    top = F.greatest(*(F.col(n) for n in TOOL_COLS))
    phase = X.case(*((F.col(f"tool_{c}") == top, c) for c in sorted(X.CATEGORIES)), otherwise="other")
    return s.withColumns({"primary_phase": phase, "stability": 1.0 - F.least(F.col("loop_intensity"), F.lit(1.0))})


def transitions(states: DataFrame) -> DataFrame:
    """trace_id, at, from_state, to_state, from_phase, to_phase, trigger_tool."""
    w = Window.partitionBy("trace_id").orderBy("state_idx")
    t = states.select("trace_id", F.col("state_idx").alias("at"), F.col("primary_phase").alias("from_phase"), F.lead("state_idx").over(w).alias("_to"), F.lead("primary_phase").over(w).alias("to_phase"), F.lead(F.struct(*TOOL_COLS)).over(w).alias("_f")).where("_to is not null")
    trigger = X.case(*((F.col(f"_f.tool_{p}") > 0, tool) for p, tool in TRIGGERS.items()), otherwise="unknown")
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    return t.select("trace_id", "at", name(F.col("at")).alias("from_state"), name(F.col("_to")).alias("to_state"), "from_phase", "to_phase", trigger.alias("trigger_tool"))


def edges(trans: DataFrame, frm: str = "from_phase", to: str = "to_phase") -> DataFrame:
    n = F.count("*")
    return trans.groupBy("trace_id", frm, to).agg(n.alias("n"), n.cast("double").alias("avg_cost"))


def state_graph(calls: DataFrame, idle_gap_ms: int = 10_000) -> DataFrame:
    """The whole chain to states."""
    return merge(features(candidates(segments(cuts(calls, idle_gap_ms))), calls))


def phase_runs(calls: DataFrame) -> DataFrame:
    """Maximal runs of calls of one phase: trace_id, run_idx, label, first_idx, last_idx, n_calls."""
    w = by_trace()
    c = calls.select("trace_id", "idx", X.tool_category(F.col("tool_name")).alias("label"))
    c = c.withColumn("new", F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(0))).withColumn("run_idx", F.sum("new").over(w).cast("int"))
    return c.groupBy("trace_id", "run_idx").agg(F.min("label").alias("label"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_calls"))


def phase_distribution(cands: DataFrame, calls: DataFrame) -> DataFrame:
    """Shares of the phases of a candidate's calls: trace_id, candidate_idx, phase, share; phases without a call have no row."""
    c = calls.select("trace_id", "idx", X.tool_category(F.col("tool_name")).alias("phase"))
    at = cands.select("trace_id", "candidate_idx", (F.col("last_idx") - F.col("first_idx") + 1).alias("n"), F.explode(F.sequence("first_idx", "last_idx")).alias("idx"))
    return at.join(c, ["trace_id", "idx"]).groupBy("trace_id", "candidate_idx", "phase").agg((F.count("*") / F.max("n")).alias("share"))
