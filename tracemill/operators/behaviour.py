"""Metrics of state graphs, the verdict, and the seven-number vector of a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .states import TOOL_COLS, phase_runs

VECTOR = ["tool_entropy", "phase_entropy", "transition_entropy", "loop_ratio", "backtrack_ratio", "burst_ratio", "stability"]


def share_entropy(df: DataFrame, key: list[str], item: list[str], name: str) -> DataFrame:
    """Entropy in bits of the distribution of `item` within `key`."""
    n = df.groupBy(*key, *item).agg(F.count("*").alias("_n"))
    p = n.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*key)))
    return p.groupBy(*key).agg(X.entropy_of(F.col("_p")).alias(name))


def state_metrics(states: DataFrame) -> DataFrame:
    w = Window.partitionBy("trace_id").orderBy("state_idx")
    own = X.total([F.when(F.col(c) > 0, -F.col(c) * F.log2(c)).otherwise(0.0) for c in TOOL_COLS])
    s = states.withColumns({"_h": own, "_same": (F.lag("primary_phase").over(w) == F.col("primary_phase")).cast("double")})
    return s.groupBy("trace_id").agg(F.avg("_h").alias("phase_entropy"), X.ratio(F.sum("_same"), F.count("*") - 1).alias("loop_ratio"), F.count("*").alias("state_count"))


def transition_metrics(visits: DataFrame, label: str = "primary_phase") -> DataFrame:
    """visits: trace_id, state_idx and a label per visit. Oscillations A-B-A, edge entropy, share of edges that go both ways."""
    w = Window.partitionBy("trace_id").orderBy("state_idx")
    v = visits.select("trace_id", "state_idx", F.col(label).alias("b"), F.lag(label).over(w).alias("a"), F.lag(label, 2).over(w).alias("z"))
    osc = F.sum(((F.col("z") == F.col("b")) & (F.col("a") != F.col("b"))).cast("bigint"))
    counts = v.groupBy("trace_id").agg(F.coalesce(osc, F.lit(0)).cast("bigint").alias("oscillations"), (F.count("*") - 1).alias("transitions"))
    e = v.where("a is not null").groupBy("trace_id", "a", "b").agg(F.count("*").alias("n"))
    e = e.withColumns({"p": F.col("n") / F.sum("n").over(Window.partitionBy("trace_id")), "u": F.least("a", "b"), "v": F.greatest("a", "b")})
    both = F.count("*").over(Window.partitionBy("trace_id", "u", "v"))
    e = e.withColumn("back", ((both == 2) | (F.col("a") == F.col("b"))).cast("double"))
    shape = e.groupBy("trace_id").agg(X.entropy_of(F.col("p")).alias("transition_entropy"), F.avg("back").alias("reversal_ratio"))
    return counts.join(shape, "trace_id", "left").fillna(0.0, ["transition_entropy", "reversal_ratio"])


def verdict(sm: DataFrame, tm: DataFrame) -> DataFrame:
    """Rules over state and transition metrics: hits, and Degraded, Watch or Pass."""
    j = sm.join(tm, "trace_id", "left")
    rules = [("SE001", "high", F.col("phase_entropy") > 1.5), ("SE002", "high", F.col("loop_ratio") > 0.5), ("TE001", "medium", F.col("oscillations") > 3), ("TE002", "high", F.col("reversal_ratio") > 0.6), ("GE001", "high", F.col("state_count") < 1)]
    hits = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(f"{i}:{s}")) for i, s, c in rules)), lambda x: x.isNotNull())
    j = j.withColumn("hits", hits)
    v = X.case((F.exists("hits", lambda x: x.endswith(":high")), "Degraded"), (F.size("hits") >= 2, "Watch"), otherwise="Pass")
    return j.withColumn("verdict", v).withColumn("hits", F.array_join("hits", ","))


def tool_entropy(calls: DataFrame) -> DataFrame:
    return share_entropy(calls.withColumn("category", X.tool_category(F.col("tool_name"))), ["trace_id"], ["category"], "tool_entropy")


def burst_ratio(calls: DataFrame) -> DataFrame:
    runs = phase_runs(calls).groupBy("trace_id").agg(F.max("n_calls").alias("longest"), F.sum("n_calls").alias("n_calls"))
    return runs.select("trace_id", "longest", "n_calls", F.when(F.col("longest") >= 3, X.ratio(F.col("longest") - 2, F.col("n_calls"))).otherwise(0.0).alias("burst_ratio"))


def backtrack_ratio(visits: DataFrame, label: str = "primary_phase", back: int = 3) -> DataFrame:
    """Share of changes of label that return to one of the last `back` visits (runs of a label count as one visit)."""
    w = Window.partitionBy("trace_id").orderBy("state_idx")
    seq = visits.select("trace_id", "state_idx", F.col(label).alias("x"), F.lag(label).over(w).alias("_p")).where("_p is null or _p <> x")
    hit = F.lit(False)
    for k in range(1, back + 1):
        hit = hit | F.coalesce(F.lag("x", k).over(w) == F.col("x"), F.lit(False))
    return seq.withColumn("hit", hit.cast("double")).groupBy("trace_id").agg(X.ratio(F.sum("hit"), F.count("*") - 1).alias("backtrack_ratio"))


def stability(states: DataFrame) -> DataFrame:
    """Mean cosine of neighbouring states; 1 for a single state."""
    cols = [*TOOL_COLS, "edit_density", "read_write_ratio"]
    w = Window.partitionBy("trace_id").orderBy("state_idx")
    s = states.select("trace_id", *cols, *(F.lag(c).over(w).alias(f"p_{c}") for c in cols))
    cos = F.when(F.col(f"p_{cols[0]}").isNotNull(), X.cosine([F.col(f"p_{c}") for c in cols], [F.col(c) for c in cols]))
    return s.groupBy("trace_id").agg(F.coalesce(F.avg(cos), F.lit(1.0)).alias("stability"))


def series(states: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: trace_id, total (calls), n_windows. (trace_id, window, n_states, edit_density, tool_*): means over the states whose middle lies in the
    window's share of the trace, 0 without any. The shares are proportional ranges next to each other, so a middle lies in one window only,
    and its number follows from it: windows meet states by equality."""
    mid = F.floor((F.col("first_idx") + F.col("last_idx") + 1) / 2)
    window = F.expr("((mid + 1) * n_windows - 1) div greatest(total, 1)").cast("int")
    s = states.select("trace_id", "edit_density", *TOOL_COLS, mid.alias("mid")).join(sizes, "trace_id").withColumn("window", window)
    means = s.groupBy("trace_id", "window").agg(F.count("*").alias("n_states"), *(F.avg(c).alias(c) for c in ("edit_density", *TOOL_COLS)))
    grid = sizes.where("n_windows > 0").select("trace_id", F.explode(F.sequence(F.lit(0), F.col("n_windows").cast("int") - 1)).alias("window"))
    return grid.join(means, ["trace_id", "window"], "left").fillna(0, ["n_states"]).fillna(0.0, ["edit_density", *TOOL_COLS])


def edit_curve(states: DataFrame, calls: DataFrame, windows: int = 10) -> DataFrame:
    """Mean edit density of states by share of the trace: trace_id, window, n_states, edit_density."""
    sizes = calls.groupBy("trace_id").agg(F.count("*").alias("total")).withColumn("n_windows", F.lit(windows).cast("bigint"))
    return series(states, sizes).select("trace_id", "window", "n_states", "edit_density")


def time_series(states: DataFrame, trans: DataFrame, calls: DataFrame, width: int = 100) -> DataFrame:
    """trans: trace_id, at (the ordinal of a transition). A row a window of `width` ordinals: series() with n_transitions. A trace without
    transitions spans a hundred ordinals for each state; one with a single transition, or a width of 0, has windows as wide as it has states."""
    n = calls.groupBy("trace_id").agg(F.count("*").alias("total")).join(states.groupBy("trace_id").agg(F.count("*").alias("k")), "trace_id")
    t = trans.groupBy("trace_id").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    j = n.join(t, "trace_id", "left").withColumns({"least": F.coalesce("least", F.lit(0)).cast("bigint"), "most": F.coalesce("most", F.col("k") * 100).cast("bigint")})
    span = F.col("most") - F.col("least")
    wide = F.when((span == 0) | F.lit(width == 0), F.col("k")).otherwise(F.lit(width)).cast("bigint")
    sizes = j.withColumns({"width": wide, "n_windows": F.when(span == 0, F.col("k")).otherwise(F.expr("(most - least)") / wide + 1).cast("bigint")})
    moved = trans.join(sizes.select("trace_id", "least", "width"), "trace_id").select("trace_id", F.expr("(at - least) div width").cast("int").alias("window"))
    counts = moved.groupBy("trace_id", "window").agg(F.count("*").alias("n_transitions"))
    return series(states, sizes.select("trace_id", "total", "n_windows")).join(counts, ["trace_id", "window"], "left").fillna(0, ["n_transitions"])


def trace_features(states: DataFrame, calls: DataFrame) -> DataFrame:
    """By trace: means of the states' shares of tools, shares of phases, calls a state, and both counts."""
    n = calls.groupBy("trace_id").agg(F.count("*").alias("total_tools"))
    phases = [F.avg((F.col("primary_phase") == c).cast("double")).alias(f"phase_{c}") for c in X.CATEGORIES]
    s = states.groupBy("trace_id").agg(F.count("*").alias("state_count"), *(F.avg(c).alias(c) for c in TOOL_COLS), *phases)
    return n.join(s, "trace_id").withColumn("avg_tools_per_state", X.ratio(F.col("total_tools"), F.col("state_count")))


def distributions(features: DataFrame) -> DataFrame:
    """trace_features as vectors in the order of categories: trace_id, tools, phases."""
    return features.select("trace_id", F.array(*TOOL_COLS).alias("tools"), F.array(*(f"phase_{c}" for c in X.CATEGORIES)).alias("phases"))


def curve_stats(curve: DataFrame) -> DataFrame:
    """Mean, least and most of the curve and of its first differences."""
    w = Window.partitionBy("trace_id").orderBy("window")
    c = curve.withColumn("d", F.col("edit_density") - F.lag("edit_density").over(w))
    stats = lambda x, p: [f(x).alias(f"{p}_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return c.groupBy("trace_id").agg(*stats("edit_density", "edit"), *stats("d", "slope")).fillna(0.0)


def vectors(calls: DataFrame, states: DataFrame) -> DataFrame:
    """VECTOR per trace: entropies and ratios, scaled by median and interquartile range across the row."""
    n = calls.groupBy("trace_id").agg(F.count("*").alias("n_calls"))
    s = states.groupBy("trace_id").agg(F.count("*").alias("n_states"))
    tm = transition_metrics(states.withColumn("_id", F.col("state_idx").cast("string")), "_id").select("trace_id", "transition_entropy")
    j = n.join(s, "trace_id").join(tool_entropy(calls), "trace_id").join(tm, "trace_id").join(burst_ratio(calls).select("trace_id", "burst_ratio"), "trace_id")
    j = j.join(backtrack_ratio(states.withColumn("_id", F.col("state_idx").cast("string")), "_id"), "trace_id").join(stability(states), "trace_id")
    square = F.pow(F.greatest(F.col("n_states"), F.lit(2)).cast("double"), F.lit(2.0))
    bounded = X.bounded_entropy(F.col("transition_entropy"), square)
    raw = [X.bounded_entropy(F.col("tool_entropy"), F.greatest(F.col("n_calls"), F.lit(1))), bounded, bounded, F.lit(0.0), X.clamp(F.col("backtrack_ratio"), 0.0, 1.0), X.log_compress(F.col("burst_ratio")), F.greatest(F.col("n_states"), F.lit(1)).cast("double")]
    scaled = X.robust_scale(raw)
    return j.select("trace_id", *(c.alias(v) for c, v in zip(scaled[:-1], VECTOR, strict=False)), F.col("stability"))




def graph_metrics(states: DataFrame, edges: DataFrame) -> DataFrame:
    """By trace: path_length (states), state_count, and structural_entropy, the entropy of transitions over kinds of edges (0 without)."""
    total = Window.partitionBy("trace_id")
    p = F.col("n") / F.sum("n").over(total)
    h = edges.withColumn("_h", -p * F.log2(p)).groupBy("trace_id").agg(F.sum("_h").alias("structural_entropy"))
    n = states.groupBy("trace_id").agg(F.count("*").alias("path_length")).withColumn("state_count", F.col("path_length"))
    return n.join(h, "trace_id", "left").fillna(0.0, ["structural_entropy"])
