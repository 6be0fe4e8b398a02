"""Queries over the driver's tables, one per operator family member, with whole tables as input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import modules as M
from ..operators import align, behaviour, code, coupling, dashboard, diffs, graph, history, redact, rules, similarity, states, validate
from ..sources import generated, store, views
from ..sources.scratch import stash
from ..streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DAY = views.DAY_MS


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def cut_calls(spark, sf_dir, gap=DAY):
    return states.cuts(views.tool_calls(spark, sf_dir), gap)


def graph_of(spark, sf_dir):
    """Calls and states, written once: what follows reads them several times."""
    calls = stash(views.tool_calls(spark, sf_dir), "calls")
    return calls, stash(states.state_graph(calls, DAY), "states")


def vectors_of(spark, sf_dir):
    return stash(behaviour.vectors(*graph_of(spark, sf_dir)), "vectors")


def trace_pairs(spark, sf_dir):
    """Neighbouring traces 2n-1 and 2n."""
    t = views.tool_calls(spark, sf_dir).select("trace_id").distinct()
    odd = t.where("trace_id % 2 = 1").select(F.col("trace_id").alias("pair_id"), F.col("trace_id").alias("trace_a"), (F.col("trace_id") + 1).alias("trace_b"))
    return odd.join(t.withColumnRenamed("trace_id", "trace_b"), "trace_b", "left_semi").select("pair_id", "trace_a", "trace_b")


@query
def state_segments(spark, sf_dir):
    return states.segments(cut_calls(spark, sf_dir))


@query
def idle_gap_default(spark, sf_dir):
    return states.segments(cut_calls(spark, sf_dir, 10_000)).groupBy("boundary_reason").agg(F.count("*").alias("n"), F.max("n_calls").alias("longest"))


@query
def segment_reasons(spark, sf_dir):
    return states.segments(cut_calls(spark, sf_dir)).groupBy("boundary_reason", "category").agg(F.count("*").alias("n"))


@query
def state_candidates(spark, sf_dir):
    return states.candidates(states.segments(cut_calls(spark, sf_dir)))


@query
def state_features(spark, sf_dir):
    calls = views.tool_calls(spark, sf_dir)
    return rounded(states.features(states.candidates(states.segments(states.cuts(calls, DAY))), calls).drop("segment_idx"))


@query
def behavior_states(spark, sf_dir):
    cols = ["trace_id", "state_idx", "first_idx", "last_idx", "n_candidates", "primary_phase", "stability", "edit_density", "read_write_ratio", "failure_rate"]
    return rounded(graph_of(spark, sf_dir)[1].select(cols))


@query
def transitions(spark, sf_dir):
    return states.transitions(graph_of(spark, sf_dir)[1])


@query
def transition_edges(spark, sf_dir):
    return states.edges(states.transitions(graph_of(spark, sf_dir)[1]))


@query
def behavior_verdict(spark, sf_dir):
    s = graph_of(spark, sf_dir)[1]
    return rounded(behaviour.verdict(behaviour.state_metrics(s), behaviour.transition_metrics(s)))


@query
def tool_entropy(spark, sf_dir):
    return rounded(behaviour.tool_entropy(views.tool_calls(spark, sf_dir)))


@query
def burst_ratio(spark, sf_dir):
    return rounded(behaviour.burst_ratio(views.tool_calls(spark, sf_dir)))


@query
def backtrack_ratio(spark, sf_dir):
    return rounded(behaviour.backtrack_ratio(graph_of(spark, sf_dir)[1]))


@query
def edit_curve(spark, sf_dir):
    calls, s = graph_of(spark, sf_dir)
    return rounded(behaviour.edit_curve(s, calls))


@query
def edit_curve_stats(spark, sf_dir):
    calls, s = graph_of(spark, sf_dir)
    return rounded(behaviour.curve_stats(behaviour.edit_curve(s, calls)))


@query
def phase_loop_ratio(spark, sf_dir):
    return rounded(graph.loop_ratio(stash(states.transitions(graph_of(spark, sf_dir)[1]), "transitions")))


@query
def trajectory_vector(spark, sf_dir):
    return rounded(vectors_of(spark, sf_dir))


@query
def vector_similarity(spark, sf_dir):
    p = similarity.contributions(similarity.alike_pairs(stash(similarity.alike(vectors_of(spark, sf_dir)), "alike")))
    shares = ("similarity", "entropy", "structural", "temporal", "density")
    return similarity.each_pair(p.withColumns({c: X.quick_round(F.col(c), 5) + F.lit(0.0) for c in shares}), *shares)


@query
def anomaly_rank(spark, sf_dir):
    return rounded(similarity.anomaly_rank(vectors_of(spark, sf_dir)))


@query
def feature_correlation(spark, sf_dir):
    return rounded(similarity.feature_correlation(vectors_of(spark, sf_dir)), 5)


def capability_means(spark, sf_dir):
    v = vectors_of(spark, sf_dir).withColumn("capability", views.capability_of(F.col("trace_id")))
    return similarity.group_means(v, "capability")


@query
def capability_vectors(spark, sf_dir):
    return rounded(capability_means(spark, sf_dir))


@query
def cochange_scores(spark, sf_dir):
    return rounded(coupling.cochange(stash(views.commit_links(spark, sf_dir).distinct(), "links")))


def coupling_of(spark, sf_dir):
    """Brands stand for capabilities; their vectors are means over line items, scaled as trace vectors are."""
    li, p = (views.table(spark, sf_dir, t) for t in ("lineitem", "part"))
    j = li.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    raw = [F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50.0, (F.col("l_returnflag") == "R").cast("double"), (F.col("l_linestatus") == "F").cast("double"), F.col("l_linenumber") / 7.0, F.lit(1.0)]
    vec = j.groupBy(F.col("p_brand").alias("capability")).agg(*(F.avg(c).alias(n) for c, n in zip(raw, behaviour.VECTOR, strict=True)))
    return coupling.edges(vec, coupling.cochange(stash(views.commit_links(spark, sf_dir).distinct(), "links")))


@query
def coupling_edges(spark, sf_dir):
    return rounded(coupling_of(spark, sf_dir))


@query
def coupling_pruned(spark, sf_dir):
    return rounded(coupling.prune(coupling_of(spark, sf_dir), k=5).select("cap_a", "cap_b", "correlation"))


@query
def coupling_strength(spark, sf_dir):
    return rounded(coupling.strength(coupling_of(spark, sf_dir)))


@query
def coupling_impact(spark, sf_dir):
    return rounded(coupling.impact(coupling_of(spark, sf_dir), "Brand#11"))


@query
def top_couplings(spark, sf_dir):
    return rounded(coupling.strongest(coupling_of(spark, sf_dir)).select("cap_a", "cap_b", "correlation"))


@query
def trace_summary(spark, sf_dir):
    t = views.traces(views.tool_calls(spark, sf_dir))
    return t.select("trace_id", "n_calls", "tokens", "duration_ms", "started_at", "finished_at", F.array_join("tools", ",").alias("tools"), X.elapsed_ms(F.col("started_at"), F.col("finished_at")).alias("elapsed_ms"))


@query
def trace_list(spark, sf_dir):
    t = views.traces(views.tool_calls(spark, sf_dir))
    return store.listing(t, limit=100, offset=3, where=store.TraceFilter(tool="cargo", date_from="2020-01-01")).select("trace_id", "started_at", "n_calls", "tokens")


@query
def trace_latest(spark, sf_dir):
    """Orders as versions of a customer's record."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("version"), "o_totalprice", (F.col("o_orderstatus") == "P").alias("deleted"))
    return store.live(o, ["id"], ["at", "version"]).select("id", "version", "o_totalprice")


@query
def trace_ids(spark, sf_dir):
    t = views.traces(views.tool_calls(spark, sf_dir))
    return store.allocate_ids(t, ["started_at", "trace_id"]).select("trace_id", "id")


@query
def phase_runs(spark, sf_dir):
    return states.phase_runs(views.tool_calls(spark, sf_dir))


@query
def segment_match(spark, sf_dir):
    return align.match_segments(trace_pairs(spark, sf_dir), views.tool_calls(spark, sf_dir)).select("pair_id", "match_id", "label", "kind", "run_a", "run_b")


def aligned(spark, sf_dir):
    calls, p = stash(views.tool_calls(spark, sf_dir), "calls"), trace_pairs(spark, sf_dir)
    m = stash(align.match_segments(p, calls), "matches")
    d = stash(align.align_calls(m, p, calls, limit=None), "diffs")
    return calls, p, align.segment_kinds(m, d), d


@query
def tool_align(spark, sf_dir):
    return aligned(spark, sf_dir)[3]


@query
def diff_summary(spark, sf_dir):
    calls, p, segs, d = aligned(spark, sf_dir)
    return align.summary(segs, d, p, views.traces(calls))


@query
def trajectory_analysis(spark, sf_dir):
    calls, p, segs, d = aligned(spark, sf_dir)
    return rounded(align.analysis(align.summary(segs, d, p, views.traces(calls))))


@query
def phase_changes(spark, sf_dir):
    _, _, segs, d = aligned(spark, sf_dir)
    c = align.phase_changes(segs, d)
    return c.withColumns({n: F.array_join(n, ",") for n in ("added_tools", "deleted_tools")})


@query
def positional_state_diff(spark, sf_dir):
    calls, s = graph_of(spark, sf_dir)
    return rounded(align.positional_states(trace_pairs(spark, sf_dir), s))


@query
def outcome_rollup(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    return history.rollup(li.select(F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") != "R").alias("passed")))


@query
def eval_trend(spark, sf_dir):
    return history.trends(views.trials(spark, sf_dir)).select("task_id", "trial", "eval_id", "outcome", "prev_outcome", "trend")


@query
def eval_compare(spark, sf_dir):
    return rounded(history.compare(views.trials(spark, sf_dir)))


@query
def eval_regression(spark, sf_dir):
    return history.regressions(views.trials(spark, sf_dir))


@query
def trend_history(spark, sf_dir):
    tasks = views.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("description"))
    return history.described(views.trials(spark, sf_dir), tasks).select("task_id", "trial", "outcome", "description")


@query
def trend_anomaly_2sigma(spark, sf_dir):
    a = history.anomalies(views.trials(spark, sf_dir))
    return rounded(a.select("task_id", "trial", "n_before", "mean_before", F.round("sd_before", 3).alias("sd_before")))


@query
def diff_lines(spark, sf_dir):
    return diffs.lines(generated.diffs(spark, sf_dir), numbered=True).select("diff_id", "file", "change", "language", "hunk_idx", "line_idx", "line_kind", "content", "line_no")


@query
def diff_summary_lang(spark, sf_dir):
    return diffs.summary_by_language(diffs.lines(generated.diffs(spark, sf_dir)))


@query
def raw_changes(spark, sf_dir):
    return diffs.raw_changes(diffs.lines(generated.diffs(spark, sf_dir)))


@query
def rule_matches(spark, sf_dir):
    return rules.matches(diffs.raw_changes(diffs.lines(generated.diffs(spark, sf_dir)))).select("diff_id", "change_id", "symbol", "rule_id", "category", "severity")


@query
def document_rules(spark, sf_dir):
    """The content rules over all documents, with a remark at the end of some."""
    remark = X.case((F.col("doc_id") % 5 == 0, " -- TODO"), (F.col("doc_id") % 5 == 1, " in Sql"), (F.col("doc_id") % 5 == 2, " deprecated, fixme"), otherwise="")
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", remark).alias("content"), F.col("source").alias("file"), F.col("source").alias("symbol"), F.lit("unknown").alias("change_type"))
    return rules.matches(d).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query
def capability_status(spark, sf_dir):
    c = diffs.raw_changes(diffs.lines(generated.diffs(spark, sf_dir)))
    return rules.capabilities(c).withColumn("categories", F.array_join("categories", ","))


@query
def import_edges(spark, sf_dir):
    return code.dependencies(generated.sources(spark, sf_dir))


@query
def file_tree(spark, sf_dir):
    return diffs.file_tree(diffs.lines(generated.diffs(spark, sf_dir)).select(F.col("file").alias("path")).distinct())


@query
def behaviour_boundaries(spark, sf_dir):
    return diffs.behaviour_boundaries(generated.diffs(spark, sf_dir))


@query
def file_modules(spark, sf_dir):
    """Every rule for modules, on paths of many shapes."""
    c = F.col("path")
    lang = X.language(c)
    rules = {"short": M.module_short(c), "full": M.module_from_path(c), "group": M.module_group(c), "cluster_module": M.cluster_module(c), "symbol_module": M.symbol_module(c, lang), "scope": X.file_scope(c), "cluster": X.file_cluster(c), "language": lang, "entry": graph.is_entry_point(c)}
    p = generated.view(spark, sf_dir, generated.PATHS).groupBy("path").agg(F.count("*").alias("n"))
    return p.select("path", "n", *(x.alias(name) for name, x in rules.items()))


@query
def symbol_links(spark, sf_dir):
    """Suppliers that share a part, as symbols that share a file, and how many parts they share."""
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("symbol"))
    return dashboard.linked_symbols(li)


@query
def fan_in_out(spark, sf_dir):
    """Customers and the suppliers of their orders, who call each other."""
    li, o = (views.table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit(0).alias("graph"), F.concat(F.lit("c"), "o_custkey").alias("node"), F.concat(F.lit("s"), "l_suppkey").alias("dep"))
    back = e.select("graph", F.col("dep").alias("node"), F.col("node").alias("dep"))
    return graph.fan_in_out(e.unionByName(back)).drop("graph")


@query
def dag_layers(spark, sf_dir):
    nodes, edges = generated.dags(spark, sf_dir)
    return graph.layers(nodes, edges)


@query
def graph_cycles(spark, sf_dir):
    return graph.cycles(generated.dags(spark, sf_dir)[1])


@query
def blocked_nodes(spark, sf_dir):
    nodes, edges = generated.dags(spark, sf_dir)
    return graph.blocked(edges, nodes.withColumn("ok", F.col("node") != "n2"))


@query
def missing_dependencies(spark, sf_dir):
    nodes, edges = generated.dags(spark, sf_dir)
    return graph.missing_dependencies(nodes.select("node").distinct(), edges.select("node", "dep"))


@query
def flow_trace(spark, sf_dir):
    _, edges = generated.dags(spark, sf_dir)
    return graph.flows(edges.withColumn("seq", F.col("dep")), edges.select("graph", F.col("node").alias("entry")).distinct())


def cohorts(spark, sf_dir):
    """Vectors in cohorts of forty neighbouring traces, a clustering run each: as many runs as the traces need."""
    return vectors_of(spark, sf_dir).withColumn("cohort", F.expr("trace_id div 40"))


@query
def dbscan_labels(spark, sf_dir):
    return similarity.clusters(cohorts(spark, sf_dir), "cohort", eps=0.001)


@query
def similarity_groups(spark, sf_dir):
    return similarity.similarity_groups(cohorts(spark, sf_dir), "cohort", threshold=0.97)


@query
def cluster_quality(spark, sf_dir):
    v = vectors_of(spark, sf_dir)
    return rounded(similarity.cluster_quality(v, v.select("trace_id", (F.col("trace_id") % 3 + 1).alias("label"))))


@query
def exact_match(spark, sf_dir):
    return validate.exact(*generated.cases(spark, sf_dir))


@query
def semantic_match(spark, sf_dir):
    e, a = generated.cases(spark, sf_dir)
    return rounded(validate.verdicts(validate.exact(e, a), validate.semantic(e, a)).select("case_id", "similarity", "verdict"))


@query
def best_matches(spark, sf_dir):
    return rounded(validate.best_matches(*generated.cases(spark, sf_dir)))


@query
def validation_suite(spark, sf_dir):
    e, a = generated.cases(spark, sf_dir)
    return rounded(validate.suite(validate.verdicts(validate.exact(e, a), validate.semantic(e, a))))


@query
def redact_text(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    text = F.concat(F.col("text"), F.lit(" token="), F.col("doc_id").cast("string"), F.lit("; Authorization: Bearer abc, x"))
    return d.select("doc_id", F.md5(redact.redact(text).cast("binary")).alias("digest"), (redact.redact(F.col("text")) != F.col("text")).alias("changed"))


@query
def sparse_roundtrip(spark, sf_dir):
    """Embeddings as (indexes, values) of components over 0.1 in size, and back."""
    v = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(x) > 0.1, x.cast("double")).otherwise(0.0)).alias("d"))
    idx = F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.abs(F.get("d", i)) > 1e-8)
    s = v.select("vec_id", "d", idx.alias("i")).withColumn("x", F.transform("i", lambda i: F.get("d", i)))
    back = F.transform(F.sequence(F.lit(0), F.size("d") - 1), lambda k: F.coalesce(F.get("x", F.array_position("i", k).cast("int") - 1), F.lit(0.0)))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return rounded(s.select("vec_id", F.size("i").cast("bigint").alias("n_set"), total.alias("total"), (back == F.col("d")).alias("same")), 4)


@query
def embedding_similarity(spark, sf_dir):
    """Cosine and Jaccard of each vector with the next one."""
    v = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    j = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    mag = lambda c: F.transform(c, F.abs)
    return rounded(j.select("vec_id", X.array_cosine(F.col("v"), F.col("w")).alias("cosine"), X.dense_jaccard(mag("v"), mag("w")).alias("jaccard")), 5)


@query
def message_categories(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.groupBy("role", X.task_category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@query
def idle_sessions(spark, sf_dir):
    calls = views.tool_calls(spark, sf_dir).select("trace_id", "ts")
    return sessions.idle_sessions(calls, "6 hours").select("trace_id", "started_at", "n_calls")
