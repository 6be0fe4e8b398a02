"""Queries on code, versions, stored records and logs, over inputs generated from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import behaviour, code, export, graph, history, registry, states
from ..sources import generated, logs, store, views
from .queries import QUERIES, graph_of, query, rounded

__all__ = ["QUERIES"]


@query
def import_lines(spark, sf_dir):
    """Every importing line of the generated sources."""
    return code.imports(generated.sources(spark, sf_dir)).groupBy("import").agg(F.count("*").alias("n"))


@query
def flow_phases(spark, sf_dir):
    """Phase and trigger of nodes named after clerks and priorities, with words of the phases in some names."""
    words = F.array(*map(F.lit, ("readAll", "ParseIt", "validate", "double_check", "saveRow", "to_DB", "Display", "render_main", "cli", "order_handler", "worker_x", "compute")))
    o = views.table(spark, sf_dir, "orders").select(F.concat(F.element_at(words, (F.col("o_orderkey") % 12 + 1).cast("int")), F.col("o_custkey").cast("string")).alias("node"))
    return o.groupBy("node").agg(F.count("*").alias("n")).select("node", "n", graph.node_phase(F.col("node")).alias("phase"), graph.trigger(F.col("node")).alias("trigger"))


def evaluations(spark, sf_dir):
    """An evaluation an order, for its customer: figures of its line items; some lack the tool pattern, some the vector."""
    o, li = (views.table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    n = lambda c: F.count_if(c).cast("double")
    g = li.groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("l_suppkey").cast("bigint")).cast("double").alias("tokens"), F.sum(F.col("l_partkey").cast("bigint")).cast("double").alias("ms"),
        n(F.col("l_returnflag") == "R").alias("r"), n(F.col("l_linestatus") == "F").alias("f"), n(F.col("l_suppkey") % 2 == 0).alias("even"), n(F.col("l_partkey") % 3 == 0).alias("third"), n(F.col("l_returnflag") == "A").alias("a"),
    )
    j = o.join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    has, full = F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "5-LOW"
    tools = [F.when(has, F.col(c)).alias(name) for c, name in (("n", "n_toolcalls"), ("tokens", "n_tokens"), ("ms", "duration_ms"))]
    vector = [F.when(has & full, F.col(c) / F.col("n")).alias(name) for c, name in (("r", "tool_entropy"), ("f", "phase_entropy"), ("even", "loop_ratio"), ("third", "backtrack_ratio"), ("a", "state_stability_score"))]
    return j.select(F.col("o_custkey").alias("task_id"), F.struct("o_orderdate", "o_orderkey").alias("trial"), F.col("o_orderkey").alias("eval_id"), *tools, *vector, F.col("f").alias("additions"), F.col("r").alias("deletions"))


@query
def eval_metrics(spark, sf_dir):
    """All ten metrics of each task's last evaluation against the one before."""
    return rounded(history.compare_metrics(evaluations(spark, sf_dir)), 4)


@query
def graph_metrics(spark, sf_dir):
    s = graph_of(spark, sf_dir)[1]
    return rounded(behaviour.graph_metrics(s, states.edges(states.transitions(s))))


@query
def phase_distribution(spark, sf_dir):
    calls = views.tool_calls(spark, sf_dir)
    return rounded(states.phase_distribution(states.candidates(states.segments(states.cuts(calls, views.DAY_MS))), calls))


def symbols_of(spark, sf_dir):
    """Line items as symbols in the files of their orders; returned ones were removed."""
    o = generated.view(spark, sf_dir, generated.PATHS)
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("n"), F.col("l_partkey").alias("symbol"), (F.col("l_returnflag") != "R").alias("added"))
    return li.join(o, "n").select("project", "symbol", F.col("path").alias("file"), "added")


def clusters_of(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    changed = generated.view(spark, sf_dir, generated.PATHS).where("n % 3 = 0").select("project", F.col("path").alias("file"))
    tasks = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("project"), F.concat(F.lit("m"), (F.col("o_orderkey") % 7).cast("string")).alias("module")).agg(F.count("*").alias("n_tasks"))
    return code.clusters(changed, symbols_of(spark, sf_dir), tasks)


@query
def module_clusters(spark, sf_dir):
    return clusters_of(spark, sf_dir)


def shared_files(spark, sf_dir):
    """Suppliers as modules that hold symbols in the file of a part."""
    li = views.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("project"), F.concat(F.lit("m"), "l_suppkey").alias("module"), F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("file"))


@query
def cluster_links(spark, sf_dir):
    return code.cluster_links(shared_files(spark, sf_dir))


@query
def cluster_summary(spark, sf_dir):
    """Clusters by project, with the links of those projects that have some."""
    return rounded(code.cluster_summary(clusters_of(spark, sf_dir), code.cluster_links(shared_files(spark, sf_dir))))


@query
def module_changes(spark, sf_dir):
    """A history with a date, an empty line and the files of each order."""
    p = generated.view(spark, sf_dir, generated.PATHS)
    return code.module_changes(p.select(F.explode(F.array(F.lit("2024-05-06 07:08:09 +0000"), F.lit(" "), F.concat(F.lit(" "), "path"))).alias("line")))


@query
def module_discovery(spark, sf_dir):
    api = F.when(F.col("n") % 9 == 0, F.element_at(F.array(*map(F.lit, ("api/", "models/", "db/", "config/", "utils/"))), (F.col("n") % 5 + 1).cast("int"))).otherwise("")
    return code.discovered(generated.view(spark, sf_dir, generated.PATHS).select(F.concat(api, "path").alias("path")))


def flows_of(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "odd"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    entry = F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("e"), F.col("o_custkey").cast("string")))
    return o.select(level.alias("risk_level"), entry.alias("entry_point"))


@query
def flow_risks(spark, sf_dir):
    return code.flow_risks(flows_of(spark, sf_dir))


@query
def top_entries(spark, sf_dir):
    return code.most_common(flows_of(spark, sf_dir), "entry_point")


@query
def review_stats(spark, sf_dir):
    """Orders as reviews of their customers."""
    o = views.table(spark, sf_dir, "orders")
    verdict = F.element_at(F.array(*map(F.lit, ("Approved", "Rejected", "Corrected", "Flagged"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return code.review_stats(o.select(F.col("o_custkey").alias("capability"), verdict.alias("verdict")))


@query
def test_map_stats(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    status = X.case((F.col("l_returnflag") == "A", "Passing"), (F.col("l_returnflag") == "R", "Failing"), (F.col("l_linestatus") == "O", "Missing"), otherwise="Flaky")
    return code.mapping_stats(li.select(F.col("l_partkey").alias("capability"), status.alias("test_status")))


def runs_of(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(*map(F.lit, ("Ok", "Skipped", "Failed", "TimedOut", "Ok"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("suite"), F.col("l_linenumber").cast("int").alias("run"), status.alias("status"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("e"), "l_suppkey")).alias("detail"))


@query
def degradation(spark, sf_dir):
    return rounded(code.degradation(runs_of(spark, sf_dir)))


@query
def degradation_reasons(spark, sf_dir):
    return code.degradation_reasons(runs_of(spark, sf_dir))


REGISTRY = registry.Registry().with_tool("deploy").upgraded(registry.Remap(1, 2, {0: 3, 3: 0}, {1: 5, 0: 4})).upgraded(registry.Remap(2, 3, {5: 2})).upgraded()


@query
def registry_reproject(spark, sf_dir):
    """Orders' items as sparse vectors of four registry versions, carried to the newest; the chain of remaps has a gap at its end."""
    li = views.table(spark, sf_dir, "lineitem")
    pair = F.struct(F.col("l_linenumber").cast("int").alias("k"), (F.col("l_partkey") % 8).cast("int").alias("i"), F.col("l_suppkey").cast("double").alias("x"))
    v = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    v = v.select("l_orderkey", (F.col("l_orderkey") % 4 + 1).cast("int").alias("registry_version"), F.transform("p", lambda p: p["i"]).alias("indices"), F.transform("p", lambda p: p["x"]).alias("values"))
    out = registry.reproject(v, REGISTRY)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")
    return out.select("l_orderkey", "registry_version", text("indices").alias("indices"), text("values").alias("values"))


@query
def schema_compat(spark, sf_dir):
    """Parts as skills that ask for versions of inputs named after their sizes."""
    p = views.table(spark, sf_dir, "part")
    need = p.select(F.col("p_partkey").alias("skill"), F.concat(F.lit("in"), (F.col("p_size") % 12).cast("string")).alias("input"), F.concat(F.lit("1."), (F.col("p_partkey") % 3).cast("string")).alias("version"))
    core = spark.range(10).select(F.concat(F.lit("in"), F.col("id").cast("string")).alias("input"), F.concat(F.lit("1."), (F.col("id") % 2).cast("string")).alias("version"))
    return registry.incompatible(need, core)


REQUIREMENTS = ("^0.4", "0.3.9", "~0.4.1", ">=0.3, <0.5", "=0.4", "<=0.3", ">0.4.0", "*", "0.*", "^1", "oops", "0", "<0.4.2", ">0.4", "=0.4.2", "~0")


@query
def semver_filter(spark, sf_dir):
    """Parts as skills with a requirement each; those that version 0.4.2 meets."""
    p = views.table(spark, sf_dir, "part")
    req = F.element_at(F.array(*map(F.lit, REQUIREMENTS)), (F.col("p_partkey") % len(REQUIREMENTS) + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("skill"), req.alias("requirement")).where(registry.satisfies(F.col("requirement"), (0, 4, 2)))


@query
def trace_by_session(spark, sf_dir):
    """Orders as traces of their customers' sessions, each numbered by its start."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("started_at"))
    return store.by_session(o).select("trace_id", "session_id", "position")


@query
def trace_by_id(spark, sf_dir):
    """Versions of a customer's record, looked up for every supplier's number; deleted ones are not found."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "P").alias("deleted"))
    ids = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return store.lookup(store.live(o, ["id"], ["at", "version"]), ids).select("id", "version")


@query
def diff_cache_latest(spark, sf_dir):
    """Line items as computed differences of a part and a supplier; the latest of each pair."""
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("trace_a"), F.col("l_suppkey").alias("trace_b"), F.col("l_shipdate").alias("computed_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("diff_id"))
    return store.latest(li, ["trace_a", "trace_b"], ["computed_at", "diff_id"]).select("trace_a", "trace_b", "diff_id")


def turns(spark, sf_dir):
    """Turns of conversations with a number for each; texts as they are."""
    c = views.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("int").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))


def completion(conv, turn, text):
    """A completion as JSON, with one call: its arguments are JSON in a string, or broken for every third turn."""
    args = F.when(turn % 3 == 0, F.lit("{oops")).otherwise(F.to_json(F.struct(F.concat(F.lit("src/f"), turn.cast("string"), F.lit(".rs")).alias("path"), F.lit(1).alias("n"))))
    function = F.struct(F.when(turn % 2 == 0, "read").otherwise("edit").alias("name"), args.alias("arguments"))
    call = F.struct(F.lit("x").alias("id"), F.lit("function").alias("type"), function.alias("function"))
    message = F.struct(F.lit("assistant").alias("role"), text.alias("content"), F.array(call).alias("tool_calls"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"))
    usage = F.struct(F.length(text).alias("prompt_tokens"), turn.alias("completion_tokens"), F.lit(0).alias("total_tokens"))
    return F.struct(F.concat(F.lit("c"), conv.cast("string"), F.lit("-"), turn.cast("string")).alias("id"), F.lit("chat.completion").alias("object"), (1_700_000_000 + conv * 60 + turn).alias("created"), F.array(choice).alias("choices"), usage.alias("usage"))


def completion_texts(spark, sf_dir):
    """A log a conversation, a line a turn; every tenth conversation has a broken line and an empty one."""
    t = turns(spark, sf_dir)
    line = F.struct("turn", F.to_json(completion(F.col("conv"), F.col("turn"), F.col("text"))).alias("line"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    broken = F.when(F.col("source") % 10 == 0, F.lit("\n{not json\n\n")).otherwise("")
    return t.groupBy(F.col("conv").alias("source")).agg(raw.alias("raw")).select("source", F.concat("raw", broken).alias("raw"))


@query
def log_completions(spark, sf_dir):
    good, _ = logs.completions(completion_texts(spark, sf_dir))
    call = F.get("tool_calls", F.lit(0))
    return good.select("source", "session_id", F.md5(F.col("final_output").cast("binary")).alias("digest"), "started_at", F.col("token_usage.input_tokens").alias("tokens_in"), F.size("tool_calls").alias("n_calls"), call["tool_name"].alias("tool"), X.arg_path(call["args"]).alias("path"))


@query
def log_import_stats(spark, sf_dir):
    return logs.import_stats(*logs.completions(completion_texts(spark, sf_dir)))


@query
def log_formats(spark, sf_dir):
    """The format of each text, as told from its start: completions, run logs, sessions, session lines, and plain texts."""
    t = completion_texts(spark, sf_dir)
    shown = F.element_at(F.array(F.col("raw"), F.concat(F.lit('{"run_id": "r", "turns": ['), "raw", F.lit("]}")), F.lit('{"messages": [{"type": "user"}]}'), F.lit('{"type": "assistant"}'), F.lit("plain"), F.lit('{"choices": [], "id": "1"}')), (F.col("source") % 6 + 1).cast("int"))
    return t.groupBy(logs.detect(shown).alias("format")).agg(F.count("*").alias("n"))


@query
def log_run_turns(spark, sf_dir):
    """A run log a conversation; ids that can be divided by seven have broken texts, which are rejected whole."""
    t = turns(spark, sf_dir)
    turn = F.struct(F.col("turn").alias("index"), F.concat(F.lit("p"), "role").alias("prompt"), completion(F.col("conv"), F.col("turn"), F.col("text")).alias("response"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"))
    log = F.to_json(F.struct(F.concat(F.lit("run"), F.col("conv").cast("string")).alias("run_id"), F.array_sort(F.collect_list(turn), lambda a, b: a["index"] - b["index"]).alias("turns")))
    texts = t.groupBy("conv").agg(log.alias("raw")).select(F.col("conv").alias("source"), F.when(F.col("conv") % 7 == 0, "[broken").otherwise(F.col("raw")).alias("raw"))
    good, _ = logs.run_logs(texts)
    return good.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.sum(F.size("tool_calls")).alias("n_calls"), F.min("started_at").alias("started_at"), F.min("prompt").alias("prompt"))


@query
def log_sessions(spark, sf_dir):
    """A session a conversation: user texts, and assistant blocks with a text and a call."""
    t = turns(spark, sf_dir)
    blank = F.lit(None).cast("string")
    block = lambda kind, text, name, given: F.struct(F.lit(kind).alias("type"), text.alias("text"), blank.alias("id"), name.alias("name"), given.alias("input"))
    blocks = F.array(block("text", F.col("text"), blank, blank), block("tool_use", blank, F.lit("grep"), F.to_json(F.struct(F.concat(F.lit("d/f"), F.col("turn").cast("string")).alias("file")))))
    user = F.col("role") == "user"
    message = F.struct("turn", F.when(user, "user").otherwise("assistant").alias("type"), F.when(user, F.col("text")).alias("text"), F.when(~user, blocks).alias("content"))
    log = F.to_json(F.struct(F.array_sort(F.collect_list(message), lambda a, b: a["turn"] - b["turn"]).alias("messages")))
    good, _ = logs.sessions(t.groupBy("conv").agg(log.alias("raw")).select(F.col("conv").cast("string").alias("source"), "raw"))
    return good.select("session_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_digest"), F.size("tool_calls").alias("n_calls"), F.coalesce(X.arg_path(F.get("tool_calls", F.lit(0))["args"]), F.lit("")).alias("first_path"))


@query
def degrade_rules(spark, sf_dir):
    """Rules of degradation on each customer's last order against the one before."""
    e = evaluations(spark, sf_dir).withColumns({"validated": F.col("backtrack_ratio") > 0, "network_calls": F.col("deletions"), "confidence": F.col("state_stability_score")})
    return history.degradations(e)


@query
def export_symbols(spark, sf_dir):
    return export.symbols(generated.diffs(spark, sf_dir))


def daily_symbols(spark, sf_dir):
    """Symbols by the day of their order instead of the order, so that a diff has many files."""
    day = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("diff_id"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return export.symbols(generated.diffs(spark, sf_dir)).join(day, "diff_id").drop("diff_id").withColumnRenamed("day", "diff_id")


@query
def export_modules(spark, sf_dir):
    return export.by_module(daily_symbols(spark, sf_dir))


@query
def export_impact(spark, sf_dir):
    return export.impact(daily_symbols(spark, sf_dir))
