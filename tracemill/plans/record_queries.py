"""Queries on stored records, graphs that carry values, running sums, reports and texts with JSON in them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import jsontext
from ..operators import behaviour, code, coupling, dashboard, diffs, evidence, export, graph, history, prefix, reach, rules, similarity, states
from ..sources import generated, logs, reports, versioned, views
from ..sources.scratch import new_path
from ..streaming import segments
from .code_queries import QUERIES, runs_of, turns
from .queries import DAY, coupling_of, graph_of, query, rounded, vectors_of

__all__ = ["QUERIES"]


@query
def impact_analysis(spark, sf_dir):
    """Everything downstream of each order: its parts, and through parts that call their customer again, the other orders and their parts."""
    return reach.impact(generated.view(spark, sf_dir, generated.CALLED), generated.view(spark, sf_dir, generated.CALLERS))


@query
def evolution_trace(spark, sf_dir):
    """Orders of a customer as versions of its capabilities; some come from a later version, some from one that is missing."""
    return reach.evolution(generated.view(spark, sf_dir, generated.VERSIONS))


@query
def skill_run(spark, sf_dir):
    """A run of each graph: outputs are added up from layer to layer, and a skill is finished after its last dependency."""
    skills = generated.view(spark, sf_dir, generated.SKILLS)
    core = spark.range(4).select(F.concat(F.lit("in"), F.col("id").cast("string")).alias("input"), F.lit("1.0").alias("version"))
    gather = {"inputs": F.sum("output"), "ready_ms": F.max("finished_ms")}
    make = {"output": (F.col("own") + 31 * F.coalesce("inputs", F.lit(0))) % 1000003, "finished_ms": F.coalesce("ready_ms", F.lit(0)) + F.col("own") % 100 + 1}
    _, edges = generated.dags(spark, sf_dir)
    return reach.run(skills.select("graph", "node", "outcome", "own"), edges, skills.select("graph", "node", "input", "version"), core, gather, make)


@query
def document_volumes(spark, sf_dir):
    """Documents from the longest on, in files of a million bytes."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    out = prefix.rolled(d, ["n_bytes desc", "doc_id"], F.col("n_bytes"), 1_000_000)
    return prefix.running(out, ["n_bytes desc", "doc_id"], {"position": F.lit(1)}).select("doc_id", "n_bytes", "running_bytes", "file_no", "position")


@query
def conversation_files(spark, sf_dir):
    """Turns of each role, in files of twenty thousand bytes."""
    c = views.table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", F.octet_length("text").alias("n_bytes"))
    out = prefix.rolled(c, ["conv_id", "turn"], F.col("n_bytes"), 20_000, by=["role"])
    return out.groupBy("role", "file_no").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


@query
def source_budget(spark, sf_dir):
    """The first source files of each project in path order that fit into four thousand bytes."""
    p = generated.view(spark, sf_dir, generated.PATHS).select("project", "path", (F.col("n") % 997).alias("length"), "n")
    return logs.source_tree(p, by=["project"], order=["path", "n"], budget=4_000).select("project", "path", "n", "running_bytes")


@query
def stream_segments(spark, sf_dir):
    """The calls as a stream that comes in three parts by time; an end beyond all gaps closes the last segments."""
    calls = views.tool_calls(spark, sf_dir).select("trace_id", "idx", F.col("ts").cast("timestamp").alias("ts"), "tool_name", "path")
    folder, out, marks = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    first, second, last = calls.agg(F.percentile_approx("ts", [0.33, 0.66, 1.0])).first()[0]
    end = spark.range(1).select(*((F.lit(last) + F.expr("INTERVAL 20 YEARS") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in calls.schema))
    ts, store = F.col("ts"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    segments.use_state(spark)
    try:
        for part in (calls.where(ts <= first), calls.where((ts > first) & (ts <= second)), calls.where(ts > second), end, end.withColumn("ts", ts + F.expr("INTERVAL 1 DAY"))):
            part.write.mode("append").parquet(folder)
            stream = spark.readStream.schema(calls.schema).parquet(folder)
            rows = segments.segments(stream, DAY, late="0 seconds", close_after_ms=15 * 365 * DAY)
            segments.to_table(rows, out, marks)
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return spark.read.schema(rows.schema).parquet(out)


@query
def stored_trials(spark, sf_dir):
    """Orders as evaluations that are stored open, and again when they are decided, with a compaction between; listed by task."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("eval_id"), F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    outcome = X.case((F.col("o_orderstatus") == "F", "Pass"), (F.col("o_orderstatus") == "O", "Fail"), otherwise="NotEvaluated")
    t = versioned.Table(spark, new_path(spark, "trials"), ["eval_id"], ["version"])
    t.append(o.select("eval_id", "task_id", "at", F.lit("NotEvaluated").alias("outcome"), F.lit(1).alias("version")))
    t.append(o.where("o_orderstatus <> 'P' and eval_id % 2 = 0").select("eval_id", "task_id", "at", outcome.alias("outcome"), F.lit(2).alias("version")))
    t.compact()
    t.append(o.where("o_orderstatus <> 'P' and eval_id % 2 = 1").select("eval_id", "task_id", "at", outcome.alias("outcome"), F.lit(2).alias("version")))
    rows = t.latest()
    return prefix.running(rows, ["at", "eval_id"], {"position": F.lit(1)}, by=["task_id"]).select("task_id", "position", "eval_id", "outcome", "version")


def tasks_of(spark, sf_dir):
    """Customers as tasks."""
    c = views.table(spark, sf_dir, "customer")
    message = F.concat(F.element_at(F.array(*map(F.lit, ("Fix", "clean", "Spec", "readme", "add", "plan"))), (F.col("c_custkey") % 6 + 1).cast("int")), F.lit(" "), "c_mktsegment")
    criteria = F.array(F.concat(F.lit("balance over "), F.floor("c_acctbal").cast("string")), F.lit("tests pass"))
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("task of "), "c_name").alias("description"), X.task_category(message).alias("category"), F.array(F.lower("c_mktsegment"), F.lit("core")).alias("modules"), criteria.alias("success_criteria"))


@query
def tasks_view(spark, sf_dir):
    return dashboard.tasks_view(tasks_of(spark, sf_dir))


@query
def trials_view(spark, sf_dir):
    """Orders as trials of their customers; items are graders and symbols; at most three trials and two of each list are shown."""
    o, li = (views.table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    n = li.groupBy(F.col("l_orderkey").alias("eval_id")).agg(F.count("*").alias("n"), F.sum(F.col("l_suppkey").cast("bigint")).alias("tokens"), F.count_if(F.col("l_returnflag") == "R").alias("gone"))
    e = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("eval_id"), rank.alias("trial_index"), F.col("o_orderstatus").alias("outcome"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    e = e.join(n, "eval_id").withColumns({
        "description": F.concat(F.lit("task "), F.col("task_id").cast("string")), "files": F.lit(1), "additions": F.col("n") - F.col("gone"), "deletions": F.col("gone"), "modules": F.array(F.concat(F.lit("m"), (F.col("eval_id") % 7).cast("string"))),
        "tool_pattern": F.when(F.col("outcome") != "P", F.struct(F.col("n").alias("total_tool_calls"), F.col("tokens").alias("total_tokens"))),
    })
    graders = li.select(F.col("l_orderkey").alias("eval_id"), F.concat(F.lit("g"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_returnflag") != "R").alias("passed"))
    action = F.when(F.col("l_returnflag") == "R", "removed").otherwise("added")
    symbols = li.select(F.col("l_orderkey").alias("eval_id"), action.alias("action"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"))
    v = dashboard.trials_view(e, graders, symbols, most_trials=3, most_each=2)
    return v.select("task_id", "n_trials", F.md5(F.col("json").cast("binary")).alias("digest"), F.length("json").alias("n_chars"))


def changed_symbols(spark, sf_dir):
    """Items as symbols of their order's change, in files named after suppliers."""
    li = views.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("change"), F.col("l_linenumber").cast("int").alias("ordinal"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("file"), F.when(F.col("l_returnflag") == "R", "removed").otherwise("added").alias("action"))


@query
def capability_nodes(spark, sf_dir):
    return dashboard.capability_nodes(changed_symbols(spark, sf_dir))


@query
def capability_links(spark, sf_dir):
    return dashboard.capability_links(changed_symbols(spark, sf_dir))


def replies(spark, sf_dir):
    """Turns of conversations as answers of a model: JSON in a block, in a block without a name, bare, within the text, broken, or none."""
    c = views.table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.expr(generated.REPLY).alias("text"))


@query
def json_in_text(spark, sf_dir):
    r = replies(spark, sf_dir).withColumn("f", jsontext.found(F.col("text")))
    return r.select("conv_id", "turn", F.col("f.kind").alias("kind"), F.md5(F.col("f.raw").cast("binary")).alias("digest"), F.try_parse_json("f.raw").isNotNull().alias("parses"))


@query
def evidence_confidence(spark, sf_dir):
    """Customers as capabilities: their items are symbols, their orders rule hits, and a text names some symbols."""
    symbols, rules, texts = (generated.view(spark, sf_dir, q) for q in (generated.EVIDENCE_SYMBOLS, generated.EVIDENCE_RULES, generated.EVIDENCE_TEXTS))
    return rounded(evidence.confidence(texts.select("capability"), symbols, rules, texts.where("fragment is not null")))


@query
def time_series(spark, sf_dir):
    calls, s = graph_of(spark, sf_dir)
    return rounded(behaviour.time_series(s, states.transitions(s), calls, width=4))


@query
def trace_features(spark, sf_dir):
    calls, s = graph_of(spark, sf_dir)
    return rounded(behaviour.trace_features(s, calls))


@query
def skill_reports(spark, sf_dir):
    """Reports on the runs of all graphs."""
    r = reports.run_reports(skill_run(spark, sf_dir))
    return r.select("graph", "risk", *(F.md5(F.col(c).cast("binary")).alias(c) for c in ("markdown", "html", "json")))


def declared(spark, sf_dir):
    """A diff an order whose lines declare something in one of the languages, with tabs, comments and repeats."""
    return generated.diffs(spark, sf_dir, generated.DECLARED_LINES, generated.DECLARED_PATH)


def declared_raw(spark, sf_dir):
    return diffs.raw_changes(diffs.lines(declared(spark, sf_dir)))


@query
def declared_changes(spark, sf_dir):
    return declared_raw(spark, sf_dir)


@query
def declared_rules(spark, sf_dir):
    return rules.matches(declared_raw(spark, sf_dir)).select("diff_id", "change_id", "symbol", "rule_id", "category", "severity")


@query
def declared_status(spark, sf_dir):
    c = declared_raw(spark, sf_dir)
    return rules.capabilities(c).withColumn("categories", F.array_join("categories", ","))


@query
def breaking_changes(spark, sf_dir):
    """Changes that break callers, by kind and language."""
    c = declared_raw(spark, sf_dir).where(diffs.is_breaking(F.col("change_type")))
    return c.groupBy("change_type", "language").agg(F.count("*").alias("n"))


@query
def declared_exports(spark, sf_dir):
    return export.symbols(declared(spark, sf_dir))


@query
def export_summary(spark, sf_dir):
    """Files, line totals and modules of each diff."""
    s = export.summary(declared(spark, sf_dir))
    return s.select("diff_id", *(F.array_join(c, ",").alias(c) for c in ("files", "modules")), "additions", "deletions", "diff_length")


@query
def module_symbols(spark, sf_dir):
    """The first symbols of each module of a customer's diffs."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("diff_id"), "o_custkey")
    found = export.symbols(declared(spark, sf_dir)).join(o, "diff_id").withColumn("diff_id", F.col("o_custkey")).drop("o_custkey").withColumn("module", F.substring_index("module", "/", 1))
    return export.module_symbols(found).withColumn("symbols", F.array_join("symbols", ","))


@query
def top_side_effects(spark, sf_dir):
    """The most frequent side effects of flows: an order has up to three."""
    o = views.table(spark, sf_dir, "orders")
    effects = F.array_compact(F.array(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("writes "), "o_orderpriority")), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("sends "), F.col("o_orderstatus"))), F.when(F.col("o_orderkey") % 7 == 0, F.lit("logs"))))
    return code.most_common(o.select(F.explode(effects).alias("side_effect")), "side_effect")


@query
def vector_diff(spark, sf_dir):
    """Neighbouring traces' vectors: likeness, what contributes to it, and the change of each field."""
    v = vectors_of(spark, sf_dir)
    side = lambda s, shift: v.select(F.col("trace_id").alias(s), (F.col("trace_id") + shift).alias("k"), *(F.col(c).alias(f"{s}_{c}") for c in behaviour.VECTOR))
    p = similarity.with_similarity(side("a", 0).join(side("b", -1), "k").drop("k"))
    return rounded(similarity.differences(similarity.contributions(p)).select("a", "b", "similarity", "entropy", "structural", "temporal", "density", *(f"d_{c}" for c in behaviour.VECTOR)), 5)


@query
def coupling_over(spark, sf_dir):
    """Couplings of at least 0.3."""
    return rounded(coupling.threshold_prune(coupling_of(spark, sf_dir), 0.3).select("cap_a", "cap_b", "correlation"))


@query
def suite_risk(spark, sf_dir):
    """Risk of each suite's run, by what failed or was skipped."""
    n = code.degradation(runs_of(spark, sf_dir))
    return n.select("suite", graph.run_risk(F.col("n_failed"), F.col("n_skipped")).alias("risk"))


@query
def eval_recommendations(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    return history.recommendations(history.rollup(li.select(F.col("l_orderkey").alias("task_id"), (F.col("l_returnflag") != "R").alias("passed"))))


@query
def turn_previews(spark, sf_dir):
    """Texts cut to eighty characters, and whether they were longer."""
    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.preview(F.col("text"), 80).alias("preview"))


@query
def log_session_lines(spark, sf_dir):
    """A log a conversation with a message a line; user lines count for nothing, and every fifth log has a broken line."""
    t = turns(spark, sf_dir)
    block = lambda kind, text, name: F.struct(F.lit(kind).alias("type"), text.alias("text"), name.alias("name"))
    blank = F.lit(None).cast("string")
    line = F.to_json(F.struct(F.concat(F.lit("m"), F.col("conv").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("type"), F.array(block("text", F.col("text"), blank), block("tool_use", blank, F.lit("grep"))).alias("content")))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    texts = t.groupBy(F.col("conv").alias("source")).agg(raw.alias("raw")).withColumn("raw", F.when(F.col("source") % 5 == 0, F.concat("raw", F.lit("\n{oops"))).otherwise(F.col("raw")))
    good, bad = logs.session_lines(texts)
    n_bad = bad.groupBy("source").agg(F.count("*").alias("n_bad"))
    return good.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("tool_calls")).alias("n_calls"), F.sum(F.length("final_output")).alias("n_chars")).join(n_bad, "source", "left").fillna(0, ["n_bad"])
