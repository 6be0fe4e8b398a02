import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.functions import modules as M
from tracemill.operators import align, behaviour, code, diffs, graph, history, redact, registry, rules, similarity, states, validate
from tracemill.sources import logs, store
from tracemill.streaming import sessions

from . import fixtures


def one(spark, col, **values):
    names = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*(v.alias(k) for k, v in names.items())).select(col.alias("x")).first().x


@pytest.mark.parametrize("args,want", [('{"path": 3, "file": "x"}', None), ('{"file": "x"}', "x"), ('{"path": "a/b"}', "a/b"), ("nope", None), ("{}", None)])
def test_arg_path(spark, args, want):
    assert one(spark, X.arg_path(F.col("a")), a=args) == want


def test_scalars(spark):
    assert [one(spark, X.file_scope(F.col("p")), p=p) for p in ("a/b/c.rs", "a\\b.rs", "c.rs")] == ["a/b", "a", ""]
    assert [one(spark, X.file_cluster(F.col("p")), p=p) for p in ("x.rs", "x.tsx", "src/x", "tests/x", "x", "x.zip")] == ["rust", "ts_js", "src", "test", "other", "other"]
    assert one(spark, X.canonical_call(F.lit("t"), F.lit('{"b":1,"a":2}')) == X.canonical_call(F.lit("t"), F.lit('{"a":2, "b":1}')))
    assert one(spark, X.rfc3339(F.lit("now"))) is None
    assert one(spark, X.glob_match(F.lit("db/My_Migration.sql"), "*migration*")) and not one(spark, X.glob_match(F.lit("a.sqlx"), "*.sql"))
    assert one(spark, X.name_tokens(F.lit("get_User-get a"))) == ["get", "user"]
    assert [one(spark, X.task_category(F.lit(m))) for m in ("Hotfix it", "clean up", "spec", "readme", "new feature", "zzz")] == ["bug_fix", "refactor", "test", "doc", "feature", "general"]


def test_robust_scale(spark):
    cols = X.robust_scale([F.lit(float(v)) for v in (7, 1, 5, 3, 2, 6, 4)])
    assert [round(v, 9) for v in spark.range(1).select(*cols).first()] == [(v - 4) / 4 for v in (7, 1, 5, 3, 2, 6, 4)]
    same = X.robust_scale([F.lit(2.0)] * 7)
    assert list(spark.range(1).select(*same).first()) == [2.0] * 7


def calls(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(1, i, None if ms is None else t0 + dt.timedelta(milliseconds=ms), tool, path) for i, (tool, path, ms) in enumerate(rows)], "trace_id bigint, idx bigint, ts timestamp, tool_name string, path string")


def test_cuts(spark):
    c = calls(spark, [("read", "a/x", 0), ("grep", "a/y", 10_000), ("grep", "a/y", 20_001), ("read", "a/y", 20_000), ("read", "b/y", 20_001), ("edit", "b/y", 20_002), ("test", "b/y", 20_003), ("edit", "b/y", 20_004), ("cargo", "b/y", 20_005), ("edit", "b/y", 20_006), ("edit", None, None), ("edit", "z/q", None)])
    got = [r.cut for r in states.cuts(c).orderBy("idx").collect()]
    assert got == [None, None, "idle_gap", "idle_gap", "file_scope_jump", "tool_type_change", "tool_type_change", "failure_loop", "tool_type_change", "tool_type_change", None, None]


def test_windows_of_candidates(spark):
    rows = [(1, k, "x", "start", 0, n) for k, n in enumerate((2, 3, 9, 10))]
    segs = spark.createDataFrame(rows, "trace_id int, segment_idx int, category string, boundary_reason string, first_idx bigint, n_calls bigint")
    got = {}
    for r in states.candidates(segs).collect():
        got.setdefault(r.segment_idx, []).append((r.first_idx, r.last_idx + 1))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(0, 2)], 1: [(0, 3)], 2: [(0, 8), (2, 9), (4, 9), (6, 9)], 3: [(0, 8), (2, 10), (4, 10), (6, 10)]}


def test_verdict_rules(spark):
    sm = spark.createDataFrame([(1, 1.6, 0.0, 3), (2, 0.0, 0.0, 3), (3, 0.0, 0.0, 0)], "trace_id int, phase_entropy double, loop_ratio double, state_count int")
    tm = spark.createDataFrame([(1, 0, 0.0), (2, 4, 0.0)], "trace_id int, oscillations int, reversal_ratio double")
    got = {r.trace_id: (r.hits, r.verdict) for r in behaviour.verdict(sm, tm).collect()}
    assert got == {1: ("SE001:high", "Degraded"), 2: ("TE001:medium", "Pass"), 3: ("GE001:high", "Degraded")}


def test_alignment_keeps_order_and_uses_each_call_once():
    g = random.Random(4)
    for _ in range(300):
        a, b = ([(g.choice("rwt"), g.choice("12")) for _ in range(g.randrange(8))] for _ in "ab")
        for f in (align.edit_align, align.greedy_align):
            out = f(a, b)
            assert sorted(i for _, _, i, _ in out if i is not None) == [*range(len(a))]
            assert sorted(j for _, _, _, j in out if j is not None) == [*range(len(b))]
            for tool, kind, i, j in out:
                assert kind == ("added" if i is None else "deleted" if j is None else "unchanged" if a[i] == b[j] else "args_changed")
                assert tool == (a[i] if j is None else b[j])[0] and (i is None or j is None or a[i][0] == b[j][0])
        assert [j for _, _, _, j in align.edit_align(a, b) if j is not None] == [*range(len(b))]
    assert [k for _, k, _, _ in align.edit_align([("read", "1"), ("edit", "1")], [("read", "1"), ("test", "1"), ("edit", "2")])] == ["unchanged", "added", "args_changed"]


def test_diff_tables(spark):
    d = diffs.line_numbers(diffs.lines(fixtures.diffs(spark)))
    got = {(r.diff_id, r.content): (r.change, r.line_no, r.line_kind) for r in d.collect()}
    assert got[1, "pub fn old_login(name: &str) -> bool {"] == ("modified", 2, "del")
    assert got[1, "pub const MAX_TRIES: u32 = 3;"] == ("modified", 23, "add")
    assert got[1, "class TestApp:"] == ("added", 5, "add")
    assert got[2, "func Exported(a int) {"] == ("deleted", 1, "del") and got[2, "export async function start() {}"][0] == "renamed"
    s = {(r.diff_id, r.symbol, r.change_type) for r in diffs.raw_changes(diffs.lines(fixtures.diffs(spark))).collect()}
    assert {(1, "login_user", "function_added"), (1, "MAX_TRIES", "constant_added"), (1, "Session", "unknown"), (2, "removeMe", "function_removed"), (2, "/users/{id}", "http_route_added"), (2, "Exported", "function_removed"), (4, "hashIt", "function_added")} <= s
    assert not {x for x in s if x[1] in ("hidden", "_private", "private")}
    hits = {(r.symbol, r.rule_id) for r in rules.matches(diffs.raw_changes(diffs.lines(fixtures.diffs(spark)))).collect()}
    assert {("login_user", "sec_auth_001"), ("removeMe", "breaking_001"), ("hashIt", "sec_crypto_001"), ("Session", "sec_token_001"), ("TestApp", "misc_test_001")} <= hits


def test_modules_by_path(spark):
    """Each rule, on paths and answers of its own."""
    cases = {
        M.module_short: {"src/auth/login.rs": "src/auth", "src/x.rs": "src", "crates/a/b.rs": "crates", "README.md": "README.md", "/x/y": ""},
        M.module_from_path: {"src/auth/login.rs": "src/auth", "src/x.rs": "src/x.rs", "crates/a/b/c.rs": "crates/a/b", "crates/a": "crates/a", "web/x.ts": "web/x.ts"},
        M.module_group: {"src/auth/login.rs": "src/auth", "crates/core/src/lib.rs": "crates/core", "crates/a": "crates/a", "README.md": "."},
        M.cluster_module: {"src/auth/handler.rs": "auth", "crates/core/src/lib.rs": "crates", "tests/integration/test_auth.rs": "integration", "./lib/x.js": "x.js", "src": "src", "": ""},
        M.rust_module: {"src/auth/login.rs": "auth", "src/x.rs": "x", "crates/k/src/f.rs": "f", "x.rs": None, "src/a/b/c.rs": "a"},
        M.path_module: {"src/web/app.ts": "web/app", "lib/x.js": "x", "src": None, "a.d/f": "a", "/abs/x.go": "//abs/x", "README": "README"},
        X.language: {"a/b.MJS": "javascript", "x.Rs": "rust", ".rs": "unknown", "a.tsx": "typescript", "a.b.py": "python", "go": "unknown"},
        graph.is_entry_point: {"a/main.rs": True, "app.ts": True, "src/bin": True, "lib.rs": False, "a/main.js": False, "index.ts": True},
        graph.node_phase: {"ReadFile": "input", "checkAll": "validation", "save_db": "persistence", "Render": "output", "compute": "business_logic"},
        graph.trigger: {"main": "CLI", "user_handler": "HTTP", "worker": "MQ", "Handler": "CLI"},
    }
    for rule, want in cases.items():
        got = spark.createDataFrame([(p,) for p in want], "p string").select("p", rule(F.col("p")).alias("m")).collect()
        assert {r.p: r.m for r in got} == want, rule


def test_imports_and_dependencies(spark):
    lines = {"use crate::store::users;": "store/users", "use super::a::{b, c};": "a/{b, c}", "use std::io;;": "std/io", "use {a, b};": None, "use crate;": "crate", "from a.b import c": "a/b", "  import x.y as z": "x/y", "import q from './w'": "q", "const m = require('./z') ;": "./z", "require(": None, "let x = 1;": None}
    got = spark.createDataFrame([(x,) for x in lines], "c string").select("c", code.imported(F.col("c")).alias("i")).collect()
    assert {r.c: r.i for r in got} == lines
    files = [(1, "src/auth/a.rs", "use src::store::x;\nuse src::store::y;"), (1, "src/store/b.rs", "import auth"), (1, "web/c.js", "x"), (2, "src/a.rs", "use src;")]
    got = code.dependencies(spark.createDataFrame(files, "project int, file string, content string")).collect()
    assert [tuple(r) for r in got] == [(1, "src/auth", "src/store", 3.0)]


def test_all_metrics_are_compared(spark):
    names = [m[0] for m in history.METRICS]
    rows = [(1, 1, 10, *[100.0] * 10), (1, 2, 11, *[110.0, 90.0, 104.0, 120.0, 80.0, 100.0, 0.0, 120.0, 94.0, 106.0]), (2, 1, 20, *[1.0] * 10), (3, 1, 30, *[0.0] * 10), (3, 2, 31, *[None] * 8, 0.0, 5.0)]
    got = history.compare_metrics(spark.createDataFrame(rows, "task_id int, trial int, eval_id int, " + ", ".join(f"{n} double" for n in names))).collect()
    by = {(r.task_id, r.metric): (r.change_pct, r.direction) for r in got}
    assert [by[1, n][1] for n in names] == ["Up", "Down", "Flat", "Down", "Up", "Flat", "Up", "Up", "Down", "Up"]
    assert by[3, "additions"] == (0.0, "Flat") and by[3, "deletions"] == (100.0, "Up") and len(by) == 12


def test_registry_and_versions(spark):
    r = registry.Registry().with_tool("deploy").with_tool("deploy").upgraded(registry.Remap(1, 2, {0: 3}, {0: 9, 1: 2}))
    assert (r.version, r.parent, len(r.tools)) == (2, 1, 6)
    v = spark.createDataFrame([(1, [0, 1, 4, 7], [1.0, 2.0, 3.0, 4.0]), (2, [7], [1.0]), (1, [], [])], "registry_version int, indices array<int>, values array<double>")
    got = [(x.registry_version, x.indices, x["values"]) for x in registry.reproject(v, r).collect()]
    assert got == [(2, [3, 2, 4], [1.0, 2.0, 3.0]), (2, [7], [1.0]), (2, [], [])]
    meets = {"^0.4": True, "0.4.3": False, "~0.4": True, ">=0.3, <0.4": False, "=0.4.2": True, ">0.4": False, "<=0.4": True, "*": True, "0.4.*": True, "^1": False, "x": False, "^0.0.3": False}
    got = spark.createDataFrame([(x,) for x in meets], "q string").select("q", registry.satisfies(F.col("q"), (0, 4, 2)).alias("ok")).collect()
    assert {x.q: x.ok for x in got} == meets


def test_clusters_and_history(spark):
    changed = spark.createDataFrame([(1, "src/auth/a.rs")], "project int, file string")
    symbols = spark.createDataFrame([(1, "s", "src/store/b.rs", True), (1, "t", "web/c.ts", False), (1, "u", "doc/d.md", False)], "project int, symbol string, file string, added boolean")
    tasks = spark.createDataFrame([(1, "web", 2)], "project int, module string, n_tasks int")
    nodes = code.clusters(changed, symbols, tasks)
    assert {(r.module, r.n_symbols, r.cluster_type) for r in nodes.collect()} == {("auth", 0, "Changed"), ("store", 1, "Changed"), ("web", 1, "Active"), ("doc", 1, "Cold")}
    links = code.cluster_links(spark.createDataFrame([(1, "a", "f"), (1, "b", "f"), (1, "c", "g")], "project int, module string, file string"))
    assert [tuple(r) for r in links.collect()] == [(1, "a", "b", 0.5)]
    assert code.cluster_summary(nodes, links).collect()[0].asDict() == {"project": 1, "n_modules": 4, "n_changed": 2, "n_active": 1, "n_cold": 1, "avg_coupling": 0.5}
    log = spark.createDataFrame([("2024-01-01 x",), ("",), (" src/a/b.rs",), ("src/a/c.rs",), ("x.md",)], "line string")
    assert {tuple(r) for r in code.module_changes(log).collect()} == {("src/a", 2), ("x.md", 1)}


def test_deep_chains_have_layers(spark):
    n = 40
    nodes = spark.createDataFrame([("g", f"n{i:03d}") for i in range(n)], "graph string, node string")
    edges = spark.createDataFrame([("g", f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, n)], "graph string, node string, dep string")
    assert sorted((r.node, r.layer) for r in graph.layers(nodes, edges).collect()) == [(f"n{i:03d}", i) for i in range(n)]


def test_history(spark):
    t = spark.createDataFrame([(1, 1, 10, "Pass", 1.0), (1, 2, 11, "Fail", 2.0), (2, 1, 20, "Fail", 0.0), (2, 2, 21, "Partial", 0.0), (3, 1, 30, "Pass", 1.0)], "task_id int, trial int, eval_id int, outcome string, metric double")
    assert {(r.task_id, r.severity, r.is_improvement) for r in history.regressions(t).collect()} == {(1, "Critical", False), (2, "Medium", True)}
    assert {(r.task_id, r.change_pct, r.direction, r.trend) for r in history.compare(t).collect()} == {(1, 100.0, "Up", "Degraded"), (2, 0.0, "Flat", "Stable")}


def test_graphs(spark):
    nodes, edges = fixtures.dags(spark)
    assert {(r.graph, r.node): r.layer for r in graph.layers(nodes, edges).collect()} == {("g1", "a"): 0, ("g1", "b"): 1, ("g1", "c"): 1, ("g1", "d"): 2, ("g1", "e"): 3, **{("g2", n): -1 for n in "abcdf"}}
    assert {r.path for r in graph.cycles(edges).collect()} == {"a>b", "a>b>c"}
    t = spark.createDataFrame([(1, x, y) for x, y in ("ab", "ba", "ab", "bc", "ca")], "trace_id int, from_phase string, to_phase string")
    assert graph.loop_ratio(t).first().loop_ratio == pytest.approx(2 / 5)


def test_clusters_follow_chains(spark):
    import math

    rows = [("x", i, *[math.cos(i * 0.7), math.sin(i * 0.7), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(5)]
    v = spark.createDataFrame(rows, ["g", "trace_id", *behaviour.VECTOR])
    full = {r.trace_id: r.label for r in similarity.clusters(v, "g").collect()}
    assert full == dict.fromkeys(range(5), 1)
    near = 1 - math.cos(0.7)
    assert near < 0.3 < 1 - math.cos(1.4)


def test_two_hop_mode_stops():
    import math

    import pandas as pd

    p = pd.DataFrame([[math.cos(i * 0.7), math.sin(i * 0.7)] + [0.0] * 5 for i in (1, 0, 2, 3, 4)], columns=behaviour.VECTOR)
    assert similarity.cluster_points(p, 0.3, 3, False) == [1] * 5
    assert similarity.cluster_points(p, 0.3, 3, True) == [1, 1, 1, 1, -1]


def test_validation(spark):
    e, a = fixtures.cases(spark)
    got = {r.case_id: r.verdict for r in validate.verdicts(validate.exact(e, a), validate.semantic(e, a)).collect()}
    assert got == {"c1": "pass", "c2": "semantic_pass", "c3": "semantic_pass", "c4": "fail"}  # c2: no categories are expected, which counts as equal


def test_redaction(spark):
    text = "api_key: abc, token=xyz; Authorization: Bearer q.r x bearer zz"
    assert one(spark, redact.redact(F.col("t")), t=text) == "api_key=***REDACTED***, token=***REDACTED***; Authorization=***REDACTED*** q.r x Bearer ***REDACTED***"
    assert one(spark, redact.redact_args(F.col("t")), t='{"k":"token=abc"}') == '{"k":"token=abc"}'
    assert one(spark, redact.redact_args(F.col("t")), t='"token=abc"') == '"token=***REDACTED***"'


LINE = '{"id":"s%d","object":"%s","model":"m","created":0,"choices":[{"index":0,"message":{"role":"assistant","content":"hi","tool_calls":[{"id":"c","type":"function","function":{"name":"read","arguments":"{\\"b\\":1,\\"a\\":2}"}},{"id":"d","type":"function","function":{"name":"grep","arguments":"not json"}}]},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":4,"total_tokens":7}}'


def test_logs(spark):
    good = LINE % (1, "x") + "\n\nbroken\n" + LINE % (2, "x")
    session = '{"messages":[{"type":"user","text":"do it"},{"type":"assistant","content":[{"type":"text","text":"ok"},{"type":"tool_use","id":"t1","name":"edit","input":"{\\"p\\":1}"}]}]}'
    lines = '{"id":"m","type":"assistant","content":[{"type":"tool_use","id":"t1","name":"edit","input":"{}"}],"usage":{"input_tokens":1,"output_tokens":2}}\nbad'
    run = '{"run_id":"r","turns":[{"index":0,"prompt":"p","response":' + LINE % (3, "x") + ',"timestamp":"2024-01-01T00:00:00Z"}]}'
    texts = spark.createDataFrame([("a", good), ("b", session), ("c", lines), ("d", run), ("e", LINE % (4, "chat.completion")), ("f", "zzz")], "source string, raw string")
    names = {r.source: r.n for r in texts.select("source", logs.detect(F.col("raw")).alias("n")).collect()}
    assert names == {"a": "deepseek", "b": "session", "c": "session_lines", "d": "run_log", "e": "openai", "f": None}
    of = lambda s: texts.where(F.col("source") == s)
    ok, bad = logs.parse(of("a"), "DeepSeek")
    rows = ok.orderBy("session_id").collect()
    assert [r.session_id for r in rows] == ["s1", "s2"] and [r.line for r in bad.collect()] == ["broken"]
    assert [(c.id, c.tool_name, c.args) for c in rows[0].tool_calls] == [("call_deepseek_s1_001", "read", '{"a":2,"b":1}'), ("call_deepseek_s1_002", "grep", '"not json"')]
    assert rows[0].started_at == "1970-01-01T00:00:00Z" and rows[0].token_usage.output_tokens == 4
    assert logs.import_stats(ok, bad).first() == (2, 1)
    assert logs.parse(of("d"), "run_log")[0].first().prompt == "p"
    s = logs.parse(of("b"), "session")[0].first()
    assert (s.prompt, s.final_output, s.tool_calls[0].tool_name) == ("do it", "ok", "edit")
    assert logs.parse(of("c"), "session_lines")[0].first().token_usage.output_tokens == 2


def test_store(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, f"t{k}", ["read", "git"] if k % 2 else ["readme"], at + dt.timedelta(hours=k), k, k == 4) for k in range(6)]
    t = spark.createDataFrame(rows, "trace_id int, session_id string, tools array<string>, started_at timestamp, version int, deleted boolean")
    store.append(t, f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t").drop("date")
    again = back.unionByName(back.where("trace_id = 1").withColumn("version", F.lit(9)).withColumn("deleted", F.lit(True)))
    assert sorted(r.trace_id for r in store.live(again, ["trace_id"], ["version"]).collect()) == [0, 2, 3, 5]
    assert [r.trace_id for r in store.listing(back, limit=2, offset=1, where=store.TraceFilter(tool="read")).collect()] == [3, 1]
    assert store.listing(back, where=store.TraceFilter(tool="read", substring=True)).count() == 6
    assert [r.id for r in store.allocate_ids(back, ["trace_id"]).orderBy("trace_id").collect()][:2] == ["trace_20240101_001", "trace_20240101_002"]


def test_sessions_on_a_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at + dt.timedelta(seconds=s)) for s in (0, 5, 15, 40)]
    t = spark.createDataFrame(rows, "trace_id int, ts timestamp")
    t.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
    q = sessions.idle_sessions(s).writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n_calls for r in sessions.idle_sessions(t).collect()) == [1, 3]
    w = sessions.ingest(s, f"{tmp_path}/out", f"{tmp_path}/ck")
    w.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_names_fall_apart_at_capitals(spark):
    words = {"getUserName": ["get", "name", "user"], "HTTPServer_start": ["httpserver", "start"], "a-bC  déjàVu": ["déjà", "vu"], "x": [], "É1Ab": ["ab", "É1".lower()]}
    for name, want in words.items():
        assert one(spark, X.name_tokens(F.lit(name))) == sorted(want), name
    assert one(spark, validate.word_similarity(F.lit("getUser"), F.lit("GETUSER"))) == 1.0
    assert one(spark, validate.word_similarity(F.lit("get_user"), F.lit("getUser"))) == 0.0  # names are lowered first
    assert one(spark, validate.word_similarity(F.lit("a"), F.lit("b"))) == 1.0 and one(spark, validate.word_similarity(F.lit("a"), F.lit("user"))) == 0.0
    cats = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert one(spark, validate.category_similarity(cats(), cats("a"))) == 1.0 and one(spark, validate.category_similarity(cats("A", "b"), cats("a", "c"))) == pytest.approx(1 / 3)
    assert one(spark, validate.category_similarity(cats("a"), cats())) == 0.0


def test_repeats_leave_gaps_in_the_ids_and_tabs_are_white_space(spark):
    body = ["@@ -1,2 +1,6 @@", "+pub fn f(", "+\tpub fn f(", "+pub struct S", '+\t// app.get("/x")', "+\u00a0# no", "-pub fn f(", '+\tapp.get("/y")']
    df = spark.createDataFrame([(1, "\n".join(["diff --git a/a.rs b/a.rs", "--- a/a.rs", "+++ b/a.rs", *body]))], "diff_id int, diff string")
    got = sorted((r.change_id, r.symbol, r.change_type) for r in diffs.raw_changes(diffs.lines(df)).collect())
    assert got == [("rc_00001", "f", "function_added"), ("rc_00003", "S", "struct_added"), ("rc_00004", "/y", "http_route_added"), ("rc_00005", "f", "function_removed")]
    lines = spark.createDataFrame([("\tuse crate::m::x;\t",), ("\u2003import a.b",)], "c string")
    assert [r.i for r in lines.select(code.imported(F.col("c")).alias("i")).collect()] == ["m/x", "a/b"]


def test_declared_inputs_reach_every_pattern_and_rule(spark):
    """All patterns of changes, and all rules but those on kinds of changes that no pattern finds."""
    from tracemill.plans import record_queries

    c = record_queries.declared_raw(spark, "/root/testdata/sf0.001")
    kinds = {(r.language, r.change_type) for r in c.select("language", "change_type").distinct().collect()}
    need = {("rust", k) for k in ("function_added", "function_removed", "struct_added", "enum_added", "trait_added", "import_added", "import_removed", "constant_added", "constant_removed", "unknown")}
    need |= {(lang, k) for lang in ("typescript", "javascript") for k in ("function_added", "struct_added", "import_added")} | {(lang, k) for lang in ("python", "go", "java") for k in ("function_added", "struct_added")}
    need |= {("unknown", k) for k in ("http_route_added", "http_route_removed", "constant_added", "constant_changed")}
    assert need <= kinds
    hit = {r.rule_id for r in rules.matches(c).select("rule_id").distinct().collect()}
    assert {r[0] for r in rules.RULES} - hit == {"breaking_002", "breaking_003", "breaking_004"}
