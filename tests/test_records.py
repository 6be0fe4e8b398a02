"""Versioned tables, nested views, JSON in texts, evidence and report files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.functions import jsontext
from tracemill.operators import dashboard, evidence
from tracemill.sources import reports, store, versioned


def table(spark, path):
    return versioned.Table(spark, f"{path}/t", ["k"], ["v"])


def rows(spark, *data):
    return spark.createDataFrame(list(data), "k int, v int, x string")


def held(df):
    return sorted(map(tuple, df.collect()))


def test_a_read_during_a_compaction_sees_one_state(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.rows() is None and t.latest() is None and t.compact() == 0
    t.append(rows(spark, (1, 1, "a"), (2, 1, "b")))
    t.append(rows(spark, (1, 2, "c"), (3, 1, "d")))
    before = t.latest()
    want = [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    seen = {}

    def meanwhile():
        seen["reader"] = held(t.latest())
        seen["all"] = t.rows().count()
        t.append(rows(spark, (2, 5, "late")))
        seen["after append"] = held(t.latest())

    number = t.compact(buckets=3, meanwhile=meanwhile)
    assert seen == {"reader": want, "all": 4, "after append": [(1, 2, "c"), (2, 5, "late"), (3, 1, "d")]}
    assert held(t.latest()) == seen["after append"] and t.rows().count() == 4  # three compacted rows, and the one that came meanwhile
    assert held(before) == want  # a reader that began before still reads its state
    assert held(t.latest(2)) == want and t.state()[0] == number == 4


def test_old_states_go_with_a_vacuum(spark, tmp_path):
    t = table(spark, tmp_path)
    for k in range(4):
        t.append(rows(spark, (1, k, str(k))))
    t.compact()
    assert t.vacuum(keep=1) == 4 and held(t.latest()) == [(1, 3, "3")] and len(os.listdir(f"{tmp_path}/t")) == 2
    t.clear()
    assert t.rows() is None


def test_two_writers_both_count(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    name = t._written(rows(spark, (1, 1, "mine")))
    tries = []

    def change(folders):
        if not tries:
            other.append(rows(spark, (2, 1, "theirs")))
        tries.append(folders)
        return [*folders, name]

    t._publish(change)
    assert len(tries) == 2 and held(t.latest()) == [(1, 1, "mine"), (2, 1, "theirs")]


def test_timeline_and_cache(spark, tmp_path):
    tl = versioned.Timeline(spark, str(tmp_path))
    evals = lambda *r: spark.createDataFrame(list(r), "eval_id string, task_id string, trial_index int, outcome string, created_at string")
    tl.save_evals(evals(("e1", "t1", 1, "Fail", "2024-01-01"), ("e2", "t1", 2, "Pass", "2024-01-02")))
    tl.save_evals(evals(("e3", "t2", 1, "Pass", "2024-01-02")))
    for again in (evals(("e2", "t9", 1, "Pass", "2025-01-01")), evals(("e7", "t9", 1, "Pass", "2025-01-01"), ("e7", "t9", 2, "Pass", "2025-01-01"))):
        with pytest.raises(ValueError):
            tl.save_evals(again)
    assert [(r.eval_id, r.position, r.is_latest) for r in tl.trials().orderBy("eval_id").collect()] == [("e1", 1, False), ("e2", 2, True), ("e3", 1, True)]
    assert [r.eval_id for r in tl.recent(2).collect()] == ["e3", "e2"]
    assert {r.description for r in tl.described().collect()} == {"Unknown task"}
    tasks = lambda *r: spark.createDataFrame(list(r), "task_id string, description string, created_at string")
    tl.save_tasks(tasks(("t1", "old", "2024-01-01")))
    tl.save_tasks(tasks(("t1", "new", "2024-02-01"), ("t3", "other", "2024-01-01")))
    assert {(r.eval_id, r.description) for r in tl.described().collect()} == {("e1", "new"), ("e2", "new"), ("e3", "Unknown task")}
    tl.save_events(spark.createDataFrame([("g1", 1), ("g2", 3), ("g3", 3), ("g1", 2)], "event_id string, at int"))
    assert [tuple(r) for r in tl.recent_events(2).collect()] == [("g3", 3), ("g2", 3)]
    c = versioned.Cache(spark, f"{tmp_path}/cache")
    assert c.read().count() == 0
    values = lambda *r: spark.createDataFrame(list(r), "key string, json string")
    c.write(values(("a", "1"), ("b", "2")))
    c.write(values(("a", "3")))
    assert sorted(map(tuple, c.read().collect())) == [("a", "3"), ("b", "2")]
    c.clear()
    assert c.read().count() == 0


TEXTS = {
    'x ```json\n{"a": 1}\n``` y': ("fenced", '{"a": 1}', True), "```\nrust\nlet x\n```": ("fenced", "let x", False), "```[1]```": ("fenced", "[1]", True), ' {"a": [1, 2]} ': ("bare", '{"a": [1, 2]}', True),
    "{a} b}": ("bare", "{a} b}", False), 'it {is} {"k": "} \\" ]", "z": [{}]} end {"b": 1}': ("inline", '{"k": "} \\" ]", "z": [{}]}', True), 'wrong {"a": [1} then [2]!': ("inline", "[2]", True),
    'open {"a": [1': (None, None, False), "none": (None, None, False), "": (None, None, False), 'quote " outside {"q": 1} ok': ("inline", '{"q": 1}', True), '}}]] [1, {"x": "\\\\"}] z': ("inline", '[1, {"x": "\\\\"}]', True), "```json {": (None, None, False),
}


def test_json_in_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string").select("t", jsontext.found(F.col("t")).alias("f"), jsontext.value(F.col("t")).isNotNull().alias("parses"))
    got = {r.t: ((r.f.kind, r.f.raw) if r.f else (None, None), r.parses) for r in df.collect()}
    assert got == {t: ((kind, raw), parses) for t, (kind, raw, parses) in TEXTS.items()} | {None: ((None, None), False)}
    long = spark.createDataFrame([("word, [ " * 20_000 + '{"at": "the end"} ' + "] " * 20_000,)], "t string").select(F.size(jsontext.balanced(F.col("t"))).alias("n")).first()
    assert long.n == 1  # one outermost stretch, through all depths


def test_evidence(spark):
    caps = spark.createDataFrame([("full",), ("none",), ("many",)], "capability string")
    l1 = [("full", "log", "pub"), ("full", "a::b", "pub"), ("full", "zz", "private"), ("full", "y" * 70, "pub")] + [("many", f"s{k}", "private") for k in range(51)]
    l2 = [("full", "high"), ("full", "low")] + [("many", "high")] * 11
    text = "relogin calls xa::bc " + "y" * 80
    out = {r.capability: (r.l1_score, r.l2_score, r.l3_score) for r in evidence.confidence(caps, spark.createDataFrame(l1, "capability string, symbol string, visibility string"), spark.createDataFrame(l2, "capability string, severity string"), spark.createDataFrame([("full", text), ("many", "")], "capability string, fragment string")).collect()}
    assert out["none"] == (0, 0, 0)
    assert out["full"] == pytest.approx((0.6 + 0.4 * 3 / 4, 0.5 + 0.25, 0.5 + 0.5 * 3 / 4))
    assert out["many"] == pytest.approx((0.4 * 0.6, 0.5 * 0.4 + 0.5, 0.0))


def test_named_symbols_are_those_the_text_contains(spark):
    symbols = [(c, s) for c in "ab" for s in ("in", "login", "gin_2", "x.y", "A", "none", "é", "lo" * 40)]
    texts = {"a": "relogin_27, x.yz " + "lo" * 50, "b": "Agin_2 é in" + "_lo" * 30}
    got = evidence.named(spark.createDataFrame(symbols, "capability string, symbol string"), spark.createDataFrame(list(texts.items()), "capability string, fragment string")).collect()
    assert sorted(map(tuple, got)) == sorted((c, s) for c, s in symbols if s in texts[c])


def test_views_are_cut_and_say_so(spark):
    e = spark.createDataFrame([(1, "d", k, k, "Pass", "2024", None, 1, 2, 3, ["m"]) for k in range(1, 6)], "task_id int, description string, eval_id int, trial_index int, outcome string, created_at string, tool_pattern struct<n:int>, files int, additions int, deletions int, modules array<string>")
    g = spark.createDataFrame([(5, f"g{k}", k > 0) for k in range(4)], "eval_id int, name string, passed boolean")
    s = spark.createDataFrame([(5, "added", "f", "fn", "a.rs"), (4, "removed", "q", "fn", "b.rs")], "eval_id int, action string, name string, kind string, file string")
    r = dashboard.trials_view(e, g, s, most_trials=2, most_each=2).first()
    doc = json.loads(r.json)
    assert r.n_trials == 5 and [t["eval_id"] for t in doc["trials"]] == [4, 5]
    assert doc["trials"][1]["grader_results"] == [{"name": "g0", "passed": False}, {"name": "g1", "passed": True}] and doc["trials"][0]["tool_pattern"] is None
    assert doc["trials"][1]["code_change"]["symbols_added"] == [{"name": "f", "kind": "fn", "file": "a.rs"}] and doc["trials"][0]["code_change"]["symbols_removed"][0]["name"] == "q"


def runs(spark):
    data = [(f"g{k % 5}", f"n{k}", k // 5, ("ok", "failed", "skipped")[k % 3], "upstream_skip" if k % 3 == 2 else None) for k in range(40)] + [("g<&>", "a<b", 0, "ok", None)]
    return reports.run_reports(spark.createDataFrame(data, "graph string, node string, layer int, status string, reason string"), most=6)


def test_files_of_a_report_equal_the_rendered_columns(spark, tmp_path):
    r = runs(spark).where("graph like 'g_'").withColumn("risk", F.upper("risk"))
    reports.write_reports(reports.files_of(r, "graph").repartition(4), f"{tmp_path}/out")
    want = {f"{x.graph}.{ext}": x[c] for x in r.collect() for c, ext in (("markdown", "md"), ("html", "html"), ("json", "json"))}
    there = sorted(os.listdir(f"{tmp_path}/out"))
    assert there == sorted([*want, "_SUCCESS"])
    assert {n: open(f"{tmp_path}/out/{n}").read() for n in want} == want
    assert json.load(open(f"{tmp_path}/out/_SUCCESS"))["files"] == 15
    odd = runs(spark).where("graph like '%&%'").first()
    assert "a&lt;b" in odd.html and "<b" not in odd.html.replace("<b>", "") and json.loads(odd.json)["skills"][0]["node"] == "a<b" and odd.risk == "low"


def test_a_task_that_runs_again_leaves_no_second_file(spark, tmp_path):
    """A task fails after its first file, and runs again to the end."""
    class Once(reports.ReportWriter):
        def write(self, iterator):
            done = 0
            def some():
                nonlocal done
                for row in iterator:
                    if done and not os.path.exists(f"{self.path}/../failed"):
                        open(f"{self.path}/../failed", "w").close()
                        raise OSError("lost")
                    done += 1
                    yield row
            return super().write(some())

    writer = Once(f"{tmp_path}/out")
    data = [{"name": f"f{k}.md", "content": f"text {k}"} for k in range(5)]
    with pytest.raises(OSError):
        writer.write(iter(data))
    writer.commit([writer.write(iter(data)), None])
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["_SUCCESS", *(f"f{k}.md" for k in range(5))]
    assert json.load(open(f"{tmp_path}/out/_SUCCESS")) == {"files": 5, "bytes": 30}
    with pytest.raises(ValueError):
        writer.write(iter([{"name": "../x", "content": ""}]))


def test_mermaid_draws_the_strongest_edges(spark):
    e = spark.createDataFrame([("p", "a", "b", 0.5), ("p", "a", "c", 0.25), ("p", "b", "c", 0.75), ("q", "x", "y", 1.0)], "project string, a string, b string, w double")
    out = {r.project: r.mermaid for r in reports.mermaid(e, "project", "a", "b", "w", most=2).collect()}
    assert out == {"p": "graph LR\n  b -- 0.75 --> c\n  a -- 0.5 --> b", "q": "graph LR\n  x -- 1.0 --> y"}


def test_lines_go_to_files_that_end_by_size(spark, tmp_path):
    path = f"{tmp_path}/log"
    batch = lambda days, n, start: spark.createDataFrame([(f"{d} 00:{k // 60:02}:{k % 60:02}", start + k, "x" * (k % 40)) for d in days for k in range(n)], "started_at string, id int, text string").withColumn("started_at", F.to_timestamp("started_at"))
    first, second = batch(["2024-01-01", "2024-01-02"], 60, 0), batch(["2024-01-02", "2024-01-03"], 30, 100)
    store.append_lines(first, path, most_bytes=1000)
    store.append_lines(second, path, most_bytes=1000)
    files = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".txt"):
                day, no = (x.split("=")[1] for x in folder.split("/")[-2:])
                assert (day, int(no)) not in files
                files[day, int(no)] = open(f"{folder}/{n}").read().splitlines()
    assert all(sum(len(x) + 1 for x in lines[:-1]) < 1100 for lines in files.values())
    for day, count in (("2024-01-01", 60), ("2024-01-02", 90), ("2024-01-03", 30)):
        numbers = sorted(n for d, n in files if d == day)
        assert numbers == list(range(1, len(numbers) + 1)) and sum(len(files[day, n]) for n in numbers) == count and len(numbers) > 1
        ids = [[json.loads(x)["id"] for x in files[day, n]] for n in numbers]
        assert all(max(a) < min(b) for a, b in zip(ids, ids[1:]))
    with pytest.raises(ValueError):
        store.append_lines(first, path, most_bytes=10, most_files=20)
    assert len(spark.read.text(path).collect()) == 180


def test_export_summary_counts_lines_of_the_text(spark):
    from tracemill.operators import export

    text = "--- a/src/x/a.rs\n+++ b/src/x/b.rs\n@@ -1 +1 @@\n+one\n-two\n++ three\n+++ b/crates/k/c.rs\n--- no header\n same"
    got = {r.diff_id: tuple(r)[1:] for r in export.summary(spark.createDataFrame([(1, text), (2, " \n\t"), (3, None), (4, "+++ b/README")], "diff_id int, diff string")).collect()}
    assert got[1] == (["crates/k/c.rs", "src/x/a.rs", "src/x/b.rs"], 2, 1, len(text), ["crates/k", "src/x"])
    assert got[2] == got[3] == ([], 0, 0, 0, []) and got[4] == (["README"], 0, 0, 12, ["."])


def test_cases_meet_within_their_task(spark, monkeypatch):
    from tracemill.operators import validate
    from tracemill.sources import generated

    pair = lambda rows: spark.createDataFrame(rows, "case_id string, name string, categories array<string>")
    e = pair([("a", "get_user", []), ("a", "zzz", []), ("b", "get_user", []), ("b", None, [])])
    a = pair([("a", "user_put", []), ("a", "put_user", []), ("a", None, [])])
    out = validate.best_matches(e, a)
    assert {tuple(r) for r in out.collect()} == {("a", "get_user", "put_user", 1 / 3), ("a", "zzz", None, 0.0), ("b", "get_user", None, 0.0), ("b", None, None, 0.0)}
    monkeypatch.setattr(generated, "ITEMS_A_TASK", 100)
    cases = generated.cases(spark, "/root/testdata/sf0.001")
    assert "Window" not in validate.best_matches(*cases)._jdf.queryExecution().executedPlan().toString()
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert [c.rdd.getNumPartitions() for c in cases] == [-(-items // 100)] * 2
