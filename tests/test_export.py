"""Symbols of a diff by language, their line numbers and modules; rules of degradation."""

import pytest

from tracemill.operators import export, history

CASES = [
    ("a.rs", "pub(crate) async fn go_on<T>(", ("go_on", "fn")), ("a.rs", "// struct Old", ("Old", "struct")), ("a.rs", "  enum E {", ("E", "enum")), ("a.rs", "impl <T> Tr for X", ("Tr", "impl")),
    ("a.rs", "impl Tr for X", ("Tr", "impl")), ("a.rs", "mod m;", ("m", "module")), ("a.rs", "pub mod m;", None), ("a.rs", "type A = B;", ("A", "type")), ("a.rs", "const K: u8 = 1;", ("K", "const")),
    ("a.py", "async def f (x):", ("f", "fn")), ("a.py", "def f", None), ("a.py", "@wraps(f)", ("wraps", "method")), ("a.py", "  MAX_1 = 2", ("MAX_1", "const")), ("a.py", "A = 2", None), ("a.py", "class C:", ("C", "class")),
    ("a.ts", "const f = (a, b) => 1", ("f", "=>")), ("a.jsx", "const f = x => 1", ("f", "=>")), ("a.js", "const g = function (", ("g", "fn")), ("a.tsx", "interface I {", ("I", "interface")),
    ("a.ts", "type T = 1", ("T", "type")), ("a.ts", "export const Z: T", ("Z", "const")), ("a.ts", "export default function D<T>(", ("D", "fn")), ("a.ts", "    run(a) {", None), ("a.ts", "const q = 1", None),
    ("a.go", "func F(", ("F", "fn")), ("a.go", "func (r *Recv) Get(", ("Get", "method")), ("a.go", "type S struct {", ("S", "struct")), ("a.go", "type I interface {", ("I", "interface")), ("a.go", "type N int", ("N", "type")),
    ("a.go", "type N = int", None), ("a.go", "var v int", ("v", "const")),
    ("a.TS", "class C", ("C", "class")), ("README", "def f", ("f", "fn")), ("rs", "struct S", None), ("x.rs.bak", "enum E", None), ("a.java", "function f", ("f", "fn")),
    ("a.rs", "fn größe(", ("größe", "fn")), ("a.rs", "", None),
]


def test_symbols_by_language(spark):
    rows = [(i, f, c) for i, (f, c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, file string, content string")
    got = {r.i: r.s and tuple(r.s) for r in df.select("i", export.symbol(df.file, df.content).alias("s")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


DIFF = """diff --git a/src/a.rs b/src/a.rs
--- a/src/a.rs
+++ b/src/a.rs
@@ -1,3 +10,3 @@ fn head
 fn kept
-fn gone()
+fn here()
@@ -50 +60 @@
+struct S
--- a/crates/k/x/old.rs
+++ /dev/null
@@ -1 +0,0 @@
-enum E
"""


def test_lines_files_and_modules(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, ""), (4, "--- a/lib.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-class C:"), (5, "+class D")], "diff_id int, diff string")
    found = export.symbols(df)
    got = sorted(tuple(r) for r in found.select("diff_id", "file", "module", "name", "kind", "action", "line").collect())
    # A removed file keeps the last new path; each line of a hunk counts, and its first is the start plus one.
    assert got == sorted([
        (1, "src/a.rs", "src/a.rs", "gone", "fn", "removed", 12), (1, "src/a.rs", "src/a.rs", "here", "fn", "added", 13), (1, "src/a.rs", "src/a.rs", "S", "struct", "added", 61),
        (1, "src/a.rs", "src/a.rs", "E", "enum", "removed", 1), (4, "lib.py", "lib.py", "C", "class", "removed", 1), (5, "unknown", "unknown", "D", "class", "added", 1),
    ])
    assert export.impact(found).count() == 0
    assert {tuple(r) for r in export.by_module(found).collect()} == {(1, "src/a.rs", 2, 2), (4, "lib.py", 0, 1), (5, "unknown", 1, 0)}


@pytest.mark.parametrize(
    ("before", "after", "rules", "verdict"),
    [
        ((10, 10, 10, 0, True, 0.9), (20, 20, 30, 0, True, 0.6), "", "Pass"),  # at each bound, none over it
        ((10, 10, 10, 0, True, 0.9), (21, 21, 31, 1, False, 0.5), "R001,R002,R003,R004,R005,R006", "Degraded"),
        ((10, 10, 10, 2, True, 0.9), (10, 10, 10, 3, True, 0.9), "R005", "Watch"),
        ((10, 10, 10, 0, True, 0.9), (10, 10, 10, 0, True, 0.1), "R006", "Pass"),
        ((0, 0, 0, 0, False, 0.5), (9, 9, 9, 0, True, 0.9), "", "Pass"),  # growth from zero is 100 percent
        ((10, None, 10, None, None, None), (None, 99, 99, 5, False, 0.1), "R003", "Watch"),
    ],
)
def test_degradations(spark, before, after, rules, verdict):
    names = "n_toolcalls double, duration_ms double, n_tokens double, network_calls double, validated boolean, confidence double"
    cast = lambda t: tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in t)
    rows = [("t", 1, "e1", *cast(before)), ("t", 2, "e2", *cast(after)), ("alone", 1, "e3", *cast(after))]
    got = history.degradations(spark.createDataFrame(rows, f"task_id string, trial int, eval_id string, {names}")).collect()
    assert [tuple(r) for r in got] == [("t", "e1", "e2", rules, verdict)]


def test_module_symbols_in_one_pass(spark):
    rows = [(1, "m", "f", f"n{i}", "fn", "removed" if i % 3 else "added", i) for i in range(9)] + [(1, "x", "f", "y", "fn", "removed", 1), (2, "m", "f", "z", "fn", "added", 1)]
    found = spark.createDataFrame(rows, "diff_id int, module string, file string, name string, kind string, action string, line bigint")
    out = export.module_symbols(found)
    assert {tuple(map(str, r)) for r in out.collect()} == {("1", "m", "3", "6", "['n0', 'n3', 'n6', 'n1', 'n2']"), ("1", "x", "0", "1", "['y']"), ("2", "m", "1", "0", "['z']")}
    assert out.columns == ["diff_id", "module", "n_added", "n_removed", "symbols"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
