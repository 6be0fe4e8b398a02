"""Capabilities are decided where their changes stand."""

from tracemill.operators import rules
from tracemill.plans import queries, record_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_needs_no_more_shuffles_than_its_changes(spark):
    for q in (queries.capability_status, record_queries.declared_status):
        assert plan(q(spark, SF)).count("Exchange hash") == 2


def test_categories_of_a_change(spark):
    rows = [(1, "a", "src/x.rs", "function_removed", "login_token", "SQL todo"), (1, "b", "db/Schema", "struct_added", "f", "x"), (2, "a", None, "constant_changed", None, None), (2, "b", "x", "unknown", "f", "")]
    c = spark.createDataFrame(rows, "diff_id int, change_id string, file string, change_type string, symbol string, content string")
    got = {(r.diff_id, r.change_id): (r.name, r.status, r.categories) for r in rules.capabilities(c).collect()}
    assert got == {(1, "a"): ("login_token", "removed", ["breaking", "deprecation", "security"]), (1, "b"): ("f", "added", ["performance"]), (2, "a"): (None, "modified", []), (2, "b"): ("f", "modified", [])}
