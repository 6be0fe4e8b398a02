from tracemill.operators import dashboard


def test_linked_symbols(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (None, "a"), (None, "b"), (4, None), (4, "a")]
    out = dashboard.linked_symbols(spark.createDataFrame(rows, "file int, symbol string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert "Join" not in plan and plan.count("Exchange hash") == 2  # by file, then by symbol; pairs don't travel
