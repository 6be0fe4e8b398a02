"""Lines of diffs fall apart within their row, and generated diffs are dealt to tasks by the number of their items."""

from pyspark.sql import functions as F

from tracemill.operators import diffs
from tracemill.plans import queries
from tracemill.sources import generated

SF = "/root/testdata/sf0.001"
ODD = "\r\n".join([
    "@@ -7 +9,2 @@ before any file", " a", "--- x", "\\ No newline at end of file", "+b",
    "diff --git a/p b/q", "rename from p", "rename to r", "--- a/p", "+++ b/q", "+++ b/late", "@@ none @@", "-gone", "+new", "",
    "diff --git a/s b/t", "deleted file mode 100644", "--- a/s", "+++ /dev/null", "@@ -3,2 +0,0 @@", "-1", " 2", "-3", "+4", "@@ -30 +40 @@", "+5", " 6",
    "diff --git a/n b/m", "new file mode 1",
])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_odd_diffs(spark):
    df = spark.createDataFrame([(1, ODD), (2, None), (3, ""), (4, "+no hunk\ndiff --git"), (5, "diff --git a/x.py b/x.py\n@@ -1 +1 @@")], "diff_id int, diff string")
    got = diffs.lines(df, numbered=True).collect()
    want = [
        (0, None, "modified", 0, 7, 9, 0, "ctx", "a", 9), (0, None, "modified", 0, 7, 9, 1, "del", "-- x", 8), (0, None, "modified", 0, 7, 9, 3, "add", "b", 10),
        (1, "q", "renamed", 0, None, None, 0, "del", "gone", None), (1, "q", "renamed", 0, None, None, 1, "add", "new", None),
        (2, "s", "deleted", 0, 3, 0, 0, "del", "1", 3), (2, "s", "deleted", 0, 3, 0, 1, "ctx", "2", 0), (2, "s", "deleted", 0, 3, 0, 2, "del", "3", 5), (2, "s", "deleted", 0, 3, 0, 3, "add", "4", 1),
        (2, "s", "deleted", 1, 30, 40, 0, "add", "5", 40), (2, "s", "deleted", 1, 30, 40, 1, "ctx", "6", 41),
    ]
    cols = ("file_no", "file", "change", "hunk_idx", "old_start", "new_start", "line_idx", "line_kind", "content", "line_no")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == sorted(want, key=str)
    again = diffs.line_numbers(diffs.lines(df))
    assert sorted(map(str, again.select(*got[0].__fields__).collect())) == sorted(map(str, got))


def test_lines_need_no_shuffle(spark):
    p = plan(diffs.lines(generated.diffs(spark, SF).limit(0).unionAll(spark.createDataFrame([(1, ODD)], "diff_id bigint, diff string")), numbered=True))
    assert "Window" not in p
    assert "Window" not in plan(queries.diff_lines(spark, SF)) and plan(queries.diff_lines(spark, SF)).count("Exchange hash") == 2


def test_a_task_holds_so_many_items_at_any_size(spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(generated, "ITEMS_A_TASK", 100)
    d = generated.diffs(spark, SF)
    assert d.rdd.getNumPartitions() == -(-items // 100)
    sizes = diffs.lines(d).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 400
