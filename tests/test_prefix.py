import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import prefix

ROWS = [(k, (k * 7919) % 101 - 50 if k % 11 else None, random.Random(k).choice(["a", "b", None, "c"]), k % 5 if k % 7 else None) for k in range(700)]
SCHEMA = "id int, v int, g string, x int"


def key(up):
    return lambda v: ((v is not None), v or 0) if up else ((v is None), -(v or 0))


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_running_sums_equal_those_of_a_loop(spark, ranges):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    for spec, sort in ((["v", "id"], lambda r: (key(True)(r[1]), r[0])), (["v desc", "id"], lambda r: (key(False)(r[1]), r[0])), (["id desc"], lambda r: -r[0])):
        out = prefix.running(df, spec, {"n": F.lit(1), "total": F.col("x")}, ranges=ranges).collect()
        want, n, total = {}, 0, 0
        for r in sorted(ROWS, key=sort):
            n, total = n + 1, total + (r[3] or 0)
            want[r[0]] = (n, total)
        assert {r.id: (r.n, r.total) for r in out} == want


@pytest.mark.parametrize("ranges", [1, 9, 64])
def test_groups_start_anew(spark, ranges):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = prefix.running(df, ["id"], {"n": F.lit(1)}, by=["g"], ranges=ranges).collect()
    seen = {}
    want = {}
    for r in ROWS:
        seen[r[2]] = want[r[0]] = seen.get(r[2], 0) + 1
    assert {r.id: r.n for r in out} == want


def test_ties_repeated_rows_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, None), (2, 5), (2, 5)], "k int, v int")
    out = sorted((r.k is not None, r.n, r.total) for r in prefix.running(df, ["k"], {"n": F.lit(1), "total": F.col("v")}, ranges=4).collect())
    assert [x[:2] for x in out] == [(False, 1), (False, 2), (True, 3), (True, 4), (True, 5)] and out[-1][2] == 12
    assert prefix.running(df.where("false"), ["k"], {"n": F.lit(1)}).count() == 0
    with pytest.raises(ValueError):
        prefix.running(df.withColumn("_range", F.lit(1)), ["k"], {"n": F.lit(1)})


def test_no_range_holds_most_rows(spark):
    """One group has half of all rows; its rows lie in many ranges."""
    df = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE cast(id as string) END AS g")
    part = df.withColumn("p", prefix.range_of(df, ["g", "id"], 16)).groupBy("p").count().collect()
    assert len(part) == 16 and max(r["count"] for r in part) < 3 * 20_000 / 16


def test_files_roll_and_budgets_end(spark):
    sizes = [5, 0, 90, 20, 300, 1, None, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, size int")
    out = {r.id: (r.running_bytes, r.file_no) for r in prefix.rolled(df, ["id"], F.col("size"), 100, ranges=3).collect()}
    ends = list(itertools.accumulate(s or 0 for s in sizes))
    assert out == {k: (e, (e - (s or 0)) // 100 + 1) for k, (e, s) in enumerate(zip(ends, sizes, strict=True))}
    assert {r.id for r in prefix.within_budget(df, ["id"], F.col("size"), 115, ranges=3).collect()} == {0, 1, 2, 3}


def test_rows_are_shuffled_once(spark):
    """One exchange of rows; what meets in one place is a row a range."""
    df = spark.range(1000).selectExpr("id", "id % 10 AS v")
    plan = prefix.running(df, ["id"], {"n": F.lit(1)}, ranges=4)._jdf.queryExecution().executedPlan().toString().splitlines()
    below = {k: next(x for x in plan[k + 1 :] if "+-" in x) for k, x in enumerate(plan) if " Exchange " in x}
    assert sum("HashAggregate" not in x for x in below.values()) == 1
