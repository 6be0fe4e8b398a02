import random

from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.plans import queries


def test_quick_round_is_round(spark):
    r = random.Random(3)
    xs = [r.uniform(-2, 2) for _ in range(20_000)] + [k / 2e5 + e for k in range(-3001, 3001) for e in (0.0, 1e-12, -1e-12, 1e-17)] + [0.0, -0.0, 1e300, -7e12, 123456.000005, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    df = df.select("x", X.quick_round(F.col("x"), 5).alias("got"), F.round("x", 5).alias("want"))
    assert df.where("not (got <=> want)").collect() == []


def test_pairs_are_dealt_to_all_cores_and_rounded_in_bulk(spark):
    plan = queries.vector_similarity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan and "FLOOR" in plan
