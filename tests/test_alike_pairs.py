"""Pairs of repeated vectors: the same rows as pairs of single ones, in fewer bytes."""

import os
import random

from pyspark.sql import functions as F

from tracemill.functions import exprs as X
from tracemill.operators import similarity
from tracemill.operators.behaviour import VECTOR
from tracemill.plans import queries

SHARES = ("similarity", "entropy", "structural", "temporal", "density")


def plain(vecs):
    p = similarity.contributions(similarity.pairs(vecs))
    return p.select("a", "b", *((X.quick_round(F.col(c), 5) + F.lit(0.0)).alias(c) for c in SHARES))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_same_rows_as_single_vectors(spark):
    """Runs of equal vectors over several rows, equal keys, and vectors and keys that are null, zero or not a number."""
    r = random.Random(5)
    kinds = [[r.choice((0.0, 0.25, 0.5, 1.0, -0.5)) for _ in VECTOR] for _ in range(6)] + [[0.0] * 7, [None] + [1.0] * 6, [float("nan")] + [1.0] * 6]
    keys = [*range(70), 3, 3, 8, None, None]
    vecs = spark.createDataFrame([(k, *r.choice(kinds)) for k in keys], "trace_id bigint, " + ", ".join(f"{c} double" for c in VECTOR)).localCheckpoint()
    p = similarity.contributions(similarity.alike_pairs(similarity.alike(vecs, most=4)))
    got = similarity.each_pair(p.withColumns({c: X.quick_round(F.col(c), 5) + F.lit(0.0) for c in SHARES}), *SHARES)
    assert got.columns == plain(vecs).columns and rows(got) == rows(plain(vecs))


def test_repeated_vectors_take_few_bytes(spark, tmp_path):
    """Sixty copies of the traces, with shifted keys. Keys take most of the bytes here, as so few vectors differ."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    copies = events.crossJoin(spark.range(60).withColumnRenamed("id", "copy")).withColumns({"user_id": F.col("user_id") + 1500 * F.col("copy"), "event_id": F.col("event_id") + 100_000 * F.col("copy")})
    copies.drop("copy").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    size = lambda name: sum(os.path.getsize(f"{tmp_path}/{name}/{f}") for f in os.listdir(f"{tmp_path}/{name}") if f.endswith(".parquet"))
    queries.vector_similarity(spark, str(tmp_path)).coalesce(2).write.parquet(f"{tmp_path}/got")
    plain(queries.vectors_of(spark, str(tmp_path))).coalesce(2).write.parquet(f"{tmp_path}/plain")
    got, want = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("got", "plain"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert size("got") < 0.6 * size("plain")
