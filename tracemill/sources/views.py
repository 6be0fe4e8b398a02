"""The domain's tables as views over star-schema tables: tool calls, traces, commits and evaluation trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import case

# Tools of a category by k modulo 3, extensions likewise.
TOOLS = {"locate": ("read", "grep", "web_search"), "modify": ("write", "edit", "bash"), "verify": ("test", "cargo", "check"), "commit": ("commit", "git", "push"), "other": ("think", "plan", "ask")}
EXTENSIONS = (".rs", ".py", ".md")
DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, idx, ts, tool_name, args, duration_ms, k: one trace per user of events."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("user_id", "event_id", "ts", "event_type", k.alias("k"), F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"))
    e = e.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))
    turn = ((F.col("user_id") + F.floor(F.col("idx") / 12)) % 5).cast("int")
    names = [*TOOLS]
    kind = F.when((F.col("event_type") == "error") & (F.col("k") < 20), "verify").otherwise(F.element_at(F.array(*map(F.lit, ("locate", "modify", "verify", "commit", "other"))), turn + 1))
    tool = case(*((F.col("kind") == n, F.element_at(F.array(*map(F.lit, TOOLS[n])), F.col("k") % 3 + 1)) for n in names), otherwise=F.lit("ask"))
    path = F.concat(F.lit("src/m"), (F.floor(F.col("idx") / 20) % 4).cast("string"), F.lit("/f"), F.col("k").cast("string"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), F.col("k") % 3 + 1))
    e = e.withColumn("kind", kind)
    return e.select(F.col("user_id").alias("trace_id"), "idx", "ts", tool.alias("tool_name"), F.to_json(F.struct(path.alias("path"))).alias("args"), path.alias("path"), "duration_ms", "k")


def traces(calls: DataFrame) -> DataFrame:
    """One row per trace with its tokens and times."""
    return calls.groupBy("trace_id").agg(F.count("*").alias("n_calls"), F.sum("k").alias("tokens"), F.sum("duration_ms").alias("duration_ms"), F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.array_sort(F.collect_set("tool_name")).alias("tools"))


def capability_of(trace_id):
    return F.concat(F.lit("cap_"), F.lpad((trace_id % 12).cast("string"), 2, "0"))


def commit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_hash, capability, file, session_id: one row per line item."""
    li, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    out = li.select("l_orderkey", "l_partkey", "l_suppkey").join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    out = out.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return out.select(F.col("l_orderkey").alias("commit_hash"), F.col("p_brand").alias("capability"), F.col("l_suppkey").alias("file"), F.col("o_custkey").alias("session_id"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, trial, eval_id, outcome, metric: one task per customer of orders."""
    o = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    outcome = case((F.col("o_orderstatus") == "F", "Pass"), (F.col("o_orderstatus") == "O", "Fail"), otherwise="Partial")
    return o.select(F.col("o_custkey").alias("task_id"), F.row_number().over(order).alias("trial"), F.col("o_orderkey").alias("eval_id"), outcome.alias("outcome"), F.col("o_totalprice").alias("metric"), F.col("o_orderpriority").alias("grader"))
