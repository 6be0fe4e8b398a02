"""Connected components of a link table, by hooking to a randomly ranked least neighbour and contracting.

Each round hooks every node to its neighbour of least random rank (an aggregate, combined before the shuffle), follows
the pointers four steps, and rewrites the links between the trees' tops; links inside a tree vanish. Random ranks make
chains and stars shrink alike, so a few rounds suffice. Rounds are written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stash, unstash


def components(links: DataFrame) -> DataFrame:
    """links: a, b bigint without nulls. Returns (id, root) for each id in a link; the root is some member of its component."""
    e = stash(links.select("a", "b").where("a <> b").distinct(), "links")
    hops: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        tree = stash(least.select(F.col("a").alias("id"), F.least("m", own)["id"].alias("up")), "hook")
        top = tree
        for _ in range(2):
            step = top.select(F.col("id").alias("up"), F.col("up").alias("next"))
            top = top.join(step, "up").select("id", F.col("next").alias("up"))
        top = stash(top, "top")
        hops.append(top)
        a = top.select(F.col("id").alias("a"), F.col("up").alias("ua"))
        b = top.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        left = e.join(a, "a").join(b, "b").where("ua <> ub")
        after = stash(left.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
        unstash(e, tree)
        e = after
    if not hops:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = hops[0].select("id", F.col("up").alias("root"))
    for hop in hops[1:]:
        step = hop.select(F.col("id").alias("root"), F.col("up").alias("next"))
        out = out.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return out
