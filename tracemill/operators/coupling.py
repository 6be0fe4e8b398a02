"""Co-change of capabilities: evidence from commits, files and sessions, coupling edges, pruning and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .similarity import contributions, pairs


def both_ways(df: DataFrame, key: str) -> DataFrame:
    """Pairs of capabilities that share a key: cap_a, cap_b, key. Rows per key are the square of its capabilities, of which there are few."""
    d = df.select(key, "capability").distinct()
    a, b = d.withColumnRenamed("capability", "cap_a"), d.withColumnRenamed("capability", "cap_b")
    return a.join(b, key).where("cap_a < cap_b")


def commit_scores(links: DataFrame) -> DataFrame:
    """Weighted share of commits that hold both; batch commits weigh less."""
    d = links.select("commit_hash", "capability").distinct()
    size = d.groupBy("commit_hash").agg(F.count("*").alias("caps"))
    n = d.select("commit_hash").distinct().agg(F.count("*").alias("n_commits"))
    weight = F.when(F.col("caps") > 1, 1.0 / (1.0 + F.log(F.col("caps").cast("double")))).otherwise(1.0)
    p = both_ways(links, "commit_hash").join(size, "commit_hash").groupBy("cap_a", "cap_b").agg(F.count("*").alias("cooccur"), F.sum(weight).alias("w"))
    return p.join(F.broadcast(n)).select("cap_a", "cap_b", "cooccur", X.ratio(F.col("w"), F.col("n_commits")).alias("commit_score"))


def file_scores(links: DataFrame) -> DataFrame:
    """Jaccard of the files that the commits of each touch, by counts: a shared file is a row of the join."""
    d = links.select("capability", "commit_hash").distinct().join(links.select("commit_hash", "file").distinct(), "commit_hash").select("capability", "file").distinct()
    n = d.groupBy("capability").agg(F.count("*").alias("n"))
    both = both_ways(d, "file").groupBy("cap_a", "cap_b").agg(F.count("*").alias("shared"))
    j = both.join(n.select(F.col("capability").alias("cap_a"), F.col("n").alias("na")), "cap_a").join(n.select(F.col("capability").alias("cap_b"), F.col("n").alias("nb")), "cap_b")
    return j.select("cap_a", "cap_b", X.ratio(F.col("shared"), F.col("na") + F.col("nb") - F.col("shared")).alias("file_score"))


def session_scores(links: DataFrame) -> DataFrame:
    s = links.where("session_id is not null")
    n = s.select("session_id").distinct().agg(F.count("*").alias("n"))
    both = both_ways(s, "session_id").groupBy("cap_a", "cap_b").agg(F.count("*").alias("shared"))
    return both.join(F.broadcast(n)).select("cap_a", "cap_b", X.ratio(F.col("shared"), F.sqrt(F.col("n").cast("double"))).alias("session_score"))


def cochange(links: DataFrame) -> DataFrame:
    """All pairs with any shared evidence, and the fused score ln(1 + commit + 1.5 file + 0.5 session)."""
    j = commit_scores(links).join(file_scores(links), ["cap_a", "cap_b"], "full").join(session_scores(links), ["cap_a", "cap_b"], "full")
    j = j.fillna(0.0, ["commit_score", "file_score", "session_score"]).fillna(0, ["cooccur"])
    return j.withColumn("fused", F.log1p(F.col("commit_score") + 1.5 * F.col("file_score") + 0.5 * F.col("session_score")))


def fused_from_counts(n, sessions):
    """The score where only counts are known."""
    return F.log1p(X.ratio(n, F.sqrt(sessions.cast("double"))))


def edges(vecs: DataFrame, evidence: DataFrame, lam: float = 0.3) -> DataFrame:
    """vecs by capability: coupling edges of all pairs; without evidence the score is 0. The strength is clamped to [0, 0.5]."""
    lam = min(max(lam, 0.0), 0.5)
    p = contributions(pairs(vecs, "capability")).select(F.col("a").alias("cap_a"), F.col("b").alias("cap_b"), "similarity", "entropy", "structural", "temporal", "density")
    e = p.join(evidence.select("cap_a", "cap_b", "fused"), ["cap_a", "cap_b"], "left").fillna(0.0, ["fused"])
    return e.withColumn("correlation", F.col("fused") * (1.0 + lam * F.col("similarity")))


def prune(e: DataFrame, eps: float = 0.01, purity: float = 0.3, k: int = 20) -> DataFrame:
    """Existence, purity, then the k strongest edges out of or into each capability."""
    pure = X.ratio(F.col("fused"), F.col("fused") + F.col("similarity") * 0.3 + 1e-6)
    e = e.where((F.col("fused") > eps) & (F.abs("fused") >= 1e-6) & (pure >= purity))
    rank = lambda c, other: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("correlation"), other))
    return e.withColumns({"_o": rank("cap_a", "cap_b"), "_i": rank("cap_b", "cap_a")}).where((F.col("_o") <= k) | (F.col("_i") <= k)).drop("_o", "_i")


def stable(e: DataFrame, seen: DataFrame, least: float) -> DataFrame:
    """Opt-in: edges seen in at least a share of the traces; seen: cap_a, cap_b, n_traces, total."""
    return e.join(seen.where(X.ratio(F.col("n_traces"), F.col("total")) >= least).select("cap_a", "cap_b"), ["cap_a", "cap_b"], "left_semi")


def threshold_prune(e: DataFrame, least: float) -> DataFrame:
    return e.where(F.col("correlation") >= least)


def incident(e: DataFrame) -> DataFrame:
    """Each edge seen from both ends."""
    out = e.select(F.col("cap_a").alias("capability"), F.col("cap_b").alias("other"), F.lit("out").alias("direction"), "correlation")
    return out.unionByName(e.select(F.col("cap_b").alias("capability"), F.col("cap_a").alias("other"), F.lit("in").alias("direction"), "correlation"))


def strength(e: DataFrame) -> DataFrame:
    c = F.col("correlation")
    return incident(e).groupBy("capability").agg(F.count("*").alias("n_edges"), F.sum(c).alias("total"), F.greatest(F.lit(0.0), F.max(c)).alias("strongest"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("spread"))


def impact(e: DataFrame, capability: str, top: int = 10) -> DataFrame:
    """The strongest couplings of one capability."""
    return incident(e).where(F.col("capability") == capability).orderBy(F.desc("correlation"), "other").limit(top).select("other", "direction", "correlation")


def strongest(e: DataFrame, top: int = 10) -> DataFrame:
    return e.orderBy(F.desc("correlation"), "cap_a", "cap_b").limit(top)
