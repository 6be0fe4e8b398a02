"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

Vectors are packed into blocks; a grid cell holds some blocks of queries and some of candidates, both bounded by
parameters. In a cell every component is a term with a posting list of the candidates where it isn't zero; a query's
weight times the postings is scattered into a dense row of scores, term after term. The k best of each row are picked by
partition selection, and merged over the cells. No pair leaves a cell but those k.

Vectors that are null or empty or hold null or non-finite components take no part. Missing components count as zero where lengths
differ. A query row is left out of its own candidates only, so repeated rows find each other. Ties go to the smaller
id, null ids last. Scores beyond 64 bits are cut to the nearest 64-bit number. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import ship, stash
from .vectors import NO_ID, finite, opened, pack_blocks

RESULT = "quid bigint, query_id bigint, vec_id bigint, score bigint"


def accumulate(queries: np.ndarray, cands: np.ndarray, group: int = 32):
    """Yields (first query, scores) for groups of queries: integer inner products with all candidates."""
    bound = np.abs(queries).sum(axis=1).max(initial=0) * np.abs(cands).max(initial=0)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object  # all exact
    exact = (lambda x: np.array([[int(y) for y in r] for r in x], dtype=object).reshape(x.shape)) if kind is object else (lambda x: x.astype(kind))
    q, terms = exact(queries), exact(np.ascontiguousarray(cands.T))
    postings = [np.flatnonzero(t) for t in terms]
    for at in range(0, len(q), group):
        part = q[at : at + group]
        scores = np.zeros((len(part), len(cands)), dtype=kind)
        for t, (rows, values) in enumerate(zip(postings, terms, strict=True)):
            for s in np.flatnonzero(part[:, t]):
                if len(rows) == len(values):
                    scores[s] += part[s, t] * values
                elif len(rows):
                    scores[s, rows] += part[s, t] * values[rows]
        yield at, scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best by (score, smaller id)."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, cell_rows: int = 8192, cell_queries: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    spark = vectors.sparkSession
    ship(spark)
    v = F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = vectors.where(finite(vec_col)).select(F.col(id_col).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("extra"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    blocks = stash(pack_blocks(rows, 512, "q", 128), "blocks")
    sizes = {r["kind"]: r["rows"] for r in blocks.groupBy("kind").agg(F.sum("n").alias("rows")).collect()}
    across, down = (-(-sizes.get(kind, 0) // most) or 1 for kind, most in (("c", cell_rows), ("q", cell_queries)))
    own = F.pmod(F.xxhash64("block"), F.when(F.col("kind") == "c", across).otherwise(down))
    over = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == "c", down).otherwise(across) - 1))
    placed = blocks.select("*", own.cast("int").alias("own"), over.alias("other"))
    cells = placed.withColumns({"i": F.when(F.col("kind") == "c", F.col("own")).otherwise(F.col("other")), "j": F.when(F.col("kind") == "c", F.col("other")).otherwise(F.col("own"))})

    def score(cell: pd.DataFrame) -> pd.DataFrame:
        width, out = int(cell["dim"].max()), []
        quids, qids, _, q = opened(cell[cell["kind"] == "q"], width)
        uids, ids, _, c = opened(cell[cell["kind"] == "c"], width)
        where = {u: n for n, u in enumerate(uids.tolist())}
        for at, scores in accumulate(q, c):
            for s, (u, i) in enumerate(zip(quids[at : at + len(scores)].tolist(), qids[at : at + len(scores)].tolist(), strict=True)):
                mine = where.get(u)
                n = best(scores[s], ids, k + (mine is not None))
                out += [(u, i, None if ids[m] == NO_ID else int(ids[m]), max(-(2**63), min(2**63 - 1, int(scores[s, m])))) for m in n if m != mine][:k]
        return pd.DataFrame({c: pd.array([r[n] for r in out], dtype="Int64") for n, c in enumerate(("quid", "query_id", "vec_id", "score"))})

    found = cells.groupBy("i", "j").applyInPandas(score, RESULT)
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
