"""Near-duplicate vectors by cosine: PCA-ordered tiled comparison with residual bounds.

Equal vectors form a class first, so copies cost nothing in what follows. The unit vectors are turned to principal axes, fitted on
a bounded sample (`sample`; they steer the order of work, never the result), and dealt to leaves of a tree that cuts the
sample along its leading axes, at gaps, large leaves in chunks of at most `tile_bytes`. Each leaf knows the ranges of the leading
coordinates and of the norms of what is left, over all its vectors; pairs of leaves whose ranges are too far apart for the
threshold are never met. Each other pair of tiles is one task. There products over the leading axes are accumulated, the
product of the suffix norms bounds what is left, and pairs that cannot reach the threshold are dropped axis group by axis
group. What survives is confirmed in double precision on the vectors as given. A task returns one row per linked
vector - its links, weighted by copies, and a local root - so a dense group yields rows in its size, not its square.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
lengths don't link. Null ids link but never name a component. Empty tables give no rows. Repeated rows are copies, and link with
each other. Other columns are ignored, so their names can't clash. Equal vectors are found by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import attach, map_batches, ship, stash
from .vectors import finite

SLACK = 1e-5  # covers single precision in the first pass


def axes(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Principal axes, widest spread first, by vector length."""
    out = {}
    for d in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == d], dtype=np.float64)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


def close_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, lead: int = 16, strip: int = 512):
    """Yields index arrays (i, j) of the pairs of rows with cosine >= threshold."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    pa, pb = (a / na[:, None]) @ basis, (b / nb[:, None]) @ basis
    d = pa.shape[1]
    cuts = [c for c in (lead, 2 * lead, 4 * lead) if c < d]
    rest = lambda p, c: np.sqrt((p[:, c:] ** 2).sum(axis=1))
    first = cuts[0] if cuts else d
    left, right = (np.column_stack([p[:, :first], rest(p, first)]).astype(np.float32) for p in (pa, pb))
    for at in range(0, len(a), strip):
        i, j = np.nonzero(left[at : at + strip] @ right.T >= threshold - SLACK)  # leading products plus the bound
        i += at
        done = np.zeros(len(i))
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            done += np.einsum("ij,ij->i", pa[i, lo:hi], pb[j, lo:hi])
            alive = done + rest(pa, hi)[i] * rest(pb, hi)[j] >= threshold - SLACK
            i, j, done = i[alive], j[alive], done[alive]
        for part in range(0, len(i), 1 << 17):
            x, y = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            cos = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            yield x[cos >= threshold], y[cos >= threshold]


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees that the pairs connect, in place; roots are least indexes."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root[:] = root[root]


@dataclass
class Leaves:
    """A tree over the leading coordinates of vectors of one length: inner nodes as (axis, cut, left, right), leaves negative."""

    basis: np.ndarray
    lead: int
    nodes: list[tuple[int, float, int, int]] = field(default_factory=list)
    size: int = 0

    def grow(self, p: np.ndarray, least: int) -> int:
        """The node for sample coordinates p: cut in the widest gap of the middle half, until a part would be smaller than `least`."""
        gap, axis, cut = 0.0, 0, 0.0
        for k in range(p.shape[1] if len(p) >= 2 * least else 0):
            x = np.sort(p[:, k])
            steps = np.diff(x[len(x) // 4 : len(x) - len(x) // 4])
            if len(steps) and (wide := steps.max() + 0.01 * (x[-1] - x[0])) > gap and steps.max() > 0:
                gap, axis, cut = wide, k, float(x[len(x) // 4 + steps.argmax() + 1])
        if not gap:
            self.size += 1
            return -self.size
        low = p[:, axis] < cut
        at = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        self.nodes[at] = (axis, cut, self.grow(p[low], least), self.grow(p[~low], least))
        return at

    def coordinates(self, m: np.ndarray) -> np.ndarray:
        """Leading coordinates of the unit vectors, and the norm of what is left."""
        p = (m / np.sqrt((m * m).sum(axis=1))[:, None]) @ self.basis[:, : self.lead]
        return np.column_stack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))])

    def of(self, c: np.ndarray) -> np.ndarray:
        at = np.zeros(len(c), dtype=np.int64) if self.nodes else np.full(len(c), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            axis, cut, low, high = (np.array(x)[at[inner]] for x in zip(*self.nodes, strict=True))
            at[inner] = np.where(c[inner, axis] < cut, low, high)
        return -at - 1


def trees(sample: list[np.ndarray], leaves: int, lead: int = 8) -> dict[int, Leaves]:
    out = {}
    for d, basis in axes(sample).items():
        tree = out[d] = Leaves(basis, min(lead, d))
        c = tree.coordinates(np.array([v for v in sample if len(v) == d], dtype=np.float64))
        tree.grow(c[:, : tree.lead], max(1, len(c) // leaves))
    return out


def dealt(classes: DataFrame, forest: dict[int, Leaves], rows: int = 512) -> DataFrame:
    """id, extra, v to blocks of one leaf and length, with the ranges of their coordinates. Lengths that the sample lacks have one leaf."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, {}

        def block(key: tuple[int, int]) -> dict[str, list]:
            nonlocal number
            ids, extra, m, c = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            number += 1
            return {"block": [number], "dim": [key[0]], "leaf": [key[1]], "n": [len(ids)], "low": [c.min(axis=0)], "high": [c.max(axis=0)], "ids": [ids.astype("<i8").tobytes()], "extra": [extra.astype("<i8").tobytes()], "data": [m.tobytes()]}

        for b in batches:
            ids, extra, vs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            flat, off = vs.values.to_numpy(zero_copy_only=False), vs.offsets.to_numpy()
            for d in np.unique(np.diff(off)).tolist():
                at = np.flatnonzero(np.diff(off) == d)
                m = flat[off[at][:, None] + np.arange(d)]
                tree = shared.value.get(d) or Leaves(np.eye(d), min(8, d))
                c = tree.coordinates(m.astype(np.float64))
                leaf = tree.of(c)
                for k in np.unique(leaf).tolist():
                    mine = leaf == k
                    held.setdefault((d, k), []).append((ids[at[mine]], extra[at[mine]], m[mine], c[mine]))
                    if sum(len(x[0]) for x in held[d, k]) >= rows:
                        yield block((d, k))
        for key in list(held):
            yield block(key)

    schema = "block bigint, dim int, leaf int, n int, low array<double>, high array<double>, ids binary, extra binary, data binary"
    return map_batches(classes.select("id", "extra", "v"), run, schema)


def met_tiles(blocks: DataFrame, tile_bytes: int, width: int, threshold: float) -> tuple[list[tuple], int]:
    """(dim, leaf, chunks, first tile, ranges of the tiles to meet) of each leaf, and the number of pairs of leaves passed over."""
    wide = blocks.select(F.max(F.size("low"))).first()[0] or 0
    ends = [f(F.element_at(c, k + 1)).alias(f"{c}{k}") for k in range(wide) for c, f in (("low", F.min), ("high", F.max))]
    short = blocks.withColumns({c: F.concat(c, F.array_repeat(F.lit(0.0), F.lit(wide) - F.size(c))) for c in ("low", "high")})
    rows = short.groupBy("dim", "leaf").agg(F.sum("n").alias("n"), *ends).orderBy("dim", "leaf").collect()
    chunks = [max(1, -(-r["n"] // min(width, max(512, tile_bytes // (8 * r["dim"]))))) for r in rows]
    first = np.cumsum([0, *chunks])
    low, high = (np.array([[r[f"{c}{k}"] for k in range(wide)] for r in rows]).reshape(len(rows), wide) for c in ("low", "high"))
    dims, out, passed = np.array([r["dim"] for r in rows]), [], 0
    for a, r in enumerate(rows):
        apart = np.maximum(0, np.maximum(low - high[a], low[a] - high))
        meets = ((apart * apart).sum(axis=1) <= 2 - 2 * threshold + SLACK) & (dims == r["dim"])
        passed += int((~meets & (dims == r["dim"])).sum())
        out.append((r["dim"], r["leaf"], chunks[a], int(first[a]), [(int(first[b]), int(first[b + 1]) - 1) for b in np.flatnonzero(meets)]))
    return out, passed // 2


def near_vectors(vectors: DataFrame, threshold: float = 0.9, tile_bytes: int = 16 << 20, sample: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. tile_rows: vectors in a tile, an eighth of all if that is fewer than
    tile_bytes hold."""
    spark = vectors.sparkSession
    ship(spark)
    good = finite(vec_col) & F.exists(vec_col, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(good, F.col(vec_col)).alias("v"))
    rows = rows.withColumns({f"h{k}": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), "v")) for k in (1, 2)})
    classes = rows.where("v is not null").groupBy("v", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("extra"))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("extra"), F.lit(0))).first()
    picked = classes.orderBy(F.xxhash64("id")).limit(sample).select("v").collect()
    width = tile_rows or max(1024, -(-n // 8))
    forest = trees([np.array(r[0], dtype=np.float64) for r in picked], min(1024, max(1, -(-n // width))))
    blocks = stash(dealt(classes, forest), "blocks")
    met, _ = met_tiles(blocks, tile_bytes, width, threshold)
    plan = spark.createDataFrame(met, "dim int, leaf int, chunks int, first int, meets array<struct<a: int, b: int>>")  # 1024 leaves a length at most
    tiles = blocks.drop("low", "high").join(F.broadcast(plan), ["dim", "leaf"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("block"), F.col("chunks")).cast("int"))
    cells = tiles.withColumn("t", F.explode(F.flatten(F.transform("meets", lambda x: F.sequence(x["a"], x["b"]))))).drop("meets").withColumns({"i": F.least("tile", "t"), "j": F.greatest("tile", "t")})

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        i, j, d = int(cell["i"].iloc[0]), int(cell["j"].iloc[0]), int(cell["dim"].iloc[0])
        ids, copies = (np.concatenate([np.frombuffer(x, "<i8") for x in cell[c]]) for c in ("ids", "extra"))
        m = np.concatenate([np.frombuffer(x, "<f8" if len(x) == 8 * k * d else "<f4").reshape(k, d) for k, x in zip(cell["n"], cell["data"], strict=True)]).astype(np.float64)
        tile = np.repeat(cell["tile"].to_numpy(), cell["n"].to_numpy())
        basis = forest[d].basis if d in forest else np.eye(d)
        links, root = np.zeros(len(ids)), np.arange(len(ids))
        ka, kb = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        for x, y in close_pairs(m[ka], m[kb], basis, threshold):
            x, y = ka[x], kb[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            links += np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
            join_roots(root, x, y)
        at = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[at], "links": links[at].astype(np.int64), "root": ids[root[at]]})

    found = stash(cells.groupBy("i", "j").applyInPandas(compare, "id bigint, links bigint, root bigint"), "found")
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = classes.select("id", "h1", "h2", "rep", "extra").join(groups, "id", "left").join(linked, "id", "left")
    own = own.select("h1", "h2", "rep", "extra", F.coalesce("root", "id").alias("root"), (F.col("extra") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    first = own.groupBy("root").agg(F.min("rep").alias("component_id"))
    own = stash(own.join(first, "root").drop("root", "rep"), "own")
    plain = attach(rows.select("vec_id", "h1", "h2"), own, ["h1", "h2"], "extra", total)
    out = plain.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
