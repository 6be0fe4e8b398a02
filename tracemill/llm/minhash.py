"""Near-duplicate documents by chosen-path set similarity join on word shingles.

Every text's distinct shingles give a class id (equal sets: one class) and `positions` minwise tokens of 8 bits. In each of
`trees` independent trees a document walks from the root: a node chooses tokens (position and value) with probability
1 / (threshold * positions) each, by a hash of the path, and the document goes to the child of each chosen token; it does
so `depth` times. A pair at the threshold shares one child per node on average, and so meets in a tree with probability
0.31 at depth 4; 32 trees miss it with probability 1e-5, and closer pairs less often. Depth and number of trees grow with the
number of documents (`forest`).

Nodes are compared in passes. In two star passes each document meets the least member among its nodes that lies in another
group, and confirmed links merge groups. Then only nodes whose members lie in different groups are left (a node of copies of
one text has dropped out whatever its size). They are compared exhaustively, in cells of bounded size and across groups
only, on sketches: documents with a partner in sight form families, and the full sets of a family are compared in cells,
until its links are known. Sketches drop pairs whose estimate lies four standard deviations below the threshold or whose
sizes exclude it; every link is confirmed on full sets of 64-bit shingle hashes. No pass emits the pairs of a group.
Components come from `components`.

Null or blank texts have an empty set and link with nothing. Texts with fewer words than a shingle are one shingle. Repeated
rows are copies. Null ids link but name no component, and are never kept. Empty tables give no rows. Long texts are hashed whole,
in one pass. Of equal texts and of a group the smallest id stays. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap
from .components import components
from .runtime import attach, map_batches, stash, unstash
from .text import as_long, mix, shingle_set

_STEP, _POS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def seeds(n: int, start: int) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=np.uint64) * _STEP + _POS)


def sketch(s: np.ndarray, positions: int) -> np.ndarray:
    """8 bits of the least hash of the set under each of `positions` hash functions."""
    a, b = seeds(positions, 1) | np.uint64(1), seeds(positions, 10_001)
    low = np.full(positions, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):
        np.minimum(low, (s[at : at + 2048, None] * a + b).min(axis=0), out=low)
    return (mix(low) >> np.uint64(56)).astype(np.uint8)


def chosen_paths(sig: np.ndarray, trees: int, depth: int, threshold: float) -> np.ndarray:
    """Distinct ids of the nodes at `depth` that the document reaches in all trees."""
    where = seeds(len(sig), 20_001)
    token = mix(where + sig.astype(np.uint64) * _STEP)
    most = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(sig)))))
    nodes = seeds(trees, 30_001)
    for _ in range(depth):
        n, p = np.nonzero(mix(nodes[:, None] ^ where[None, :]) < most)
        nodes = np.unique(mix(nodes[n] * _STEP + token[p]))
    return nodes


def forest(docs: int, miss: float = 1e-5) -> tuple[int, int]:
    """Number and depth of the trees. A level tells 256 tokens apart: the depth lets unrelated texts fall to different nodes, and
    the number makes up for pairs at the threshold that part on the way (children in common: one a node on average)."""
    depth = max(4, 1 + -(-max(1, docs).bit_length() // 8))
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return max(32, math.ceil(math.log(miss) / math.log(1 - meet))), depth


def prints(docs: DataFrame, words: int, percent: int, positions: int, trees: int, depth: int) -> DataFrame:
    """doc_id, n (shingles), cid (null: empty set), sig, nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {"doc_id": b.column(0).to_pylist(), "n": [], "cid": [], "sig": [], "nodes": []}
            for text in b.column(1).to_pylist():
                s = shingle_set(text, words)
                sig = sketch(s, positions) if len(s) else None
                out["n"].append(len(s))
                out["cid"].append(set_id(s))
                out["sig"].append(sig.tobytes() if len(s) else None)
                out["nodes"].append(as_long(chosen_paths(sig, trees, depth, percent / 100)) if len(s) else None)
            yield out

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, n bigint, cid bigint, sig binary, nodes array<bigint>")


def set_id(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None


def sight(percent: int, positions: int) -> float:
    """Equal tokens that a pair at the threshold has, less four standard deviations."""
    p = percent / 100
    return positions * (p - 4 * (p * (1 - p) / positions) ** 0.5)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def in_sight(pairs: DataFrame, sketches: DataFrame, percent: int, positions: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    least = sight(percent, positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, positions) for c in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield {c: b.column(c).filter(keep).to_pylist() for c in ("a", "b")}

    one = sketches.select(F.col("cid").alias("a"), F.col("sig").alias("x"), F.col("n").alias("nx"))
    two = sketches.select(F.col("cid").alias("b"), F.col("sig").alias("y"), F.col("n").alias("ny"))
    joined = pairs.join(one, "a").join(two, "b").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return map_batches(joined.select("a", "b", "x", "y"), run, "a bigint, b bigint")


def full_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cid, members) of the class ids, made anew from one text of each: a bitmap of their doc_ids lets few others pass."""
    ids = ids.distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap.build(ids.join(classes, "cid").select(F.coalesce("rep", F.lit(-1)).alias("rep")), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            b = b.filter(pa.array(bitmap.holds(wanted.value, b.column(0).to_numpy())))
            for at in range(0, len(b), 256):
                sets = [shingle_set(t, words) for t in b.column(1).slice(at, 256).to_pylist()]
                yield {"cid": [set_id(s) for s in sets], "members": [s.tobytes() for s in sets]}

    found = map_batches(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), "text"), run, "cid bigint, members binary")
    return stash(found.where("cid is not null").join(ids, "cid").groupBy("cid").agg(F.first("members").alias("members")), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")), docs, classes, words)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            keep = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield {c: b.column(c).filter(keep).to_pylist() for c in ("a", "b")}

    joined = pairs.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b")
    out = stash(map_batches(joined.select("a", "b", "x", "y"), check, "a bigint, b bigint"), "confirmed")
    unstash(sets)
    return out


def keyed_runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first `key` columns, of rows that come sorted by them."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:key] != row[:key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def top(up: dict[int, int], x: int) -> int:
    while up.setdefault(x, x) != x:
        up[x] = x = up[up[x]]
    return x


def fitting(x: int, ys: np.ndarray, root: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int, least: float) -> np.ndarray:
    """Of the rows ys, those in other groups than row x that sizes and sketches allow."""
    ys = ys[(root[ys] != root[x]) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x]))]
    return ys[(sig[ys] == sig[x]).sum(axis=1) >= least]


def dealt_to_cells(members: DataFrame, key: str, cell: int) -> DataFrame:
    """members: key, cid, root, and more. Rows with i, j and own: a cell (key, i, j) holds two chunks of at most about `cell` rows.

    All pairs of different groups of a key share a cell: the largest group is met with the others only, they with all."""
    groups = members.groupBy(key, "root").agg(F.count("*").alias("size"))
    sizes = groups.groupBy(key).agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("all")).where("top.size < all")
    sizes = sizes.select(key, F.col("top.root").alias("largest"), F.ceil((F.col("all") - F.col("top.size")) / cell).cast("int").alias("m"), F.ceil(F.col("top.size") / cell).cast("int").alias("l"))
    p = members.join(sizes, key).withColumn("big", F.col("root") == F.col("largest"))
    chunk = F.when(F.col("big"), F.col("m") + F.pmod(F.xxhash64("cid"), F.col("l"))).otherwise(F.pmod(F.xxhash64("cid"), F.col("m"))).cast("int")
    over = F.when(F.col("big"), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.sequence(F.lit(0), F.col("m") + F.col("l") - 1))
    p = p.withColumn("own", chunk).withColumn("over", F.explode(over))
    return p.withColumns({"i": F.least("own", "over"), "j": F.greatest("own", "over")}).drop("largest", "m", "l", "big", "over")


def families(members: DataFrame, sketches: DataFrame, percent: int, positions: int, cell: int = 256) -> DataFrame:
    """members: node, cid, root. (cid, family) of all that have a partner in sight: in a node of theirs and another
    group. Partners share a family. Cells of a node return one row for each such member, not their pairs."""
    least = sight(percent, positions)
    placed = dealt_to_cells(members.select("node", "cid", "root"), "node", cell).join(sketches, "cid")
    placed = placed.select("node", "i", "j", "own", "cid", "root", "n", "sig").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {"a": [], "b": []}
        for rows in keyed_runs(batches, 3):
            own, cid, root, n = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6))
            sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(-1, positions)
            up: dict[int, int] = {}
            ys = np.flatnonzero(own == rows[0][2])
            for x in np.flatnonzero(own == rows[0][1]):
                for y in fitting(x, ys, root, n, sig, percent, least):
                    up[top(up, int(y))] = top(up, int(x))
            out["a"] += [int(cid[k]) for k in up]
            out["b"] += [int(cid[top(up, k)]) for k in list(up)]
            if len(out["a"]) > 10_000:
                yield out
                out = {"a": [], "b": []}
        yield out

    return components(map_batches(placed, run, "a bigint, b bigint")).withColumnRenamed("id", "cid").withColumnRenamed("root", "family")


def family_links(members: DataFrame, percent: int, positions: int, cell: int = 128) -> DataFrame:
    """members: family, cid, root, n, sig, members (the full set). Confirmed links that join groups of a family.

    In a cell, pairs in sight are checked on full sets, unless links have joined their groups already. It returns the links
    that join groups."""
    least = sight(percent, positions)
    p = dealt_to_cells(members, "family", cell)
    p = p.select("family", "i", "j", "own", "cid", "root", "n", "sig", "members")
    p = p.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for rows in keyed_runs(batches, 3):
            own, cid, root, n = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6))
            sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(-1, positions)
            sets = [np.frombuffer(r[8], np.uint64) for r in rows]
            up: dict[int, int] = {}
            out: dict[str, list] = {"a": [], "b": []}
            ys = np.flatnonzero(own == rows[0][2])
            for x in np.flatnonzero(own == rows[0][1]):
                for y in fitting(x, ys, root, n, sig, percent, least):
                    u, v = top(up, int(root[x])), top(up, int(root[y]))
                    if u != v and alike(sets[x], sets[y], percent):
                        up[u] = v
                        out["a"].append(int(cid[x]))
                        out["b"].append(int(cid[y]))
            yield out

    return map_batches(p, run, "a bigint, b bigint")


def near_documents(docs: DataFrame, words: int = 5, percent: int = 80, positions: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    total = docs.count()
    trees, depth = forest(total)
    all_rows = stash(prints(docs, words, percent, positions, trees, depth), "prints")
    full = all_rows.where("cid is not null")
    sketches = full.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    sketches = stash(sketches, "sketches")
    classes = sketches.select("cid", "rep")
    written, sketches = sketches, sketches.drop("copies")
    met = stash(full.select(F.explode("nodes").alias("node"), "cid").groupBy("node").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("node", "lo"), "met")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(met, "node"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            nodes = b.column(1)
            flat, off = nodes.values.to_numpy(), nodes.offsets.to_numpy()
            keep = bitmap.holds(shared.value, flat)
            cid = np.repeat(b.column(0).to_numpy(), np.diff(off))
            both = np.unique(np.column_stack([flat[off[0] : off[-1]], cid])[keep[off[0] : off[-1]]], axis=0)
            yield {"node": both[:, 0], "cid": both[:, 1]}

    seen = stash(map_batches(full.select("cid", "nodes"), visits, "node bigint, cid bigint").distinct().join(met, "node"), "visits")
    links, groups, done = None, None, []
    lying = seen.withColumn("root", F.col("cid")).withColumn("first", F.struct(F.col("lo").alias("root"), F.col("lo").alias("cid")))
    for _ in range(2):
        star = lying.where(F.col("first.root") != F.col("root")).groupBy("cid").agg(F.min("first.cid").alias("a")).select("a", F.col("cid").alias("b"))
        star = stash(in_sight(star, sketches, percent, positions), "star")
        more = confirmed(star, docs, classes, words, percent)
        links = more if links is None else links.unionByName(more)
        groups = stash(components(links), "groups")
        done += [star]
        lying = seen.select("node", "cid").join(groups.withColumnRenamed("id", "cid"), "cid", "left").select("node", "cid", F.coalesce("root", "cid").alias("root"))
        first = lying.groupBy("node").agg(F.min(F.struct("root", "cid")).alias("first"), F.max("root").alias("last")).where("first.root < last")
        lying = lying.join(first, "node")
    kin = stash(families(lying.select("node", "cid", "root"), sketches, percent, positions), "families")
    if not kin.isEmpty():
        sets = full_sets(kin.select("cid"), docs, classes, words)
        people = kin.join(groups.withColumnRenamed("id", "cid"), "cid", "left").select("family", "cid", F.coalesce("root", "cid").alias("root")).join(sketches.select("cid", "n", "sig"), "cid").join(sets, "cid")
        more = stash(family_links(people, percent, positions), "confirmed")
        if not more.isEmpty():
            groups = stash(components(links.unionByName(more)), "groups")
        unstash(sets)
    own = classes.join(groups.withColumnRenamed("id", "cid"), "cid").select("cid", "rep", "root")
    named = own.join(own.groupBy("root").agg(F.min("rep").alias("least")), "root").select("cid", "least")
    named = written.select("cid", "rep", "copies").join(named, "cid", "left").select("cid", F.coalesce("least", "rep").alias("component_id"), "copies")
    out = stash(attach(all_rows.select("doc_id", "n", "cid"), named, ["cid"], "copies", total).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "near")
    unstash(all_rows, written, met, seen, kin, *done)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone (doc_id, no nulls). A bitmap of these ids passes most other rows where they are; only the
    rows that it holds meet the ids in a shuffle, with their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.build(gone, "doc_id"))

    @F.arrow_udf("boolean")
    def held(ids: pa.Array) -> pa.Array:
        return pa.array(bitmap.holds(shared.value, ids.to_numpy(zero_copy_only=False).astype(np.int64)), pa.bool_())

    doubt = held(F.col("doc_id").cast("bigint"))
    met = docs.where(doubt).join(gone.withColumnRenamed("doc_id", "_gone"), F.col("doc_id") == F.col("_gone"), "left_anti")
    return docs.where(~doubt).unionByName(met)


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of docs for each group of texts: that of the smallest id (null is largest); of rows with equal ids any one, all
    columns from it. Rows without words stay, as they link with nothing."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("times")).where("doc_id is null or times > 1").isEmpty():
        return without(docs, near_documents(docs.select("doc_id", "text"), **options).where("not kept").select("doc_id"))
    numbered = stash(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = near_documents(numbered.select(F.col("_row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    first = found.join(numbered.select("_row", "doc_id"), "_row").groupBy("_group").agg(F.min(order)["_row"].alias("_row"))
    return numbered.join(first.select("_row"), "_row", "left_semi").select(docs.columns)
