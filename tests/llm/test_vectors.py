import numpy as np
from pyspark.sql import functions as F

from tracemill.llm import topk, vecdup

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, v string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], SCHEMA)


def hard_rows():
    g = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in g.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, [float(np.float32(x)) for x in np.array(rows[i % 7][1]) * (1 + i) + g.normal(size=6) * 0.02]) for i in range(60)]
    rows += [(300 + i, rows[4][1]) for i in range(90)] + [rows[5], rows[5]]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, []), (406, [1.0, 0.0]), (407, [2.0, 0.0]), (None, rows[4][1])]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def brute_near(rows, threshold):
    ok = [usable(v) and any(v) for _, v in rows]
    near = lambda a, b: ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]) and a != b and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= threshold
    links = {a: [b for b in range(len(rows)) if near(a, b)] for a in range(len(rows))}
    out, seen = [], {}
    for a in links:
        if a not in seen:
            group, todo = {a}, [a]
            while todo:
                for b in links[todo.pop()]:
                    if b not in group:
                        group.add(b)
                        todo.append(b)
            ids = [rows[x][0] for x in group if rows[x][0] is not None]
            seen.update(dict.fromkeys(group, min(ids) if ids else None))
        out.append((rows[a][0], len(links[a]), seen[a], rows[a][0] is not None and rows[a][0] == seen[a]))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_near_vectors_like_brute_force(spark):
    rows = hard_rows()
    for tile_rows in (40, 10_000):
        got = [tuple(r) for r in vecdup.near_vectors(frame(spark, rows).repartition(3), 0.9, tile_rows=tile_rows).collect()]
        assert sorted(got, key=key) == sorted(brute_near(rows, 0.9), key=key)


def test_close_pairs_stops_early_and_loses_nothing():
    g = np.random.default_rng(0)
    x = g.normal(size=(400, 64)) * np.linspace(3, 0.2, 64)
    x[200:300] = x[:100] + g.normal(size=(100, 64)) * 0.3
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = {(int(a), int(b)) for i, j in vecdup.close_pairs(x, x, vecdup.axes(list(x))[64], 0.9, strip=64) for a, b in zip(i, j, strict=True)}
    assert got == {tuple(map(int, p)) for p in np.argwhere(unit @ unit.T >= 0.9)}


def test_empty_vectors(spark):
    assert vecdup.near_vectors(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 2 == 0).count() == 0


def brute_top(rows, every, k):
    data = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if usable(v)]
    out = []
    for a, (i, v) in enumerate(data):
        if i is not None and i % every == 0:
            scores = sorted(((sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(data) if b != a), key=lambda r: (-r[0], r[1] is None, r[1]))
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(scores[:k])]
    return out


def test_top_k_like_brute_force(spark):
    rows = hard_rows()
    for cell in (64, 10_000):
        got = [tuple(r) for r in topk.top_k(frame(spark, rows).repartition(3), F.col("vec_id") % 5 == 0, cell_rows=cell, cell_queries=cell).collect()]
        assert sorted(got, key=key) == sorted(brute_top(rows, 5, 5), key=key)


def test_scores_of_any_size_are_exact():
    g = np.random.default_rng(1)
    for top in (100, 10**5, 10**9):
        q, c = (g.integers(-top, top, size=(n, 8)).astype(float) for n in (5, 40))
        c[c % 3 == 0] = 0
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in c] for r in q]
        got = [row.tolist() for _, scores in topk.accumulate(q, c, 2) for row in scores]
        assert [[int(x) for x in r] for r in got] == want


def test_far_leaves_are_never_met(spark):
    """Ten directions far apart: most pairs of leaves are passed over, and no link is lost."""
    g = np.random.default_rng(7)
    centres = np.eye(10)[:, :10] * 5
    rows = [(k, [float(np.float32(x)) for x in centres[k % 10] + g.normal(size=10) * 0.2]) for k in range(500)]
    sample = [np.array(v) for _, v in rows]
    df = frame(spark, rows).selectExpr("vec_id AS id", "1L AS extra", "embedding AS v").repartition(3)
    blocks = vecdup.dealt(df, vecdup.trees(sample, 16))
    met, passed = vecdup.met_tiles(blocks, 1 << 20, 20, 0.9)
    assert len(met) >= 10 and passed > len(met) * (len(met) - 1) / 4
    assert sum(m[2] for m in met) > len(met)  # large leaves have chunks
    got = [tuple(r) for r in vecdup.near_vectors(frame(spark, rows), 0.9, tile_rows=20).collect()]
    assert sorted(got, key=key) == sorted(brute_near(rows, 0.9), key=key)
