import numpy as np
from pyspark.sql import functions as F

from tracemill.llm import bitmap, minhash
from tracemill.llm.components import components


def corpus(seed=0):
    g = np.random.default_rng(seed)
    word = lambda: "w" + str(g.integers(0, 5000))
    rows = []
    for i in range(60):
        rows.append([word() for _ in range(g.integers(1, 120))])
    for base in range(20, 60):
        for _ in range(3):
            near = list(rows[base])
            for _ in range(g.integers(1, 4)):
                near[g.integers(0, len(near))] = word()
            rows.append(near)
    hub = [word() for _ in range(90)]
    for _ in range(150):
        near = list(hub)
        near[g.integers(0, 90)] = word()
        rows.append(near)
    texts = [" ".join(r) for r in rows] + ["A b\tC\n d"] * 40 + ["a B c D", None, "", " \t ", "two words", "TWO words", "Ä b c", "ä b c"]
    return list(enumerate(texts)) + [(5, texts[5]), (None, "Ä b c")]


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    s = [sets(t, k) for _, t in rows]
    lab = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = lab[a], lab[b]
                lab = [y if z == x else z for z in lab]
    least = {}
    for (i, _), z in zip(rows, lab):
        if i is not None:
            least[z] = min(i, least.get(z, i))
    return sorted(((i, len(v), least.get(z), i is not None and i == least.get(z)) for (i, _), v, z in zip(rows, s, lab)), key=str)


def test_near_documents_like_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, n int, sig string").repartition(4)
    got = [tuple(r) for r in minhash.near_documents(docs, 3, 85).collect()]
    assert sorted(got, key=str) == brute(rows, 3, 85)


def test_families_hold_partners_of_other_groups(spark):
    rows = [(node, c, c, 5, bytes([c % 3] * 128), 10) for node in (1, 2) for c in range(5)]
    members = spark.createDataFrame([r[:4] for r in rows], "node bigint, cid bigint, root bigint, n_members bigint")
    sketches = spark.createDataFrame([(c, None, n, s) for _, c, _, _, s, n in rows[:5]], "cid bigint, rep bigint, n bigint, sig binary")
    for cell in (2, 256):
        got = {}
        for r in minhash.families(members, sketches, 85, 128, cell).collect():
            got.setdefault(r.family, set()).add(r.cid)
        assert sorted(map(sorted, got.values())) == [[0, 3], [1, 4]]


def test_links_of_a_family_join_its_groups(spark):
    g = np.random.default_rng(6)
    base = g.integers(0, 2**60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 200 - 8 * k], g.integers(0, 2**60, 8 * k, dtype=np.uint64)])) for k in range(6)] + [base] * 300
    root = [*range(6), *[77] * 300]
    rows = [(1, c, root[c], len(s), minhash.sketch(s, 128).tobytes(), s.tobytes()) for c, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "family bigint, cid bigint, root bigint, n bigint, sig binary, members binary")
    for cell in (3, 128):
        got = minhash.family_links(members, 85, 128, cell).collect()
        joined = {77}
        for _ in range(9):
            joined |= {root[x] for r in got for x in (r.a, r.b) if {root[r.a], root[r.b]} & joined}
        assert joined == {77, 0, 1, 2} and all(minhash.alike(sets[r.a], sets[r.b], 85) for r in got)


def test_empty(spark):
    assert minhash.near_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_bitmap_has_the_places_of_sql(spark):
    keys = np.array([0, 1, -5, 2**62, -(2**63)])
    want = [r[0] for r in spark.createDataFrame([(int(k),) for k in keys], "k bigint").select(F.xxhash64("k")).collect()]
    assert bitmap.spark_xxhash64(keys).view(np.int64).tolist() == want
    bits = bitmap.build(spark.createDataFrame([(1,), (-5,)], "k bigint"), "k")
    assert bitmap.holds(bits, keys).tolist() == [False, True, True, False, False]


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.id)
    assert sorted(map(len, groups.values())) == [3, 100, 201] and all(k in v for k, v in groups.items())


def test_without_drops_the_ids_and_nothing_else(spark):
    docs = spark.range(5000).selectExpr("id * 7 AS doc_id", "concat('text ', id) AS text", "id AS n_chars").repartition(3)
    gone = spark.range(900).selectExpr("id * 21 AS doc_id")
    left = {r.doc_id: r.text for r in minhash.without(docs, gone).collect()}
    assert left == {7 * k: f"text {k}" for k in range(5000) if k % 3 or k >= 2700}
    assert minhash.without(docs, gone.limit(0)).count() == 5000 and minhash.without(docs, docs.select("doc_id")).count() == 0
