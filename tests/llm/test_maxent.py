import math
import zlib
from collections import Counter

import numpy as np

from tracemill.llm import maxent
from tracemill.llm.text import words


def rows():
    g = np.random.default_rng(8)
    two = [["der", "hund", "und", "katze", "läuft"], ["the", "dog", "and", "cat", "runs"]]
    out = [(i, " ".join([*g.choice(two[i % 2], 30), f"rare{g.integers(0, 400)}"]), 1) for i in range(400)]
    return out + [(1000, None, 1), (1001, " \t", 1), (1002, "The DOG x ÄB", 1), (1003, "dog cat " * 30_000, 1), (None, "the dog", 1), (5, out[5][1], 1)]


def tokens(t):
    return (t or "").encode().lower().split() + [b""]


def test_counts_base_and_held_out_gain(spark):
    data = rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in data if not held(i) for w in tokens(t))
    n = sum(c.values())
    base = lambda t: sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in tokens(t))
    docs = spark.createDataFrame(data, "doc_id bigint, text string, score int").repartition(3)
    for head in (5, 1000):
        got = maxent.score_documents(docs, head_size=head).collect()
        assert len(got) == len(data)
        by = {r.doc_id: r for r in got}
        for i, t, _ in data:
            r = by[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)
            assert math.isclose(r.base_score, base(t), rel_tol=1e-9)
            assert r.score < 0 and math.isfinite(r.score)
        out = [r for r in got if r.held_out and r.doc_id < 400]
        assert sum(r.score for r in out) > sum(r.base_score for r in out) + 2 * len(out)


def softmax_at(w, rows, k):
    z = [sum(float(w[r][j]) for r in rows) for j in range(w.shape[1])]
    top = max(z)
    return math.exp(z[k] - top) / sum(math.exp(x - top) for x in z)


def past_of(batch):
    """(past, hashes of the last three words) of each token, by a loop."""
    out, v = [], batch
    for ws in v:
        hs = [maxent.word_hash(w) for w in ws]
        for i in range(len(ws)):
            out.append((min(i, 10**9), [hs[i - k] if i >= k else 0 for k in (1, 2, 3)], ws[i]))
    return out


def test_scores_equal_a_plain_model(spark):
    """Each held-out text against a loop over its tokens, with the fitted weights."""
    data = [(i, t) for i, t, _ in rows() if i != 1003]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(2)
    train = docs.where(~maxent.held_out())
    table = maxent.counted(train)
    m = maxent.fitted(train, table, head_size=30)
    known = {int(h): int(x) for h, x in zip(m.head["h"], m.head["leaf"], strict=True)}
    c = {r.h % 2**64: r.c for r in table.collect()}
    leaf_of = lambda w: known.get(maxent.word_hash(w), maxent.word_class(w) * maxent.SLOTS + int(maxent.hashed_slot(np.array([maxent.word_hash(w)], np.uint64))[0]))
    got = {r.doc_id: r.score for r in maxent.score_documents(docs, head_size=30).where("held_out").collect()}
    assert len(got) > 30
    for i, t in data:
        if i not in got:
            continue
        total = 0.0
        for past, back, w in past_of([tokens(t)]):
            back = np.array([[x] for x in back], np.uint64)
            leaf = leaf_of(w)
            kind, slot = divmod(leaf, maxent.SLOTS)
            p = softmax_at(m.weights[0], maxent.class_features(np.array([past]), back, len(m.weights[0]))[0], kind)
            if kind >= maxent.SINGLE:
                p *= softmax_at(m.weights[1], maxent.slot_features(np.array([kind]), back, len(m.weights[1]))[0], slot)
            total += math.log10(p) + math.log10(c.get(maxent.word_hash(w), 0) + 1) - m.leaf_log[leaf]
        assert math.isclose(total, got[i], rel_tol=1e-4), i


def test_probabilities_of_all_words_sum_to_one(spark):
    """Over the training words and one unseen word a leaf, from any past."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows()], "doc_id bigint, text string")
    table = maxent.counted(docs)
    m = maxent.fitted(docs, table, head_size=50)
    v = maxent.Vocabulary(m.head)
    mass = np.zeros(maxent.CLASSES * maxent.SLOTS)
    for r in table.collect():
        at = np.flatnonzero(m.head["h"] == np.uint64(r.h % 2**64))
        mass[m.head["leaf"][at[0]] if len(at) else r.leaf] += r.c + 1
    back = np.array([[maxent.word_hash(w)] for w in (b"der", b"hund", b"und")], np.uint64)
    past, total = np.array([3]), 0.0
    for leaf in range(len(mass)):
        kind = leaf // maxent.SLOTS
        if kind < maxent.SINGLE and leaf % maxent.SLOTS:
            continue
        log = maxent.token_logs(m.weights, past, back, np.array([leaf]))[0]
        total += math.exp(log) * (mass[leaf] + 1) / 10 ** m.leaf_log[leaf]
    assert math.isclose(total, 1, abs_tol=1e-3) and len(v) == 0


def test_features_of_parts_equal_those_of_whole_texts():
    v = maxent.Vocabulary({"h": np.zeros(0, np.uint64), "c": np.zeros(0, np.int64), "leaf": np.zeros(0, np.int64)})
    texts = ["a b c d e f g h i j", None, "x", "k l m n o p q"]
    whole = [b.arrays() for b in maxent.batched(iter(texts), v, 10**6)]
    parts = [b.arrays() for b in maxent.batched(iter(texts), v, 4)]
    past = np.concatenate([p[1] for p in parts])
    assert np.array_equal(whole[0][0], np.concatenate([p[0] for p in parts]))
    assert np.array_equal(np.minimum(whole[0][1], 3), np.minimum(past, 3))
    assert np.array_equal(whole[0][2], np.concatenate([p[2] for p in parts], axis=1))
    assert [tuple(int(x) for x in h) for h in whole[0][2].T] == [tuple(h) for _, h, _ in past_of([tokens(t) for t in texts])]


def test_gradient_sums_like_a_loop():
    """Observed counts equal a loop's; expected ones, drawn, agree with its probabilities in the mean."""
    g = np.random.default_rng(2)
    w = g.normal(size=(128, maxent.CLASSES)).astype(np.float32)
    f, kind = g.integers(0, 40, size=(300, 5)).astype(np.int32), g.integers(0, maxent.CLASSES, 300)
    f[:, 0] = 0
    seen, hoped = np.zeros((128, maxent.CLASSES), np.float32), np.zeros((128, maxent.CLASSES), np.float32)
    times = 200
    for k in range(times):
        maxent.feature_sums(kind, f, w, seen, hoped, np.random.default_rng(k))
    a, b = np.zeros_like(seen), np.zeros_like(seen)
    for i in range(300):
        p = [softmax_at(w, f[i], j) for j in range(maxent.CLASSES)]
        for k in range(5):
            a[f[i, k], kind[i]] += 1
            b[f[i, k]] += p
    assert np.array_equal(a * times, seen)
    assert np.allclose(b.sum(axis=1), hoped.sum(axis=1) / times, rtol=1e-4)
    assert np.abs(b - hoped / times).max() < 5 * np.sqrt(b.max() / maxent.DRAWS / times)


def test_twenty_common_words_are_told_apart(spark):
    cycle = [f"w{k}same" for k in range(20)]
    data = [(i, " ".join((cycle * 4)[i % 20 : i % 20 + 40])) for i in range(600)]
    got = maxent.score_documents(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).where("held_out").collect()
    assert sum(r.score for r in got) > -0.25 * sum(r.n_tokens for r in got)


def test_nothing_to_learn(spark):
    assert maxent.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    r = maxent.score_documents(spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)


def test_words_split_in_bulk_are_those_of_each_text():
    texts = ["  A b\x1cc \t\x0bd\x85e F  ", "", None, " ", "É x", "a\x00b a", " Q r\n", "A a"]
    ws, code, sizes = maxent.split(texts)
    start = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert [ws[k] for k in code[start : start + n]] == words(t)
        start += n
    assert start == len(code) and len({*ws}) == len(ws)
    assert [len(x) for x in maxent.slices(iter(["ab", None, "c", "defgh", "i"]), 3)] == [3, 1, 1]


def test_products_of_raised_weights_keep_their_range():
    w = np.full((10, 4), -50, np.float32)
    w[:, 0] = 20
    e, f = maxent.odds_of(w, 1, 5), np.arange(10, dtype=np.int32).reshape(2, 5)
    assert e.dtype == np.float64 and maxent.odds_of(w / 10, 1, 5).dtype == np.float32
    assert np.allclose(maxent.own_scores(e, f, np.array([0, 1])), [0, -350])
