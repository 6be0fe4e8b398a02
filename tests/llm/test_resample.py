import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tracemill.llm import queries, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " - ", "One, two THREE 4four ünï·code 日本 x_y", "w " * 30, "İSTANBUL ÀÉ \x7f\x00 a'b", "same words here again and again " * 5, "same words here again and again " * 5, "z" * 50 + " " + "y" * 50]


def grams(text, most):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    return w, [" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1)]


def plain(docs, target, percent=10, most=1, buckets=10_000, least=20, seed=2024):
    """The definition, one feature after the other."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for c, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            c.update(map(bucket, grams(text, most)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for doc, text in docs:
        w, f = grams(text, most)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    ranks = {}
    for k, x in enumerate(drawn[: len(drawn) * percent // 100]):
        ranks.setdefault(x[0], []).append(k + 1)
    return sorted((x[0] is None, x[0] or 0, *x[2:]) for x in out), {k: sorted(v) for k, v in ranks.items()}


def check(spark, docs, target, **settings):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, rank int, weight string").repartition(3)
    out = resample.resample(d, spark.createDataFrame([(t,) for t in target], "text string"), **{("least_words" if k == "least" else k): v for k, v in settings.items()}).collect()
    rows, ranks = plain(docs, target, **settings)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score) for r in out) == rows
    got = {}
    for r in out:
        if r["rank"] is not None:
            got.setdefault(r.doc_id, []).append(r["rank"])
    assert {k: sorted(v) for k, v in got.items()} == ranks
    return got


@pytest.mark.parametrize("common", [100_000, 20, 1])
@pytest.mark.parametrize("most,buckets", [(1, 10_000), (3, 50)])
def test_draw_is_that_of_the_definition(spark, common, most, buckets, monkeypatch):
    """Whether all, some or no features travel to all tasks; repeated rows and a null id among the documents."""
    monkeypatch.setattr(resample, "COMMON", common)
    g = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(60)] + ["a-much-longer-word-than-thirty-two-bytes".replace("-", "q")]
    docs = list(enumerate(TEXTS)) + [(100 + k, " ".join(g.choice(vocabulary, g.integers(1, 90)))) for k in range(150)]
    docs += [(None, "no id " * 12), (104, docs[13][1]), (104, docs[13][1])]
    assert check(spark, docs, [" ".join(vocabulary[:9]) * 3, None, "two three"], most=most, buckets=buckets)


def test_features_of_a_long_text(monkeypatch):
    text = "The quick-brown fox, ünder 12 x " * 400
    whole = {n: Counter(grams(text, n)[1]) for n in (1, 2, 3)}
    for window in (1, 50, 999):
        monkeypatch.setattr(resample, "WINDOW", window)
        for n in (1, 2, 3):
            found = list(resample.features(text.encode(), n))
            assert Counter(f.decode() for _, fs in found for f in fs) == whole[n] and sum(k for k, _ in found) == len(grams(text, 1)[0])


def test_equal_scores_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(resample, "noise", lambda seed, doc_id: resample.F.lit(0).cast("bigint"))
    docs = [(k, "the same words " * 10) for k in range(50)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    out = resample.resample(d, d.limit(0)).collect()
    assert {r.doc_id: r["rank"] for r in out if r["rank"]} == {k: k + 1 for k in range(5)}


def test_no_documents_or_no_target(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resample.resample(none, none).count() == 0
    check(spark, [(k, "some words " * k) for k in range(40)], [], percent=50)
    with pytest.raises(ValueError):
        resample.resample(none, none, buckets=10**7)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.op13_resample(spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op13_resample']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
