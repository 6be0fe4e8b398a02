import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import infill, queries

TEXTS = [
    None, "", "a", "<", "<P", "has <P> in it", "x<S>", "<M>", "<P<S", "<<M>", "Ünïcode é ﬁ 日本語 \U0001f600‍\U0001f600", " \n two  words\nand lines \n\n", "word and " * 900, "日" * 700, "x" * 127, "x" * 128, "x" * 129,
    "a" * 126 + "<P>", "a" * 127 + "<S>", "b" * 255 + "<M" + "c", "same one", "same one",
]


def starts(text, units):
    """Where units begin, in code points."""
    if units == "code_points":
        return list(range(len(text)))
    if units == "lines":
        return [i for i in range(len(text)) if not i or text[i - 1] == "\n"]
    inside = [c not in " \t\n\r\x0b\x0c" for c in text]
    return [i for i in range(len(text)) if inside[i] and (not i or not inside[i - 1])]


def plain(doc_id, text, units="code_points"):
    """The definition, in code points, one after the other."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    at = starts(text, units)
    n = len(at)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (0 if k == 0 else len(text) if k == n else at[k] for k in (low, high))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:i], text[i:j], text[j:]
    return (n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}")


def got(r):
    return r.n_units, r.form, r.prefix_units, r.middle_units, r.output


@pytest.mark.parametrize("units", sorted(infill.UNITS))
@pytest.mark.parametrize("giant", [8 << 20, 100])
def test_cuts_are_those_of_the_definition(spark, units, giant):
    rows = [(i, TEXTS[i % len(TEXTS)], "x", i, None) for i in range(20 * len(TEXTS))] + [(None, "no id", "x", 1, "k"), (5, "again", None, 2, None), (5, "again", None, 2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n bigint, _found string")
    out = infill.fill_in_middle(docs.repartition(4), units=units, giant_bytes=giant).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(out[0].asDict()) == sorted(["doc_id", "text", "n", "_found", "back", *infill.RESULTS])
    assert len(out) == len(rows)
    for r in out:
        assert got(r) == plain(r.doc_id, r.text, units), (r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert len({r.form for r in out}) == 3 and sum(r.doc_id == 5 for r in out) == 3


@pytest.mark.parametrize("units", sorted(infill.UNITS))
def test_stretches_compose_to_the_whole(units):
    """Chunks summed up apart, cut at any byte, give the cuts of the text at once."""
    g = np.random.default_rng(3)
    cutter = infill.Cutter(units, infill.MARKS)
    letters = list("ab é日\U0001f600 \n<PSM>") + ["<P>", "<M>", "word "]
    for size in (10, 500, 5000, 90_000, 300_000):
        text = "".join(g.choice(letters, size))
        raw, draws = text.encode(), g.integers(0, 1 << 32, 2)
        sums = b"".join(cutter.sums(raw[k : k + infill.STRETCH * 2]) for k in range(0, len(raw), infill.STRETCH * 2))
        a, b = cutter.cut([b"xy", raw], np.array([[1, 1], draws]))[1], cutter.cut_giant(raw, sums, draws)
        assert a.tolist() == b.tolist()
        at = starts(text, units)
        assert a[0] == len(at) and a[1] == sum(text.count(m) for m in infill.MARKS)
        for k, byte in zip(a[2:4], a[4:6], strict=True):
            assert len(raw[:byte].decode()) == (0 if k == 0 else len(text) if k == len(at) else at[k])


def test_giant_texts_in_many_chunks(spark):
    """Copies of a text share its sums, and each is cut by its own id."""
    text = "Ünïcode words é日 \n" * 20_000
    docs = spark.createDataFrame([(i, text if i % 3 else text + str(i)) for i in range(40)], "doc_id bigint, text string").repartition(5)
    for r in infill.fill_in_middle(docs, giant_bytes=1 << 17).collect():
        assert got(r) == plain(r.doc_id, r.text)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.op11_infill(spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op11_infill']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_composition_is_associative():
    auto, g = infill.Automaton("words", infill.MARKS), np.random.default_rng(1)
    data = g.choice(np.frombuffer(b"ab <PSM>\n", np.uint8), 3 * 128 * 50)
    f, c = infill.blocks(auto, data)[-1]
    x, y, z = ((f[k::3], c[k::3].astype(np.int64)) for k in range(3))
    one, two = infill.compose(infill.compose(x, y), z), infill.compose(x, infill.compose(y, z))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


def test_marks_that_overlap(spark):
    with pytest.raises(ValueError):
        infill.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), marks=("<|", "|<", "x"))


def test_other_shares_and_marks(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text of ', id) AS text")
    forms = {r.form: r.n for r in infill.fill_in_middle(docs, plain_percent=50, spm_percent=100, marks=("[p]", "[s]", "[m]")).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert set(forms) == {"plain", "spm"} and 100 < forms["plain"] < 200


def test_empty(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
