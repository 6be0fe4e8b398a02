import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tracemill.llm import pii

WORDS = {"en": "the house of that man with this other thing was and is not for them who went there".split(), "de": "das haus und der mann mit dem anderen ding war nicht für sie ist die wir dort".split()}


def test_stages_and_their_decisions(spark, tmp_path):
    g = np.random.default_rng(9)
    rows = []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(g.choice(WORDS[lang], 60)), lang, "s", 1))
    rows[10] = (10, rows[10][1] + " write to a.b@mail.example.com", "en", "s", 1)
    rows += [(100, rows[4][1], "en", "s", 1), (101, rows[6][1] + " end", "en", "s", 1), (102, "12 34 %%", None, "s", 1), (103, None, "en", "s", 1), (None, rows[3][1], "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumn("kept", docs.doc_id).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.stash(stage(spark, now, str(tmp_path)), name)
        assert now.columns == pipeline.COLUMNS
        seen[name] = {r.doc_id: r for r in now.collect()}
    assert set(seen["language"]) == {*range(80), 100, 101, None}
    assert set(seen["near_duplicates"]) == set(range(80))
    for i, r in seen["personal_data"].items():
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text)
    assert seen["personal_data"][10].text.endswith(" write to [EMAIL]") and seen["personal_data"][11].text == rows[11][1]
    out = pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["personal_data"].values())
    assert sum(r.length for r in out) == want


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_ties_long_texts_and_nulls(spark, tmp_path):
    g = np.random.default_rng(10)
    words = lambda lang, n: " ".join(g.choice(WORDS[lang], n))
    rows = [(i, words(("en", "de")[i % 2], 60), ("en", "de")[i % 2], "s", 1) for i in range(60)]
    long = words("en", 30_000)
    rows += [(70, long, "en", "s", 1), (71, long, "en", "s", 1), (7, rows[7][1], "de", "s", 1), (80, "", "en", None, None), (81, None, None, None, None), (None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    # Texts without a letter go as und; of copies, repeated rows among them, one stays.
    assert {r.doc_id for r in out} == {*range(60), 70}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in rows[:61]}
    total = {i: len(t.encode(text, add_special_tokens=False).ids) + 1 for i, text in texts.items()}
    for i, n in total.items():
        pieces = sorted((r.start, r.length) for r in out if r.doc_id == i)
        assert [s for s, _ in pieces] == [0, *np.cumsum([k for _, k in pieces])[:-1]] and sum(k for _, k in pieces) == n
    for s in {r.sequence_id for r in out}:
        at = sorted((r.offset, r.length) for r in out if r.sequence_id == s)
        assert [o for o, _ in at] == [0, *np.cumsum([k for _, k in at])[:-1]] and sum(k for _, k in at) <= 4096
