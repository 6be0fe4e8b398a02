import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tracemill.llm import queries, tokcount

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
TEXTS = [
    None, "", " ", "   ", "\n", "a", "a ", " a", " a  b   c ", "It's 12 don't 'sx", "x<|endoftext|>y <|endoftext|> <|startoftext|>", "a\x1cb \x1f c\x85d\xa0e", "Ünïcode é   ﬁ ΑΣ ΑΣ. Å Ⅳ", "é ́x 3́",
    "日本語のテキスト　テスト   x", "\t\ttab\r\n\r\nline \x0b\x0c", "▁ under▁score ▁▁", "\U0001f600‍\U0001f600 ﻿", "a\x00b \x00", "word " * 9000, "x" * 5000, "one two  three\n" * 3000, "same", "same",
]


def plain(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        m = SentencePieceProcessor(model_file=path)
        return lambda t: len(m.encode(t))
    t = Tokenizer.from_file(path)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("giant", [8 << 20, 20_000, 64])
def test_counts_are_those_of_the_library(spark, name, giant, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x", t, "y") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None)], "doc_id bigint, text string, n_tokens string, key string, _key string")
    rows = tokcount.count_tokens(docs.repartition(3), public_tokenizers.path(name), giant_bytes=giant).collect()
    count = plain(name)
    assert len(rows) == len(TEXTS) + 1
    texts = {**dict(enumerate(TEXTS)), None: "no id"}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: count(t or "") for i, t in texts.items()}
    assert {r.doc_id: r.n_bytes for r in rows} == {i: len((t or "").encode()) for i, t in texts.items()}
    assert all(r._key == ("y" if r.doc_id is not None else None) and r.key == (texts[r.doc_id] if r.doc_id is not None else None) for r in rows)


@pytest.mark.parametrize("name", FILES)
def test_random_texts_in_small_pieces(name, monkeypatch):
    monkeypatch.setattr(tokcount, "PIECE", 7)
    monkeypatch.setattr(tokcount, "BATCH", 50)
    monkeypatch.setattr(tokcount, "CALL", 20)
    g, count = np.random.default_rng(4), plain(name)
    letters = list("abcdeXYZ 0129 .,'!<|>  \n\t éßΣ日本́　\xa0-_") + ["<|endoftext|>", "'re", "the ", " of", "</s>", "<s>", "<unk>", "<0x41>"]
    lengths = tokcount.Lengths(public_tokenizers.path(name), most=200)
    assert lengths.safe
    texts = ["".join(g.choice(letters, g.integers(0, 80))) for _ in range(3000)]
    assert lengths([t.encode() for t in texts]) == [count(t) for t in texts]
    assert len(lengths.memo) <= 200 + 50


def test_long_texts_are_cut_and_batches_are_even():
    lengths = tokcount.Lengths(public_tokenizers.path(FILES[0]))
    texts = [b"some words and 12 numbers " * 40_000, *[b"short one"] * 50_000, b"x" * 300_000]
    sizes = [sum(len(p) for _, p in b) for b in lengths.batches(texts)]
    assert all(tokcount.BATCH <= s < tokcount.BATCH + tokcount.PIECE + 64 for s in sizes[:-2])
    assert max(len(p) for b in lengths.batches(texts[:1]) for _, p in b) < tokcount.PIECE + 64
    lengths(texts)
    calls = lengths.calls
    lengths(texts[:-1])
    assert lengths.calls == calls  # every chunk is known by now


def test_other_tokenizers_are_not_cut(tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    t.normalizer = None
    from tokenizers import pre_tokenizers

    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)])
    t.save(f"{tmp_path}/other.json")
    lengths = tokcount.Lengths(f"{tmp_path}/other.json")
    text = "two words and more " * 5000
    assert not lengths.safe and lengths([text.encode()]) == [len(t.encode(text, add_special_tokens=False).ids)]


def test_empty(spark):
    assert tokcount.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), public_tokenizers.path(FILES[0])).count() == 0


def test_query_against_the_library(spark):
    got = {r.doc_id: r for r in queries.op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    count = plain(FILES[0])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = count(d.text or "")
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 2048)
