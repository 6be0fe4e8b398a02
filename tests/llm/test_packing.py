from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracemill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  ", "Hello World, it's  1234 \n don't", "a\x1cb \x1f c", "<|endoftext|> x<|startoftext|>y", "Ünïcode é   ﬁ ΑΣ ΑΣ.", "word " * 9000, "x" * 5000, "long tail of words " * 300, "same", "same"]


@pytest.mark.parametrize("window,open_limit", [(64, 2048), (4096, 2048), (64, 3)])
def test_every_id_lies_in_one_piece(spark, window, open_limit):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "x", 1)], "doc_id bigint, text string, ids string, start int")
    t = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs.repartition(3), PATH, window=window, open_limit=open_limit).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in [*enumerate(TEXTS * 3), (None, "no id")]:
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want
        assert all(r.doc_tokens == len(want) for r in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        total = sum(r.length for r in pieces)
        assert total <= window and (total == window or total & (total - 1) == 0)


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_level_is_the_one_of_least_squares():
    g = np.random.default_rng(2)
    for step in (1, 8):
        p = packing.SquaresPacker(256, 10**6, step)
        for size in g.integers(1, 256, 2000).tolist():

            def squares(h, size=size):
                n = list(p.levels)
                fill = size + (p.open[h][-1][0] if h else 0)
                n[h] -= h > 0
                if fill < 256:
                    n[p.level_of(fill)] += 1
                return sum(x * x for x in n[1:])

            allowed = [h for h in range(1, len(p.levels)) if p.levels[h] and p.open[h][-1][0] + size <= 256] + [0]
            assert squares(p.level_for(size)) == min(map(squares, allowed))
            list(p.place((0, 0, b"\0" * 4 * size, size)))
            assert p.levels == [len(x) for x in p.open] and all(p.level_of(f) == h for h, x in enumerate(p.open) for f, _ in x)


@pytest.mark.parametrize("docs,share", [(500, 0.05), (4000, 0.02)])
def test_few_ids_are_open_at_the_end(docs, share):
    """Lengths like those of the documents: the level array places nearly all ids, and most documents stay whole."""
    g = np.random.default_rng(5)
    p, pieces = packing.SquaresPacker(4096, 2048), 0
    sizes = np.minimum(60_000, g.lognormal(6.4, 1.0, docs)).astype(int) + 1
    for k, n in enumerate(sizes.tolist()):
        pieces += sum(map(len, p.add(k, b"\0" * 4 * n)))
    pieces += sum(map(len, p.flush()))
    assert p.placed == sizes.sum() and p.relaid < share * p.placed
    assert pieces < 1.4 * docs


def test_workers_forget_what_other_operators_remember():
    from tracemill.llm import runtime, text

    runtime.enter("tracemill.llm.packing")
    packing._loaded[PATH, 2]("some words")
    text.word_hashes([b"a", b"b"])
    runtime.enter("tracemill.llm.packing")
    assert packing._loaded and text._hashes
    runtime.enter("tracemill.llm.minhash")
    assert not packing._loaded and not text._hashes
