import numpy as np
import public_tokenizers

from tracemill.llm import pieces

P = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["The nation's  best\n\nthing", "", " ", "  lead and trail  ", "é ñ 🙂🙂 x", "a" * 500, "\n", "ab\tcd", "thththnationing " * 40, "日本語テキスト"]


def whole(text):
    """Viterbi over the whole text at once, with the same ties."""
    w = "▁" + text.replace(" ", "▁")
    best, back = [0.0] + [None] * len(w), [0] * (len(w) + 1)
    for j in range(1, len(w) + 1):
        for i in range(max(0, j - P.longest), j):
            s = P.scores.get(w[i:j], P.unknown if i == j - 1 else None)
            if s is not None and best[i] is not None and (best[j] is None or best[i] + s > best[j]):
                best[j], back[j] = best[i] + s, i
    out, j = [], len(w)
    while j:
        p = w[back[j] : j]
        out = ([P.ids[p]] if p in P.ids else [P.bytes[x] for x in p.encode()]) + out
        j = back[j]
    return out


def test_stream_like_whole_viterbi():
    g = np.random.default_rng(4)
    letters = list("abcdehinorst ▁é\n")
    for text in [*TEXTS, *("".join(g.choice(letters, 60)) for _ in range(60))]:
        if text:
            assert np.frombuffer(P.encode(text), "<u4").tolist() == whole(text), text
            assert list(P.stream("▁" + text.replace(" ", "▁"))) == whole(text)


def test_window_stays_small():
    stats = {}
    assert sum(1 for _ in P.stream(("nationing" for _ in range(1)), stats)) >= 0
    list(P.stream((c for _ in range(20_000) for c in "nationing"), stats))
    assert stats["window"] < 10 * P.longest and stats["commits"] > 1000


def test_round_trip(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_ids int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(docs, path), path).collect()
    assert len(back) == len(rows) and all(r.decoded == (r.text or "") for r in back)
    assert pieces.encode(docs.limit(0), path).count() == 0


def test_clashing_columns_give_way(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "some text", "old", b"old")], "doc_id bigint, text string, decoded string, piece_ids binary")
    r = pieces.decode(pieces.encode(docs, path), path).first()
    assert r.decoded == "some text" and bytes(r.piece_ids) == P.encode("some text")
