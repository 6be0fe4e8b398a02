import math

import public_tokenizers
import pytest

from tracemill.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")
SAID = {"en": "the house of that man with this other thing was and is not for them", "de": "das haus und der mann mit dem anderen ding war nicht für sie ist", "fr": "la maison de cet homme avec une autre chose était pas pour elle est les"}


def segmentations(word, pieces, probs):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = pieces.get(word[:k])
        if p is not None:
            total += probs[p] * segmentations(word[k:], pieces, probs)
    return total + (langid.UNKNOWN * segmentations(word[1:], pieces, probs) if word[0] not in pieces else 0)


def test_forward_sums_all_segmentations():
    pieces = langid.vocabulary(PATH)
    probs = [1 / (3 + i) for i in range(32000)]
    starts = langid.prefixes(PATH)
    for w in ("the", "nation", "éénation", "x🙂y"):
        got = langid.log_prob(langid.lattice(w, starts), probs)
        assert math.isclose(got, math.log(segmentations("▁" + w, pieces, probs)), rel_tol=1e-9)
    flat = [1e-5] * 32000
    short, long = (langid.log_prob(langid.lattice("ab" * n, starts), flat) for n in (2000, 4000))
    assert math.isfinite(long) and math.isclose(long / short, 2, rel_tol=0.01)


def test_expected_uses_are_posteriors():
    pieces = langid.vocabulary(PATH)
    probs = [1e-3] * 32000
    got = {}
    langid.expected(langid.lattice("than", langid.prefixes(PATH)), probs, 2.0, got)
    share = segmentations("▁than", pieces, [0 if i == pieces["▁than"] else 1e-3 for i in range(32000)])
    assert math.isclose(got[pieces["▁than"]], 2 * (1 - share / segmentations("▁than", pieces, probs)), rel_tol=1e-9)


def test_long_words_are_trained_on():
    """Expected uses cover each character once, however far the probabilities have to be rescaled."""
    pieces = langid.vocabulary(PATH)
    size = {i: len(p) for p, i in pieces.items()}
    starts = langid.prefixes(PATH)
    for probs in ([1e-5] * 32000, [1 / (3 + i) for i in range(32000)]):
        for word in ("than", "ab" * 2000, "nationing" * 500):
            got = {}
            langid.expected(langid.lattice(word, starts), probs, 1.0, got)
            assert math.isclose(sum(x * size[p] for p, x in got.items()), len(word) + 1, rel_tol=1e-6)


def test_models_do_not_share_scores(spark):
    """The same worker scores with two models whose rows are swapped."""
    docs = spark.createDataFrame([(i, SAID[k]) for i, k in enumerate(("en", "de"))], "doc_id bigint, text string").coalesce(1)
    langs, probs = langid.fit(spark.createDataFrame(rows()[:300], "doc_id bigint, text string, lang string, source string, score double"), PATH)
    one = [r.lang_pred for r in langid.predict(docs, PATH, langs, probs).collect()]
    two = [r.lang_pred for r in langid.predict(docs, PATH, langs, probs[[1, 0, 2]]).collect()]
    assert one == ["en", "de"] and two == ["de", "en"] and langs[:2] == ["de", "en"]
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([(i, "a", f"l{i}") for i in range(5)], "doc_id bigint, text string, lang string"), PATH, most_languages=4)


def rows():
    out = []
    for i in range(300):
        lang = list(SAID)[i % 3]
        ws = SAID[lang].split()
        out.append((i, " ".join(ws[(i * 7 + k * 5) % len(ws)] for k in range(3 + i % 40)), lang, "s", 0.5))
    return out + [(1000, None, "en", "s", 0.1), (1001, "12 %% ²", "en", "s", 0.1), (1002, "", None, "s", 0.1), (1003, "the that " * 20_000, None, "s", 0.1), (None, "das haus und", "de", "s", 0.1), (1004, "мир", "en", "s", 0.1)]


def test_held_out_accuracy_and_edges(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string, score double").repartition(3)
    got = {r.doc_id: r for r in langid.identify(docs, PATH, ["doc_id"]).collect()}
    held = [r for r in rows()[:300] if got[r[0]].held_out]
    assert 30 < len(held) < 90 and all(got[r[0]].lang_pred == r[2] for r in held if len(r[1].split()) > 5)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "en" and got[None].lang_pred == "de"
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())


@pytest.mark.parametrize("data", [[], [(5, "some text", None)]])
def test_nothing_to_learn(spark, data):
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in langid.identify(docs, PATH, ["doc_id"]).collect()] == ["und"] * len(data)
