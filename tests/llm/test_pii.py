import hashlib
import itertools
import re

import numpy as np

from tracemill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_the_matches_of_the_patterns():
    g = np.random.default_rng(5)
    parts = ["a", "b.c", "@", ".", "@x.y", "1", "255", "256", "4111 1111-1111 1111", "4111111111111111", "+1 (437) 555-0689", "+", " ", "-", "(", "1.2.3.4", "001.2.3.4", "é", "x@y", "@@", "٣", "\n", "79927398713", "..", "%"]
    for _ in range(4000):
        text = "".join(parts[k] for k in g.integers(0, len(parts), g.integers(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "@", "a@", "+1(", "1 "):
        pii.base_spans(unit * 100_000)


def test_field_adds_what_repeats_a_base_span(spark):
    clean = [f"words of text {i} with {i * 37} numbers" for i in range(100)]
    texts = clean + [f"mail joe{i}.m@host{i}.example.com, call +1 437 555-06{i % 90 + 10} now" for i in range(100)]
    again = "write to anna.b@mail.example.com soon. Or to anna.b@mail please, or +1 437 555-0689, that is (437) 555-0689, not 12 555-1111."
    rows = [(k, t, 7, "x") for k, t in enumerate([*texts, again, None, ""])] + [(None, "a@b.cc", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_email int, spans string").repartition(3)
    model = pii.fit(docs.select("doc_id", "text"))
    got = {r.doc_id: r for r in pii.find(docs, model, ["doc_id"]).collect()}
    for i, t, *_ in rows:
        base = brute(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(said.split(",") if said else []) <= set(spans)
        if i is not None and i < 200:
            assert got[i].spans == said
    added = [again[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[200].spans.split(","))]
    assert sorted(added) == ["(437) 555-0689", "+1 437 555-0689", "anna.b@mail", "anna.b@mail.example.com"]
    text = pii.find(docs, model, ["doc_id", "text"], mask=True).where("doc_id = 200").first().text
    assert text == "write to [EMAIL] soon. Or to [EMAIL] please, or [PHONE], that is [PHONE], not 12 555-1111."


def test_overlapping_spans_become_one_mark():
    assert pii.masked("abcdefgh", [("card", 1, 4), ("phone", 2, 6)]) == "a[CARD]gh"


def test_messages_agree_with_all_labellings_on_a_tree():
    g = np.random.default_rng(1)
    n = len(pii.KINDS) + 1
    model = {"unary": {"bias": g.normal(size=n)}, "chain": g.normal(size=(n, n)), "skip": g.normal(size=(n, n))}
    model["chain"] += model["chain"].T
    found = [(0, 1, "12", 0), (2, 3, "34", 0), (5, 6, "7", 2)]
    p = pii.marginals(found, [], model, rounds=60)
    want = np.zeros((3, n))
    for a in range(n):
        for b in range(n):
            weight = np.exp(model["unary"]["bias"][[a, b]].sum() + model["chain"][a, b] + model["chain"][b, 2])
            want[0, a] += weight
            want[1, b] += weight
            want[2, 2] += weight
    assert np.allclose(p, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def exact(found, skips, model):
    """Marginals by summing over all labellings."""
    n = len(pii.KINDS) + 1
    alone = [pii.unary(m[2], model) for m in found]
    want = np.zeros((len(found), n))
    for labels in itertools.product(*([m[3]] if m[3] else range(n) for m in found)):
        weight = sum(u[k] for u, k, m in zip(alone, labels, found, strict=True) if not m[3])
        weight += sum(model["chain"][a, b] for a, b in itertools.pairwise(labels)) + sum(model["skip"][labels[a], labels[b]] for a, b in skips)
        want[range(len(found)), labels] += np.exp(weight)
    return want / want.sum(axis=1, keepdims=True)


def test_messages_over_skip_edges_against_all_labellings():
    g = np.random.default_rng(3)
    n = len(pii.KINDS) + 1
    text = "call +1 437 555-0689 or 437 555-0689, not 20 or 1234567 but 4375550689; joe.x@mail.com, joe.x@mail"
    found = pii.mentions(text, pii.base_spans(text))
    skips = pii.skip_edges(found)
    assert len(skips) == 3 and len(found) == 7
    for strength, chained, close in ((2.0, 0.0, 1e-5), (0.5, 0.3, 0.05)):  # without a chain it is a forest, else it has loops
        skip = strength * g.normal(size=(n, n))
        chain = chained * g.normal(size=(n, n))
        model = {"unary": {"bias": g.normal(size=n), "number": g.normal(size=n)}, "chain": chain, "skip": skip + skip.T}
        assert np.abs(pii.marginals(found, skips, model) - exact(found, skips, model)).max() < close


def test_bound_of_reach_never_hides_a_span():
    g = np.random.default_rng(4)
    n = len(pii.KINDS) + 1
    text = "call +1 437 555-0689 or 437 555-0689, not 20 or 1234567; joe.x@mail.com, joe.x@mail"
    found = pii.mentions(text, pii.base_spans(text))
    skips = pii.skip_edges(found)
    seen = set()
    for _ in range(200):
        skip = 3 * g.normal(size=(n, n))
        model = {"unary": {"bias": 2 * g.normal(size=n)}, "chain": g.normal(size=(n, n)), "skip": skip + skip.T}
        p = pii.marginals(found, skips, model)
        open_ = [k for k, m in enumerate(found) if not m[3]]
        hit = bool((p[open_, 1:] >= 0.9).any())
        seen.add(hit)
        assert pii.in_reach(found, skips, model, 0.9) or not hit
    assert seen == {True, False}


def test_planted_variants_are_found_and_plain_texts_left_alone(spark):
    g = np.random.default_rng(6)
    docs, planted = [], {}
    for i in range(600):
        name, call, card = f"p{i}.q{i % 7}", f"{g.integers(200, 999)} 555-{g.integers(1000, 9999)}", "4111111111111111"
        docs.append((i, f"in {i} words, {name}@mail{i % 9}.example.com and +1 {call} or {card} of 1{i:03d}9807915762804 x"))
    for i in range(600, 660):
        name, call = f"r{i}.s", f"{g.integers(200, 999)} 555-{g.integers(1000, 9999)}"
        planted[i] = [f"{name} (at) mail.example.com", call, f"{name}@mail"]
        docs.append((i, f"from {name}@mail.example.com, +1 {call}: that is {planted[i][0]}, {planted[i][1]}, {planted[i][2]}, not @user or 2021"))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    model = pii.fit(frame)
    assert np.array_equal(model["skip"], model["skip"].T) and (np.diag(model["skip"])[1:] > 0)[[0, 3]].all()
    text = dict(docs)
    got = {r.doc_id: [text[r.doc_id][int(a) : int(b)] for _, a, b in (s.split(":") for s in r.spans.split(","))] for r in pii.find(frame, model, ["doc_id"]).collect()}
    for i, want in planted.items():
        assert set(want) <= set(got[i]) and len(got[i]) == 5, (want, got[i])
    for i in range(600):
        assert len(got[i]) == len(pii.base_spans(text[i])), (text[i], got[i])


def test_a_label_reaches_fifty_repeats():
    n = len(pii.KINDS) + 1
    model = {"unary": {"bias": np.zeros(n)}, "chain": np.zeros((n, n)), "skip": 8.0 * np.eye(n)}
    for lead in ("", "in 12 or 345 words "):
        text = "write to anna.b@mail.example.com. " + f"{lead}or to anna.b@mail now. " * 50
        spans = pii.all_spans(text, pii.base_spans(text), model)
        assert sum(k == "email" for k, _, _ in spans) == 51


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find(docs, pii.fit(docs), ["doc_id"]).count() == 0
