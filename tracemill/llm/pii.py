"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Patterns give the base spans, in one pass over a text for each kind. Mentions are tokens with @, with an at in brackets, and
runs of digits with their punctuation. The field labels mentions (none or a kind): features of a mention's shape, transitions along
the chain of mentions, and skip edges that join each mention to the previous one that repeats or resembles it (same
part before the at, or the same last seven digits). Mentions that base spans cover are observed; loopy message passing carries
their labels along skip edges. An uncovered mention becomes a span where the marginal of a kind reaches `least`.

All weights are fitted together by pseudo-likelihood on about `sample` rows picked by a hash of id and text, from counts of
feature sets and neighbours' labels. Base labels cannot teach what they miss, so mentions that resemble a base span are left
out as unlabelled, and every base mention is shown a second time as a repeat of an unknown shape with the same label; as often as
a kind on average, mentions of unknown shape that are alone or resemble none are shown as none. What a skip edge weighs follows
from these.

Null texts count as empty and have no spans. Texts are read whole, however long; messages pass over all their mentions. Base
spans are never removed. Ties go to the kind first in the list. Repeated rows give equal results each, null ids like any other;
an empty table gives no rows and weights of zero. Columns of docs that are named like a result give way to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_digit = re.compile("[0-9]").search
_digits = re.compile("[0-9]+").findall
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local_end = re.compile("[A-Za-z0-9._%+-]").match
_ip = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_mention = re.compile(r"\S*@\S*|[+(]?[0-9][0-9().\x20-]*[0-9]").finditer
_spelled = re.compile(r"[\[({]\x20?(?:at|AT)\x20?[\])}]").finditer
_host = re.compile(r"\x20?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*").match


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @, so that long runs of letters cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _local_end(text, start - 1):
            start -= 1
        m = _domain(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = list(emails(text))
    if _digit(text):
        small = lambda p: len(p := p.lstrip("0")) < 4 and int(p or 0) <= 255
        out += [("ip", m.start(), m.end()) for m in _ip(text) if all(map(small, m[0].split(".")))]
        for kind, found, fits in (("card", _card, lambda d: 16 <= len(d) <= 19 and luhn(d)), ("phone", _phone, lambda d: 8 <= len(d) <= 15)):
            out += [(kind, m.start(), m.end()) for m in found(text) if fits("".join(_digits(m[0])))]
    return out


def said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def features(s: str) -> str:
    """A small closed set of shapes, without the plus sign, which a repeat may lack."""
    if cut := split_at(s):
        name, host = cut
        return f"mail at{min(2, s.count('@'))} name{min(1, len(name))} host{0 if not host else 2 if '.' in host.strip('.') else 1}"
    groups = [len(g) for g in _digits(s)]
    size = next(n for n, top in enumerate((0, 3, 7, 15, 19, 10**9)) if sum(groups) <= top)
    last = "-".join(str(min(5, g)) for g in groups[-3:])
    check = f" check{int(luhn(''.join(_digits(s))))}" if size == 4 else ""
    return f"number size{size}{check} dots{min(3, s.count('.'))} {'gap' if re.search('[ ()-]', s) else 'nogap'} groups{last}"


def split_at(s: str) -> tuple[str, str] | None:
    """What stands before and after the at of a mention."""
    if "@" in s:
        name, _, host = s.partition("@")
        return name, host
    m = next(_spelled(s), None)
    return (s[: m.start()].strip(), s[m.end() :].strip()) if m else None


def resembles(s: str) -> str | None:
    """Mentions of equal keys are linked by skip edges."""
    cut = split_at(s)
    if cut:
        name = re.sub(r"[^a-z0-9._%+-]", "", cut[0].lower())
        return "@" + name if len(name) > 2 else None
    d = "".join(_digits(s))
    return d[-7:] if len(d) >= 7 else None


def spelled(text: str) -> list[tuple[int, int]]:
    """Spans of name (at) host."""
    out = []
    for m in _spelled(text):
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        end = start
        while start and _local_end(text, start - 1):
            start -= 1
        h = _host(text, m.end())
        if h and start < end:
            out.append((start, h.end()))
    return out


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, str, int]]:
    """(start, end, string, label): label 0 for none, k for KINDS[k - 1] where a base span overlaps. An @ token is cut to its core."""
    found = []
    for m in _mention(text):
        s = m[0].strip("()[]<>{}.,;:!?\"'|#$%&*") if "@" in m[0] else m[0]
        if s:
            start = m.start() + m[0].index(s)
            found.append((start, start + len(s)))
    other = spelled(text)
    if other:
        free, at = [], 0
        for a, b in found:
            while at < len(other) and other[at][1] <= a:
                at += 1
            if at == len(other) or other[at][0] >= b:
                free.append((a, b))
        found = sorted(free + other)
    by_start = sorted(base, key=lambda s: s[1])
    out, at = [], 0
    for start, end in found:
        while at < len(by_start) and by_start[at][2] <= start:
            at += 1
        over = [b for b in by_start[at : at + 8] if b[1] < end and b[2] > start]
        out.append((start, end, text[start:end], KINDS.index(over[0][0]) + 1 if over else 0))
    return out


def skip_edges(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    last: dict[str, int] = {}
    out = []
    for n, m in enumerate(found):
        key = resembles(m[2])
        if key:
            if key in last:
                out.append((last[key], n))
            last[key] = n
    return out


WIDE = len(KINDS) + 1
NEW = "mention new"  # the features of a mention of unknown shape


def lessons(text: str) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(features, label, labels of the mentions before and after and of the look-alikes before and after; -1: none there
    or unlabelled) of the mentions of a text, and once more of its base mentions, as repeats of unknown shape."""
    found = mentions(text, base_spans(text))
    label = [m[3] for m in found]
    skips = skip_edges(found)
    before, after = [-1] * len(found), [-1] * len(found)
    for a, b in skips:
        before[b], after[a] = a, b
    like_base = [k > 0 for k in label]
    for order in (skips, reversed(skips)):
        for a, b in order:
            like_base[a] = like_base[b] = like_base[a] or like_base[b]
    label = [-1 if like and not k else k for like, k in zip(like_base, label, strict=True)]
    of = lambda n: label[n] if 0 <= n < len(label) else -1
    for n, m in enumerate(found):
        if label[n] >= 0:
            yield features(m[2]), label[n], of(n - 1), of(n + 1), of(before[n]), of(after[n])
        if label[n] > 0:
            yield NEW, label[n], -1, -1, label[n], -1


def fit(docs: DataFrame, sample: int = 20_000, steps: int = 400, keep: float = 1e-4) -> dict:
    """docs: doc_id, text. Weights: unary by feature, chain and skip potentials, all WIDE wide. `keep` pulls weights to zero."""
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < 1_000_003 * min(1.0, sample / max(1, n))).select("text")
    names = ("features", "label", "left", "right", "before", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        got: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                if "@" in text or _digit(text):
                    got.update(lessons(text))
        yield {k: [x[i] for x in got] for i, k in enumerate(names)} | {"n": list(got.values())}

    rows = map_batches(picked, run, "features string, label int, left int, right int, before int, after int, n bigint")
    rows = [tuple(r) for r in rows.groupBy(*names).agg(F.sum("n").alias("n")).collect()]
    return learned(rows + nothing_new(rows), steps, keep)


def nothing_new(rows: list[tuple]) -> list[tuple]:
    """Lessons of none for mentions of unknown shape, alone and after a look-alike that is none: as many as a kind has on average."""
    shown = sum(r[6] for r in rows if r[0] == NEW) / (WIDE - 1)
    return [(NEW, 0, -1, -1, k, -1, max(1.0, shown)) for k in (-1, 0)] if rows else []


def learned(rows: list[tuple], steps: int, keep: float) -> dict:
    """Gradient ascent of the pseudo-likelihood, each weight at its own pace."""
    place = {x: k for k, x in enumerate(sorted({x for r in rows for x in r[0].split()} | {"bias"}))}
    x, y, c = np.zeros((len(rows), len(place))), np.zeros((len(rows), WIDE)), np.array([float(r[6]) for r in rows])
    near = np.zeros((4, len(rows), WIDE))
    for k, r in enumerate(rows):
        x[k, [place[f] for f in r[0].split()] + [place["bias"]]] = 1
        y[k, r[1]] = 1
        for side in range(4):
            if r[2 + side] >= 0:
                near[side, k, r[2 + side]] = 1
    w, chain, skip = np.zeros((len(place), WIDE)), np.zeros((WIDE, WIDE)), np.zeros((WIDE, WIDE))
    paces = [np.full_like(m, 1e-8) for m in (w, chain, skip)]
    for _ in range(steps if len(rows) else 0):
        z = x @ w + near[0] @ chain + near[1] @ chain.T + (near[2] + near[3]) @ skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (y - p) * c[:, None] / c.sum()
        pull = (near[2] + near[3]).T @ miss
        steps_to = (x.T @ miss, near[0].T @ miss + miss.T @ near[1], (pull + pull.T) / 2)
        for m, g, pace in zip((w, chain, skip), steps_to, paces, strict=True):
            g -= keep * m
            pace += g * g
            m += 0.3 * g / np.sqrt(pace)
    return {"unary": {f: w[k] for f, k in place.items()}, "chain": chain, "skip": skip}


def unary(s: str, model: dict) -> np.ndarray:
    """Scores of a mention's shape; one with a feature never seen is of unknown shape."""
    table, names = model["unary"], features(s).split()
    if any(f not in table for f in names):
        names = [f for f in NEW.split() if f in table]
    return table.get("bias", np.zeros(WIDE)) + sum((table[f] for f in names), np.zeros(WIDE))


def marginals(found: list[tuple[int, int, str, int]], skips: list[tuple[int, int]], model: dict, rounds: int = 200, close: float = 1e-6) -> np.ndarray:
    """Loopy sum-product over the chain and the skip edges; mentions with a label are observed. A round goes through the mentions
    forward and back, so that a label crosses the whole text in it. Rounds end when no message moves by `close`; from the
    tenth on messages are damped, and `rounds` bounds those that never settle."""
    n, wide = len(found), WIDE
    alone = np.array([np.where(np.arange(wide) == m[3], 0.0, -50.0) if m[3] else unary(m[2], model) for m in found])
    chain, skip = np.exp(model["chain"]), np.exp(model["skip"])
    edges = [(k, k + 1, chain) for k in range(n - 1)] + [(a, b, skip) for a, b in skips]
    msg = np.zeros((2 * len(edges), wide))  # of edge e: 2e to its later end, 2e + 1 to its earlier one
    ahead: list[list] = [[] for _ in found]
    behind: list[list] = [[] for _ in found]
    for e, (a, b, pot) in enumerate(edges):
        ahead[a].append((2 * e, b, pot))
        behind[b].append((2 * e + 1, a, pot.T))
    belief = alone.copy()
    for turn in range(rounds):
        moved = 0.0
        for order, out in ((range(n), ahead), (range(n - 1, -1, -1), behind)):
            for k in order:
                for e, to, pot in out[k]:
                    x = belief[k] - msg[e ^ 1]
                    new = np.log(np.exp(x - x.max()) @ pot + 1e-300)
                    new -= new.max()
                    step = (new - msg[e]) / (1 if turn < 10 else 2)
                    belief[to] += step
                    msg[e] += step
                    moved = max(moved, float(np.abs(step).max()))
        if moved < close:
            break
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def in_reach(found: list[tuple[int, int, str, int]], skips: list[tuple[int, int]], model: dict, least: float) -> bool:
    """Whether an open mention can get a marginal of `least`: a message changes no odds by more than its potential does."""
    chain, skip = model["chain"], model["skip"]
    chained = np.maximum(0, (chain - chain[:, :1]).max(axis=0)) + np.maximum(0, (chain - chain[:1]).max(axis=1))
    skipped = np.maximum(0, (skip - skip[:, :1]).max(axis=0))
    degree = Counter(x for e in skips for x in e)
    for n, m in enumerate(found):
        if not m[3]:
            u = unary(m[2], model)
            odds = u - u[0] + chained + degree[n] * skipped
            if odds[1:].max() >= math.log(least / (1 - least)):
                return True
    return False


def all_spans(text: str, base: list[Span], model: dict, least: float = 0.9) -> list[Span]:
    """Base spans and those that the field adds."""
    if not base and "@" not in text and not _digit(text) and not next(_spelled(text), None):
        return base
    found = mentions(text, base)
    skips = skip_edges(found)
    if not in_reach(found, skips, model, least):
        return base
    p = marginals(found, skips, model)
    out = list(base)
    for n, m in enumerate(found):
        k = int(p[n, 1:].argmax()) + 1
        if not m[3] and p[n, k] >= least:
            out.append((KINDS[k - 1], m[0], m[1]))
    return out


def find(docs: DataFrame, model: dict, keep: list[str], least: float = 0.9, mask: bool = False) -> DataFrame:
    """Columns `keep` with n_<kind>, base_sha256 and spans; with mask, `text` has each span replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [k for k in keep if k not in {*(f"n_{k}" for k in KINDS), "base_sha256", "spans"}]
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    names = rows.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for b in batches:
            out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
            texts = []
            for t in b.column(at):
                text = t.as_py()
                base = base_spans(text or "")
                spans = all_spans(text or "", base, shared.value, least)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(said(base).encode()).hexdigest())
                out["spans"].append(said(spans))
                texts.append(masked(text, spans) if mask and spans else text)
            cols = {n: b.column(k) for k, n in enumerate(names)}
            yield cols | ({"text": texts} if mask else {}) | out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_batches(rows, run, fields + "".join(f", n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string").select(*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


def masked(text: str, spans: list[Span]) -> str:
    """Overlapping spans become one mark, of the kind that starts first."""
    out, at, end = [], 0, -1
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"[{k.upper()}]"]
            at = end = b
        elif b > end:
            at = end = b
    return "".join([*out, text[at:]])
