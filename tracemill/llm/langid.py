"""Language identification by segmentation-marginalised unigrams.

A language is a unigram model over the pieces of a fixed public vocabulary. The probability of a word is the sum over all
its segmentations into pieces, by the forward algorithm; a text's is the product over its words (runs of letters,
lower-cased), and the answer is the language of highest posterior under equal priors. Piece probabilities are fitted by
expectation maximisation on labelled training rows: about `sample` rows a language, picked by a hash of doc_id (all rows
where there are fewer); each step runs on the executors and brings back one number per language and piece.

Null texts and texts without a letter, and all texts where no training row exists, give `und` with score 0. Ties go to
the first language in alphabetical order. Rows with null ids or languages are predicted and never trained on. Words of
any length are walked in full, in training and prediction; probabilities are rescaled on the way. Repeated rows count as often as
they occur. An empty table gives no rows. Columns of docs named like a result give way to it. More than `most_languages`
languages are an error.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import forgets, map_batches
from .text import Memo

letters = re.compile(r"[^\W\d_]+").findall
UNKNOWN = 1e-6  # for a character that the vocabulary lacks, in every language
TINY = 1e-200


def vocabulary(path: str) -> dict[str, int]:
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}


def prefixes(path: str) -> dict[str, int]:
    """Every start of a piece, with the id where it is a piece itself, else -1."""
    pieces = _vocabularies[path]
    return {p[:k]: pieces.get(p[:k], -1) for p in pieces for k in range(1, len(p) + 1)}


_vocabularies = Memo(vocabulary, 4)
_prefixes = Memo(prefixes, 4)


def lattice(word: str, starts: dict[str, int]) -> list[tuple[int, int, int]]:
    """Edges (from, to, piece id) of '▁' + word; -1 for a character without a piece. From sorted ascending."""
    w = "▁" + word
    n, out, get = len(w), [], starts.get
    for i in range(n):
        p = get(w[i], -1)
        out.append((i, i + 1, p))
        j = i + 2
        while j <= n:
            p = get(w[i:j])
            if p is None:
                break
            if p >= 0:
                out.append((i, j, p))
            j += 1
    return out


def forward(edges: list[tuple[int, int, int]], probs: list[float]) -> tuple[list[float], list[float]]:
    """Sums over segmentations up to each boundary, each rescaled by exp of its log scale."""
    n = edges[-1][1]
    a, scale = [0.0] * (n + 1), [0.0] * (n + 1)
    a[0], at = 1.0, 0
    shift = 0.0
    for i, j, p in edges:
        if i != at:
            at = i
            if 0 < a[i] < TINY:  # what was reached so far and is yet to be used gets larger by one factor
                up = 1 / a[i]
                shift -= math.log(up)
                for k in range(i, min(n + 1, i + 64)):
                    a[k] *= up
            scale[i] = shift
        a[j] += a[i] * (probs[p] if p >= 0 else UNKNOWN)
    scale[n] = shift
    return a, scale


def log_prob(edges: list[tuple[int, int, int]], probs: list[float]) -> float:
    if edges[-1][1] < 24:  # too short to need rescaling
        a = [1.0] + [0.0] * edges[-1][1]
        for i, j, p in edges:
            a[j] += a[i] * (probs[p] if p >= 0 else UNKNOWN)
        if a[-1] > TINY:
            return math.log(a[-1])
    a, scale = forward(edges, probs)
    return math.log(a[-1]) + scale[-1] if a[-1] > 0 else scale[-1] - 700.0


def backward(edges: list[tuple[int, int, int]], probs: list[float]) -> tuple[list[float], list[float]]:
    """Sums over segmentations from each boundary on, rescaled like those of `forward`."""
    n = edges[-1][1]
    b, scale = [0.0] * (n + 1), [0.0] * (n + 1)
    b[n], at, shift = 1.0, n, 0.0
    for i, j, p in reversed(edges):
        if i != at:  # all edges from `at` are summed
            scale[at] = shift
            if 0 < b[at] < TINY:
                up = 1 / b[at]
                shift -= math.log(up)
                for k in range(at, min(n + 1, at + 64)):
                    b[k] *= up
                    scale[k] = shift
            at = i
        b[i] += b[j] * (probs[p] if p >= 0 else UNKNOWN)
    scale[0] = shift
    return b, scale


def expected(edges: list[tuple[int, int, int]], probs: list[float], times: float, into: dict[int, float]) -> None:
    """Adds the expected number of uses of each piece."""
    a, scale = forward(edges, probs)
    if a[-1] <= 0:
        return  # no segmentation has a probability that a float can hold even when rescaled
    b, behind = backward(edges, probs)
    for i, j, p in edges:
        if p >= 0:
            x = a[i] * probs[p] * b[j]
            if scale[-1] or behind[0]:  # rescaled on the way
                logs = math.log(a[i]) + math.log(probs[p]) + math.log(b[j]) - math.log(a[-1]) if a[i] and probs[p] and b[j] else -math.inf
                x = math.exp(logs + scale[i] + behind[j] - scale[-1])
            else:
                x /= a[-1]
            into[p] = into.get(p, 0.0) + times * x


def fit(train: DataFrame, vocab: str, sample: int = 1500, rounds: int = 3, floor: float = 0.05, most_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """train: doc_id, text, lang. The languages and their piece probabilities."""
    spark = train.sparkSession
    train = train.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages: the model holds a row of piece probabilities for each")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, 0))
    place = {name: n for n, name in enumerate(langs)}
    share = F.coalesce(*[F.when(F.col("lang") == name, min(1.0, sample / sizes[name])) for name in langs])
    picked = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("lang", "text")
    size = max(_vocabularies[vocab].values()) + 1
    probs = np.full((len(langs), size), 1.0 / size)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(probs)

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[dict[str, list]]:
            starts = _prefixes[vocab]
            seen: dict[str, Counter] = {}
            got: dict[str, dict[int, float]] = {}

            def spend() -> None:
                for lang, words in seen.items():
                    p = now.value[place[lang]].tolist()
                    for w, n in words.items():
                        expected(lattice(w, starts), p, n, got.setdefault(lang, {}))
                seen.clear()

            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    seen.setdefault(lang, Counter()).update(letters(text.as_py().lower()))
                if sum(map(len, seen.values())) > 200_000:
                    spend()
            spend()
            for lang, counts in got.items():
                yield {"lang": [lang] * len(counts), "piece": list(counts), "uses": list(counts.values())}

        rows = map_batches(picked, step, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full((len(langs), size), floor)
        for r in rows:
            uses[place[r["lang"]], r["piece"]] += r["uses"]
        probs = uses / uses.sum(axis=1, keepdims=True)
        now.destroy()
    return langs, probs


class WordScores(dict):
    """Word -> row of a table of log probabilities by language, made when first asked for; forgets all when full."""

    def __init__(self, vocab: str, probs: np.ndarray, most: int = 700_000):
        super().__init__()
        self.starts, self.most = _prefixes[vocab], most
        self.probs = [p.tolist() for p in probs]
        self.table, self.rows = np.zeros((1024, len(probs))), 0

    def __missing__(self, word: str) -> int:
        if self.rows == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        edges = lattice(word, self.starts)
        self.table[self.rows] = [log_prob(edges, p) for p in self.probs]
        self[word] = self.rows
        self.rows += 1
        return self.rows - 1

    def text(self, text: str | None) -> np.ndarray | None:
        """Log probability of the text by language; None without a letter."""
        words = letters(text.lower()) if text else []
        if not words or not any(c.isalpha() for w in words for c in w):
            return None
        out = np.zeros(self.table.shape[1])
        for at in range(0, len(words), 100_000):
            if self.rows > self.most:
                self.clear()
                self.rows = 0
            out += self.table_of(words[at : at + 100_000])
        return out

    def table_of(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.table[rows].sum(axis=0)


_scorers: dict[bytes, WordScores] = {}
forgets(__name__, _vocabularies, _prefixes, _scorers)


def predict(docs: DataFrame, vocab: str, langs: list[str], probs: np.ndarray, most: int = 700_000) -> DataFrame:
    """docs with lang_pred and score appended, every other column kept as it is."""
    model = docs.sparkSession.sparkContext.broadcast(probs)
    key = hashlib.sha256(repr((vocab, langs, probs.shape)).encode() + probs.tobytes()).digest()
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = WordScores(vocab, model.value, most)
        scorer = _scorers[key]
        for b in batches:
            pred, score = [], []
            for t in b.column(names.index("text")):
                logs = scorer.text(t.as_py()) if langs else None
                if logs is None:
                    pred.append("und")
                    score.append(0.0)
                else:
                    best = int(logs.argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield {n: b.column(k) for k, n in enumerate(names)} | {"lang_pred": pred, "score": score}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"{fields}, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, vocab: str, keep: list[str], **options) -> DataFrame:
    """Columns `keep`, held_out, lang_pred and score, trained on the rows of docs that aren't held out."""
    langs, probs = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"), vocab, **options)
    keep = [k for k in keep if k not in ("held_out", "lang_pred", "score")]
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []), held_out().alias("held_out"))
    return predict(rows, vocab, langs, probs).select(*keep, "held_out", "lang_pred", "score")
