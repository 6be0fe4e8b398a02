"""A hashed maximum-entropy language model with a class-factored softmax.

log p(word | past) = log p(class | past) + log p(slot | class, past) + log p(word | slot). The first factor is a softmax over
`CLASSES` classes whose scores sum one hashed weight row for each active feature: a bias, the last word, the last two, and
skips to the second and third last. The second is a softmax over the `SLOTS` slots of that class, with rows for the class
alone, with its last word and with its second last. The `SINGLE` most frequent words are classes of their own, the others
are classed by a hash of their last bytes; the `OWN` most frequent words of each class have slots of their own, the others
share slots by a hash. The third is the smoothed share of the word's count in its slot: 1 for a slot of one word.

Counts cover all training rows, by a grouped sum of partial counts. Weight rows grow with the number of distinct words, up to
what `weight_rows` lets be shipped. Weights are trained in `rounds` distributed updates: each takes its own share of
the training rows, so that every row is used once; tasks sum observed and expected feature counts (the latter from outcomes drawn from the
model at each token), which are added up in slices, and the weights take a preconditioned gradient step. Scoring runs in sparse numpy batches. The `head` most frequent words are
shipped with the model, a size that the parameter bounds; the counts of all others meet the documents' rare words in a
join.

Null texts count as empty: one end token. Words unseen in training have count 0. Null ids count as training rows. Without any training
row every base probability is 1. Repeated rows count as often as they occur. Words are matched by 64-bit hashes. Of words with equal counts the one of the smaller
hash comes first. Long texts are scored in parts that know the words before them. Other columns are ignored, so names can't clash; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches, stash
from .text import Memo, mix

SINGLE, CLASSES = 24, 64  # classes of one word each, and all classes
OWN, SLOTS = 16, 32  # slots of one word each in a class, and all its slots
PER = 32  # weight rows in a slice of the gradient
DRAWS = 4  # outcomes drawn for a token
END = b""
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_KIND = mix(np.arange(1, 9, dtype=np.uint64) * _A)


def word_hash(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w)


def word_class(w: bytes) -> int:
    return SINGLE + zlib.crc32(w[-2:]) % (CLASSES - SINGLE)


_kinds = Memo(word_class)  # by the last two bytes


def hashes_and_leaves(ws) -> tuple[np.ndarray, np.ndarray]:
    """Hash, and class with hashed slot, of each word."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    kind = np.fromiter([_kinds[w[-2:]] for w in ws], dtype=np.int64, count=len(ws))
    return h, kind * SLOTS + hashed_slot(h)


def hashed_slot(h: np.ndarray) -> np.ndarray:
    return (OWN + (h >> np.uint64(40)) % np.uint64(SLOTS - OWN)).astype(np.int64)


def slices(texts: Iterator[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
    """Lists of whole texts of about `most` characters, a longer text by itself: words that repeat in one are looked up once."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word of all texts in a row, and how many words each text has: as `text.words` does."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    flat, ends = parts.values, parts.offsets.to_numpy()
    real = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty part
    known = flat.filter(pa.array(real)).dictionary_encode()
    sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[ends])
    return known.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False), known.indices.to_numpy(), sizes


def counted(train: DataFrame) -> DataFrame:
    """h, leaf (class and hashed slot), c of all words, from counts made within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held: Counter = Counter()

        def rows() -> dict[str, list]:
            h, leaf = hashes_and_leaves(held)
            return {"h": h.view(np.int64), "leaf": leaf, "c": list(held.values())}

        for texts in slices(t.as_py() for b in batches for t in b.column(0)):
            ws, code, _ = split(texts)
            held.update(dict(zip(ws, np.bincount(code, minlength=len(ws)).tolist(), strict=True)))
            held[END] += len(texts)
            if len(held) > 1_000_000:
                yield rows()
                held.clear()
        yield rows()

    parts = map_batches(train.select("text"), run, "h bigint, leaf int, c bigint")
    return parts.groupBy("h").agg(F.first("leaf").alias("leaf"), F.sum("c").alias("c"))


class Vocabulary(dict):
    """Word -> place in arrays of what is known of it. Forgets everything when full."""

    def __init__(self, head: dict[str, np.ndarray], most: int = 500_000):
        super().__init__()
        self.head, self.most = head, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.h, self.leaf, self.count = (np.zeros(1 << 16, kind) for kind in (np.uint64, np.int32, np.int64))

    def places(self, ws) -> np.ndarray:
        """Places of distinct words; those that are new get the next ones."""
        fresh = [w for w in ws if w not in self]
        new = slice(len(self), len(self) + len(fresh))
        if fresh:
            h, leaf = hashes_and_leaves(fresh)
            known, count = self.head["h"], np.full(len(h), -1)  # -1: not in the head
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                count[hit] = self.head["c"][at[hit]]
                leaf[hit] = self.head["leaf"][at[hit]]
            while new.stop > len(self.h):
                self.h, self.leaf, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.h, self.leaf, self.count))
            self.h[new], self.leaf[new], self.count[new] = h, leaf, count
            self.update(zip(fresh, range(new.start, new.stop), strict=True))
        return np.fromiter(map(self.__getitem__, ws), dtype=np.int64, count=len(ws))


class Batch:
    """Tokens of several texts in a row. `sizes`: tokens of each text; negative where the text goes on in the next batch."""

    def __init__(self, v: Vocabulary):
        self.v, self.sizes, self.parts, self.held = v, [], [], 0

    def add(self, at: np.ndarray, start: int, end: int) -> None:
        """Tokens start..end of a text whose places are `at`; up to three before them serve as their past."""
        lead = max(0, start - 3)
        self.parts.append((at[lead:end], start - lead, lead))
        self.sizes.append(end - start if end == len(at) else start - end)
        self.held += end - start

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, number of past words in the text (3 at most), and the hashes of the last three words (0: none)."""
        at = np.concatenate([p[0] for p in self.parts])
        n = [len(p[0]) for p in self.parts]
        begin = np.cumsum([0, *n[:-1]])
        past = np.arange(len(at)) - np.repeat(begin - [p[2] for p in self.parts], n)
        h = self.v.h[at]
        back = np.zeros((3, len(at)), dtype=np.uint64)
        for k in (1, 2, 3):
            back[k - 1, k:] = h[:-k]
            back[k - 1][past < k] = 0
        keep = np.arange(len(at)) >= np.repeat(begin + [p[1] for p in self.parts], n)
        return at[keep], past[keep], back[:, keep]


def place_in(h: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each hash, by its upper half: numpy divides whole numbers slowly."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def class_features(past: np.ndarray, back: np.ndarray, rows: int) -> np.ndarray:
    """Weight rows active at each token: n x 5. Row 0: the bias; rows 1 to 4 stand for words before the text's start."""
    out = np.empty((len(past), 5), dtype=np.int32)
    out[:, 0] = 0
    two = back[0] ^ mix(back[1] + _B)
    for k, (x, need) in enumerate(((back[0], 1), (two, 1), (back[1], 2), (back[2], 3))):
        out[:, k + 1] = np.where(past < need, k + 1, 5 + place_in(mix(x * _A + _KIND[k]), rows - 5))
    return out


def slot_features(kind: np.ndarray, back: np.ndarray, rows: int) -> np.ndarray:
    """Weight rows of the second factor: the class alone, with the last word, with the second last."""
    out = np.empty((len(kind), 3), dtype=np.int32)
    out[:, 0] = kind
    own = mix(kind.astype(np.uint64) + _KIND[6])
    for k in (0, 1):
        out[:, k + 1] = CLASSES + place_in(mix(back[k] * _A + _KIND[4 + k] ^ own), rows - CLASSES)
    return out


def odds_of(w: np.ndarray, biases: int, active: int) -> np.ndarray:
    """exp of the weights, so that a product of rows takes the place of a sum and its exp. Doubles where a product of `active` rows, one of
    them among the first `biases`, could leave the range of floats: a step is bounded, so only many rounds lead there."""
    furthest = np.abs(w[:biases]).max() + (active - 1) * np.abs(w).max(initial=0, where=(np.arange(len(w)) >= biases)[:, None])
    return np.exp(w if furthest < 80 else w.astype(np.float64))


def odds(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Odds of all outcomes: products of the rows active at each token."""
    z = e.take(f[:, 0], axis=0)
    row = np.empty_like(z)
    for k in range(1, f.shape[1]):
        z *= e.take(f[:, k], axis=0, out=row, mode="clip")
    return z


def own_scores(e: np.ndarray, f: np.ndarray, own: np.ndarray, block: int = 512) -> np.ndarray:
    """Log probability of each token's own outcome; blocks stay in the cache."""
    out, ones = np.empty(len(f), e.dtype), np.ones(e.shape[1], e.dtype)
    for k in range(0, len(f), block):
        z = odds(e, f[k : k + block])
        out[k : k + block] = z[np.arange(len(z)), own[k : k + block]] / (z @ ones)
    return np.log(out, out=out)


def batched(texts: Iterator[str | None], v: Vocabulary, most: int = 8192) -> Iterator[Batch]:
    out = Batch(v)
    for some in slices(texts):
        ws, code, sizes = split(some)
        if len(v) + len(ws) >= v.most:  # places of one batch belong to one state of the vocabulary
            if out.held:
                yield out
                out = Batch(v)
            v.reset()
        at_all, end, start = v.places(ws)[code], v.places([END])[0], 0
        for n in sizes.tolist():
            at, start = np.append(at_all[start : start + n], end), start + n
            for k in range(0, len(at), most):
                out.add(at, k, min(len(at), k + most))
                if out.held >= most:
                    yield out
                    out = Batch(v)
    if out.held:
        yield out


def feature_sums(own: np.ndarray, f: np.ndarray, w: np.ndarray, seen: np.ndarray, hoped: np.ndarray, draws: np.random.Generator, biases: int = 1) -> None:
    """Adds observed counts of (row, outcome), and expected ones from DRAWS outcomes of each token, drawn from the model in even
    steps of its distribution: their mean is the expectation, at a cost that does not grow with the number of outcomes. The first feature
    of all tokens is one of the first `biases` rows."""
    odds_sums(own, f, odds_of(w, biases, f.shape[1]), seen, hoped, draws)


def odds_sums(own: np.ndarray, f: np.ndarray, e: np.ndarray, seen: np.ndarray, hoped: np.ndarray, draws: np.random.Generator) -> None:
    """feature_sums for weights that `odds_of` has raised."""
    wide, share, one = e.shape[1], np.float32(1 / DRAWS), np.float32(1)
    up_to = np.triu(np.ones((wide, wide), e.dtype))
    seen, hoped = seen.reshape(-1), hoped.reshape(-1)
    for at in range(0, len(own), 512):
        rows = f[at : at + 512].astype(np.int64) * wide
        sums = odds(e, f[at : at + 512]) @ up_to
        np.add.at(seen, (rows + own[at : at + 512, None]).ravel(), one)  # flat places: numpy's quick way
        most = sums[:, -1] * np.float32(1 - 1e-6)
        steps = draws.random(len(sums), dtype=np.float32)[:, None] + np.arange(DRAWS, dtype=np.float32)
        drawn = np.empty((len(sums), DRAWS), np.int64)
        for k in range(DRAWS):
            drawn[:, k] = (sums <= (steps[:, k] * share * most)[:, None]).argmin(axis=1)
        np.add.at(hoped, (rows[:, :, None] + drawn[:, None, :]).ravel(), share)


def token_sums(batch: Batch, e: tuple[np.ndarray, np.ndarray], seen: list[np.ndarray], hoped: list[np.ndarray], draws: np.random.Generator) -> None:
    """Adds the counts of both factors over a batch; e: their raised weights."""
    at, past, back = batch.arrays()
    leaf = batch.v.leaf[at]
    kind, slot = leaf // SLOTS, leaf % SLOTS
    odds_sums(kind, class_features(past, back, len(e[0])), e[0], seen[0], hoped[0], draws)
    inner = kind >= SINGLE
    odds_sums(slot[inner], slot_features(kind[inner], back[:, inner], len(e[1])), e[1], seen[1], hoped[1], draws)


def moved(w: np.ndarray, seen: np.ndarray, hoped: np.ndarray, rate: float, smooth: float) -> np.ndarray:
    """The preconditioned gradient step; a step is bounded."""
    return w + np.clip(rate * (seen - hoped) / (hoped + smooth), -1.5, 1.5).astype(np.float32)


def updated(train: DataFrame, w: tuple[np.ndarray, np.ndarray], head: dict[str, np.ndarray], rate: float, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one distributed update on all rows of train."""
    shared = train.sparkSession.sparkContext.broadcast((w, head))
    shapes = [x.shape for x in w]

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        weights, known = shared.value
        e = raised(weights)
        v, draws = Vocabulary(known), np.random.default_rng(TaskContext.get().partitionId())  # a task that runs again draws the same
        seen, hoped = ([np.zeros(s, np.float32) for s in shapes] for _ in range(2))
        for batch in batched((t.as_py() for b in batches for t in b.column(0)), v, 32768):
            token_sums(batch, e, seen, hoped, draws)
        for factor, (x, y) in enumerate(zip(seen, hoped, strict=True)):
            cut = [np.stack([x[k : k + PER], y[k : k + PER]]) for k in range(0, len(x), PER)]
            full = [k for k, c in enumerate(cut) if c.any()]
            for some in (full[k : k + 128] for k in range(0, len(full), 128)):
                yield {"slice": [2 * k + factor for k in some], "sums": [zlib.compress(cut[k].astype("<f4").tobytes(), 1) for k in some]}

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.frombuffer(zlib.decompress(x.as_py()), "<f4").astype(np.float64)
                total[s] = total[s] + got if s in total else got
        yield {"slice": list(total), "sums": [x.astype("<f4").tobytes() for x in total.values()]}

    parts = map_batches(train.select("text"), gradients, "slice int, sums binary").repartition("slice")
    w = tuple(x.copy() for x in w)
    for r in map_batches(parts, added, "slice int, sums binary").collect():
        k, x = r["slice"] // 2 * PER, w[r["slice"] % 2]
        seen, hoped = np.frombuffer(r["sums"], "<f4").reshape(2, -1, x.shape[1])
        x[k : k + PER] = moved(x[k : k + PER], seen, hoped, rate, smooth)
    shared.destroy()
    return w


def weight_rows(distinct: int, most: int = 1 << 15) -> int:
    """Rows of a weight table: a power of two that grows with the distinct words; `most` bounds what is shipped."""
    return min(most, max(1 << 13, 1 << max(0, distinct // 16 - 1).bit_length()))


def with_slots(top: dict[str, np.ndarray], n_of: np.ndarray, v_of: np.ndarray) -> np.ndarray:
    """Leaves of the head words, which come by falling count: the first are classes of their own, the next of each class have
    slots of their own. Moves their counts in n_of and v_of."""
    leaf, used = top["leaf"].copy(), np.zeros(CLASSES, np.int64)
    for k, (old, c) in enumerate(zip(top["leaf"].tolist(), top["c"].tolist(), strict=True)):
        kind = old // SLOTS
        if k < SINGLE:
            new = k * SLOTS
        elif used[kind] < OWN:
            new = kind * SLOTS + used[kind]
            used[kind] += 1
        else:
            continue
        leaf[k] = new
        n_of[old], v_of[old], n_of[new], v_of[new] = n_of[old] - c, v_of[old] - 1, c, 1
    return leaf


def first_weights(n_of: np.ndarray, v_of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Biases from the counts of classes, and of slots in them; a slot of its own without a word can't occur."""
    w = np.zeros((rows, CLASSES), np.float32), np.zeros((rows, SLOTS), np.float32)
    mass = n_of + v_of + 1.0
    mass[(v_of == 0) & (np.arange(len(mass)) % SLOTS < OWN)] = 0
    mass = mass.reshape(CLASSES, SLOTS)
    kinds = (n_of + v_of).reshape(CLASSES, SLOTS).sum(axis=1) + 1.0
    w[0][0] = np.log(kinds / kinds.sum())
    w[1][:CLASSES] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / np.maximum(mass.sum(axis=1, keepdims=True), 1)), -30)
    return w


def raised(w: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return odds_of(w[0], 1, 5), odds_of(w[1], CLASSES, 3)


def token_logs(w: tuple[np.ndarray, np.ndarray], past: np.ndarray, back: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Natural log of p(class) p(slot | class) at each token."""
    return odds_logs(raised(w), past, back, leaf)


def odds_logs(e: tuple[np.ndarray, np.ndarray], past: np.ndarray, back: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """token_logs for raised weights."""
    kind, slot = leaf // SLOTS, leaf % SLOTS
    out = own_scores(e[0], class_features(past, back, len(e[0])), kind).astype(np.float64)
    inner = np.flatnonzero(kind >= SINGLE)
    out[inner] += own_scores(e[1], slot_features(kind[inner], back[:, inner], len(e[1])), slot[inner])
    return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    """What scoring needs: the weights of both factors, the head words, log10 of each leaf's mass, and counts of the training rows."""

    weights: tuple[np.ndarray, np.ndarray]
    head: dict[str, np.ndarray]
    leaf_log: np.ndarray
    tokens: int
    distinct: int


def fitted(train: DataFrame, table: DataFrame, head_size: int = 200_000, rounds: int = 4, rate: float = 0.5, smooth: float = 4.0) -> Model:
    """train: doc_id, text; table: what `counted` gives for it."""
    size = F.floor(F.log2("c") * 16).cast("int")  # counts by size, to find the least count of the head
    by_size = sorted(((r["size"], r["n"]) for r in table.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, least = head_size, float("inf")
    for k, n in by_size:
        room -= n
        if room < 0:
            break
        least = k
    top = table.where(size >= least).toPandas() if least < float("inf") else table.limit(0).toPandas()
    top = top.sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    head = {"h": top["h"].to_numpy(np.int64).view(np.uint64), "c": top["c"].to_numpy(np.int64), "leaf": top["leaf"].to_numpy(np.int64)}
    n_of, v_of = np.zeros(CLASSES * SLOTS), np.zeros(CLASSES * SLOTS)
    for r in table.groupBy("leaf").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n_of[r["leaf"]], v_of[r["leaf"]] = r["n"], r["v"]
    head["leaf"] = with_slots(head, n_of, v_of)
    order = np.argsort(head["h"])
    head = {k: x[order] for k, x in head.items()}
    n_all, v_all = int(n_of.sum()), int(v_of.sum())
    w = first_weights(n_of, v_of, weight_rows(v_all))
    for k in range(rounds if n_all else 0):
        w = updated(train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k), w, head, rate, smooth)
    return Model(w, head, np.log10(n_of + v_of + 1), n_all, v_all)


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    train = docs.where(~held_out())
    table = stash(counted(train), "counts")
    model = fitted(train, table, **options)
    shared = spark.sparkContext.broadcast(model)
    base_log, log10, n_all = np.log10(model.tokens + model.distinct + 1), np.log(10), model.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        m = shared.value
        v, row, e = Vocabulary(m.head), TaskContext.get().partitionId() << 33, raised(m.weights)
        ids: list = []
        empty = lambda: {k: [] for k in ("row", "doc_id", "n_tokens", "n_known", "base", "score", "tail", "times")}
        out, now, rare, at_doc = empty(), [0, 0, 0.0, 0.0], [], 0

        def texts() -> Iterator[str | None]:
            for b in batches:
                ids.extend(b.column(0).to_pylist())
                for t in b.column(1):
                    yield t.as_py()

        for batch in batched(texts(), v):
            at, past, back = batch.arrays()
            leaf, count = v.leaf[at], v.count[at]
            logs = odds_logs(e, past, back, leaf) / log10 - m.leaf_log[leaf]
            head_log = np.log10(np.maximum(count, 0) + 1)
            start = 0
            for size in batch.sizes:
                s = slice(start, start + abs(size))
                start += abs(size)
                lg = head_log[s].sum()
                now[0] += abs(size)
                now[1] += int((count[s] > 0).sum())
                now[2] += lg - abs(size) * base_log
                now[3] += lg + logs[s].sum()
                rare.append(v.h[at[s][count[s] < 0]])
                if size > 0:
                    tail, times = np.unique(np.concatenate(rare), return_counts=True)
                    for k, x in zip(out, (row, ids[at_doc], *now, tail.view(np.int64), times), strict=True):
                        out[k].append(x)
                    row, at_doc, now, rare = row + 1, at_doc + 1, [0, 0, 0.0, 0.0], []
            if len(out["row"]) >= 500:
                yield out
                out = empty()
                del ids[:at_doc]
                at_doc = 0
        yield out

    rows = stash(map_batches(docs, run, "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, tail array<bigint>, times array<bigint>"), "scored")
    lone = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("h"), F.col("x.times").alias("times"))
    more = lone.join(table.select("h", "c"), "h").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    known, extra = F.coalesce("known", F.lit(0)), F.coalesce("more", F.lit(0.0))
    return rows.drop("tail", "times").join(more, "row", "left").select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))
