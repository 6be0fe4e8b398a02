"""Fill-in-the-middle: whole texts are cut into prefix, middle and suffix at units drawn by a hash of their id, and put in another order.

Units (code points, words or lines) and marks are matched by one automaton over bytes. A stretch of bytes is summed up by the
function from the state before it to the state after it, and by how many units begin and marks end in it for each state
before it. Two neighbouring stretches compose, and composition is associative, so stretches are summed up without knowing
what comes before them: pairs of bytes by a table, then blocks, then texts, in numpy over many texts at a time. The cut after k
units is found from the top down, by choosing the half that holds unit k and carrying the state to it.

Texts of more than `giant_bytes` bytes are cut into chunks once a distinct text; chunks are summed up by all tasks, in stretches of
`STRETCH` bytes, and a row that holds the text composes these sums and looks into two stretches only.

Form: plain if the text is empty, holds a mark, or by the hash; else suffix first (spm) or prefix first (psm). Nulls: a null
text counts as empty, a null id hashes as an empty string and stays null. Two equal cuts give an empty middle; repeated rows give equal results each,
as all depends on id and text alone. Very long texts go as said above. An empty table gives no rows. Other columns stay;
those named like a result give way.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import giants
from .runtime import enter, forgets, ship
from .text import Memo

BLOCK, STATES, STRETCH, BATCH, PAD = 128, 8, 1 << 16, 1 << 20, 255
MARKS = ("<P>", "<S>", "<M>")
SPACES = b" \t\n\r\x0b\x0c"


def code_points(state: int, byte: int) -> tuple[int, bool]:
    return 0, not 0x80 <= byte < 0xC0


def words(state: int, byte: int) -> tuple[int, bool]:
    """A word begins after white space; what stands before the first word goes with it."""
    inside = byte not in SPACES
    return int(inside), inside and not state


def lines(state: int, byte: int) -> tuple[int, bool]:
    return int(byte != 10), not state


UNITS = {"code_points": code_points, "words": words, "lines": lines}


class Automaton:
    """next1[byte, state] and count1[byte, state] (units begun, and marks ended times 256), next2 and count2 for pairs of bytes.
    Byte 255, which no text holds, leaves every state."""

    def __init__(self, units: str, marks: tuple[str, ...]):
        step, marks = UNITS[units], tuple(m.encode() for m in marks)
        heads = {m[:k] for m in marks for k in range(len(m))}
        states, at = [(0, b"")], 0
        self.next1 = np.tile(np.arange(STATES, dtype=np.uint8), (256, 1))
        self.count1 = np.zeros((256, STATES), np.uint16)
        while at < len(states):
            unit, head = states[at]
            for byte in range(PAD):
                to, begins = step(unit, byte)
                read = head + bytes([byte])
                ends = sum(read.endswith(m) for m in marks)
                new = to, next(read[k:] for k in range(len(read) + 1) if read[k:] in heads)
                if new not in states:
                    states.append(new)
                    if len(states) > STATES:
                        raise ValueError(f"more than {STATES} states")
                self.next1[byte, at] = states.index(new)
                self.count1[byte, at] = begins + 256 * ends
            at += 1
        first, second = np.arange(65536) & 255, np.arange(65536) >> 8
        self.next2 = self.next1[second[:, None], self.next1[first]]
        self.count2 = self.count1[first] + self.count1[second[:, None], self.next1[first]]


def compose(left: tuple, right: tuple) -> tuple:
    """Sums of stretches next to each other: (function, counts)."""
    f, c = left
    at = np.arange(len(f))[:, None] * STATES + f
    return np.take(right[0].ravel(), at), c + np.take(right[1].ravel(), at)


def blocks(auto: Automaton, data: np.ndarray) -> list[tuple]:
    """Sums of pairs of bytes, of four bytes and so on to blocks; data is whole blocks."""
    pairs = data.view("<u2")
    levels = [(auto.next2[pairs], auto.count2[pairs])]
    for _ in range(BLOCK.bit_length() - 2):
        f, c = levels[-1]
        levels.append(compose((f[::2], c[::2]), (f[1::2], c[1::2])))
    return levels


def apart(counts: np.ndarray) -> np.ndarray:
    """Counts of blocks as two numbers a state: units, then marks."""
    return np.stack([counts & 255, counts >> 8], -1).astype(np.int64)


class Tree:
    """Composes rows of stretches, sizes[i] of them for text i, in pairs up to one for each text."""

    def __init__(self, f: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.levels, sizes = [(f, counts, np.cumsum(sizes) - sizes)], sizes
        while sizes.max(initial=0) > 1:
            f, counts, begin = self.levels[-1]
            to = (sizes + 1) // 2
            owner, rank = np.repeat(np.arange(len(to)), to), np.arange(to.sum()) - np.repeat(np.cumsum(to) - to, to)
            left = begin[owner] + 2 * rank
            alone = 2 * rank + 1 >= sizes[owner]
            right = np.where(alone, left, left + 1)
            at = f[left].astype(np.int64)
            g, more = f[right], counts[right]
            g[alone], more[alone] = np.arange(STATES), 0
            new = np.take_along_axis(g, at, 1), counts[left] + np.take_along_axis(more, at[..., None], 1)
            self.levels.append((*new, np.cumsum(to) - to))
            sizes = to

    def total(self) -> np.ndarray:
        """(units, marks) of each text from state 0."""
        return self.levels[-1][1][:, 0]

    def find(self, text: np.ndarray, rank: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where unit `rank` (from 1, at most the total) of each text begins: (stretch, state before it, rank in it); state: before the text."""
        j, state = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64) if state is None else state
        for f, counts, begin in self.levels[-2::-1]:
            left = begin[text] + 2 * j
            here = counts[left, state, 0]
            right = rank > here
            j, rank, state = 2 * j + right, rank - here * right, np.where(right, f[left, state], state)
        return self.levels[0][2][text] + j, state, rank


def find_in_blocks(auto: Automaton, data: np.ndarray, levels: list[tuple], at: np.ndarray, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The byte of data at which unit `rank` (from 1) of block `at` begins, for the state before the block."""
    halves = [*levels[-2::-1], None]
    for half in halves:
        left = 2 * at
        if half is None:
            here, to = auto.count1[data[left], state], auto.next1[data[left], state]
        else:
            here, to = half[1][left, state], half[0][left, state]
        here = (here & 255).astype(np.int64)
        right = rank > here
        at, rank, state = left + right, rank - here * right, np.where(right, to, state)
    return at


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whole blocks for each text, and how many."""
    sizes = np.array([-(-len(t) // BLOCK) for t in texts], dtype=np.int64)
    data = np.full(int(sizes.sum()) * BLOCK, PAD, np.uint8)
    for t, at in zip(texts, (np.cumsum(sizes) - sizes).tolist(), strict=True):
        data[at * BLOCK : at * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return data, sizes


class Cutter:
    """Cuts of texts in bytes, and sums of chunks of long ones."""

    def __init__(self, units: str, marks: tuple[str, ...]):
        self.auto = Automaton(units, marks)

    def batches(self, texts: list[bytes]):
        begin = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= BATCH:
                yield begin, k + 1
                begin, size = k + 1, 0
        if begin < len(texts):
            yield begin, len(texts)

    def cut(self, texts: list[bytes], draws: np.ndarray) -> np.ndarray:
        """draws: two numbers a text. (units, marks, units before the first and the second cut, bytes before them) a text."""
        out = np.zeros((len(texts), 6), np.int64)
        for a, b in self.batches(texts):
            data, sizes = padded(texts[a:b])
            levels = blocks(self.auto, data)
            full = np.flatnonzero(sizes)  # texts without a block are in no tree; they have no units
            tree = Tree(levels[-1][0], apart(levels[-1][1]), sizes[full])
            lengths = np.array([len(texts[a + k]) for k in full], np.int64)
            first = ((np.cumsum(sizes) - sizes) * BLOCK)[full]

            def place(text, rank, data=data, levels=levels, tree=tree, first=first):
                block, state, rank = tree.find(text, rank)
                return find_in_blocks(self.auto, data, levels, block, state, rank) - first[text]

            out[a + full] = self._cuts(tree.total(), draws[a + full], lengths, place)
        return out

    @staticmethod
    def _cuts(total: np.ndarray, draws: np.ndarray, lengths: np.ndarray, place) -> np.ndarray:
        n = total[:, 0]
        units = np.sort(draws % (n + 1)[:, None], 1)
        at = np.where(units == n[:, None], lengths[:, None], 0)
        text, which = np.nonzero((units > 0) & (units < n[:, None]))
        at[text, which] = place(text, units[text, which] + 1)
        return np.column_stack([n, total[:, 1], units, at])

    def sums(self, chunk: bytes) -> bytes:
        """For each STRETCH of the chunk, functions and counts of every state."""
        data, _ = padded([chunk])
        levels = blocks(self.auto, data)
        f, c = levels[-1][0], apart(levels[-1][1])
        per = STRETCH // BLOCK
        n = -(-len(f) // per)
        tree = Tree(f, c, np.array([min(per, len(f) - k * per) for k in range(n)], np.int64))
        f, c, _ = tree.levels[-1]
        return b"".join(x.tobytes() + y.astype("<i8").tobytes() for x, y in zip(f, c, strict=True))

    def cut_giant(self, text: bytes, sums: bytes, draws: np.ndarray) -> np.ndarray:
        """As cut(), of one text whose stretches were summed up before."""
        record = np.frombuffer(sums, np.dtype([("f", "u1", STATES), ("c", "<i8", (STATES, 2))]))
        tree = Tree(record["f"], record["c"], np.array([len(record)]))

        def place(owner, rank):
            stretch, state, rank = tree.find(owner, rank)
            out = np.zeros(len(owner), np.int64)
            for k, (s, q, r) in enumerate(zip(stretch.tolist(), state, rank, strict=True)):
                data, sizes = padded([text[s * STRETCH : (s + 1) * STRETCH]])
                levels = blocks(self.auto, data)
                inner = Tree(levels[-1][0], apart(levels[-1][1]), sizes)
                out[k] = s * STRETCH + self._inner(inner, data, levels, q, r)
            return out

        return self._cuts(tree.total(), draws[None], np.array([len(text)]), place)[0]

    def _inner(self, tree: Tree, data: np.ndarray, levels: list[tuple], state: int, rank: int) -> int:
        block, state, rank = tree.find(np.zeros(1, np.int64), np.array([rank]), np.array([state], np.int64))
        return int(find_in_blocks(self.auto, data, levels, block, state, rank)[0])


_loaded = Memo(lambda key: Cutter(*key), 4)
forgets(__name__, _loaded)
FOUND = "struct<units bigint, marks bigint, low bigint, high bigint, low_at bigint, high_at bigint>"
NAMES = [x.split()[0] for x in FOUND[7:-1].split(", ")]


def _struct(found: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found.reshape(-1, 6).T], NAMES)


def _numbers(a: pa.Array, b: pa.Array) -> np.ndarray:
    return np.column_stack([a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)]).astype(np.int64)


def cuts(key: tuple, text: Column, a: Column, b: Column) -> Column:
    @F.arrow_udf(FOUND)
    def found(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        enter(__name__)
        return _struct(_loaded[key].cut([t or b"" for t in texts.to_pylist()], _numbers(a, b)))

    return found(text, a, b)


def giant_cuts(key: tuple, text: Column, sums: Column, a: Column, b: Column) -> Column:
    @F.arrow_udf(FOUND)
    def found(texts: pa.Array, sums: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        enter(__name__)
        cutter, draws = _loaded[key], _numbers(a, b)
        return _struct(np.array([cutter.cut_giant(t.as_py(), s.as_py(), d) for t, s, d in zip(texts, sums, draws, strict=True)], np.int64))

    return found(text, sums, a, b)


def chunk_sums(key: tuple, chunk: Column) -> Column:
    @F.arrow_udf("binary")
    def sums(chunks: pa.Array) -> pa.Array:
        enter(__name__)
        return pa.array([_loaded[key].sums(c.as_py()) for c in chunks], pa.binary())

    return sums(chunk)


def draw(seed: int, doc_id: Column, k: int) -> Column:
    """The k-th (from 0) group of eight hex digits of the hash of seed and id, as a number."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint")


RESULTS = ["n_units", "form", "prefix_units", "middle_units", "output"]


def fill_in_middle(docs: DataFrame, seed: int = 1, units: str = "code_points", marks: tuple[str, str, str] = MARKS, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text", giant_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_units long, form string, prefix_units and middle_units long (null if plain) and output string. marks: before
    prefix, suffix and middle; none may begin as another or itself ends, so that outputs fall apart in one way only."""
    if any(x.startswith(y[k:]) for x in marks for y in marks for k in range(1, len(y))):
        raise ValueError("marks overlap")
    ship(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in RESULTS and c not in (id_col, text_col)))
    key, found, auto = giants.free(docs, "_key"), giants.free(docs, "_found"), (units, tuple(marks))
    text, ident = F.col(f"`{text_col}`").cast("binary"), F.col(f"`{id_col}`")
    a, b = draw(seed, ident, 0), draw(seed, ident, 1)
    usual, long = giants.split(docs, text_col, giant_bytes, key)
    usual = usual.withColumn(found, cuts(auto, text, a, b))
    step = max(STRETCH, giant_bytes // 2 // STRETCH * STRETCH)
    chunks = giants.dealt(giants.distinct_texts(long, text_col, key), lambda t: F.transform(F.sequence(F.lit(0), F.octet_length(t) - 1, F.lit(step)), lambda i: F.substr(t, i + 1, F.lit(step))))
    sums = chunks.select("key", F.struct("part", chunk_sums(auto, F.col("bytes")).alias("sums")).alias("x")).groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("x"))
    stretches = giants.free(docs, "_sums")
    joined = F.aggregate("x", F.lit(b""), lambda out, x: F.concat(out, x["sums"]))
    long = giants.attach(long, sums.select("key", joined.alias(stretches)), key)
    long = long.withColumn(found, giant_cuts(auto, text, F.col(stretches), a, b)).drop(stretches)
    return shaped(usual.unionByName(long), found, text, ident, seed, marks, plain_percent, spm_percent)


def shaped(rows: DataFrame, found: str, text: Column, ident: Column, seed: int, marks: tuple[str, str, str], plain_percent: int, spm_percent: int) -> DataFrame:
    cut = {n: F.col(f"{found}.{n}") for n in NAMES}
    plain = (F.coalesce(F.octet_length(text), F.lit(0)) == 0) | (cut["marks"] > 0) | (draw(seed, ident, 2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(draw(seed, ident, 3) % 100 < spm_percent, "spm").otherwise("psm")
    prefix, middle, suffix = (F.substr(text, i + 1, j - i).cast("string") for i, j in ((F.lit(0), cut["low_at"]), (cut["low_at"], cut["high_at"]), (cut["high_at"], F.octet_length(text))))
    p, s, m = map(F.lit, marks)
    rows = rows.withColumns({"n_units": cut["units"], "form": form})
    whole = F.coalesce(text.cast("string"), F.lit(""))
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    shown = F.col("form") != "plain"
    return rows.withColumns({"prefix_units": F.when(shown, cut["low"]), "middle_units": F.when(shown, cut["high"] - cut["low"]), "output": output}).drop(found)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from output and form alone."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
