"""Sum-of-squares online packing of token ids into windows.

Every task packs the documents it reads, with no shuffle. A level array counts the partially filled windows by fill, in 64
levels; a document's last part goes to the level for which the sum of squared counts becomes least. Full windows are written at
once. A window whose gap is below one level is filled with the head of the next document, so few windows are open at any
time: what is open at a task's end (a fortieth of 500 documents, a three-hundredth of 10,000) or when `open_limit` windows are
open is laid end to end and cut at the window size, and the last rest is cut at powers of two, which need no padding.

Nulls: a null text counts as empty, and holds the end id only; a null id stays null. Ties go to the fullest level.
Repeated rows are packed as often as they occur. An empty table gives no pieces. Long texts fill windows of their own, and their
last part goes by the rule. Extra columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import forgets, map_batches
from .text import Memo

ODD_SPACE = re.compile("[\x1c-\x1f]").search  # str.split() takes these for white space, the tokenizer doesn't
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordTokens:
    """Ids of texts, the end id appended. The tokenizer drops white space, lower-cases and cuts texts into word parts.

    Texts of Latin-1 characters, for which that cutting is plain, are cut here, and the ids of chunks between white space
    and of word parts are memoised (no rule crosses white space): the tokenizer's model sees new parts only. Other
    texts, and those that spell out added tokens, go through the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.whole, self.end = Tokenizer.from_file(path), np.uint32(end_id).tobytes()
        spec = json.loads(self.whole.to_str())
        self.added = [x["content"] for x in spec["added_tokens"]]
        bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        chars = [chr(c) for c in range(256)]
        letters, numbers = (re.escape("".join(c for c in chars if unicodedata.category(c)[0] == kind)) for kind in "LN")
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\t-\\r \x85\xa0{letters}{numbers}]+").findall
        shown = byte_letters()
        cut = bare.model.tokenize
        self.part_ids = Memo(lambda w: array("I", [t.id for t in cut(w.encode().decode("latin-1").translate(shown))]).tobytes(), most)
        self.chunk_ids = Memo(lambda c: b"".join(map(self.part_ids.__getitem__, self.parts(c))), most // 2)

    def __call__(self, text: str) -> bytes:
        if not latin(text) or any(a in text for a in self.added):
            return self._whole(text)
        text = text.lower()
        chunks = self.parts(text) if ODD_SPACE(text) else text.split()
        return b"".join(map(self.chunk_ids.__getitem__, chunks)) + self.end

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + self.end


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(others)}


_loaded = Memo(lambda key: WordTokens(*key), 8)
forgets(__name__, _loaded)


class SquaresPacker:
    """Windows of one task. Pieces are (doc, start, ids, doc_tokens); closed windows are lists of pieces."""

    def __init__(self, window: int, open_limit: int, step: int | None = None):
        self.window, self.open_limit, self.step = window, open_limit, step or max(1, window // 64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(self.level_of(window) + 1)]
        self.levels = [0] * len(self.open)
        self.n_open = self.placed = self.relaid = 0

    def level_of(self, fill: int) -> int:
        return -(-fill // self.step)

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) whose use makes the sum of squared counts least. Ties go to the fullest."""
        n, best, least = self.levels, 0, 2 * self.levels[self.level_of(size)] + 1
        for h in range(len(n) - 1, 0, -1):
            if n[h] and (fill := self.open[h][-1][0] + size) <= self.window:
                to = self.level_of(fill)
                cost = 1 - 2 * n[h] if fill == self.window else 0 if to == h else 2 * (n[to] - n[h]) + 2
                if cost < least or cost == least and not best:
                    best, least = h, cost
        return best

    def take(self, h: int) -> tuple[int, list]:
        self.levels[h] -= 1
        self.n_open -= 1
        return self.open[h].pop()

    def put(self, fill: int, pieces: list) -> Iterator[list]:
        if fill == self.window:
            yield pieces
            return
        h = self.level_of(fill)
        self.open[h].append((fill, pieces))
        self.levels[h] += 1
        self.n_open += 1
        if self.n_open > self.open_limit:
            yield from self.flush(last=False)

    def place(self, piece: tuple) -> Iterator[list]:
        """A window of the top level, whose gap is below one level, is filled with the piece's head; the rest goes by the rule."""
        size = len(piece[2]) // 4
        self.placed += size
        while self.levels[-1] and self.open[-1][-1][0] + size > self.window:
            fill, pieces = self.take(len(self.open) - 1)
            doc, start, ids, n = piece
            gap = self.window - fill
            yield [*pieces, (doc, start, ids[: gap * 4], n)]
            piece, size = (doc, start + gap, ids[gap * 4 :], n), size - gap
        h = self.level_for(size)
        fill, pieces = self.take(h) if h else (0, [])
        yield from self.put(fill + size, [*pieces, piece])

    def add(self, doc, ids: bytes) -> Iterator[list]:
        n, step = len(ids) // 4, self.window * 4
        for at in range(0, len(ids) - step + 1, step):
            self.placed += self.window
            yield [(doc, at // 4, ids[at : at + step], n)]
        if n % self.window:
            at = n // self.window * self.window
            yield from self.place((doc, at, ids[at * 4 :], n))

    def flush(self, last: bool = True) -> Iterator[list]:
        """Lay all open windows end to end, cut at the window size; the rest stays open, or is cut at powers of two."""
        pieces = [p for level in reversed(self.open) for _, w in level for p in w]
        total = sum(len(p[2]) for p in pieces) // 4
        self.relaid += total
        self.open = [[] for _ in self.open]
        self.levels, self.n_open = [0] * len(self.open), 0
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1] if last else [rest] * bool(rest)
        queue = iter(pieces)
        piece = next(queue, None)
        for size in sizes:
            out, left = [], size
            while left:
                doc, start, ids, n = piece
                take = min(left, len(ids) // 4)
                out.append((doc, start, ids[: take * 4], n))
                left -= take
                piece = (doc, start + take, ids[take * 4 :], n) if take * 4 < len(ids) else next(queue, None)
            if not last and size < self.window:
                yield from self.put(size, out)
            else:
                yield out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, open_limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; `ids` holds its ids as little-endian unsigned 32-bit numbers. sequence_id: task number * 2^33 + window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        tokens, packer = _loaded[tokenizer, end_id], SquaresPacker(window, open_limit)
        sequence = TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out: list[tuple] = []
        held = 0

        def closed(windows: Iterator[list]) -> int:
            nonlocal sequence
            size = 0
            for w in windows:
                at = 0
                for doc, start, ids, n in w:
                    out.append((doc, start, len(ids) // 4, ids, n, sequence, at))
                    at += len(ids) // 4
                size += at
                sequence += 1
            return size

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held += closed(packer.add(doc, tokens(text.as_py() or "")))
                if held >= 1 << 20:
                    yield dict(zip(names, zip(*out), strict=True))
                    out, held = [], 0
        closed(packer.flush())
        if out:
            yield dict(zip(names, zip(*out), strict=True))

    return map_batches(docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")), run, SCHEMA)
