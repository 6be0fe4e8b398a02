"""SentencePiece encoding and decoding by streaming Viterbi over a public vocabulary.

The best segmentation maximises the sum of the model's piece scores; a character without a piece costs ten less than the
least score and is written as byte pieces. A model of merges, as the one of the registered query, has ranks for scores: there the
ids are valid pieces that decode to the text, but not those that merging in order of rank would give.

The decoder keeps back-pointers for a window only: whenever the paths of all boundaries that a later piece could still start
from meet in one boundary, the ids up to it are committed and forgotten. No piece spans the boundary before a run of spaces, so all
paths meet there by construction; texts are cut there and the ids of the parts memoised. `stream` takes a text uncut as well,
with equal ids.

White space becomes '▁' and one is put in front; decoding undoes both, so a text comes back as it was unless it holds '▁'
itself. Null and empty texts have no ids; a null decodes to null. Ties go to the longer last piece. No limit on length. Repeated
rows give equal results each, an empty table gives no rows, and a column named like a result gives way to it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import forgets, map_batches
from .text import Memo

SPACE = "▁"


class Pieces:
    def __init__(self, path: str, most: int = 600_000):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.ids = {m.id_to_piece(i): i for i in ids}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in ids}
        self.names = {i: p for p, i in self.ids.items()}
        bytes_ = [i for i in range(m.get_piece_size()) if m.is_byte(i)]
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in bytes_}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = min(s for s in self.scores.values() if s > -1e8) - 10
        self.longest = max(map(len, self.ids))
        self.suffixes = {p[k:] for p in self.ids for k in range(len(p))}
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)  # no piece goes on into the next run of spaces
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if apart else lambda t: [t]
        self.memo = Memo(lambda part: array("I", self.stream(part)).tobytes(), most)

    def stream(self, chars: Iterable[str], stats: dict | None = None) -> Iterator[int]:
        """Ids of a stream of characters. stats gets the longest window that was held, and how often ids were committed before the end."""
        score, suffixes, longest = self.scores.get, self.suffixes, self.longest
        window, best, back, m, wait = "", [0.0], [0], 0, self.longest
        for c in chars:
            window += c
            k, m = m, m + 1
            s = score(c)
            top, frm = best[k] + (self.unknown if s is None else s), k
            while k and m - k < longest:  # longer pieces that end here, while any piece ends so
                k -= 1
                part = window[k:]
                if part not in suffixes:
                    break
                s = score(part)
                if s is not None and best[k] + s >= top:
                    top, frm = best[k] + s, k
            best.append(top)
            back.append(frm)
            if m >= wait:
                live = set(range(max(0, m - longest + 1), m + 1))
                while len(live) > 1:
                    k = max(live)
                    live.discard(k)
                    live.add(back[k])
                meet = live.pop()
                if stats is not None:
                    stats["window"] = max(stats.get("window", 0), m)
                    stats["commits"] = stats.get("commits", 0) + (meet > 0)
                if meet:
                    yield from self.path(window, meet, back)
                    window, best, back, m = window[meet:], [x - best[meet] for x in best[meet:]], [x - meet for x in back[meet:]], m - meet
                wait = m + longest
        yield from self.path(window, m, back)

    def path(self, window: str, end: int, back: list[int]) -> list[int]:
        cuts = [end]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        out = []
        for a, b in zip(cuts[:0:-1], cuts[-2::-1], strict=True):
            p = window[a:b]
            out += [self.ids[p]] if p in self.ids else [self.bytes[x] for x in p.encode("utf-8")]
        return out

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        return b"".join(map(self.memo.__getitem__, self.cut(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: bytes) -> str:
        out, raw = [], bytearray()
        for i in np.frombuffer(ids, dtype="<u4").tolist():
            if i in self.of_byte:
                raw.append(self.of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.names.get(i, ""))
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")[1:]


_loaded = Memo(Pieces, 4)
forgets(__name__, _loaded)


def _fields(df: DataFrame) -> str:
    return "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """docs with piece_ids binary put first."""
    docs = docs.drop("piece_ids")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        p = _loaded[model]
        for b in batches:
            yield {"piece_ids": [p.encode(t.as_py()) for t in b.column(names.index(text_col))]} | {n: b.column(k) for k, n in enumerate(names)}

    return map_batches(docs, run, "piece_ids binary" + _fields(docs))


def decode(docs: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """docs with decoded string put first."""
    docs = docs.drop("decoded")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        p = _loaded[model]
        for b in batches:
            yield {"decoded": [None if x.as_py() is None else p.decode(x.as_py()) for x in b.column(names.index(ids_col))]} | {n: b.column(k) for k, n in enumerate(names)}

    return map_batches(docs, run, "decoded string" + _fields(docs))
