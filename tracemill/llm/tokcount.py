"""Numbers of tokens of whole texts, by the tokenizer's own library, without keeping a token.

An Arrow function gets a column of texts and returns lengths only. Texts are cut at safe boundaries into pieces of about
`PIECE` bytes, and pieces are put together into batches of about `BATCH` bytes, so that neither a long text nor many short ones
make an uneven batch. Within a batch the texts fall apart at boundaries that no token crosses; chunks that the task hasn't
seen lately are encoded by the library, in calls of at most `CALL` bytes, and their lengths are added up.

A boundary is safe where the tokenizer's own rules can't look across it, which is read from its file:

* word tokenizers, which drop white space before they look for words: at every run of ASCII white space;
* byte-level tokenizers, whose words take the last space before them: before a run of white space;
* sentencepiece models without a piece that goes on into the next run of spaces, and that keep texts as they are: before a
  run of spaces, one of which is put back by the model's own leading space.

With any other tokenizer, and for texts with control characters that libraries class differently, texts are encoded whole.

Texts of more than `giant_bytes` bytes are cut once a distinct text, and their pieces are dealt to all tasks and summed; a text
without any safe boundary stays one piece. Null and empty texts have no bytes and no tokens. Bytes that aren't UTF-8 count as
the replacement character. Special strings in a text are special tokens or not as the library does by default. A row gives a row;
repeated rows give equal results each, nothing is ordered, so there are no ties; an empty table gives none; other columns stay, but columns named
n_bytes or n_tokens give way.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import giants
from .runtime import enter, forgets, map_batches, ship
from .text import Memo

PIECE, BATCH, CALL, KEPT = 1 << 16, 1 << 20, 1 << 18, 64
BETWEEN = re.compile(rb"(?<=[!-~]) (?=[!-~])")
ODD = re.compile("[\x00\x1c-\x1f]").search
BEFORE_SPACE = re.compile(r"\s*\S+|\s+").findall
BEFORE_SPACES = re.compile(r" *[^ ]+(?: +\Z)?| +").findall


class Lengths:
    """Numbers of tokens of texts in bytes; the lengths of up to `most` chunks of at most KEPT bytes are remembered."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.memo: dict = {}
        self.most, self.calls = most, 0
        self._model(path) if path.endswith(".model") else self._json(path)

    def _json(self, path: str) -> None:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        spec = json.loads(t.to_str())
        self.measure = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        self.chunks = {"words": bytes.split, "bytes": self._before_space}.get(kind_of(spec), self._whole)
        self.safe = self.chunks != self._whole

    def _model(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        self.measure = lambda texts: list(map(len, m.encode(texts, num_threads=1)))
        whole = all("".join(m.encode(x, out_type=str)) == "▁" + x.replace(" ", "▁") for x in ("a", "a b", " a  b ", "a   b c"))
        apart = not any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size()))
        same = m.decode(m.encode("ﬁ Å Ⅳ é")) == "ﬁ Å Ⅳ é"
        self.safe = whole and apart and same
        self.chunks = self._before_spaces if self.safe else self._whole

    @staticmethod
    def _whole(text: bytes) -> list[bytes]:
        return [text] if text else []

    @staticmethod
    def _before_space(text: bytes) -> list:
        s = text.decode("utf-8", "replace")
        return [text] if ODD(s) else BEFORE_SPACE(s)

    @staticmethod
    def _before_spaces(text: bytes) -> list:
        s = text.decode("utf-8", "replace")
        if "▁" in s or ODD(s):
            return [text]
        first, *others = BEFORE_SPACES(s) or [""]
        return [first, *(x[1:] for x in others)]

    def pieces(self, text: bytes) -> Iterator[bytes]:
        """The text cut at single spaces between printable ASCII characters, which every safe kind of tokenizer may be cut at; the space
        goes where the model puts one itself or drops it, and stays in front of the next piece elsewhere."""
        at = 0
        while self.safe and len(text) - at > PIECE and (m := BETWEEN.search(text, at + PIECE)):
            yield text[at : m.start()]
            at = m.start() if self.chunks == self._before_space else m.end()
        yield text[at:]

    def batches(self, texts: Iterable[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
        batch, size = [], 0
        for row, text in enumerate(texts):
            for piece in self.pieces(text or b""):
                batch.append((row, piece))
                size += len(piece)
                if size >= BATCH:
                    yield batch
                    batch, size = [], 0
        yield batch

    def learn(self, unseen: Iterable) -> None:
        def known(call):
            self.calls += 1
            self.memo.update(zip(call, self.measure([c.decode("utf-8", "replace") if isinstance(c, bytes) else c for c in call]), strict=True))

        call, size = [], 0
        for c in unseen:
            call.append(c)
            size += len(c)
            if size >= CALL:
                known(call)
                call, size = [], 0
        if call:
            known(call)

    def __call__(self, texts: list[bytes | None]) -> list[int]:
        out = [0] * len(texts)
        for batch in self.batches(texts):
            chunks = [self.chunks(piece) for _, piece in batch]
            unseen = set().union(*chunks).difference(self.memo)
            self.learn(unseen)
            length = self.memo.__getitem__
            for (row, _), own in zip(batch, chunks, strict=True):
                out[row] += sum(map(length, own))
            for c in unseen:
                if len(c) > KEPT:
                    del self.memo[c]
            if len(self.memo) > self.most:
                self.memo.clear()
        return out


def kind_of(spec: dict) -> str | None:
    """'words' or 'bytes' for the two kinds of tokenizer files whose boundaries are known, else None."""
    free = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in spec["added_tokens"])
    if not free or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return None
    steps = spec["pre_tokenizer"] or {}
    steps = steps.get("pretokenizers", [steps])
    norms = spec["normalizer"] or {"normalizers": []}
    norms = norms.get("normalizers", [norms])
    last = steps[-1]
    if last.get("type") != "ByteLevel" or last["add_prefix_space"]:
        return None
    if len(steps) == 1 and last["use_regex"] and not norms:
        return "bytes"
    split = steps[0] if len(steps) == 2 else {}
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norms)
    if plain and not last["use_regex"] and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]:
        pattern = split["pattern"].get("Regex", "")
        # The words are runs of letters, digits, or of what is neither these nor white space, and short endings.
        if re.fullmatch(r"(?:'\w+\||\[\\p\{[LN]\}\]\+?\|)*\[\^\\s\\p\{L\}\\p\{N\}\]\+", pattern):
            return "words"
    return None


_loaded = Memo(Lengths, 4)
forgets(__name__, _loaded)


def counted(text: Column, tokenizer: str) -> Column:
    """Tokens of texts in bytes, as a Column; the other columns stay in the JVM."""

    @F.arrow_udf("bigint")
    def n_tokens(texts: pa.Array) -> pa.Array:
        enter(__name__)
        return pa.array(_loaded[tokenizer](texts.to_pylist()), pa.int64())

    return n_tokens(text)


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", giant_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_bytes long and n_tokens long put last."""
    ship(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_bytes", "n_tokens") and c != text_col))
    text, key = F.col(f"`{text_col}`").cast("binary"), giants.free(docs, "_key")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    usual, long = giants.split(docs, text_col, giant_bytes, key)
    usual = usual.withColumns({"n_bytes": n_bytes, "n_tokens": counted(text, tokenizer)})
    parts = cut_texts(giants.distinct_texts(long, text_col, key), tokenizer, giant_bytes // 4)
    sums = parts.select("key", counted(F.col("bytes"), tokenizer).alias("n")).groupBy("key").agg(F.sum("n").alias("n_tokens"))
    return usual.unionByName(giants.attach(long.withColumn("n_bytes", n_bytes), sums, key))


def cut_texts(texts: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """(key, part, bytes): pieces of about `size` bytes between safe boundaries, dealt evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        lengths = _loaded[tokenizer]
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list[bytes] = []
                part = total = 0
                joint = b"" if lengths.chunks == lengths._before_space else b" "
                for piece in lengths.pieces(text.as_py()):
                    held.append(piece)
                    total += len(piece)
                    if total >= size:
                        yield {"key": [key], "part": [part], "bytes": [joint.join(held)]}
                        held, total, part = [], 0, part + 1
                if held:
                    yield {"key": [key], "part": [part], "bytes": [joint.join(held)]}

    return map_batches(texts.select("key", "text"), run, "key string, part int, bytes binary").repartition("key", "part")
