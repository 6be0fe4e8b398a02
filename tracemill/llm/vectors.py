"""Blocks of vectors: many rows of an embedding table packed into one binary row, so that a task works on matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import map_batches

NO_ID = np.iinfo(np.int64).max
BLOCK = "block bigint, kind string, n int, dim int, uids binary, ids binary, extra binary, data binary"


def finite(v: str) -> Column:
    """True for vectors that are not null or empty and hold no null, NaN or infinite component."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(F.col(v).isNotNull() & (F.size(v) > 0) & ok, F.lit(False))


def pack_blocks(df: DataFrame, rows: int, query: str | None = None, query_rows: int = 256) -> DataFrame:
    """df: id bigint, extra bigint, v array<double or float>. Blocks of kind 'c' hold all rows, of kind 'q' those where
    the boolean column `query` is true. uids number the rows of a task. Vectors of a block have one length."""
    cols = ["id", "extra", "v", *([query] if query else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        at, held, blocks = 0, {}, 0

        def block(key) -> dict[str, list]:
            nonlocal blocks
            got = held.pop(key)
            blocks += 1
            uids, ids, extra, vs = zip(*got, strict=True)
            as8 = lambda x: np.array(x, dtype="<i8").tobytes()
            return {"block": [base + blocks], "kind": [key[0]], "n": [len(ids)], "dim": [key[1]], "uids": [as8(uids)], "ids": [as8(ids)], "extra": [as8(extra)], "data": [np.stack(vs).astype("<f8" if vs[0].dtype == np.float64 else "<f4").tobytes()]}

        for b in batches:
            vs = b.column(2)
            flat, off = vs.values.to_numpy(zero_copy_only=False), vs.offsets.to_numpy()
            asked = b.column(3).to_pylist() if query else [False] * len(b)
            for k, (i, x, q) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), asked, strict=True)):
                v = flat[off[k] : off[k + 1]]
                for key, most in ((("c", len(v)), rows), (("q", len(v)), query_rows))[: 1 + bool(q)]:
                    held.setdefault(key, []).append((base + at, NO_ID if i is None else i, x or 0, v))
                    if len(held[key]) >= most:
                        yield block(key)
                at += 1
        for key in list(held):
            yield block(key)

    return map_batches(df.select(*cols), run, BLOCK)


def opened(blocks, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """uids, ids, extra and the matrix of pandas rows of blocks, zero-padded to `width` columns."""
    ints = [np.concatenate([np.frombuffer(x, "<i8") for x in blocks[c]]) if len(blocks) else np.zeros(0, np.int64) for c in ("uids", "ids", "extra")]
    out = np.zeros((len(ints[0]), width))
    at = 0
    for n, d, x in zip(blocks["n"], blocks["dim"], blocks["data"], strict=True):
        out[at : at + n, :d] = np.frombuffer(x, "<f8" if len(x) == 8 * n * d else "<f4").reshape(n, d)
        at += n
    return *ints, out
