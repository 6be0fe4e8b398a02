"""A bitmap of hashed keys: it passes every key put in, and few others.

It has 16 bits a key, within LEAST and MOST: above 2^24 keys more of the others pass, and nothing else changes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

LEAST, MOST = 16, 28  # powers of two: 8 KB to 32 MB


def build(keys: DataFrame, key: str) -> bytes:
    """keys: a bigint column without nulls. The driver gets 2^(bits-6) words at most."""
    ship(keys.sparkSession)
    bits = min(MOST, max(LEAST, 4 + keys.count().bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    word = F.floor(at / 64).cast("int").alias("word")
    got = keys.select(word, (at % 64).cast("int").alias("at")).withColumn("bit", F.expr("shiftleft(1L, at)")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return out.tobytes()


def holds(bitmap: bytes, keys: np.ndarray) -> np.ndarray:
    """For int64 keys; the places are those of Spark's xxhash64 of a bigint."""
    words = np.frombuffer(bitmap, dtype=np.uint64)
    at = spark_xxhash64(keys) & np.uint64(len(words) * 64 - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def spark_xxhash64(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of an 8-byte value, as the SQL function xxhash64 has it."""
    with np.errstate(over="ignore"):
        h = np.full(len(keys), seed + int(_P[4]) + 8, dtype=np.uint64)
        h = _rotate(h ^ (_rotate(keys.view(np.uint64) * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        return h ^ (h >> np.uint64(32))


__all__ = ["build", "holds", "spark_xxhash64"]
