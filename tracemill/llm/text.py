"""Words, hashes and shingles of whole texts, for numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .runtime import forgets

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words(text: str | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased, as UTF-8 (bytes.split and bytes.lower know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Memo(dict):
    """A bounded memo: forgets everything when full, so that memory stays within `most` entries."""

    def __init__(self, f, most: int = 400_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.f(key)
        return out


_hashes = Memo(xxhash.xxh3_64_intdigest)
forgets(__name__, _hashes)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence where there are fewer words; empty without words."""
    h = word_hashes(words(text))
    if not len(h):
        return h
    k = min(k, len(h))
    acc = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        acc = mix(acc * _K1 + h[j : len(h) - k + 1 + j] * _K2 + _K3)
    return np.unique(acc)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
