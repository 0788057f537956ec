"""Whole texts to numpy arrays, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k words; empty if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(h[:n] + _A)
    for i in range(1, k):
        out = mix(out * _A + h[i : n + i])
    return out


def shingle_set(ws: list[bytes], k: int) -> np.ndarray:
    """The sorted distinct k-word shingles, hashed; with fewer words, the whole sequence as one; none without words."""
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
    return np.unique(window_hashes(word_hashes(ws), k))


def slices(batches: Iterator[pa.RecordBatch], text_at: int, max_chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, texts) with about max_chars characters each, one text at least; null texts become empty."""
    for batch in batches:
        start, size, texts = 0, 0, []
        for i, t in enumerate(batch.column(text_at)):
            t = t.as_py() or ""
            if texts and size + len(t) > max_chars:
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(t)
            size += len(t)
        if texts:
            yield batch.slice(start), texts
