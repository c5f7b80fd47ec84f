"""Words and word windows of whole batches of texts as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D (they never occur inside a UTF-8 sequence). Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Words:
    data: np.ndarray  # the texts' bytes
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about that many bytes at most (or a single row)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0)
    lo, total = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        if total and total + n > most:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def split(texts: pa.Array, lower: bool = False) -> Words:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    after = np.ones(n, dtype=bool)  # the byte before is no part of the same word
    after[1:] = space[:-1]
    begins = ~space & (after | edge[:-1])
    before = np.ones(n, dtype=bool)
    before[:-1] = space[1:]
    ends = ~space & (before | edge[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if len(start):
        inside = np.flatnonzero(~space)
        size = end - start
        lead = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = inside - np.repeat(start, size)
        h = mix(data[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h = mix(np.add.reduceat(h, lead))
    else:
        h = np.zeros(0, np.uint64)
    return Words(data, start, end, h, np.searchsorted(start, offsets, side="left"))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive word hashes (they may reach over texts)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j : j + n] * _ODD[j]
    return mix(out)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of each text, sorted, one text after the other, and where each text's begin (one more than
    texts). A text with fewer words has its whole sequence as its only one, a text without words none."""
    every = windows(w.hash, size)
    parts, counts = [], [0]
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            u = np.unique(every[a : b - size + 1])
        elif b > a:
            u = mix(np.add.reduce(w.hash[a:b] * _ODD[: b - a], keepdims=True) + np.uint64(b - a))
        else:
            u = np.zeros(0, np.uint64)
        parts.append(u)
        counts.append(len(u))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)
