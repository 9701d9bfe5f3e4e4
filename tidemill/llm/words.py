"""Word and shingle hashes of a whole Arrow batch of texts at once.

Words are the runs of bytes outside space and tab..carriage return, after
lower-casing A-Z. A word's hash is a polynomial over random byte values,
finished by a mixer; a shingle's hash combines its words' hashes in order.
Nothing depends on the process, so every executor gets the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two multiply-xorshift steps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def mix1(x: int) -> int:
    return int(mix(np.array([x], dtype=np.uint64))[0])


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        powers = np.full(max(n, 64), _BASE, dtype=np.uint64)
        powers[0] = 1
        _POWERS = np.multiply.accumulate(powers)
    return _POWERS


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts (and the last ends)."""
    kind = pa.large_string()
    texts = pc.fill_null(texts.cast(kind), pa.scalar("", kind))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a text's edge ends a word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, and each text's first word (and the end)."""
    raw, offsets = raw_bytes(texts)
    raw = LOWER[raw]
    starts, ends = word_bounds(raw, offsets)
    first = np.searchsorted(starts, offsets)
    return hash_spans(raw, starts, ends), first


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = np.cumsum(lengths)
    begin = total - lengths
    place = np.arange(total[-1]) - np.repeat(begin, lengths)
    values = _BYTE[raw[np.repeat(starts, lengths) + place]] * _powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * _BYTE[0])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and each text's first shingle (and the end).

    A text with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    counts = np.diff(first)
    have = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    out_first = np.concatenate([[0], np.cumsum(have)])
    n = out_first[-1]
    if n == 0:
        return np.zeros(0, np.uint64), out_first
    text = np.repeat(np.arange(len(counts)), have)
    at = first[:-1][text] + (np.arange(n) - out_first[:-1][text])
    end = first[1:][text]
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        here = at + k
        inside = here < end
        out = out * np.uint64(0xA0761D6478BD642F) + np.where(
            inside, words[np.minimum(here, len(words) - 1)], np.uint64(k + 1))
    return mix(out), out_first
