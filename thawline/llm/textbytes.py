"""Vectorised word scanning of Arrow string columns with numpy.

A batch of texts is one run of UTF-8 bytes. Both word definitions used here have ASCII separators only, so words
are runs of bytes, and a word's 64-bit hash is a polynomial over its bytes, taken from prefix sums. Work goes in
segments of about ``SEGMENT`` bytes cut at separators, so memory doesn't follow the length of a text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.RandomState(20240607).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)[LOWER]


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: bytes of words: letters, digits and everything outside ASCII
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: bytes of words: all but space and 0x09-0x0D
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads each input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words(NamedTuple):
    """doc: row of each word; start, end: bytes in the batch; hash: of the lower-cased word."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def scan(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, hashed: bool = True, split=None) -> Words:
    """All words of a batch in order. split: gives for bytes where else, within words, a new one starts."""
    total, a, out = len(data), 0, []
    breaks = offsets[1:-1]
    while a < total:
        b = min(total, a + SEGMENT)
        while b < total and word[data[b - 1]] and word[data[b]]:
            more = np.flatnonzero(~word[data[b : b + SEGMENT]])
            b = b + int(more[0]) if len(more) else min(total, b + SEGMENT)
        seg = data[a:b]
        m = word[seg]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        if split is not None and len(seg) > 1:
            more = split(seg)
            first |= more
            last[:-1] |= more[1:]
        cut = breaks[np.searchsorted(breaks, a, "right") : np.searchsorted(breaks, b, "left")] - a
        first[cut] = m[cut]
        last[cut - 1] = m[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if hashed and len(s):
            up, down = _powers(len(seg) + 1)
            sums = np.empty(len(seg) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_VALUES[seg] * up[: len(seg)], dtype=np.uint64, out=sums[1:])
            h = mix((sums[e] - sums[s]) * down[s])
        else:
            h = np.zeros(len(s), np.uint64)
        out.append((s + a, e + a, h))
        a = b
    if not out:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    start, end, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, h)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; entry i is of words i to i+k-1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        acc = (acc * np.uint64(0xD6E8FEB86659FD93)) ^ h[j : j + n]
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """The batch in slices of about ``most`` bytes of text, a row at least."""
    _, off = buffers(batch.column(batch.schema.get_field_index(text)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
