"""Words of an Arrow column of texts as arrays: positions and 64-bit hashes, without a Python string per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
"""Texts are worked on in slices of about these bytes; a longer text is a slice of its own."""

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

MULTIPLIER = 0x9E3779B97F4A7C13 | 3
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values; one to one for a given salt."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 1)
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for i, base in enumerate((MULTIPLIER, INVERSE)):
            each = np.full(size, base & (1 << 64) - 1, np.uint64)
            each[0] = 1
            _POWERS[i] = np.cumprod(each, dtype=np.uint64)
        if size > 8 * SLICE_BYTES:  # of one very long text: not kept
            once = _POWERS[0][:n], _POWERS[1][:n]
            _POWERS[:] = [p[: 2 * SLICE_BYTES].copy() for p in _POWERS]
            return once
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Running sums of which ``span_hashes`` takes differences."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``codes[start:end]`` for each pair, the same wherever the span stands."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about ``size`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


@dataclass
class Words:
    first: int
    """Position of the slice's first text in the batch."""
    texts: int
    buffer: np.ndarray
    """Bytes of the slice; a space ends each text."""
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    """Text of each word, counted from ``first``."""
    hash: np.ndarray
    begin: np.ndarray
    """First word of each text, and the number of words at the end."""
    ends: np.ndarray
    """Where the space behind each text stands in the buffer."""


def words(column: pa.Array, fold: bool = True, breaks: np.ndarray = WHITE) -> Iterator[Words]:
    """Words (longest runs of bytes that are no breaks) of each slice. ``fold``: A-Z hash as a-z."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        buffer = np.insert(data[offsets[lo] : offsets[hi]], at[1:], 0x20)
        inside = np.zeros(len(buffer) + 1, np.int8)
        inside[1:] = ~breaks[buffer]
        turns = np.diff(inside)
        start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        begin = np.searchsorted(start, at + np.arange(len(at)))
        prefix = prefix_hashes((FOLDED_CODES if fold else BYTE_CODES)[buffer])
        hashes = mix(span_hashes(prefix, start, end))
        yield Words(lo, hi - lo, buffer, start, end, np.repeat(np.arange(hi - lo), np.diff(begin)), hashes, begin, at[1:] + np.arange(len(at) - 1))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``n`` words; of a text with fewer words, the whole sequence as one."""
    counts = np.diff(w.begin)
    per_text = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(w.texts), per_text)
    first = np.repeat(w.begin[:-1] - np.concatenate(([0], np.cumsum(per_text)[:-1])), per_text) + np.arange(len(text))
    length = np.repeat(np.minimum(counts, n), per_text)
    out = mix(length.astype(np.uint64), 7)
    for i in range(n):
        more = i < length
        out[more] = mix(out[more] ^ w.hash[first[more] + i], i + 11)
    return text, out


def distinct(text: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs in that order. Sorts ``value`` within each text in place; ``text`` ascends."""
    begin = np.searchsorted(text, np.arange(texts + 1)).tolist()
    for lo, hi in zip(begin, begin[1:]):
        if hi - lo > 1:
            value[lo:hi].sort()
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
