"""64-bit hashes of words and word shingles, vectorised over the bytes of a text column.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Every word gets a polynomial
hash of its bytes modulo 2**64, taken from prefix sums, then mixed; a shingle is a
polynomial of its words' hashes, mixed again. Two different words of a corpus share
a hash with probability about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a single longer text makes a chunk of its own.
CHUNK = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = (_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses up to n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def chunks(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null texts are empty."""
    text = text.cast(pa.large_binary())
    if text.null_count:
        text = text.fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        end = min(end, len(text))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[cuts] = inside[cuts]
    ends[cuts[1:] - 1] = inside[cuts[1:] - 1]
    ends[-1] = inside[-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    h = (sums[end] - sums[begin]) * inverse[begin]
    return mixed(h + (end - begin).astype(np.uint64)), np.searchsorted(begin, offsets)


def shingle_sets(text: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of so many words.

    A text of fewer words has its whole sequence as one shingle; without words, none.
    """
    for _, data, offsets in chunks(text):
        h, first = word_hashes(data, offsets)
        s = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            s = s * _SHINGLE + h[k : k + len(s)]
        s = mixed(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(s[a : b - size + 1])
            elif b > a:
                one = np.zeros(1, np.uint64)
                for x in h[a:b]:
                    one = one * _SHINGLE + x
                yield mixed(one + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
