"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers with numpy.

Words are runs of bytes other than U+0020 and U+0009 to U+000D, A-Z lower-cased; in UTF-8 these
are ASCII bytes, so a text is read as bytes. A word's hash is a polynomial over its bytes, taken
from one prefix sum over the buffer and mixed afterwards; a shingle's hash mixes its words'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # texts handled together; a longer text is handled alone
_SPACES = b" \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


_VALUES = _byte_values()
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(_SPACES)] = False
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; NULL is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string()) if len(texts) else texts
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, whole[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of the first word of each text (one more at the end)."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = _IS_WORD[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # a text begins here, or the buffer ends
    starts = np.flatnonzero(inside & (first[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * down[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, words: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and their bounds.

    A text with fewer words than a shingle has the whole sequence as its one shingle; a text
    without words has none.
    """
    hashes, bounds = word_hashes(data, offsets)
    n = max(0, len(hashes) - words + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        runs = mix(runs * np.uint64(_BASE) + hashes[k:k + n])
    sets, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.unique(runs[a:b - words + 1])
        elif b > a:
            own = np.array([b - a], dtype=np.uint64)
            for h in hashes[a:b]:
                own = mix(own * np.uint64(_BASE) + h)
        else:
            own = hashes[:0]
        sets.append(own)
        sizes.append(len(own))
    return (np.concatenate(sets) if sets else hashes[:0]), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
