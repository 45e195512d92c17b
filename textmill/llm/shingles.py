"""Word shingles of whole batches of texts in numpy: words, their hashes and the sets of shingle hashes.

A word's hash is a polynomial over random numbers that stand for its bytes, modulo 2**64. Prefix sums over a block of
text give the hashes of all its words at once. Blocks end between words, so memory is bounded by BLOCK bytes and the
longest word, however long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text hashed at once.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Numbers that stand for bytes; A-Z have those of a-z.
_CODE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_CODE[65:91] = _CODE[97:123]


class Powers:
    """Powers of an odd base modulo 2**64, kept between calls."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), 1 << 64))
            self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


_UP, _DOWN = Powers(_BASE), Powers(_INVERSE)


def _hash_block(data: np.ndarray, cuts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a block; no word crosses a cut."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * _UP(len(data)), out=sums[1:])
    found = (sums[stop] - sums[start]) * _DOWN(len(data))[start]
    return _mixed(found + (stop - start).astype(np.uint64)), start


def word_hashes(data: np.ndarray, cuts: np.ndarray, block: int = BLOCK, code: np.ndarray = _CODE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of data, and for each cut the number of words before it. cuts: offsets of texts; code: the
    numbers that stand for bytes, by default alike for A-Z and a-z."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + block)
        while stop < len(data) and not _SPACE[data[stop - 1]] and not _SPACE[data[stop]]:
            space = np.flatnonzero(_SPACE[data[stop : stop + block]])
            stop = stop + int(space[0]) if len(space) else min(len(data), stop + block)
        h, s = _hash_block(data[at:stop], cuts - at, code)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), cuts)


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of so many words, from the hashes of the words."""
    n = len(h)
    if n < width:
        return h[:0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _UP(n), out=sums[1:])
    return _mixed((sums[width:] - sums[:-width]) * _DOWN(n)[: n - width + 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the offsets at which they begin and end; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = texts.buffers()[2]
    return (np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)), bounds


def _slices(offsets: np.ndarray, limit: int):
    """(start, stop) of runs of texts of about limit bytes each; a longer text is a run of its own."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, rows)
        start = stop


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) > 1 else values


def shingle_sets(texts: pa.Array, block: int = BLOCK):
    """(start, stop, sets) for runs of texts: the distinct shingle hashes of each, sorted; a null text has none.

    A shingle is SHINGLE words in a row; fewer words are one shingle; no word, none."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    whole = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    for start, stop in _slices(bounds, block):
        cuts = bounds[start : stop + 1]
        h, at = word_hashes(whole[cuts[0] : cuts[-1]], cuts - cuts[0], block)
        rolled = np.full(max(0, len(h) - SHINGLE + 1), np.uint64(SHINGLE))
        for j in range(SHINGLE):
            rolled = rolled * np.uint64(_BASE) + h[j : j + len(rolled)]
        rolled = _mixed(rolled)
        sets = []
        for row, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), start):
            if missing[row] or a == z:
                sets.append(h[:0])
            elif z - a >= SHINGLE:
                sets.append(_distinct(rolled[a : z - SHINGLE + 1]))
            else:
                one = np.full(1, np.uint64(z - a))
                for word in h[a:z]:
                    one = one * np.uint64(_BASE) + word
                sets.append(_mixed(one))
        yield start, stop, sets
