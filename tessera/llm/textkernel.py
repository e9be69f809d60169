"""Vectorised hashing of words and word shingles over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
It is read in lanes of eight bytes, counted from its own start; each lane is mixed
with its number by a non-linear function and the lanes of a word are summed, so a
word has one 64-bit hash wherever it stands and however long it is, and no Python
object is made per word.  Memory follows ``SEGMENT`` and the longest single text,
never the number of rows of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time.
SEGMENT = 1 << 18
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LANE, _NUMBER, _SIZE = _rng.integers(1, 2**63, 3, dtype=np.uint64) | np.uint64(1)
_MIX = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
#: What is read of a lane with 0..8 bytes left.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null has no bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def text_groups(at: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have at most ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _sums(lanes: np.ndarray, start: np.ndarray, end: np.ndarray, number: int = 0) -> np.ndarray:
    """Sums of the mixed lanes of words that begin with lane ``number``; ``lanes`` has the eight bytes from each position on."""
    count = (end - start + 7) >> 3
    first = np.cumsum(count) - count
    which = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(which)) - first[which]
    at = start[which] + 8 * nth
    lane = lanes[at] & _KEEP[np.minimum(end[which] - at, 8)]
    return np.add.reduceat(fmix(fmix(lane ^ _LANE) + (nth + (number + 1)).astype(np.uint64) * _NUMBER), first)


def _bounds(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``raw``; no word crosses a position of ``cuts``."""
    solid = ~_SPACE[raw]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive texts (``at`` are offsets into ``raw``), and each text's first word as offsets."""
    lo, hi = int(at[0]), int(at[-1])
    start, end = _bounds(raw[lo:hi], at[1:-1] - lo) if hi > lo else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    low = np.zeros(hi - lo + 8, dtype=np.uint8)
    np.take(_LOWER, raw[lo:hi], out=low[: hi - lo])
    lanes = np.ndarray(hi - lo, dtype="<u8", buffer=low, strides=(1,))
    total = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):  # words of SEGMENT bytes together; a longer word alone, piece by piece
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, side="right")))
        if j > i + 1 or end[i] - start[i] <= SEGMENT:
            total[i:j] = _sums(lanes, start[i:j], end[i:j])
        else:
            cuts = np.append(np.arange(start[i], end[i], SEGMENT), end[i])
            parts = [_sums(lanes, cuts[k : k + 1], cuts[k + 1 : k + 2], k * (SEGMENT >> 3)) for k in range(len(cuts) - 1)]
            total[i] = np.concatenate(parts).sum(dtype=np.uint64)
        i = j
    return fmix(total + (end - start).astype(np.uint64) * _SIZE), np.searchsorted(start, at - lo)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of one text's five-word shingles in order; of all its words if there are fewer."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return fmix(np.array([n], np.uint64) * _MIX[SHINGLE] + (h * _MIX[:n]).sum(dtype=np.uint64))
    x = h[: n - SHINGLE + 1] * _MIX[0]
    for i in range(1, SHINGLE):
        x = x + h[i : n - SHINGLE + 1 + i] * _MIX[i]
    return fmix(x)


def shingles(h: np.ndarray) -> np.ndarray:
    """The same, sorted and distinct."""
    return np.unique(shingle_hashes(h))
