"""Words of Arrow text batches as NumPy arrays: positions, 64-bit hashes, shingles.

Everything works on the UTF-8 bytes of many texts at once. A hash is a polynomial over a table of
random byte values, taken from prefix sums modulo 2**64 and mixed; A-Z hash like a-z. Two different words share
a hash with a chance of about 2**-64.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18  # bytes of text handled at once; a longer text makes a block of its own

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _ODD)[LOWER]

SPACED = np.ones(256, dtype=bool)  # words are runs of anything but ASCII white space
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)  # words are runs of digits, ASCII letters and all beyond ASCII
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int):
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, _U(base), dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        if size > 8 * BLOCK_BYTES:
            return made  # not kept, so that one huge text does not hold memory
        _powers = tuple(made)
    return _powers


@dataclass
class Block:
    """Texts `first` .. `first + len(bounds) - 1` of a batch; `bounds` cuts `data` into texts."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column (null: empty) into blocks of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Byte ranges of words, in order, and the first word of each text (`cuts`, one more than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray


def find_words(block: Block, kind: np.ndarray) -> Words:
    inside = kind[block.data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(inside):
        before[0] = after[-1] = False
        edges = block.bounds[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, block.bounds))


def hash_words(block: Block, words: Words) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z."""
    up, down = _power_tables(len(block.data) + 1)
    sums = np.zeros(len(block.data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[block.data] * up[:len(block.data)], out=sums[1:])
    h = (sums[words.ends] - sums[words.starts]) * down[words.starts]
    return mix(h + (words.ends - words.starts).astype(np.uint64) * _ODD)


def hash_text(word: str) -> int:
    """The hash of one word as `hash_words` gives it."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    whole = Words(np.array([0]), np.array([len(data)]), np.array([0, 1]))
    return int(hash_words(Block(0, data, np.array([0, len(data)])), whole)[0])


def hash_runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` consecutive words, over text borders too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total += mix(hashes[k:k + n] + _U((k + 1) * int(_ODD) % (1 << 64)))
    return mix(total)


def shingle_sets(hashes: np.ndarray, cuts: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer words than `width` make one shingle."""
    runs = hash_runs(hashes, width)
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo >= width:
            out.append(np.unique(runs[lo:hi - width + 1]))
        elif hi > lo:
            out.append(hash_runs(hashes[lo:hi], hi - lo) + _U(hi - lo))
        else:
            out.append(runs[:0])
    return out
