"""Words of texts as 64-bit hashes, for the operators that compare runs of words.

A whole batch of texts is hashed at once: bytes become random numbers by a table,
and a word is a range of their sequence.  No step is a loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd multiplier, so that it can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time, about; some 40 times as much memory is used.
PIECE = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    global _up, _down
    if len(_up) <= n:
        size = max(n + 1, 2 * len(_up))
        one = np.ones(1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            _up = np.concatenate([one, np.cumprod(np.full(size, BASE, dtype=np.uint64), dtype=np.uint64)])
            _down = np.concatenate([one, np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64), dtype=np.uint64)])
    return _up, _down


_up = _down = np.ones(1, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that lets every bit depend on all others."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Ranges:
    """Hashes of any range of a sequence of 64-bit numbers, from prefix sums."""

    def __init__(self, h: np.ndarray):
        up, self.down = powers(len(h))
        self.sums = np.zeros(len(h) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * up[: len(h)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        """Of [start, end), each an array or number; equal ranges have equal hashes wherever they start."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.down[start])


#: A random number per byte, and the same with A-Z as a-z.
_CODES = mixed(np.arange(1, 257, dtype=np.uint64))
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[0x41:0x5B] = _CODES[0x61:0x7B]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places to cut at, each at a text's end or, in a text longer than PIECE, at white space: no word is cut."""
    cuts, at, last = [int(offsets[0])], int(offsets[0]), int(offsets[-1])
    while at < last:
        k = int(np.searchsorted(offsets, at + PIECE, side="right")) - 1
        to = int(offsets[k])
        if to <= at:  # a long text
            to, end = min(at + PIECE, int(offsets[k + 1])), int(offsets[k + 1])
            while to < end:
                found = np.flatnonzero(_SPACE[data[to : to + PIECE]])
                if len(found):
                    to += int(found[0])
                    break
                to = min(end, to + PIECE)
        cuts.append(to)
        at = to
    return cuts


def hashed(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and where each text's begin and end.

    data holds the texts' bytes, text k from offsets[k] to offsets[k + 1].  Words are
    maximal runs of other than ASCII white space; with `lower`, A-Z count as a-z.
    """
    codes = _LOWER_CODES if lower else _CODES
    offsets = offsets.astype(np.int64)
    out, places = [], []
    cuts = _cuts(data, offsets)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = data[lo:hi]
        inside = ~_SPACE[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi, side="left")] - lo
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        out.append(Ranges(codes[part]).of(start, end))
        places.append(start + lo)
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(out), np.searchsorted(np.concatenate(places), offsets)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of binary without nulls."""
    size = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=size)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=size)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offsets


def word_hashes(text: bytes | None) -> np.ndarray:
    """A hash per word of one text."""
    text = text or b""
    return hashed(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[0]
