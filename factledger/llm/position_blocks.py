"""Names of substrings and anchored blocks of positions, for many texts at once.

The texts of an Arrow batch are laid out as one byte array, in pieces of bounded size.
A prefix sum of byte weights gives the 64-bit name of any substring in constant time.

Every window of ``threshold`` bytes picks one anchor, its k-gram of least hash (the
rightmost of equals). Equal windows pick the same place, so starts are dealt into
blocks that lie at fixed distances before their anchor: equal windows in two texts
stand at the same place of two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFF)


@dataclass(frozen=True)
class Shape:
    """Lengths that follow from the threshold.

    A block holds ``block`` neighbouring starts. All its windows share ``core`` bytes,
    the largest power of two below the threshold, and lie in its hull of
    ``threshold + block - 1`` bytes. ``part`` starts make a part of a block.
    """

    threshold: int

    @property
    def core(self) -> int:
        return 1 << ((self.threshold - 1).bit_length() - 1)

    @property
    def block(self) -> int:
        return self.threshold - self.core + 1

    @property
    def part(self) -> int:
        return max(1, round(math.sqrt(self.block)))

    @property
    def gram(self) -> int:
        return max(1, min(16, self.threshold // 4))

    @property
    def hull(self) -> int:
        return self.threshold + self.block - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    base = np.full(n, _ODD)
    base[0] = 1
    inverse = np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Names:
    """Names of the substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        room = 1 << max(12, len(data).bit_length())
        up, self._down = _powers(room)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_weights()[data] * up[: len(data)], out=self._sums[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        """uint64 names of the substrings of ``length`` bytes at ``at``; both arrays or the length one number."""
        return _mixed((self._sums[at + length] - self._sums[at]) * self._down[at])

    def grams(self, length: int) -> np.ndarray:
        n = len(self._sums) - length
        return _mixed((self._sums[length:] - self._sums[:n]) * self._down[:n])


@dataclass
class Piece:
    """Some texts, or a part of a long one, as one byte array.

    ``first``/``last`` are the bounds of each text in ``data``, ``row`` its row in the
    batch, ``shift`` what to add to get places in the whole text, and ``from_``/``to``
    the places in ``data`` of the starts that this piece answers for.
    """

    data: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    shift: np.ndarray
    from_: np.ndarray
    to: np.ndarray


def pieces(offsets: np.ndarray, data: np.ndarray, shape: Shape) -> Iterator[Piece]:
    """All texts of a batch long enough for a window, in pieces of about PIECE bytes."""
    sizes = np.diff(offsets)
    held: list[int] = []
    total = 0

    def together(rows: list[int]) -> Piece:
        row = np.array(rows)
        size = sizes[row]
        last = np.cumsum(size)
        first = last - size
        body = np.concatenate([data[offsets[r] : offsets[r + 1]] for r in rows])
        return Piece(body, row, first, last, -first, first, last - shape.threshold + 1)

    for r in np.flatnonzero(sizes >= shape.threshold).tolist():
        n = int(sizes[r])
        if n > PIECE:
            for start in range(0, n - shape.threshold + 1, PIECE):
                stop = min(start + PIECE, n - shape.threshold + 1)
                lo, hi = max(0, start - shape.block), min(n, stop + shape.threshold + shape.block)
                body = data[offsets[r] + lo : offsets[r] + hi]
                one = lambda v: np.array([v])
                yield Piece(body, one(r), one(0), one(hi - lo), one(lo), one(start - lo), one(stop - lo))
            continue
        if total + n > PIECE and held:
            yield together(held)
            held, total = [], 0
        held.append(r)
        total += n
    if held:
        yield together(held)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    grid = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Blocks:
    """Blocks of one piece: index of the text in the piece, front (the block's last start) and the starts
    ``front - high .. front - low`` that picked the block's anchor. Places are those in the piece."""

    text: np.ndarray
    front: np.ndarray
    low: np.ndarray
    high: np.ndarray


def blocks(piece: Piece, names: Names, shape: Shape) -> Blocks:
    """Every start of the piece, in the block that its window's anchor gives it."""
    gram = shape.gram
    hashes = names.grams(gram)
    keys = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    least = _least(keys, shape.threshold - gram + 1)
    counts = piece.to - piece.from_
    starts = np.repeat(piece.from_ - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    anchor = (_LOW - (least[starts] & _LOW)).astype(np.int64)
    begins = np.flatnonzero(np.diff(anchor, prepend=-1))
    ends = np.append(begins[1:], len(anchor)) - 1
    a = anchor[begins]
    near, far = a - starts[ends], a - starts[begins]
    low_block, high_block = near // shape.block, far // shape.block
    repeat = high_block - low_block + 1
    which = np.repeat(np.arange(len(a)), repeat)
    number = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat) + low_block[which]
    base = number * shape.block
    front = a[which] - base
    low = np.maximum(near[which] - base, 0)
    high = np.minimum(far[which] - base, shape.block - 1)
    text = np.searchsorted(piece.first, a[which], side="right") - 1
    return Blocks(text, front, low, high)
