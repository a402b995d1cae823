"""Vectorised word hashing of a batch of texts, and sliding extremes."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i < n."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = base, pow(base, -1, 1 << 64)
        held = _POWERS[base] = (np.cumprod(up), np.cumprod(down))
    return held


def ranges(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:stop] for every pair, the same wherever it stands."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)
                 * _STEP)


class Words:
    """The words of a batch of texts: maximal runs without ASCII white space.

    ``hash``: one 64-bit hash per word; ``first[d]:first[d + 1]``: the words of text d;
    ``start``, ``stop``: byte offsets in the joined texts; ``base[d]``: where text d starts.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.base = np.cumsum([0] + [len(t) + 1 for t in texts])
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.start, self.stop = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self.hash = ranges(_BYTE[raw], self.start, self.stop, 0x2545F4914F6CDD1D)


def sliding(values: np.ndarray, width: int, extreme) -> np.ndarray:
    """extreme of values[i:i + width] for every i that has so many."""
    size = 1
    while size * 2 <= width:
        values = extreme(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return extreme(values[:len(values) - rest], values[rest:]) if rest else values
