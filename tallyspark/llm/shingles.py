"""Sets of word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            n = max(n, 1 << 20)
            full = np.full(n + 1, _BASE)
            full[0] = 1
            self.up = np.multiply.accumulate(full)
            full[1:] = _INVERSE
            self.down = np.multiply.accumulate(full)
        return self.up, self.down


_POWERS = Powers()
#: A random number for each byte; in those for words A to Z are as a to z.
BYTES = mix(np.arange(1, 257, dtype=_U) * _BASE)
_WORD_BYTES = BYTES.copy()
_WORD_BYTES[65:91] = BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows by ``stretch``; values: 64-bit numbers."""
    up, _ = _POWERS.to(len(values))
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def stretch(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from starts to stops: equal contents give equal hashes."""
    _, down = _POWERS.to(len(sums))
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(_U))


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of ``k`` words of each text, ascending, one text after the other, and the n + 1 offsets.

    Words are runs of other bytes than white space, A to Z lower-cased. A text with fewer words has one shingle of all of them.
    """
    n, texts = len(data), len(ends) - 1
    if not n:
        return np.zeros(0, _U), np.zeros(texts + 1, np.int64)
    space = _SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[ends[:-1][ends[:-1] < n]] = True
    after[ends[1:][ends[1:] > 0] - 1] = True
    starts, stops = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    words = stretch(prefix_hashes(_WORD_BYTES[data]), starts, stops)
    of = np.searchsorted(ends, starts, "right") - 1
    counts = np.bincount(of, minlength=texts)
    first = np.cumsum(counts) - counts
    hashes, owners = [], []
    for size in range(1, k + 1):
        if size < k:
            at = first[counts == size]
        else:
            at = np.arange(max(0, len(words) - k + 1))
            at = at[of[at] == of[at + k - 1]]
        h = np.full(len(at), size, _U)
        for j in range(size):
            h = mix(h * _BASE + words[at + j])
        hashes.append(h)
        owners.append(of[at])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=texts))])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two ascending arrays of distinct numbers share."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
