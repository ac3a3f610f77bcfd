"""Words of many texts at once, as byte ranges and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

#: White space of a word's definition, an odd base and an odd factor of the hash.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE, FACTOR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def bounds(data: np.ndarray, at: np.ndarray, extra_starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the count of all) of texts that lie end to end in data, text i from at[i] to at[i + 1]."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:n])
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = at[:-1]
    begin[edges] |= inside[edges]
    begin[n] = False
    if extra_starts is not None:
        begin[extra_starts] = True
    stop = np.zeros(n, bool)
    stop[:] = inside[:n] & (~inside[1:] | begin[1:])
    if n:
        last = at[1:] - 1
        last = last[last >= 0]
        stop[last] |= inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(FACTOR)
    x ^= x >> np.uint64(29)
    x *= np.uint64(BASE)
    return x ^ (x >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: differences of one running polynomial, moved to the range's start, with the length mixed in."""
    global _powers, _inverse
    if len(_powers) < len(data) + 1:
        size = max(len(data) + 1, 1 << 20)
        _powers, _inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(FACTOR))


class Table:
    """An open-addressing map from 64-bit hashes to small integers, looked up and filled by whole arrays."""

    def __init__(self, bits: int = 22):
        self.mask = np.int64((1 << bits) - 1)
        self.keys, self.values, self.count = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        out = self.values[slot]
        probe = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(probe):
            slot[probe] = (slot[probe] + 1) & self.mask
            out[probe] = self.values[slot[probe]]
            probe = probe[(out[probe] >= 0) & (self.keys[slot[probe]] != keys[probe])]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Give new, distinct keys the next values."""
        values = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        slot, rest = (keys & np.uint64(self.mask)).astype(np.int64), np.arange(len(keys))
        while len(rest):
            s = slot[rest]
            free = self.values[s] < 0
            _, one = np.unique(s[free], return_index=True)
            won = rest[free][one]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.ones(len(rest), bool)
            left[np.flatnonzero(free)[one]] = False
            rest = rest[left]
            slot[rest] = (slot[rest] + 1) & self.mask
        self.count += len(keys)
        return values
