"""Word shingles of many texts at once: hashes come from the Arrow buffer, without Python strings."""

from __future__ import annotations

import numpy as np

from pvlake.llm.common import mix

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 19
_powers: dict[int, np.ndarray] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A well mixed value for each byte.
_VALUE = mix(np.arange(256, dtype=np.uint64), 77)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, offsets of the rows' words)."""
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + _BLOCK, side="right")))
        at = int(begin[i])
        part = raw[at:end[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[_LOWER[part]] * _power(_P, len(part)), out=sums[1:])
        b, e = begin[i:j] - at, end[i:j] - at
        out[i:j] = mix((sums[e] - sums[b]) * _power(_PINV, len(part))[b] + (e - b).astype(np.uint64))
        i = j
    return out, np.searchsorted(begin, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each row in ascending order, row offsets).

    A row with fewer words than ``size`` has its whole sequence as one shingle; without words, none.
    """
    words, at = word_hashes(raw, offsets)
    windows = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        windows += mix(words[k:k + len(windows)], k)
    windows = mix(windows, 99)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(windows[a:b - size + 1]))
        elif b > a:
            short = sum(mix(words[a + k:a + k + 1], k) for k in range(b - a))
            sets.append(mix(short, 100 + b - a))
        else:
            sets.append(words[:0])
    return (np.concatenate(sets) if sets else words[:0]), np.cumsum([0, *map(len, sets)])


def minhashes(values: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) 32-bit minhashes; rows without values hold zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, count), np.uint32)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if not len(filled):
        return out
    starts = offsets[:-1][filled]
    multipliers = mix(np.arange(2 * count, dtype=np.uint64), 5) | np.uint64(1)
    for j in range(count):
        x = values * multipliers[2 * j]
        x ^= x >> np.uint64(32)
        x *= multipliers[2 * j + 1]
        out[filled, j] = (np.minimum.reduceat(x, starts) >> np.uint64(32)).astype(np.uint32)
    return out
