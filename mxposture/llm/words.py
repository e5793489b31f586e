"""Words, lines and shingles of many texts at once, as arrays over their UTF-8 bytes.

A word is a run of bytes other than space and the five ASCII control spaces; bytes of longer
characters never equal those six, so the bytes need no decoding.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240117).integers(1, 2**64, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values: every bit of the input reaches every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        inverse = np.uint64(pow(int(_ROOT), -1, 2**64))
        for name, root in (("_powers", _ROOT), ("_inverses", inverse)):
            table = np.full(size, root, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _powers, _inverses


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over all bytes."""
    powers, inverses = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=running[1:])
    return mixed((running[ends] - running[starts]) * inverses[starts])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the maximal runs of ``inside`` that stay in one text."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of every run of ``width`` words of one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    weight = 1
    for k in range(width):
        total += hashes[k : k + n] * np.uint64(weight)
        weight = weight * int(_ROOT) % 2**64
    place = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mixed(total[place]), place


def within(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, so that texts of a slice can be sorted together."""
    return mixed(hashes ^ mixed(owner.astype(np.uint64) + np.uint64(1)))


def prefix_sums(names: np.ndarray) -> np.ndarray:
    """Running sums over 64-bit names from which ``spans_of`` hashes any span of them."""
    powers, _ = _power_tables(len(names) + 1)
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * powers[: len(names)], out=sums[1:])
    return sums


def spans_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the names from ``starts`` to ``ends``; equal spans have equal hashes."""
    _, inverses = _power_tables(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverses[starts])
