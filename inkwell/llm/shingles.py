"""Sets of word shingles as sorted 64-bit hashes, many texts at once.

Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than a shingle
is one shingle. Hashes are polynomial sums over bytes, so one cumulative sum serves all words. Two
different shingles of a pair of texts of 10,000 words share a hash with a probability below 1e-11.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_BYTES[65:91] = _BYTES[97:123]
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = _powers[k]
            while len(p) < n:
                p = np.concatenate([p, p * _U(pow(base, len(p), 1 << 64))])
            _powers[k] = p
    return _powers[0], _powers[1]


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its hash)."""
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=sums[1:])
    return starts, mix64((sums[ends] - sums[starts]) * inverse[starts])


def shingle_sets(texts: list[str | None], k: int, most_bytes: int = 1 << 20):
    """Yields the sorted distinct shingle hashes of each text, in order."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").encode())
        size += len(held[-1]) + 1
        if size >= most_bytes:
            yield from _sets(held, k)
            held, size = [], 0
    if held:
        yield from _sets(held, k)


def _sets(raws: list[bytes], k: int):
    raw = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    starts, words = _word_hashes(raw)
    cuts = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
    n = len(words) - k + 1
    rolled = np.zeros(max(0, n), np.uint64)
    for j in range(k):
        if n > 0:
            rolled += words[j : j + n] * _FACTORS[j]
    rolled = mix64(rolled)
    for a, z in zip(cuts[:-1], cuts[1:]):
        m = z - a
        if m >= k:
            yield np.unique(rolled[a : z - k + 1])
        elif m:
            yield mix64((words[a:z] * _FACTORS[:m]).sum(dtype=np.uint64, keepdims=True) + _FACTORS[32 + m : 33 + m])
        else:
            yield np.zeros(0, np.uint64)
