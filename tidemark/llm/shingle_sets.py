"""Sets of word shingles as sorted 64-bit hashes, made with numpy over many texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shingle is five of them in a row. A shingle's 64-bit hash stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Bytes of text that are hashed together.
TOGETHER = 1 << 20

_U = np.uint64
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_random = np.random.default_rng(20240229)
_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUE[_BLANK] = 0
_TIMES = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_R, _R_INVERSE)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte string, and where each begins."""
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.zeros(0, _U), begin
    power, inverse = _powers_to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin]), begin


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode()
        if group and size + len(data) > TOGETHER:
            yield from _sets(group)
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    yield from _sets(group)


def _sets(group: list[bytes]) -> Iterator[np.ndarray]:
    if not group:
        return
    ends = np.cumsum([len(d) + 1 for d in group])
    words, begin = word_hashes(b" ".join(group))
    bounds = np.concatenate([[0], np.searchsorted(begin, ends)])
    n = len(words) - SHINGLE + 1
    made = np.zeros(max(n, 0), _U)
    for j in range(SHINGLE if n > 0 else 0):
        made += words[j : j + n] * _TIMES[j]
    made = mix(made)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(made[a : b - SHINGLE + 1])
        elif b > a:  # fewer words: the whole sequence
            yield mix(np.array([(words[a:b] * _TIMES[: b - a]).sum(dtype=_U) ^ _U(b - a)], _U))
        else:
            yield made[:0]


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    a = mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)
    b = mix(s ^ _U(0xE7037ED1A0B428DB)).sum(dtype=_U)
    pair = np.array([a, b], _U).view(np.int64)
    return int(pair[0]), int(pair[1])


#: Bits of a parity map.
PARITY = 1024


def parity_map(s: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each of 1024 places. Two maps differ in no more places than the sets have elements that only one holds."""
    return np.packbits(np.bincount((s >> _U(54)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union, of two sets that aren't empty."""
    if not len(a) or not len(b) or 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)
