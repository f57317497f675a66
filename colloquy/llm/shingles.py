"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words start (one more entry than texts)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, q = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=total[1:])
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
    return h, np.concatenate([[0], np.searchsorted(start, ends_at)])


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles.

    A-Z are lower-cased; words are runs of characters other than space and x09-x0D. A text of fewer
    words gives its whole sequence as one shingle, a text without words (or null) an empty set.
    """
    h, at = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        s = mix((s ^ h[j : j + len(s)]) + _U(j + 1))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for j in range(b - a):
                one = mix((one ^ h[a + j]) + _U(j + 1 + 1000 * k))
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
