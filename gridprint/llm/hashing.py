"""Vectorised 64-bit hashes of byte ranges, words and word shingles."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that their powers have inverses
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**0..base**n and their inverses, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = _POWERS[base] = tuple(np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(size, b, U))]) for b in (base, inverse))
    return have


def prefix(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of (byte + 1) * base**i before each position."""
    up = powers(len(data), base)[0]
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of the bytes of each range, from prefix()."""
    down = powers(len(sums), base)[1]
    return mix((sums[end] - sums[start]) * down[start] ^ ((end - start).astype(U) * U(0xA24BAED4963EE407)))


def words(text: str | None) -> np.ndarray:
    """Hash of each word, A-Z lower-cased; words end at the six ASCII white-space characters."""
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edge):
        return np.zeros(0, U)
    return ranges(prefix(data), edge[::2], edge[1::2])


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole sequence if it is shorter; empty without words."""
    w = words(text)
    if not len(w):
        return w
    width = min(size, len(w))
    out = w[: len(w) - width + 1].copy()
    for k in range(1, width):
        out = mix(out * U(BASE) + w[k : len(w) - width + 1 + k])
    return np.unique(mix(out + U(width)))
