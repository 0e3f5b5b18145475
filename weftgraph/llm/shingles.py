"""Hashes of words and of word shingles for many texts at a time, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

N = 5
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) << np.uint64(1) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A to Z count as a to z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
#: Texts are hashed together up to so many bytes.
TOGETHER = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, np.uint64)
    step = base
    for k in range(bits):  # out[i + 2**k] = out[i] * base**(2**k)
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(step)
        step = step * step % 2**64
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    begin = np.cumsum([1] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, begin)
    bits = max(10, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, bits)[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_BACK, bits)[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), bounds


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct n-word shingles; with fewer words, of the whole sequence; without words, none."""
    words, bounds = word_hashes(texts)
    count = len(words)
    grams = np.zeros(count, np.uint64)
    if count >= n:
        grams = words[: count - n + 1].copy()
        for k in range(1, n):
            grams = mixed(grams * np.uint64(0x9FB21C651E98DF25) + words[k : count - n + 1 + k])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = mixed(np.array([h * np.uint64(0x9FB21C651E98DF25) + w]))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def together(texts: list, most: int = TOGETHER):
    """Runs [a, b) of texts of about ``most`` bytes."""
    a = size = 0
    for b, t in enumerate(texts):
        if b > a and size + len(t) > most:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def signature(grams: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    a = int(mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    b = int(mixed(grams + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) ^ len(grams)
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")
