"""Vectorised hashing of bytes, words and shingles for NumPy code inside tasks."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs only give equal outputs."""
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    return np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of mix(the eight bytes from k on) * BASE**k over k < i.

    Mixing eight bytes at a time keeps texts apart whose differences cancel in a plain polynomial modulo 2**64.
    """
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix(grams(data) + C1) * powers(len(data))[0], dtype=np.uint64, out=out[1:])
    return out


def ranges(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], of eight bytes at least each, the same wherever the bytes stand; lengths count."""
    down = powers(len(prefix) + 1)[1]
    return mix((prefix[end - 7] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * C2)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], of any length above 0: eight bytes at a time, each mixed with its place."""
    size = end - start
    n = (size + 7) // 8
    first = np.cumsum(n) - n
    nth = np.arange(n.sum()) - np.repeat(first, n)
    value = grams(data)[np.repeat(start, n) + nth * 8]
    left = np.minimum(np.repeat(size, n) - nth * 8, 8).astype(np.uint64)
    value &= ~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8))
    parts = mix(value ^ mix(nth.astype(np.uint64) * C1 + BASE))
    return mix(np.add.reduceat(parts, first) + size.astype(np.uint64) * C2) if len(n) else np.zeros(0, dtype=np.uint64)


def chunks(texts: list[bytes], most: int = 1 << 20):
    """Slices of a list whose texts have about ``most`` bytes together; one long text is a slice of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all blank-separated words, A-Z lower-cased, and each text's first word (one more entry at the end)."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return spans(data, start, end), np.searchsorted(start, offsets)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: ``width`` words each, or the whole of a shorter, non-empty sequence."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        words, first = word_hashes(texts[a:b])
        shingles = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            shingles = mix(shingles + words[k : k + len(shingles)] + np.uint64(k))
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= width:
                out.append(np.unique(shingles[lo : hi - width + 1]))
            elif hi > lo:
                short = np.zeros(1, dtype=np.uint64)
                for k in range(lo, hi):
                    short = mix(short + words[k] + np.uint64(k - lo))
                out.append(mix(short + np.uint64(hi - lo)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
