"""Vectorised word hashing over UTF-8 bytes.

A chunk of whole documents is one byte array.  Words are maximal runs of bytes
outside ``[\\x20\\x09-\\x0D]``; a word's 64-bit hash comes from prefix sums of a
polynomial modulo 2**64, finished by a mixer, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
#: Values that are hashed at a time: texts of any length need the same few megabytes.
PIECE = (1 << 18) - 1024
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, base: int = _R) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (kept; n is at most a little above PIECE)."""
    table = _TABLES.get(base)
    if table is None or len(table[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
            up[0] = down[0] = 1
            table = _TABLES[base] = (np.cumprod(up), np.cumprod(down))
    return table


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _R) -> np.ndarray:
    """Polynomial hash of values[start:end] for every segment; equal content gives equal hashes."""
    up, down = powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def long_hash(values: np.ndarray, base: int = _R) -> int:
    """The same hash of all values, piece by piece."""
    out = 0
    for at in range(0, len(values), PIECE):
        part = values[at : at + PIECE].astype(U)
        out += int(segment_hash(part, np.array([0]), np.array([len(part)]), base)[0]) * pow(base, at, 1 << 64)
    return out & (2**64 - 1)


def window_hash(values: np.ndarray, width: int, base: int = _R) -> np.ndarray:
    """Mixed hash of every run of ``width`` values (len(values) - width + 1 of them), piece by piece."""
    n = max(0, len(values) - width + 1)
    out = np.empty(n, U)
    for at in range(0, n, PIECE):
        m = min(PIECE, n - at)
        starts = np.arange(m)
        out[at : at + m] = mix(segment_hash(values[at : at + m + width - 1], starts, starts + width, base))
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every word, piece by piece; words are disjoint and in order."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, side="right")))
        b = int(ends[j - 1])
        if b - a <= PIECE:
            out[i:j] = segment_hash(data[a:b].astype(U) + U(1), starts[i:j] - a, ends[i:j] - a)
        else:  # one word that is longer than a piece
            out[i] = (long_hash(data[a:b]) + long_hash(np.ones(b - a, np.uint8))) & (2**64 - 1)
        i = j
    return out


def doc_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, its byte start, its byte end, number of words of every text)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = mix(word_hashes(data, starts, ends) + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.searchsorted(starts, bounds)
    return h, starts, ends, np.diff(at)


def chunks(texts: list, limit: int = 1 << 20):
    """Index ranges of consecutive texts of about ``limit`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
