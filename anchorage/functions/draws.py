"""Poisson draws from md5, for many short texts at once: what a task computes with arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: A draw of 32 bits at or above the k-th cut counts a row k times at least.
POISSON_CUTS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Rows that are hashed together; so that numpy's calls cost little and the arrays stay small.
ROWS = 64

# Fixed values of RFC 1321.
_BLOCK, _LONGEST = 64, 55
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_SINES = [math.floor(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_ORDER = [(1, 0), (5, 1), (3, 5), (7, 0)]


def _first_word(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """First 32 bits, read as eight hex digits, of the md5 of single blocks given as 16 arrays of words."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        step, first = _ORDER[kind]
        f += a
        f += words[(step * i + first) % 16] + np.uint32(_SINES[i])
        turn = _TURNS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    return a.byteswap()


def _blocks(texts: list[bytes], at: int) -> np.ndarray:
    out = np.zeros((len(texts), _BLOCK), np.uint8)
    for row, text in zip(out, texts):
        row[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return out


def md5_bits(prefixes: list[bytes], suffixes: list[bytes]) -> np.ndarray:
    """First 32 bits of md5(prefix + suffix), prefixes of one length by row and suffixes by column."""
    size = len(prefixes[0])
    if size + max(map(len, suffixes)) > _LONGEST:
        digits = [[hashlib.md5(p + s).digest()[:4] for s in suffixes] for p in prefixes]
        return np.frombuffer(b"".join(b"".join(row) for row in digits), ">u4").astype(np.uint32).reshape(len(prefixes), -1)
    ends = _blocks([s + b"\x80" for s in suffixes], size)
    ends[:, 56:58] = np.array([8 * (size + len(s)) for s in suffixes], "<u2").view(np.uint8).reshape(-1, 2)
    by_row, by_column = _blocks(prefixes, 0).view("<u4"), ends.view("<u4")
    words = [by_row[:, j, None] | by_column[None, :, j] if size < 4 * j + 4 else by_row[:, j, None] for j in range(16)]
    return _first_word(words, (len(prefixes), len(suffixes)))


def poisson_weights(bits: np.ndarray) -> np.ndarray:
    """Poisson(1) from 32 even bits: how many of the cuts the draw reaches."""
    weights = np.zeros(bits.shape, np.uint8)
    for cut in POISSON_CUTS:
        reached = bits >= np.uint32(cut)
        if not reached.any():
            break
        weights += reached
    return weights


def weighted_sums(prefixes: list[bytes], values: np.ndarray, suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of weight times value, sum of weights) per suffix, each row weighted by its draw with that suffix."""
    total, count = np.zeros(len(suffixes)), np.zeros(len(suffixes), np.int64)
    for rows in _alike(prefixes):
        weights = poisson_weights(md5_bits([prefixes[i] for i in rows], suffixes))
        finite = np.isfinite(values[rows])
        total += np.where(finite, values[rows], 0) @ weights.astype(np.float64)
        # A row that is not drawn adds nothing, whatever its value.
        for i in np.flatnonzero(~finite):
            total += np.where(weights[i] > 0, values[rows[i]], 0)
        count += weights.sum(axis=0, dtype=np.int64)
    return total, count


def _alike(prefixes: list[bytes]) -> Iterator[list[int]]:
    """Indices of up to ``ROWS`` prefixes of one length at a time."""
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(prefixes):
        by_size.setdefault(len(p), []).append(i)
    for found in by_size.values():
        for k in range(0, len(found), ROWS):
            yield found[k : k + ROWS]
