"""MD5 of many short texts at once: what `text.keyed` gives row by row, as arrays of numbers."""

from __future__ import annotations

import hashlib

import numpy as np

_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [int(abs(np.sin(k + 1.0)) * 2**32) for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts done at once, chosen for the processor's cache, and the longest text of one block.
PIECE, LONGEST = 8192, 55


def decimals(x: np.ndarray) -> np.ndarray:
    """Whole numbers as rows of ASCII digits, filled up with zero bytes."""
    return np.asarray(x, np.int64).astype("S20").view(np.uint8).reshape(len(x), 20)


def _first(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first 64 bits of the digests of n blocks, given as 16 words that are arrays or the same for all."""
    u = np.uint32
    a, b, c, d = (np.full(n, x, u) for x in _START)
    f, high = np.empty(n, u), np.empty(n, u)
    for k in range(64):
        turn, g = k // 16, (k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        w = words[g]
        if isinstance(w, int):
            f += u((w + _SINES[k]) & 0xFFFFFFFF)
        else:
            f += w
            f += u(_SINES[k])
        s = _TURNS[turn][k % 4]
        np.right_shift(f, u(32 - s), out=high)
        np.left_shift(f, u(s), out=f)
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = (a + u(_START[0])).byteswap(), (b + u(_START[1])).byteswap()
    return first.astype(np.uint64) << np.uint64(32) | second


def first_bits(prefix: str, tails: np.ndarray) -> np.ndarray:
    """The first 64 bits of md5(prefix + tail) of each row of `tails` (see `decimals`): numbers in the order of the hexadecimal digests."""
    head = prefix.encode()
    size = np.count_nonzero(tails, axis=1)
    out = np.empty(len(tails), np.uint64)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        total = len(head) + int(length)
        if total > LONGEST:
            out[at] = [int(hashlib.md5(head + tails[k, :length].tobytes()).hexdigest()[:16], 16) for k in at]
            continue
        first, last = len(head) // 4, total // 4  # words that differ between texts
        same = np.zeros(64, np.uint8)
        same[: len(head)] = np.frombuffer(head, np.uint8)
        same[total], same[56:] = 0x80, np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
        fixed = same.view("<u4").tolist()
        for k in range(0, len(at), PIECE):
            rows = at[k : k + PIECE]
            block = np.repeat(same[None, 4 * first : 4 * last + 4], len(rows), axis=0)
            block[:, len(head) - 4 * first : total - 4 * first] = tails[rows, :length]
            own = np.ascontiguousarray(block.view("<u4").T)
            out[rows] = _first([own[w - first] if first <= w <= last else fixed[w] for w in range(16)], len(rows))
    return out
