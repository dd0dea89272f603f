"""The least MD5 of many strings with common beginnings, many hashes at once in numpy.

Strings are a head and a tail. Words of a block that hold the head alone are a column, those that hold
the tail alone a row, and the steps of MD5 stay that narrow until the first word with both. The first
of the digest's four words is known three steps before the others; only strings with the least one are
hashed whole. What does not fit one block is hashed string by string.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Bytes that one block holds beside the mark and the length; hashes at once, so that six words of each stay near the processor; tails of a head among them at most.
ONE_BLOCK, TILE, WIDE = 55, 1 << 15, 1 << 13
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [*[7, 12, 17, 22] * 4, *[5, 9, 14, 20] * 4, *[4, 11, 16, 23] * 4, *[6, 10, 15, 21] * 4]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_BY = [np.array(n, np.uint32) for n in range(33)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(texts: list[bytes], at: int, last: bool) -> np.ndarray:
    """The 16 words of blocks that hold texts of one length from byte ``at`` on; with the mark and the length if they are the last ones."""
    n = len(texts[0])
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, at : at + n] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), n)
    if last:
        block[:, at + n] = 0x80
        block[:, 56], block[:, 57] = (at + n) * 8 & 255, (at + n) * 8 >> 8
    return block.view("<u4").astype(np.uint32)


def _words(heads: np.ndarray, tails: np.ndarray) -> list[tuple[int, bool, bool]]:
    """Of each word its common part, and whether heads (rows) and tails differ in it."""
    out = []
    for w in range(16):
        same = [bool((x[:, w] == x[0, w]).all()) for x in (heads, tails)]
        out.append((sum(int(x[0, w]) for x, s in zip((heads, tails), same, strict=True) if s), not same[0], not same[1]))
    return out


def _mixed(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """What a step takes of three words of the state; ``out`` holds each result on the way."""
    if i < 16:
        return np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out), b, out), d, out)
    if i < 32:
        return np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out), d, out), c, out)
    if i < 48:
        return np.bitwise_xor(np.bitwise_xor(b, c, out), d, out)
    return np.bitwise_xor(np.bitwise_or(np.bitwise_not(d, out), b, out), c, out)


def _first_words(heads: np.ndarray, tails: np.ndarray, words: list[tuple[int, bool, bool]], room: np.ndarray) -> np.ndarray:
    """The digests' first words, sorting as their hexadecimal digits do, of each head (row) with each tail (column).

    Each pass over the hashes is one call. Passes work in place, in two arrays of ``room`` beside the state.
    """
    full = (len(heads), len(tails))
    f, turned = (x[: full[0] * full[1]].reshape(full) for x in room)
    a, b, c, d = (np.full((1, 1), v, np.uint32) for v in _START)
    for i in range(61):
        fixed, by_head, by_tail = words[_WORD[i]]
        k = np.array(_K[i] + fixed & 0xFFFFFFFF, np.uint32)
        more = ([heads[:, _WORD[i], None]] if by_head else []) + ([tails[None, :, _WORD[i]]] if by_tail else [])
        if more:
            k, more = more[0] + k, more[1:]
        left, right = _BY[_TURN[i]], _BY[32 - _TURN[i]]
        if a.shape == full:
            _mixed(i, b, c, d, f)
            np.add(a, k, a)
            for x in more:
                np.add(a, x, a)
            np.add(a, f, a)
            np.right_shift(a, right, turned)
            np.left_shift(a, left, a)
            np.bitwise_or(a, turned, a)
            np.add(a, b, a)
        else:
            # words of the state that hold a head alone are still columns
            a = sum(more, a + k) + _mixed(i, b, c, d)
            a = (a << left | a >> right) + b
        a, b, c, d = d, a, b, c
    return np.broadcast_to(b + np.uint32(_START[0]), full).byteswap()


def _by_length(texts: list[bytes]) -> dict[int, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def least_md5(heads: list[bytes], tails: list[bytes]) -> tuple[list[str], list[int]]:
    """For each head the least MD5 (hexadecimal) of it and a tail, and which tail; there is one tail at least."""
    best: list[tuple[str, int]] = [("g", -1)] * len(heads)  # above any digest
    least = np.full(len(heads), 0xFFFFFFFF, np.uint32)

    def meet(h: int, t: int) -> None:
        best[h] = min(best[h], (hashlib.md5(heads[h] + tails[t], usedforsecurity=False).hexdigest(), t))

    ends = _by_length(tails)
    for n, rows in _by_length(heads).items():
        for m, cols in ends.items():
            if n + m > ONE_BLOCK or len(cols) * len(rows) < 64:
                for h in rows.tolist():
                    for t in cols.tolist():
                        meet(h, t)
                continue
            begin = _block([heads[h] for h in rows], 0, False)
            end = _block([tails[t] for t in cols], n, True)
            words, wide = _words(begin, end), min(len(cols), WIDE)
            high = max(1, TILE // wide)
            room = np.empty((2, high * wide), np.uint32)
            for i in range(0, len(rows), high):
                for j in range(0, len(cols), wide):
                    x = _first_words(begin[i : i + high], end[j : j + wide], words, room)
                    low, here = x.min(axis=1), rows[i : i + high]
                    low_or_equal = low <= least[here]
                    least[here] = np.minimum(least[here], low)
                    for r in np.flatnonzero(low_or_equal).tolist():
                        for t in np.flatnonzero(x[r] == low[r]).tolist():
                            meet(int(here[r]), int(cols[j + t]))
    return [r for r, _ in best], [t for _, t in best]
