"""The hashed uniforms of ``linalg.uniform`` for runs of numbers, many at a time in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import cache

import numpy as np

_LANES = 16384  # messages hashed side by side; their state stays in the processor's cache
_TABLED = 5  # digits up to which numbers are kept as text
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(np.sin(np.float64(i + 1))) * 2**32)) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_head(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the MD5 of one-block messages, (16, n) words each."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, v) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    used = words.any(axis=1)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            at = 7 * i % 16
        f += a
        f += _SINES[i]
        if used[at]:
            f += words[at]
        turn = _SHIFTS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a  # the old a is free
    return a + _START[0], b + _START[1]


@cache
def _texts(digits: int) -> np.ndarray:
    return _as_text(np.arange(10 ** (digits - 1) if digits > 1 else 0, 10**digits), digits)


def _as_text(k: np.ndarray, digits: int) -> np.ndarray:
    return (k[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10 + 48).astype(np.uint8)


def _digits(lo: int, hi: int, digits: int) -> np.ndarray:
    if digits > _TABLED:
        return _as_text(np.arange(lo, hi), digits)
    first = 10 ** (digits - 1) if digits > 1 else 0
    return _texts(digits)[lo - first:hi - first]


def uniforms(runs: Sequence[tuple[bytes, int, int]], seed: int) -> np.ndarray:
    """``linalg.uniform(seed, *keys, k)`` for each run (text of the keys, lo, hi) and each k from lo to hi - 1, in order.

    The text is what ``concat_ws`` makes of the keys with a colon after each.
    """
    total = sum(hi - lo for _, lo, hi in runs)
    msg, at, long = np.zeros((total, 64), np.uint8), 0, []
    tail = np.frombuffer(b":%d\x80" % seed, np.uint8)
    for head, lo, hi in runs:
        start, text = len(head), np.frombuffer(head, np.uint8)
        while lo < hi:
            digits = len(str(lo))
            end = min(hi, 10**digits)
            size = start + digits + len(tail)
            rows = msg[at:at + end - lo]
            if size <= 56:
                rows[:, :start] = text
                rows[:, start:start + digits] = _digits(lo, end, digits)
                rows[:, start + digits:size] = tail
                rows[:, 56] = (size - 1) * 8 % 256
                rows[:, 57] = (size - 1) * 8 // 256
            else:  # more than one block
                long.append((at, head, lo, end))
            at += end - lo
            lo = end
    first, second = np.empty(total, np.uint32), np.empty(total, np.uint32)
    words = msg.view("<u4")
    for i in range(0, total, _LANES):
        first[i:i + _LANES], second[i:i + _LANES] = _md5_head(np.ascontiguousarray(words[i:i + _LANES].T))
    bits = (first.byteswap().astype(np.uint64) << np.uint64(20)) | (second.byteswap() >> np.uint32(12)).astype(np.uint64)
    for at, head, lo, hi in long:
        bits[at:at + hi - lo] = [int(hashlib.md5(b"%b%d:%d" % (head, k, seed)).hexdigest()[:13], 16) for k in range(lo, hi)]
    return bits / 2.0**52
