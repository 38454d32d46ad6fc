"""First words of MD5 digests of many strings under one prefix, computed column-wise."""

from __future__ import annotations

import hashlib
import math

import numpy as np

SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(2**32 * abs(math.sin(i + 1))) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Strings that go through the steps at once; columns of 128 KB.
CHUNK = 32_768


class Suffixes:
    """Strings, of which `first_words` gives the first 32 bits (as a hex digest orders them) of md5(prefix + string).

    The strings are laid out once for each length of the prefix. Those that do not fit one block of 55 bytes with it go through hashlib."""

    def __init__(self, texts: list[str]):
        self.texts = [t.encode() for t in texts]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.laid: dict[int, tuple] = {}

    def _layout(self, size: int) -> tuple:
        if size not in self.laid:
            fits = np.flatnonzero(self.length + size <= 55)
            block = np.zeros((len(fits), 64), np.uint8)
            for row, i in zip(block, fits, strict=True):
                end = size + int(self.length[i])
                row[size:end] = np.frombuffer(self.texts[i], np.uint8)
                row[end] = 0x80
            block[:, 56:58] = (8 * (size + self.length[fits])).astype("<u2").view(np.uint8).reshape(-1, 2)
            words = np.ascontiguousarray(block.view("<u4").T)
            if len(self.laid) > 8:
                self.laid.clear()
            self.laid[size] = fits, words, [not w.any() for w in words], np.flatnonzero(self.length + size > 55)
        return self.laid[size]

    def first_words(self, prefix: bytes) -> np.ndarray:
        out = np.empty(len(self.texts), np.uint32)
        fits, words, empty, others = self._layout(len(prefix))
        head = np.frombuffer(prefix[:55].ljust(64, b"\0"), "<u4")
        for lo in range(0, len(fits), CHUNK):
            out[fits[lo : lo + CHUNK]] = _steps([int(h) if e else w[lo : lo + CHUNK] | h if h else w[lo : lo + CHUNK] for w, e, h in zip(words, empty, head, strict=True)], len(fits[lo : lo + CHUNK]))
        for i in others:
            out[i] = int.from_bytes(hashlib.md5(prefix + self.texts[i]).digest()[:4], "big")
        return out


def _steps(words: list, n: int) -> np.ndarray:
    """The first word of MD5 after one block; words: 16 columns or numbers. It is final after 61 of the 64 steps."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        turn, at = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(words[at], int):
            f += np.uint32((SINES[i] + words[at]) & 0xFFFFFFFF)
        else:
            f += words[at]
            f += np.uint32(SINES[i])
        shift = SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(shift), out=g)
        np.right_shift(f, np.uint32(32 - shift), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(START[0])
    return b.byteswap()
