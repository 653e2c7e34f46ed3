"""MD5 of many short texts at once: the digests of "<prefix><tail>" for every row's prefix and every tail.

The draws of ``hashing`` are digests of a row's id, a salt and a replicate. A call of a library costs most of its time
before it hashes anything; here the 64 steps run over arrays instead, with the same bits.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np

#: Digests computed together: few enough to stay in a core's cache.
AT_ONCE = 1 << 15
# The constants of MD5 (RFC 1321).
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINE = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that fit one block beside its end mark and its length.
_BLOCK = 55


def digest_words(prefixes: list[bytes], tails: list[bytes], words: int = 4) -> np.ndarray:
    """(words, prefixes, tails): the first 32-bit words of the digests, as their hexadecimal text reads."""
    out = np.empty((words, len(prefixes), len(tails)), np.uint32)
    for size, rows in _by_length(prefixes).items():
        for tail_size, cols in _by_length(tails).items():
            ends = [tails[c] for c in cols]
            if size + tail_size > _BLOCK:
                for r in rows:
                    got = b"".join([md5(prefixes[r] + t).digest() for t in ends])
                    out[:, r, cols] = np.frombuffer(got, ">u4").reshape(len(ends), 4).T[:words]
                continue
            step = max(1, AT_ONCE // len(cols))
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                out[:, some[:, None], cols[None, :]] = _one_block([prefixes[r] for r in some], ends)[:words]
    return out


def _by_length(texts: list[bytes]) -> dict[int, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}


def _blocks(texts: list[bytes], before: int) -> np.ndarray:
    """(16, texts): the texts, of one length, as 32-bit words of a block after ``before`` zero bytes."""
    block = np.zeros((len(texts), 64), np.uint8)
    size = len(texts[0])
    block[:, before:before + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    return block.view("<u4").T


def _one_block(prefixes: list[bytes], tails: list[bytes]) -> np.ndarray:
    size = len(prefixes[0])
    total = size + len(tails[0])
    first, last = _blocks(prefixes, 0), _blocks([t + b"\x80" for t in tails], size)
    shape = (len(prefixes), len(tails))
    block = [None if 4 * i > total else (first[i][:, None] | last[i][None, :]) for i in range(16)]
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        word = block[_WORD[i]]
        f += np.uint32((_SINE[i] + (8 * total if _WORD[i] == 14 else 0)) & 0xFFFFFFFF)
        if word is not None:
            f += word
        np.left_shift(f, np.uint32(_TURN[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        f |= g
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return np.stack([(x + np.uint32(s)).byteswap() for x, s in zip((a, b, c, d), _START)])
