"""CRC-32C (Castagnoli) of many byte strings at once, in numpy.

A checksum that begins at zero is linear: zero bytes in front do not change it, and the checksum of two strings in a row is that of
the first, moved on by the second's length, plus that of the second. So strings are cut into blocks from their ends, all
blocks advance together two bytes at a time, and neighbours are joined until one is left of each string. The usual start
value flips a string's first four bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# Fixed value: the reversed Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78
#: Bytes of a block.
BLOCK = 64


@cache
def _pairs() -> np.ndarray:
    """The register behind each pair of bytes, by the polynomial's rule."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def _moved_bits(bits: np.ndarray, pairs: int) -> np.ndarray:
    for _ in range(pairs):
        bits = (bits >> np.uint32(16)) ^ _pairs()[bits & np.uint32(0xFFFF)]
    return bits


def _apply(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    for k in range(32):
        out ^= np.where(values >> np.uint32(k) & np.uint32(1), images[k], np.uint32(0))
    return out


@cache
def _shift(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables that move a register on by BLOCK * 2**level zero bytes, for its low and high half."""
    if level == 0:
        images = _moved_bits(np.uint32(1) << np.arange(32, dtype=np.uint32), BLOCK // 2)
    else:
        half = np.uint32(1) << np.arange(32, dtype=np.uint32)
        low, high = _shift(level - 1)
        for _ in range(2):
            half = low[half & np.uint32(0xFFFF)] ^ high[half >> np.uint32(16)]
        images = half
    value = np.arange(1 << 16, dtype=np.uint32)
    return _apply(images, value), _apply(images, value << np.uint32(16))


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums (uint32) of the parts of ``data`` (uint8) of ``lengths`` bytes from ``starts``."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    # a front of zeros makes every string a whole number of blocks, one at least, with room for the flipped bytes
    blocks = -(-np.maximum(lengths, 4) // BLOCK)
    ends = np.cumsum(blocks) * BLOCK
    padded = np.zeros(int(ends[-1]), np.uint8)
    if lengths.sum() > n * BLOCK:  # longer strings go one by one, which needs no index of their bytes
        for to, start, length in zip(ends.tolist(), starts.tolist(), lengths.tolist()):
            padded[to - length : to] = data[start : start + length]
    else:
        at = np.repeat(ends - lengths - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        source = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        padded[at] = data[source]
    for k in range(4):
        some = lengths > k
        padded[(ends - lengths)[some] + k] ^= 0xFF
    words = padded.view("<u2").reshape(-1, BLOCK // 2).T.astype(np.uint32)
    table, crc = _pairs(), np.zeros(words.shape[1], np.uint32)
    for row in words:
        crc = (crc >> np.uint32(16)) ^ table[(crc ^ row) & np.uint32(0xFFFF)]
    left, level = blocks, 0
    while (left > 1).any():  # join neighbours from each string's end; an odd first one stays
        low, high = _shift(level)
        first = np.cumsum(left) - left
        odd = left & 1
        pairs = left // 2
        owner = np.repeat(np.arange(n), pairs)
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        a = first[owner] + odd[owner] + 2 * k
        joined = low[crc[a] & np.uint32(0xFFFF)] ^ high[crc[a] >> np.uint32(16)] ^ crc[a + 1]
        now = pairs + odd
        begin = np.cumsum(now) - now
        out = np.zeros(int(now.sum()), np.uint32)
        out[begin[odd == 1]] = crc[first[odd == 1]]
        out[begin[owner] + odd[owner] + k] = joined
        crc, left, level = out, now, level + 1
    flipped = np.minimum(lengths, 4)
    # bytes of the start value that a string shorter than four does not reach move out of the register as they are
    rest = np.where(flipped < 4, np.uint32(0xFFFFFFFF) >> (8 * flipped).clip(0, 31).astype(np.uint32), np.uint32(0))
    return crc ^ rest ^ np.uint32(0xFFFFFFFF)
