"""Vectorised text primitives over Arrow string arrays (numpy on the raw UTF-8 bytes)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes handled at once; bounds a worker's memory whatever the batch size. A longer text goes alone.
CHUNK_BYTES = 3 << 19


def trim() -> None:
    """Give freed memory back to the system; reused workers stay small between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run, each: bool = True):
    """A batch function whose worker gives freed memory back at the task's end, and (each) after every batch read."""

    def trimmed(batches):
        for batch in batches:
            yield batch
            trim()

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(trimmed(batches) if each else batches)
        trim()

    return wrapped


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """Texts as large binaries without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column))
    return column.cast(pa.large_binary())


def raw(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an array, without copying."""
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunked(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.LargeBinaryArray]]:
    """Slices of a batch of at most ``limit`` text bytes each, one row at least."""
    texts = as_binary(batch.column(batch.schema.get_field_index(text)))
    _, off = raw(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags that are set for bytes in the inclusive ranges."""
    flags = np.zeros(256, bool)
    for lo, hi in ranges:
        flags[lo : hi + 1] = True
    return flags


#: Bytes of words parted by ASCII white space, and of words of letters, digits and non-ASCII characters.
NON_SPACE = ~table_of((0x20, 0x20), (0x09, 0x0D))
ALNUM = table_of((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of concatenated texts: where they lie, their text's row, and dictionary codes.

    ``starts``/``ends``: byte spans; ``rows``: text of each word; ``counts``: words of each text;
    ``codes``/``vocab``: dictionary encoding of the lower-cased words.
    """

    def __init__(self, texts: pa.LargeBinaryArray, flags: np.ndarray, lower: bool = True):
        data, off = raw(texts)
        mask = flags[data]
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        firsts = off[:-1][off[:-1] < off[1:]]
        begins[firsts] = mask[firsts]
        ends = mask.copy()
        ends[:-1] &= ~mask[1:]
        lasts = off[1:][off[:-1] < off[1:]] - 1
        ends[lasts] = mask[lasts]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.counts = np.diff(np.searchsorted(self.starts, off))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        kept = data[mask]
        if lower:
            kept = LOWER[kept]
        bounds = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=bounds[1:])
        array = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
        coded = array.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocab = coded.dictionary

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, the same in every task."""
        if not len(self.vocab):
            return np.zeros(0, np.uint64)
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocab.to_pylist()), np.uint64, len(self.vocab))
        return own[self.codes]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (a bijection)."""
    t = h >> np.uint64(33)
    h = h ^ t
    h *= np.uint64(0xFF51AFD7ED558CCD)
    np.right_shift(h, np.uint64(33), out=t)
    h ^= t
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    np.right_shift(h, np.uint64(33), out=t)
    h ^= t
    return h


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, flat, and the bounds of the texts.

    A text with fewer words than ``size``, but not none, has its whole word sequence as one n-gram.
    """
    h = words.hashes()
    n = len(h)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams[: n - k] = mix(grams[: n - k] + h[k:] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) if n > k else grams[: n - k]
    parts, bounds = [], np.zeros(len(words.counts) + 1, np.int64)
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        if b - a >= size:
            g = grams[a : b - size + 1].copy()
            g.sort()
            g = g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif b > a:
            short = np.zeros(1, np.uint64)
            for k in range(b - a):
                short = mix(short + h[a + k] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
            g = mix(short + np.uint64(b - a))
        else:
            g = np.zeros(0, np.uint64)
        parts.append(g)
        bounds[i + 1] = bounds[i] + len(g)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds
