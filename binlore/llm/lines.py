"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, distributed union-find.

Lines are the parts of a text between newlines. White space runs become one space, edges are trimmed and A-Z
lower-cased; lines of fewer than ``MIN_WORDS`` words are kept as they are. A line in a script written without
spaces also meets the bound if it has ``UNSPACED_CHARS`` such characters for each word. A line's set is its distinct 5-character
shingles. One-permutation MinHash gives ``BINS`` minima from a few draws of each shingle (empty bins borrow from the next), cut into bands;
all lines that share a band are candidates of one another, and candidates whose sets have a Jaccard similarity of
``NUM / DEN`` or more are linked. Of each component the first line, by document id and line number, is kept.

Equal lines are one class from the start, so repeats cost one row for each task. A band of few classes gives its pairs; a
longer one is cut into tiles of bounded weight, each of which gives a spanning forest of its links. Lines have 128-bit hashes: a class
is named by the one half, and classes whose names collide get other names in a second run.

Nulls: a null text has no lines; a null document id comes first in the order. Whole texts count, however long; an empty line has no
words. Repeated rows have the same line places, and both keep the kept line; rows of one id (or of none) with different
texts are told apart by their texts' hashes before lines are taken out. Only the id and text columns are read, and columns that clash with results'
names stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, read_table, staged, unstage
from .components import connected_components
from .jaccard import SHORT, _bands, _with_end, collided, similar, tile_links
from .textbatch import as_binary, chunked, lean, mix, raw

MIN_WORDS = 5
#: Code points, inclusive, of scripts without spaces between words: Thai and Lao, Burmese, Khmer, Chinese and Japanese.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0x20000, 0x3FFFF)]
UNSPACED_CHARS = 2
CHARS = 5
#: Odd multipliers of a shingle's characters.
GRAM = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 & (1 << 64) - 1) for k in range(CHARS)]
#: The same for the 32-bit hashes that only choose candidates.
SKETCH = np.array([int(g) >> 32 | 1 for g in GRAM], np.uint32)
BINS, ROWS = 72, 6
#: Draws of each shingle into bins, so that short lines fill them too.
DRAWS = 3
NUM, DEN = 80, 100


def _unspaced(text: np.ndarray) -> np.ndarray:
    """Flags of characters of ``UNSPACED``."""
    out = np.zeros(len(text), bool)
    for a, b in UNSPACED:
        out |= (text >= a) & (text <= b)
    return out


#: Characters of lines whose shingles are made at once, so that arrays stay in a core's cache; a longer line goes alone.
BLOCK_CHARS = 1 << 15
#: Text bytes whose lines are taken at once; a longer text goes alone.
LINES_BYTES = 1 << 19


def code_points(data: np.ndarray) -> np.ndarray:
    """Characters of UTF-8 bytes."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32)
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def in_characters(data: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """Places in UTF-8 bytes as places in their characters."""
    later = np.flatnonzero((data & 0xC0) == 0x80)
    return [at - np.searchsorted(later, at) if len(later) else at for at in places]


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the shingle that starts at each character; the last ones are of what is left."""
    t = text.astype(np.uint64)
    h = t * GRAM[0]
    for k in range(1, min(CHARS, len(t))):
        h[: len(t) - k] += t[k:] * GRAM[k]
    return mix(h)


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive lines of ``BLOCK_CHARS`` characters at most, one line at least."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK_CHARS, "right")))
        yield at, to
        at = to


class Lines:
    """The candidate lines of a chunk of texts.

    ``row``, ``number``: text and place of each line; ``data``, ``start``, ``end``: normalised UTF-8, flat, and where lines lie;
    ``text``, ``lo``, ``hi``: the same in characters; ``names``, ``checks``: halves of the lines' hashes. ``renamed``: checks that keep
    a name; other lines of it are named by their checks.
    """

    def __init__(self, texts: pa.LargeBinaryArray, min_words: int = MIN_WORDS, renamed: dict[int, int] | None = None):
        data, off = raw(texts)
        try:
            str(memoryview(data), "utf-8")
        except UnicodeDecodeError:
            data, off = raw(pa.array([x.decode("utf-8", "replace").encode() for x in texts.to_pylist()], pa.large_binary()))
        firsts = off[:-1][off[:-1] < off[1:]]
        newline = data == 10
        begin = np.zeros(len(data) + 1, bool)
        begin[1:] = newline
        begin[firsts] = True
        starts = np.flatnonzero(begin[:-1])
        all_row = np.searchsorted(off, starts, "right") - 1
        all_number = np.arange(len(starts)) - np.searchsorted(starts, off[:-1])[all_row]
        space = (data == 32) | (data - np.uint8(9) < 5)
        drop = space.copy()  # a space that follows a space or the line's start
        drop[1:] &= space[:-1] | begin[1:-1]
        drop |= newline
        dropped = np.flatnonzero(drop)
        text = data[~drop]
        text[text - np.uint8(9) < 5] = 32
        text += (text - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)  # lower-cases A-Z
        ends = np.append(starts[1:], len(data))
        lo, hi = (at - np.searchsorted(dropped, at) for at in (starts, ends))
        if len(text):
            hi = hi - ((hi > lo) & (text[np.maximum(hi - 1, 0)] == 32))
        spaces = np.flatnonzero(text == 32)
        words = np.where(hi > lo, np.searchsorted(spaces, hi) - np.searchsorted(spaces, lo) + 1, 0)
        use = words >= min_words
        wide = np.flatnonzero(text >= 0xE0)  # where characters of UNSPACED, among others, begin
        if len(wide):
            some = np.flatnonzero(~use & ((np.searchsorted(wide, hi) - np.searchsorted(wide, lo)) // UNSPACED_CHARS >= min_words))
            use[some] = [_unspaced(code_points(text[a:b])).sum() // UNSPACED_CHARS >= min_words for a, b in zip(lo[some].tolist(), hi[some].tolist())]
        self.row, self.number, self.words = all_row[use], all_number[use], words[use]
        self.data, self.start, self.end = text, lo[use].astype(np.int64), hi[use].astype(np.int64)
        view = memoryview(text)
        halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(self.start.tolist(), self.end.tolist())]), "<i8").reshape(-1, 2)
        self.names, self.checks = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
        for name, check in (renamed or {}).items():
            self.names = np.where((self.names == name) & (self.checks != check), self.checks, self.names)

    @cached_property
    def text(self) -> np.ndarray:
        return code_points(self.data)

    @cached_property
    def _places(self) -> list[np.ndarray]:
        return in_characters(self.data, self.start, self.end)

    @property
    def lo(self) -> np.ndarray:
        return self._places[0]

    @property
    def hi(self) -> np.ndarray:
        return self._places[1]

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit hash of each shingle, its line's index in ``which``, ascending places); shingles that are no line's have the index ``len(which)``."""
        if not len(which):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lo, hi = self.lo[which], self.hi[which]
        t = self.text[lo[0] : hi[-1]]
        h = t * SKETCH[0]
        for k in range(1, min(CHARS, len(t))):
            h[: len(t) - k] += t[k:] * SKETCH[k]
        n = np.maximum(hi - lo - CHARS + 1, 1)
        line, counts = np.full((len(which), 2), len(which)), np.empty((len(which), 2), np.int64)
        line[:, 0] = np.arange(len(which))
        counts[:, 0], counts[:, 1] = n, np.append(lo[1:], hi[-1]) - lo - n
        for k in np.flatnonzero(hi - lo < CHARS).tolist():  # a shorter line is one shingle, which ends with it
            h[lo[k] - lo[0]] = (t[lo[k] - lo[0] : hi[k] - lo[0]] * SKETCH[: hi[k] - lo[k]]).sum(dtype=np.uint32)
        return mix32(h), np.repeat(line.ravel(), counts.ravel())


def mix32(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 32-bit values (a bijection)."""
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def gram_sets(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of the lines ``text[lo:hi]``, its line's index); a shorter line is one shingle."""
    n = np.maximum(hi - lo - CHARS + 1, 1)
    line = np.repeat(np.arange(len(lo), dtype=np.int32), n)
    base = int(lo.min())
    at = np.repeat(lo - base - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    h = gram_hashes(text[base : int(hi.max())])[at]
    for k in np.flatnonzero(hi - lo < CHARS).tolist():  # its shingle ends with the line
        h[int(n[:k].sum())] = gram_hashes(text[lo[k] : hi[k]])[0]
    return h, line


def minima(hashes: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """One-permutation MinHash: each draw's bin comes from its high bits; empty bins take the next full one's minimum, marked by distance."""
    most = np.uint32((1 << 32) - 1)
    sig = np.full((lines + 1) * BINS, most)
    base = (line * BINS).astype(np.uint32)
    at = np.empty(len(line), np.int64)
    for draw in range(DRAWS):
        if draw:
            hashes = hashes ^ hashes >> np.uint32(15)
            hashes *= SKETCH[draw]
        bins = hashes >> np.uint32(16)
        bins *= np.uint32(BINS)
        bins >>= np.uint32(16)
        bins += base
        at[:] = bins
        np.minimum.at(sig, at, hashes)
    sig = sig[: lines * BINS].reshape(lines, BINS).astype(np.uint64)
    rows = np.flatnonzero((sig == most).any(1))
    part = sig[rows]
    place = np.arange(2 * BINS)
    following = np.where(np.tile(part != most, 2), place, 2 * BINS)
    following = np.minimum.accumulate(following[:, ::-1], 1)[:, ::-1][:, :BINS]  # the first full bin from each one on
    distance = (following - place[:BINS]).astype(np.uint64)
    sig[rows] = np.take_along_axis(part, following % BINS, 1) + distance * GRAM[2]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(lines, bands) keys."""
    bands = sig.reshape(len(sig), -1, ROWS)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    for r in range(ROWS):
        key = mix(key + bands[:, :, r])
    return key


_LINE = pa.schema([("kind", pa.int8()), ("name", pa.int64()), ("check", pa.int64()), ("number", pa.int32()), ("words", pa.int32()), ("lead", pa.bool_()), ("bands", pa.binary())])
#: Bands of a line.
BANDS = BINS // ROWS


def _packed(names: np.ndarray, grams: np.ndarray, keys: np.ndarray) -> bytes:
    """The bands of classes as one value, so that no engine handles them one by one."""
    return names.tobytes() + keys.tobytes() + grams.tobytes()


def _unpacked(value: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, shingles before repeats go, keys by class and band) of ``_packed``."""
    names, keys = np.frombuffer(value, np.int64, n), np.frombuffer(value, np.uint64, n * BANDS, 8 * n)
    return names, np.frombuffer(value, np.int32, n, 8 * n * (1 + BANDS)), keys.reshape(n, BANDS)


def _line_table(df: DataFrame, doc_type: str, renamed: dict) -> DataFrame:
    """Kind 0: a line (doc, number, name, check, words); 1: the bands of ``number`` classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, texts in chunked(batch, "__bl_text", LINES_BYTES):
                lines = Lines(texts, renamed=renamed)
                docs = part.column(0)

                def out(kind, n, name=None, check=None, number=None, words=None, doc=None, lead=None, bands=None):
                    given = (pa.array(np.full(n, kind, np.int8)), name, check, number, words, lead, bands)
                    arrays = [doc if doc is not None else pa.nulls(n, docs.type), *(x if isinstance(x, pa.Array) else pa.array(x) if x is not None else pa.nulls(n, t) for x, t in zip(given, _LINE.types))]
                    return pa.RecordBatch.from_arrays(arrays, names=["doc", *_LINE.names])

                order = np.lexsort((lines.names, lines.row))
                lead = np.ones(len(order), bool)  # first of its class in its text
                lead[order[1:]] = (lines.names[order[1:]] != lines.names[order[:-1]]) | (lines.row[order[1:]] != lines.row[order[:-1]])
                yield out(0, len(lines.row), lines.names, lines.checks, lines.number.astype(np.int32), lines.words.astype(np.int32), docs.take(pa.array(lines.row)), lead)
                names, first = np.unique(lines.names, return_index=True)
                fresh = np.fromiter((x not in seen for x in names.tolist()), bool, len(names))
                seen.update(names[fresh].tolist())
                first = np.sort(first[fresh])
                if not len(first):
                    continue
                sizes = lines.hi[first] - lines.lo[first]
                sig = [minima(*lines.grams(first[x:y]), y - x) for x, y in blocks(sizes)]
                value = _packed(lines.names[first], np.maximum(sizes - CHARS + 1, 1).astype(np.int32), band_keys(np.concatenate(sig)))
                yield out(1, 1, number=np.array([len(first)], np.int32), bands=pa.array([value], pa.binary()))

    return df.mapInArrow(lean(run), f"doc {doc_type}, kind byte, name long, check long, number int, words int, lead boolean, bands binary")


#: Rows of bands that are handled at once.
BAND_BUFFER = 1 << 16
#: Bytes of a bucket of bands, unless one band has more; of rows of bands dealt at once; and rows of a bucket's piece.
BUCKET_BYTES, DEALT_ROWS, PIECE = 4 << 20, 1 << 19, 2048
#: Bytes of bands for which another partition is worth while.
PART_BYTES = 1 << 20
_PIECE = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("names", pa.binary()), ("grams", pa.binary())])


def _bucketed(bands: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, names, grams): rows of bands, dealt by ranges of keys, many to a row."""

    def deal(held):
        names, grams, keys = (np.concatenate(x) for x in zip(*held))
        keys = keys.ravel()
        bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        counts = np.diff(np.append(starts, len(bucket)))
        starts = np.flatnonzero((np.arange(len(bucket)) - np.repeat(starts, counts)) % PIECE == 0)
        bounds = np.append(starts, len(bucket))
        of = order // BANDS
        pieces = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (keys[order], names[of], grams[of])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), *pieces], schema=_PIECE)

    def run(batches):
        held, n, limit = [], 0, min(DEALT_ROWS, PIECE // 2 * buckets)
        for batch in batches:
            for count, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(_unpacked(value.as_py(), count))
                n += count * BANDS
                if n >= limit:
                    yield deal(held)
                    held, n = [], 0
        if n:
            yield deal(held)

    return bands.select("number", "bands").mapInArrow(lean(run), "bucket long, keys binary, names binary, grams binary")


def _flat(column: pa.Array, dtype) -> np.ndarray:
    """The values of a column of binaries, one after the other."""
    column = column.cast(pa.large_binary())
    return raw(column)[0].view(dtype)


def _candidates(bands: DataFrame) -> DataFrame:
    """Every pair of classes of a band: as a pair (tile null), or inside a tile (tile, side, a) where more than SHORT share the band."""
    schema = pa.schema([("tile", pa.int64()), ("side", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])

    def pairs(name, starts, counts):
        """Pairs of all short bands at once, by the distance inside a band."""
        end = np.repeat(starts + counts, counts)
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        found = []
        for d in range(1, int(counts.max(initial=1))):
            ok = at + d < end
            at, end = at[ok], end[ok]
            found.append(np.stack([name[at], name[at + d]]))
        pair = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pair.sort(axis=0)
        order = np.lexsort(pair)
        pair = pair[:, order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (pair[:, 1:] != pair[:, :-1]).any(0)
        return pair[:, fresh]

    def tiles(name, grams):
        """Tiles are named by their classes, so that bands of the same classes give the same tiles."""
        bounds = _bands(grams.astype(np.int64))
        parts = [name[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        for i in range(len(parts)):
            for j in range(i, len(parts)):
                tile = xxhash.xxh3_64_intdigest(parts[i].tobytes() + b"|" + parts[j].tobytes()) - (1 << 63)
                for side, k in ((0, i), (1, j)) if i != j else ((0, i),):
                    m = len(parts[k])
                    yield pa.RecordBatch.from_arrays([pa.array([tile] * m, pa.int64()), pa.array([side] * m, pa.int8()), pa.array(parts[k]), pa.nulls(m, pa.int64())], schema=schema)

    def run(batches):
        held, n, limit = [], 0, BAND_BUFFER
        for batch in _with_end(batches):
            if batch is not None:
                keys = _flat(batch.column(1), np.uint64)
                lengths = np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: batch.num_rows + 1]) // 8
                held.append([np.repeat(batch.column(0).to_numpy(), lengths), keys, _flat(batch.column(3), np.int32), _flat(batch.column(2), np.int64)])
                n += len(keys)
                if n < limit:
                    continue
            if not n:
                continue
            bucket, key, grams, name = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(bucket, bucket[-1])) if batch is not None else n  # the last bucket may go on
            held, n = [[bucket[cut:], key[cut:], grams[cut:], name[cut:]]], n - cut
            limit = max(BAND_BUFFER, 2 * n)
            order = np.argsort(key[:cut])
            same = key[order[1:]] == key[order[:-1]]
            order = order[np.append(same, False) | np.append(False, same)] if cut else order
            order = order[np.lexsort((name[order], grams[order], key[order]))]
            key, grams, name = key[order], grams[order], name[order]
            cut = len(order)
            once = np.ones(cut, bool)
            once[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            key, grams, name = key[once], grams[once], name[once]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if cut else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(key)))
            some = (counts > 1) & (counts <= SHORT)
            pair = pairs(name, starts[some], counts[some])
            if m := pair.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int8()), *(pa.array(np.ascontiguousarray(x)) for x in pair)], schema=schema)
            for s, c in zip(starts[counts > SHORT].tolist(), counts[counts > SHORT].tolist()):
                yield from tiles(name[s : s + c], grams[s : s + c])

    rows = (bands.agg(F.sum(F.col("number").cast("long"))).first()[0] or 0) * BANDS
    size = 20 * rows
    parts = min(int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    each = size // (parts * BUCKET_BYTES) + 1
    # buckets are of one size, so parts of as many buckets are even; a hash of the bucket would heap some up
    dealt = _bucketed(bands, parts * each).repartitionById(parts, F.floor(F.col("bucket") / each).cast("int")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(run), "tile long, side byte, a long, b long")


def _check_tiles(members: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        links = tile_links(group["a"].to_pylist(), group["side"].to_numpy(), shingle_sets(group["line"]), num, den)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    rows = members.join(table.select(F.col("name").alias("a"), "line"), "a")
    return rows.groupBy("tile").applyInArrow(run, "a long, b long")


#: Line classes to fetch whose names and first places may be broadcast.
BROADCAST_NAMES = 1_000_000


def _line_texts(df: DataFrame, wanted: DataFrame, renamed: dict) -> DataFrame:
    """(name, line): normalised texts of the classes in ``wanted`` (name), staged.

    The names are broadcast if there are few enough; beyond that all lines are sent to a join with them.
    """
    schema = pa.schema([("name", pa.int64()), ("line", pa.string())])
    few = None
    if wanted.count() <= BROADCAST_NAMES:
        few = df.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["name"].to_numpy()))

    def run(batches):
        seen: set[int] = set()
        names = few.value if few is not None else None
        for batch in batches:
            for _, texts in chunked(batch, "__bl_text", LINES_BYTES):
                lines = Lines(texts, renamed=renamed)
                own, first = np.unique(lines.names, return_index=True)
                if names is not None:
                    at = np.minimum(np.searchsorted(names, own), max(len(names) - 1, 0))
                    use = names[at] == own if len(names) else np.zeros(len(own), bool)
                    own, first = own[use], first[use]
                fresh = [k for k, x in enumerate(own.tolist()) if x not in seen]
                seen.update(own[fresh].tolist())
                at = first[fresh]
                out = [lines.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(lines.start[at].tolist(), lines.end[at].tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(own[fresh]), pa.array(out, pa.string())], schema=schema)

    table = df.select("__bl_text").mapInArrow(lean(run), "name long, line string")
    if few is None:
        table = table.join(wanted, "name", "left_semi")
    return staged(table.dropDuplicates(["name"]), "line-texts")


def shingle_set(line: str) -> np.ndarray:
    """Sorted distinct hashes of a normalised line's character shingles; a shorter line is one."""
    t = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(1, len(t) - CHARS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(CHARS, len(t))):
        part = t[k : k + n]
        h[: len(part)] += part * GRAM[k]
    h = mix(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingle_sets(lines: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """``shingle_set`` of each of many lines, of one character or more."""
    data, off = raw(as_binary(lines))
    text = code_points(data)
    (off,) = in_characters(data, off)
    out = []
    for x, y in blocks(np.diff(off)):
        h, line = gram_sets(text, off[x:y], off[x + 1 : y + 1])
        bounds = np.searchsorted(line, np.arange(y - x + 1)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            h[a:b].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        h = h[fresh]
        bounds = np.searchsorted(line[fresh], np.arange(y - x + 1)).tolist()
        out += [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def _common(u: np.ndarray, v: np.ndarray) -> int:
    """Size of the intersection of distinct arrays."""
    both = np.concatenate((u, v))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _linked(pairs: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "xa", "xb"))
            names, first, at = np.unique(np.concatenate((a.to_numpy(), b.to_numpy())), return_index=True, return_inverse=True)
            sets = shingle_sets(pa.concat_arrays([x, y]).take(pa.array(first)))
            n = np.array([len(s) for s in sets], np.int64)
            u, v = at[: len(a)], at[len(a) :]
            keep = np.flatnonzero(np.minimum(n[u], n[v]) * den >= num * np.maximum(n[u], n[v]))
            shared = np.array([_common(sets[i], sets[j]) for i, j in zip(u[keep].tolist(), v[keep].tolist())], np.int64)
            keep = pa.array(keep[similar(shared, n[u[keep]], n[v[keep]], num, den)])
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], schema=schema)

    side = lambda c: table.select(F.col("name").alias(c), F.col("line").alias(f"x{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(run), "a long, b long")


def line_classes(df: DataFrame, doc: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """Every candidate line: ``doc``, ``line_no`` (from 0), ``n_words``, the place of its class's kept line (``kept_doc``, ``kept_line``), ``kept``."""
    kind = df.schema[doc].dataType.simpleString()
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("__bl_text"))
    place = F.struct("doc", "number")
    renamed: dict[int, int] = {}
    while True:
        table = staged(_line_table(rows, kind, renamed), "lines")
        lines = table.where("kind = 0").select("doc", "number", "name", "words")
        # primitive buffers, so that hash aggregates combine before the shuffle; a class leads a text once, so no ties
        lead, doc_of, at = F.col("lead"), F.col("doc"), F.col("number")
        firsts = table.where("kind = 0").groupBy("name").agg(F.min("doc").alias("d"), F.coalesce(F.min_by(F.when(lead, at), F.when(lead, doc_of)), F.min("number")).alias("l"), F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
        firsts = staged(firsts.select("name", F.struct(F.col("d").alias("doc"), F.col("l").alias("number")).alias("first"), "n", "low", "high"), "firsts")
        if renamed or not (renamed := collided(firsts)):
            break
        unstage(table, firsts)
    found = staged(_candidates(table.where("kind = 1")), "candidates")
    pairs = staged(found.where("tile is null").select("a", "b").distinct(), "pairs")
    members = staged(found.where("tile is not null").select("tile", "side", "a").distinct(), "members")
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(members.select(F.col("a").alias("name"))).distinct(), "wanted")
    texts = _line_texts(rows, wanted, renamed)
    labels = connected_components(_linked(pairs, texts, num, den).unionByName(_check_tiles(members, texts, num, den)))
    unstage(found, pairs, members, wanted, texts)
    members = labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
    joined = firsts.join(members, F.col("name") == F.col("node"), "left").where("n > 1 or root is not null").select("name", "first", "n", "root")
    joined = staged(joined, "joined")
    rooted = joined.where("root is not null")
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"), F.count("*").alias("classes"))
    # a component may hold any share of the classes, a class any share of the lines
    linked = hot_join(rooted.select("name", "n", "root"), kept, "root", "classes", rooted.count(), F.col("name"))
    shared = joined.where("root is null").select("name", "n", F.col("first").alias("kept")).unionByName(linked.select("name", "n", "kept"))
    shared = staged(shared, "shared")
    unstage(firsts, joined)
    out = hot_join(lines, shared, "name", "n", lines.count(), place)
    at = F.coalesce("kept", place)
    return out.select(F.col("doc").alias(doc), F.col("number").alias("line_no"), F.col("words").cast("long").alias("n_words"), at["doc"].alias("kept_doc"), at["number"].alias("kept_line"), at.eqNullSafe(place).alias("kept"))


def dedup_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", min_left: int = 0, num: int = NUM, den: int = DEN) -> DataFrame:
    """``df`` with the lines that are not kept taken out of ``text``.

    Documents that lose lines and are left with fewer than ``min_left`` words are dropped; others keep their row.
    """
    mark = F.xxhash64(text)
    if not df.groupBy(doc).agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").isEmpty():
        keyed = df.withColumn("__bl_id", F.struct(F.col(doc).alias("id"), mark.alias("mark")))
        return _without_lines(keyed, "__bl_id", text, min_left, num, den).drop("__bl_id")
    return _without_lines(df, doc, text, min_left, num, den)


def _without_lines(df: DataFrame, doc: str, text: str, min_left: int, num: int, den: int) -> DataFrame:
    gone = line_classes(df, doc, text, num, den).where("not kept").select(F.col(doc).alias("__bl_doc"), "line_no").distinct()
    gone = gone.groupBy("__bl_doc").agg(F.collect_list("line_no").alias("__bl_gone"))
    joined = df.join(gone, F.col(doc).eqNullSafe(F.col("__bl_doc")), "left")
    # a map of the places makes the test of each line constant in time
    places = F.map_from_arrays("__bl_gone", "__bl_gone")
    lines = F.split(F.col(text), "\n")
    left = F.transform(F.array(F.struct(lines.alias("s"), places.alias("m"))), lambda x: F.array_join(F.filter(x["s"], lambda s, i: ~F.map_contains_key(x["m"], i)), "\n"))[0]
    out = joined.withColumn(text, F.when(F.col("__bl_gone").isNull(), F.col(text)).otherwise(left))
    if min_left:
        words = F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        out = out.where(F.col("__bl_gone").isNull() | (words >= min_left))
    return out.select(*df.columns)


def op6_fuzzy_lines(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_classes(docs)


def stage_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: near-duplicate lines go, and with them documents of which no words stay."""
    cut = dedup_lines(docs, min_left=1)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
