"""Benchmark decontamination by training suffix arrays.

Documents are taken in shards (bounded runs of texts inside a task). A shard's words become ids of the benchmark's
vocabulary; words that no benchmark item has match nothing and part the text. Over the positions from which a match of
the shortest window can begin, a suffix array is built, and every benchmark suffix is found in it by binary search:
its neighbours give its longest verbatim match and where it lies, and the suffixes that share a whole window with it
give all the window's occurrences.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is ``window`` consecutive words
of an item; an item of fewer, but not none, is one window. Null texts and items have no words; an empty benchmark hits
nothing; repeated items count by their ids, repeated rows each. Null item ids are left out of lists.

The benchmark goes to the executors in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words, of which the driver
holds one at a time; beyond one block, passes over the documents follow each other in one stage, each adding its hits. A shard
searches only windows whose first words follow each other in it, and equal windows once, so its work grows with its own matches.
Whole texts count, however long; a longer text is a shard of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .textbatch import ALNUM, Words, as_binary, chunked, lean

WINDOW = 10
BLOCK_ITEMS = 200_000
BLOCK_WORDS = 20_000_000
#: Text bytes of a shard; Arrow batches are joined up to it.
SHARD_BYTES = 8 << 20


def suffix_array(text: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """``positions`` in the order of the suffixes of ``text`` (ids from 1; 0 ends a suffix), by prefix doubling.

    Ends of runs and of the text compare as smallest. The sort doubles the compared length until all ranks differ
    or the longest run is covered.
    """
    rank = text.astype(np.int64)
    n, k = len(text), 1
    zero = np.flatnonzero(text == 0)
    longest = int(np.diff(np.concatenate(([-1], zero, [n]))).max(initial=1))
    while k < longest:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:]
        ahead[text == 0] = 0
        pair = rank * (int(rank.max(initial=0)) + 1) + ahead
        _, rank = np.unique(pair, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        rank[text == 0] = 0
        k *= 2
    return positions[np.argsort(rank[positions], kind="stable")]


def common_prefix(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Words that the suffixes of ``a`` at ``at`` and of ``b`` at ``bt`` share; id 0 shares nothing."""
    length = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        x, y = at[live] + length[live], bt[live] + length[live]
        inside = (x < len(a)) & (y < len(b))
        live, x, y = live[inside], x[inside], y[inside]
        same = (a[x] == b[y]) & (a[x] != 0)
        live = live[same]
        length[live] += 1
    return length


def search(text: np.ndarray, order: np.ndarray, query: np.ndarray, starts: np.ndarray, limits: np.ndarray | None = None) -> np.ndarray:
    """First place in ``order`` whose suffix is not below each query suffix; with ``limits``, the first whose first ``limit`` words are above it."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        t, q = order[mid], starts[open_]
        shared = common_prefix(query, q, text, t)
        a = np.where(q + shared < len(query), query[np.minimum(q + shared, len(query) - 1)], 0)
        b = np.where(t + shared < len(text), text[np.minimum(t + shared, len(text) - 1)], 0)
        below = b < a
        if limits is not None:
            below |= shared >= limits[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


class Benchmark:
    """A block of items: vocabulary, ids of all items parted by 0, and every window's start, length and item."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        words = Words(as_binary(pa.array(texts, pa.string())), ALNUM)
        self.vocab, self.items, self.window = words.vocab, ids, window
        parts, starts, owner, sizes, at = [], [], [], [], 0
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            n = int(b - a)
            if n:
                parts.append(np.append(words.codes[a:b] + 1, 0))
                windows = max(1, n - window + 1)
                starts.append(np.arange(at, at + windows))
                owner.append(np.full(windows, i))
                sizes.append(np.full(windows, min(n, window)))
                at += n + 1
        cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.text, self.starts, self.owner, self.sizes = cat(parts), cat(starts), cat(owner), cat(sizes)
        self.shortest = int(self.sizes.min(initial=window))
        leads = self.leads_of(self.text, self.starts)
        self.by_lead = np.argsort(leads, kind="stable")
        self.leads = leads[self.by_lead]

    def leads_of(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first two words at each place as one number; the first alone if a window may have no second."""
        first = text[at] * (len(self.vocab) + 1)
        return first + text[np.minimum(at + 1, len(text) - 1)] if self.shortest > 1 else first

    def shard_text(self, words: Words) -> np.ndarray:
        """Benchmark ids of a shard's words, 0 for others, with a 0 between texts: position of word i of text r is i + r."""
        import pyarrow.compute as pc

        known = pc.index_in(words.vocab, value_set=self.vocab).fill_null(-1).to_numpy(zero_copy_only=False) + 1
        out = np.zeros(len(words.codes) + len(words.counts), np.int64)
        if len(words.codes):
            out[np.arange(len(words.codes)) + words.rows] = known[words.codes]
        return out


class ShardIndex:
    """Suffix array over the parts of a shard where a window can occur. ``place``: original position of each kept word."""

    def __init__(self, bench: Benchmark, words: Words):
        text = bench.shard_text(words)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (text != 0).astype(np.int8), [0]))))
        begin, end = edges[::2], edges[1::2]
        keep = end - begin >= bench.shortest
        begin, end = begin[keep], end[keep]
        sizes = end - begin + 1  # with a 0 after each run
        total = int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        self.place = np.repeat(begin - first, sizes) + np.arange(total)
        self.text = text[np.minimum(self.place, len(text) - 1)] if total else np.zeros(0, np.int64)
        self.text[first + sizes - 1] = 0
        ok = np.ones(total, bool)
        for k in range(min(bench.shortest, int(sizes.max(initial=0)))):
            ok[: total - k] &= self.text[k:] != 0
            ok[total - k :] = False
        self.order = suffix_array(self.text, np.flatnonzero(ok))

    def candidates(self, bench: Benchmark) -> np.ndarray:
        """Windows whose first words begin a suffix of the shard; no other window or match of the shortest length can occur."""
        if not len(self.order) or not len(bench.starts):
            return np.zeros(0, np.int64)
        own = np.unique(bench.leads_of(self.text, self.order))
        left, right = np.searchsorted(bench.leads, own, "left"), np.searchsorted(bench.leads, own, "right")
        return np.sort(bench.by_lead[ranges(left, right - left)])

    def _nearest(self, bench: Benchmark, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the suffix at each window: length in words of its longest match, and the suffix (its place in ``text``) that has it."""
        starts = bench.starts[windows]
        lo = search(self.text, self.order, bench.text, starts)
        after, before = self.order[np.minimum(lo, len(self.order) - 1)], self.order[np.maximum(lo - 1, 0)]
        a, b = common_prefix(bench.text, starts, self.text, after), common_prefix(bench.text, starts, self.text, before)
        return np.maximum(a, b), np.where(a >= b, after, before)

    def occurrences(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(windows that occur, the group of each, groups, original positions): equal windows are a group, and each
        occurrence of a group is one (group, position)."""
        none = np.zeros(0, np.int64)
        windows = self.candidates(bench)
        if not len(windows):
            return none, none, none, none
        length, _ = self._nearest(bench, windows)
        hit = windows[length >= bench.sizes[windows]]
        # suffixes that share the window lie on both sides of the full suffix's place
        left, right = self._range(bench, hit)
        _, first, group = np.unique(left * (bench.window + 1) + bench.sizes[hit], return_index=True, return_inverse=True)
        left, count = left[first], (right - left)[first]
        return hit, group, np.repeat(np.arange(len(first)), count), self.place[self.order[ranges(left, count)]]

    def _range(self, bench: Benchmark, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in the suffix array of the suffixes that begin with each window."""
        starts, sizes = bench.starts[hit], bench.sizes[hit]
        width = int(sizes.max(initial=0))
        cut = np.zeros((len(hit), width + 1), np.int64)  # windows alone, each ended by 0
        for k in range(width):
            cut[:, k] = np.where(k < sizes, bench.text[np.minimum(starts + k, len(bench.text) - 1)], 0)
        flat, at = cut.ravel(), np.arange(len(hit)) * (width + 1)
        return search(self.text, self.order, flat, at), search(self.text, self.order, flat, at, sizes)

    def longest(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, length in words of the longest match of the suffix that begins at each, one original position of it)."""
        windows = self.candidates(bench)
        if not len(windows):
            return windows, windows, windows
        length, at = self._nearest(bench, windows)
        keep = length >= bench.shortest
        return windows[keep], length[keep], self.place[at[keep]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def shard_hits(bench: Benchmark, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of each text's first word, flags of hit words by shard position, distinct (text, item) pairs)."""
    windows, group, which, at = ShardIndex(bench, words).occurrences(bench)
    sizes = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
    sizes[group] = bench.sizes[windows]
    flags = np.zeros(len(words.codes) + len(words.counts) + 1, np.int64)
    np.add.at(flags, at, 1)
    np.add.at(flags, at + sizes[which], -1)
    hit = np.cumsum(flags)[:-1] > 0
    base = words.first + np.arange(len(words.first))
    if not len(at):
        return base, hit, np.zeros((2, 0), np.int64)
    texts = np.unique(np.stack([which, np.searchsorted(base, at, "right") - 1]), axis=1)
    owners = np.unique(np.stack([group, bench.owner[windows]]), axis=1)
    first = np.searchsorted(owners[0], texts[0], "left")
    count = np.searchsorted(owners[0], texts[0], "right") - first
    return base, hit, np.unique(np.stack([np.repeat(texts[1], count), owners[1][ranges(first, count)]]), axis=1)


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.LargeBinaryArray]]:
    """Rows in runs of at most ``SHARD_BYTES`` bytes, one row at least, across batches."""
    held, size = [], 0
    for batch in batches:
        for part, _ in chunked(batch, text, SHARD_BYTES):
            more = part.nbytes
            if held and size + more > SHARD_BYTES:
                yield _joined(held, text)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield _joined(held, text)


def _joined(parts: list[pa.RecordBatch], text: str) -> tuple[pa.RecordBatch, pa.LargeBinaryArray]:
    whole = pa.concat_batches(parts)
    return whole, as_binary(whole.column(whole.schema.get_field_index(text)))


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded size, one at a time as they stream to the driver; each becomes one broadcast."""
    ids, texts, words = [], [], 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or words > BLOCK_WORDS):
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"] or "")
        words += len(texts[-1]) // 2
    yield ids, texts


def match_documents(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with ``n_words``, ``hits`` (spans of hit words, first and end) and ``items`` (ids whose windows occur, as sorted strings).

    Existing columns of these names are replaced.
    """
    spark = df.sparkSession
    base = [c for c in df.columns if c not in ("n_words", "hits", "items")]
    cols = [f"__bl_{i}" for i in range(len(base))]
    out = df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(base, cols)])
    where = base.index(text)
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<struct<a:int,b:int>>"), "items": F.array().cast("array<string>")})
    schema = out.schema
    for ids, texts in _blocks(benchmark, item, item_text):
        block = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*block.value, window)
            spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            for part, part_texts in _shards(batches, cols[where]):
                words = Words(part_texts, ALNUM)
                first, hit, pairs = shard_hits(bench, words)
                hits, items = part.column(len(base) + 1).to_pylist(), part.column(len(base) + 2).to_pylist()
                names: dict[int, set] = {}
                for row, owner in zip(*pairs.tolist()):
                    names.setdefault(row, set()).add(bench.items[owner])
                for row, found in names.items():
                    flags = np.zeros(int(words.counts[row]) + 2, np.int8)
                    flags[1:-1] = hit[first[row] : first[row] + words.counts[row]]
                    for s in hits[row]:
                        flags[s["a"] + 1 : s["b"] + 1] = 1
                    edges = np.flatnonzero(np.diff(flags)).tolist()
                    hits[row] = [{"a": a, "b": b} for a, b in zip(edges[::2], edges[1::2])]
                    items[row] = sorted({*items[row], *found} - {None})
                columns = [part.column(i) for i in range(len(base))] + [pa.array(words.counts, pa.int64()), pa.array(hits, spans), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*cols, "n_words", "hits", "items"])

        out = out.mapInArrow(lean(run), schema)
    return out.select(*[F.col(x).alias(c) for c, x in zip(base, cols)], "n_words", "hits", "items")


def longest_matches(df: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For every benchmark suffix with a window: its item, first word, longest verbatim match over all shards, and where (document, word).

    Of equal matches, a shard names the neighbour in its suffix order; between shards the smallest document id, then word, wins. Suffixes without a match of the shortest window are left out.
    """
    spark = df.sparkSession
    kind = df.schema[doc].dataType.simpleString()
    found = None
    for ids, texts in _blocks(benchmark, item, item_text):
        block = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*block.value, window)
            begin = np.concatenate(([True], bench.owner[1:] != bench.owner[:-1])) if len(bench.owner) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(begin, bench.starts, 0)) if len(begin) else bench.starts
            for part, part_texts in _shards(batches, "__bl_text"):
                words = Words(part_texts, ALNUM)
                keep, length, at = ShardIndex(bench, words).longest(bench)
                base = words.first + np.arange(len(words.first))
                row = np.searchsorted(base, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bench.items[i] for i in bench.owner[keep]], pa.string()), pa.array(bench.starts[keep] - first[keep]), pa.array(length), part.column(0).take(pa.array(row)), pa.array(at - base[row])],
                    names=["item", "item_word", "match_words", "doc", "doc_word"],
                )

        part = df.select(F.col(doc).alias("__bl_doc"), F.col(text).alias("__bl_text")).mapInArrow(lean(run), f"item string, item_word long, match_words long, doc {kind}, doc_word long")
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("match_words", "doc", "doc_word"), F.struct(F.col("match_words"), -F.col("doc"), -F.col("doc_word"))).alias("m")
    return found.groupBy("item", "item_word").agg(best).select("item", "item_word", "m.match_words", F.col("m.doc").alias(doc), F.col("m.doc_word").alias("doc_word"))


def op10_suffix_array_matches(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_documents(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "hits", "items")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["b"] - s["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a benchmark window go."""
    hidden = [f"__bl_s{i}" for i in range(len(docs.columns))]  # columns named as the operator's results stay as they are
    rows = docs.select(F.col("text").alias("__bl_text"), *[F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, hidden)])
    found = match_documents(rows, read_table(spark, sf_dir, "benchmark"), "__bl_text")
    return found.where(F.size("hits") == 0).select(*[F.col(h).alias(c) for c, h in zip(docs.columns, hidden)])


ORACLE = """
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
       FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (SELECT rid, i, n, list_slice(w, i, i + n - 1) AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
m AS (SELECT DISTINCT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
k AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
