"""N-gram Jaccard join: size-banded tiles, hashed bitmaps whose bit counts bound the overlap, exact intersections.

Every link between different texts is found:

1. A pass over the texts gives each text's shingle set, its size and a 64-bit name of the set (equal sets are one class
   from here on), and the shingles that repeat inside a task, whose summed counts name the frequent ones.
2. Sets that are similar enough share a shingle among the rarest few of each (prefix filter, exact for any common order).
   Frequent shingles come last in the order, so passages shared by many texts bring few together. Only shingles that two
   classes have in their prefixes go on.
3. A short posting gives its pairs of compatible sizes; bitmaps as wide as the sets bound the overlap from above
   (a bit in one bitmap alone is an element in one set alone) and the sorted sets of the pairs left are intersected.
4. A long posting is cut, ordered by size, into bands of bounded weight; each pair of bands of compatible sizes is a
   tile. A tile holds its sets, bounds overlaps by bitmaps, and intersects the pairs not yet joined inside it, so that it
   emits a spanning forest of its links and never all pairs.
5. Links go through distributed union-find.

Shingles are compared by 64-bit hashes inside pairs of texts, classes by 128-bit hashes of their sets: a class is named by the one half,
and classes whose names collide (the other halves tell) get other names in a second run. A text with fewer words than a
shingle, but not none, is one shingle; a text without words (null too) links with nothing. Whole texts count, however long.
A null id takes part as any other; a component of null ids alone has a null component id. Repeated rows are equal sets; ties
go to the smaller id. Only the id and text columns are read, so that clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, read_table, staged, unstage
from .components import UnionFind, connected_components
from .textbatch import NON_SPACE, Words, chunked, lean, shingles

WORDS = 4
#: Similarity as a fraction: links have DEN * intersection >= NUM * union.
NUM, DEN = 85, 100
#: Entries of the table of frequent shingles. It orders shingles and nothing else: any order gives the same links.
FREQUENT_ROWS = 500_000
FREQUENT_COUNT = 16
#: Shingles a task counts at once before it drops those seen once.
COUNTED = 1_500_000
#: Postings up to this many classes give pairs; longer ones tiles.
SHORT = 32
#: Rows of postings that are handled at once; a longer part of a posting goes alone.
POSTING_BUFFER = 1 << 16
#: Most classes and most shingles in a band of a tile.
BAND_ROWS, BAND_SHINGLES = 512, 2_000_000
#: Classes to fetch whose names and first documents may be broadcast (16 bytes each).
BROADCAST_NAMES = 2_000_000


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-num * n // den) + 1


def bitmap(hashes: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(hashes >> np.uint64(17)).astype(np.int64) & (width - 1)] = True
    return np.packbits(bits, bitorder="little")


def bitmap_width(n: int) -> int:
    return 1 << max(6, min(20, int(n - 1).bit_length() if n > 1 else 1))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes with the bits of a wider one."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """No intersection is larger: elements behind bits that only one side has are in one set only."""
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def similar(i, na, nb, num: int, den: int):
    return (den * i >= num * (na + nb - i)) & (i > 0)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


class _Sets:
    """Distinct sets of a task's texts, each once: (row in part, name, sorted hashes)."""

    def __init__(self, size: int, renamed: dict[int, int] | None = None):
        self.size, self.seen, self.check, self.renamed = size, set(), 0, renamed or {}

    def of(self, texts: pa.LargeBinaryArray) -> Iterator[tuple[int, int, np.ndarray, bool]]:
        grams, bounds = shingles(Words(texts, NON_SPACE), self.size)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            s = grams[a:b]
            name, self.check = set_names(s) if b > a else (0, 0)
            if self.renamed and self.renamed.get(name, self.check) != self.check:
                name = self.check
            fresh = b > a and name not in self.seen
            if fresh:
                self.seen.add(name)
            yield i, name, s, fresh


def set_names(s) -> tuple[int, int]:
    """The halves of a set's 128-bit hash, signed: its name, and the check that tells sets of one name apart."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(s))


def collided(names: DataFrame) -> dict[int, int]:
    """From (name, low, high: least and greatest check): the checks that keep their names, where names collide.

    Of n different sets about n**2 / 2**65 collide, so these are few at any size.
    """
    return {r["name"]: r["low"] for r in names.where("low <> high").select("name", "low").collect()}


class _Counter:
    """Counts of hashes in bounded memory: when full, hashes seen once are dropped."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.held += len(hashes)
        if self.held >= COUNTED:
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *self.waiting])
        counts = np.concatenate([self.counts, np.ones(self.held, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.waiting, self.held = [], 0
        if len(self.keys) > COUNTED:
            keep = self.counts > 1
            self.keys, self.counts = self.keys[keep], self.counts[keep]

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        keep = self.counts > 1
        return self.keys[keep], self.counts[keep]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _classes(df: DataFrame, size: int, kind: str, renamed: dict) -> DataFrame:
    """Rows (doc, n, name, check, bits: once for each name in a task) of all texts, and rows (name: shingle, n: its count in a task, frequent: true)."""
    names_of = ["doc", "n", "name", "check", "frequent", "bits"]

    def run(batches):
        sets, counter, doc_type = _Sets(size, renamed), _Counter(), None
        for batch in batches:
            for part, texts in chunked(batch, "__bl_text"):
                n, names, checks, bits = [], [], [], []
                for _, name, s, fresh in sets.of(texts):
                    n.append(len(s))
                    names.append(name)
                    checks.append(sets.check)
                    bits.append(bitmap(s, bitmap_width(len(s))).tobytes() if fresh else None)
                    if fresh:
                        counter.add(s)
                doc_type = part.column(0).type
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(checks, pa.int64()), pa.array([False] * len(n), pa.bool_()), pa.array(bits, pa.binary())], names=names_of)
        if doc_type is not None:
            keys, counts = counter.repeated()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), doc_type), pa.array(counts), pa.array(_signed(keys)), pa.nulls(len(keys), pa.int64()), pa.array([True] * len(keys), pa.bool_()), pa.nulls(len(keys), pa.binary())], names=names_of)

    return df.mapInArrow(lean(run), f"doc {kind}, n long, name long, check long, frequent boolean, bits binary")


def _frequent(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (ascending hashes) and levels, FREQUENT_ROWS at most."""
    top = classes.where("frequent").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_COUNT)
    rows = top.orderBy(F.desc("n"), "name").limit(FREQUENT_ROWS).toArrow()
    keys = rows["name"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.log2(rows["n"].to_numpy()[order]).astype(np.int64)


def _postings(df: DataFrame, size: int, num: int, den: int, frequent, renamed: dict) -> DataFrame:
    """(shingle, part, guest, n, name) for the prefix of every distinct set.

    The postings of frequent shingles come in parts by size, each less than a link's ratio wide: a set is in its own part, and as a
    guest in the next, so that sets of compatible sizes meet in the larger one's part.
    """
    schema = pa.schema([("shingle", pa.int64()), ("part", pa.int32()), ("guest", pa.bool_()), ("n", pa.int32()), ("name", pa.int64())])

    def run(batches):
        sets = _Sets(size, renamed)
        keys, levels = frequent.value
        for batch in batches:
            for _, texts in chunked(batch, "__bl_text"):
                out, names, sizes, often = [], [], [], []
                for _, name, s, fresh in sets.of(texts):
                    if not fresh:
                        continue
                    p = int(prefix_length(np.int64(len(s)), num, den))
                    level = np.zeros(p, np.int64)
                    if len(keys):
                        at = np.searchsorted(keys, s)
                        at[at == len(keys)] = 0
                        level = np.where(keys[at] == s, levels[at], 0)
                        if level.any():
                            order = np.argsort(level, kind="stable")
                            s, level = s[order], level[order]
                    out.append(s[:p])
                    often.append(level[:p] > 0)
                    names.append(name)
                    sizes.append(len(s))
                lengths = [len(x) for x in out]
                if out:
                    shingle, often, name, n = _signed(np.concatenate(out)), np.concatenate(often), np.repeat(names, lengths), np.repeat(np.array(sizes, np.int32), lengths)
                    part = np.where(often, size_part(n, num, den), 0).astype(np.int32)
                    yield _batch(schema, pa.array(shingle), pa.array(part), pa.array(np.zeros(len(n), bool)), pa.array(n), pa.array(name))
                    if often.any():
                        yield _batch(schema, pa.array(shingle[often]), pa.array(part[often] + np.int32(1)), pa.array(np.ones(int(often.sum()), bool)), pa.array(n[often]), pa.array(name[often]))

    return df.select("__bl_text").mapInArrow(lean(run), "shingle long, part int, guest boolean, n int, name long")


def size_part(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Number, from 1, of the range of sizes that ``n`` is in; compatible sizes lie in the same range or in neighbours."""
    # a range's ends differ by more than the ratio, whatever the logarithm's last digits
    return 1 + np.floor(np.log(n) / (np.log(den / num) * 1.001)).astype(np.int64)


def _bands(sizes: np.ndarray) -> np.ndarray:
    """Bounds of bands of ascending sizes: BAND_ROWS rows and BAND_SHINGLES shingles at most, one row at least."""
    total = np.cumsum(sizes)
    bounds = [0]
    while bounds[-1] < len(sizes):
        a = bounds[-1]
        before = total[a - 1] if a else 0
        b = int(np.searchsorted(total, before + BAND_SHINGLES, "right"))
        bounds.append(min(max(a + 1, b), a + BAND_ROWS, len(sizes)))
    return np.array(bounds)


def _candidates(postings: DataFrame, num: int, den: int) -> DataFrame:
    """From postings sorted by shingle, part and size: pairs (tile null) and members of tiles (tile, side, a)."""
    schema = pa.schema([("tile", pa.int64()), ("side", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])

    def short(shingle, name, n, starts, counts):
        """Pairs of all short postings at once, by the distance inside a posting."""
        left, right = [], []
        end = np.repeat(starts + counts, counts)
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        for d in range(1, int(counts.max(initial=1))):
            ok = at + d < end
            at, end = at[ok], end[ok]
            if not len(at):
                break
            fit = (den * n[at].astype(np.int64) >= num * n[at + d].astype(np.int64)) & (name[at] != name[at + d])
            left.append(name[at[fit]])
            right.append(name[at[fit] + d])
        if not left:
            return np.zeros((2, 0), np.int64)
        pair = np.stack([np.concatenate(left), np.concatenate(right)])
        pair.sort(axis=0)
        return np.unique(pair, axis=1)

    def tiles(shingle, part, guest, n, name):
        bounds = _bands(n.astype(np.int64))
        for i in range(len(bounds) - 1):
            for j in range(i, len(bounds) - 1):
                if den * int(n[bounds[i + 1] - 1]) < num * int(n[bounds[j]]):
                    break
                if guest[bounds[i] : bounds[i + 1]].all() and guest[bounds[j] : bounds[j + 1]].all():
                    continue  # these meet in their own part
                tile = xxhash.xxh3_64_intdigest(f"{shingle}|{part}|{i}|{j}") - (1 << 63)
                for side, k in ((0, i), (1, j)) if i != j else ((0, i),):
                    m = int(bounds[k + 1] - bounds[k])
                    yield _batch(schema, [tile] * m, [side] * m, pa.array(name[bounds[k] : bounds[k + 1]]), pa.nulls(m, pa.int64()))

    def run(batches):
        held, rows, limit = [], 0, POSTING_BUFFER
        for batch in _with_end(batches):
            if batch is not None:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
                rows += batch.num_rows
                if rows < limit:
                    continue
            if not rows:
                continue
            all_of = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(all_of[0], all_of[0][-1]))
            last += int(np.searchsorted(all_of[1][last:], all_of[1][-1]))
            cut = last if batch is not None else rows  # the last part of a posting may go on
            held, rows = [[x[cut:] for x in all_of]], rows - cut
            limit = max(POSTING_BUFFER, 2 * rows)
            if not cut:
                continue
            shingle, part, guest, n, name = (x[:cut] for x in all_of)
            once = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1]) | (name[1:] != name[:-1])))
            shingle, part, guest, n, name = (x[once] for x in (shingle, part, guest, n, name))
            starts = np.flatnonzero(np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1]))))
            counts = np.diff(np.append(starts, len(shingle)))
            some = (counts > 1) & (counts <= SHORT)
            pair = short(shingle, name, n, starts[some], counts[some])
            if pair.shape[1]:
                m = pair.shape[1]
                yield _batch(schema, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int8()), pa.array(np.ascontiguousarray(pair[0])), pa.array(np.ascontiguousarray(pair[1])))
            for a, c in zip(starts[counts > SHORT].tolist(), counts[counts > SHORT].tolist()):
                yield from tiles(int(shingle[a]), int(part[a]), *(x[a : a + c] for x in (guest, n, name)))

    dealt = postings.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n", "name")
    return dealt.mapInArrow(lean(run), "tile long, side byte, a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def _set_table(df: DataFrame, size: int, wanted: DataFrame, renamed: dict) -> DataFrame:
    """(name, n, hashes) of the classes in ``wanted`` (name, first), from each one's first document, staged.

    The wanted names are broadcast if there are few enough; beyond that all sets are made and joined with them.
    """
    schema = pa.schema([("name", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary())])
    few = None
    if wanted.count() <= BROADCAST_NAMES:
        rows = wanted.toArrow()
        names = rows["name"].to_numpy()
        order = np.argsort(names)
        few = df.sparkSession.sparkContext.broadcast((names[order], rows["first"].combine_chunks().take(pa.array(order))))

    def run(batches):
        sets, names, firsts = _Sets(size, renamed), *(few.value if few is not None else (None, None))
        for batch in batches:
            for part, texts in chunked(batch, "__bl_text"):
                out, docs = [], part.column(0)
                for i, name, s, fresh in sets.of(texts):
                    if not fresh and names is None or not len(s):
                        continue
                    if names is not None and ((at := int(np.searchsorted(names, name))) == len(names) or names[at] != name or firsts[at] != docs[i]):
                        continue
                    out.append((name, len(s), s.tobytes()))
                if out:
                    yield _batch(schema, *zip(*out))

    table = df.mapInArrow(lean(run), "name long, n int, hashes binary")
    if few is None:
        table = table.join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"])
    return staged(table, "sets")


def _pair_rows(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    side = lambda x: table.select(F.col("name").alias(x), F.col("n").alias(f"n{x}"), F.col(column).alias(f"{column}_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _passing(pairs: DataFrame, table: DataFrame, column: str, count, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that are similar by ``count`` of their rows' ``column``, an overlap or an upper bound of it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, na, nb, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "na", "nb", f"{column}_a", f"{column}_b"))
            keep = [k for k in range(len(a)) if similar(count(x[k], na[k], y[k], nb[k]), na[k], nb[k], num, den)]
            yield _batch(schema, [a[k] for k in keep], [b[k] for k in keep])

    return _pair_rows(pairs, table, column).mapInArrow(lean(run), "a long, b long")


def _bound(x: bytes, n: int, y: bytes, m: int) -> int:
    return overlap_bound(np.frombuffer(x, np.uint8), n, np.frombuffer(y, np.uint8), m)


def _exact(x: bytes, n: int, y: bytes, m: int) -> int:
    return intersection(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))


def tile_links(names: list[int], sides: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between a tile's bands (inside its band, if it has one).

    Bitmaps bound each row against all before it; pairs that may link and are not joined yet are intersected, best bound first.
    """
    order = sorted(range(len(names)), key=lambda k: (len(sets[k]), names[k]))
    names, sets, sides = [names[k] for k in order], [sets[k] for k in order], np.asarray(sides)[order]
    n = np.array([len(s) for s in sets], np.int64)
    width = bitmap_width(int(min(n.max(initial=1), 16384)))
    bits = np.stack([bitmap(s, width) for s in sets]).view(np.uint64)
    both = bool((sides == 1).any())
    root = np.arange(len(names))
    links = []
    for k in range(1, len(names)):
        low = int(np.searchsorted(n, -(-num * n[k] // den)))  # rows of compatible size
        rest = np.arange(low, k)
        if both:
            rest = rest[sides[rest] != sides[k]]
        rest = rest[root[rest] != root[k]]
        if not len(rest):
            continue
        only = np.bitwise_count(bits[rest] & ~bits[k]).sum(1, dtype=np.int64)
        mine = np.bitwise_count(bits[k] & ~bits[rest]).sum(1, dtype=np.int64)
        bound = np.minimum(n[rest] - only, n[k] - mine)
        may = similar(bound, n[rest], n[k], num, den)
        rest = rest[may][np.argsort(-bound[may], kind="stable")]
        step = 4
        while len(rest):
            for j in rest[:step].tolist():
                if root[j] != root[k] and similar(intersection(sets[j], sets[k]), n[j], n[k], num, den):
                    links.append((names[j], names[k]))
                    root[root == root[j]] = root[k]
            rest = rest[step:]
            rest = rest[root[rest] != root[k]]
            step *= 2
    return links


def _check_tiles(members: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        links = tile_links(group["a"].to_pylist(), group["side"].to_numpy(), sets, num, den)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    rows = members.join(table.select(F.col("name").alias("a"), "hashes"), "a")
    return rows.groupBy("tile").applyInArrow(run, "a long, b long")


#: Bytes of sets that tiles may bring into a shuffle at once, or as many as the table of sets has.
TILE_BYTES = 2_000_000_000


def _tile_rounds(members: DataFrame, table: DataFrame) -> int:
    """Rounds in which tiles are checked: each member brings its set, and a set may be in many tiles."""
    sizes = table.select(F.col("name").alias("a"), "n")
    held, total = (df.agg(F.sum("n")).first()[0] or 0 for df in (sizes, members.join(sizes, "a")))
    return max(1, -(-8 * total // max(TILE_BYTES, 8 * held)))


def _tile_links(members: DataFrame, table: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Staged links of all tiles, a table for each round; what a round shuffles is deleted before the next."""
    rounds = _tile_rounds(members, table)
    parts = [members if rounds == 1 else members.where(F.pmod(F.xxhash64("tile"), F.lit(rounds)) == k) for k in range(rounds)]
    return [staged(_check_tiles(part, table, num, den), "tile-links") for part in parts]


def similar_components(df: DataFrame, doc: str = "doc_id", text: str = "text", size: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of ``df``: ``doc``, ``n_shingles``, ``n_links`` (of its class's spanning forest), ``component_id``.

    ``component_id`` is the smallest ``doc`` that links reach.
    """
    spark = df.sparkSession
    kind = df.schema[doc].dataType.simpleString()
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("__bl_text"))
    renamed: dict[int, int] = {}
    while True:
        classes = staged(_classes(rows, size, kind, renamed), "classes")
        docs = classes.where("not frequent").select("doc", "n", "name")
        named = classes.where("not frequent and n > 0").groupBy("name")
        firsts = staged(named.agg(F.min("doc").alias("first"), F.count("*").alias("copies"), F.min("check").alias("low"), F.max("check").alias("high")), "firsts")
        if renamed or not (renamed := collided(firsts)):
            break
        unstage(classes, firsts)
    frequent = spark.sparkContext.broadcast(_frequent(classes))
    found = staged(_candidates(_postings(rows, size, num, den, frequent, renamed), num, den), "candidates")
    pairs = found.where("tile is null").select("a", "b").distinct()
    members = found.where("tile is not null").select("tile", "side", "a")
    bits = classes.where("bits is not null").select("name", "n", "bits").dropDuplicates(["name"])
    likely = staged(_passing(pairs, bits, "bits", _bound, num, den), "likely")
    both = likely.select(F.explode(F.array("a", "b")).alias("name")).unionByName(members.select(F.col("a").alias("name"))).distinct()
    wanted = staged(firsts.join(both, "name", "left_semi").select("name", "first"), "wanted")
    table = _set_table(rows, size, wanted, renamed)
    linked = [staged(_passing(likely, table, "hashes", _exact, num, den), "pair-links"), *_tile_links(members, table, num, den)]
    links = staged(reduce(DataFrame.unionByName, linked).distinct(), "links")
    labels = connected_components(links)
    unstage(found, likely, wanted, table, *linked)
    rooted = staged(firsts.join(labels, F.col("name") == F.col("node"), "left").select("name", "first", "copies", F.coalesce("root", "name").alias("root")), "rooted")
    parts = rooted.groupBy("root").agg(F.min("first").alias("component"), F.sum("copies").alias("rows"), F.count("*").alias("classes")).where(F.col("rows") > 1).drop("rows")
    # a component may hold any share of the classes, a class any share of the documents
    met = hot_join(rooted, parts, "root", "classes", rooted.count(), F.col("name")).where("component is not null")
    degree = links.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("links"))
    shared = met.join(degree, "name", "left").select("name", "component", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    shared = staged(shared, "components")
    unstage(firsts, rooted, links)
    out = hot_join(docs, shared, "name", "copies", docs.count(), F.struct("doc", "n"))
    return out.select(
        F.col("doc").alias(doc), F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component_id"),
    )


def op1_ngram_jaccard_components(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_components(docs).select("doc_id", "n_shingles", "component_id")


#: The pipeline's near duplicates: five words, a similarity of 0.8.
STAGE_WORDS, STAGE_NUM, STAGE_DEN = 5, 80, 100


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one with the smallest id. Documents with a null id stay."""
    found = similar_components(docs.select("doc_id", "text"), size=STAGE_WORDS, num=STAGE_NUM, den=STAGE_DEN)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__bl_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__bl_gone"), "left_anti").select(*docs.columns)
