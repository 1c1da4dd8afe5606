"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

At each node every child draws ``-ln(u) / weight`` with ``u`` from a hash of (seed, node, child, key); the
smallest draw wins, so a child gets its share of weight. A draw depends on nothing but its own node, child and
key: changing weights inside a subtree moves only rows into or out of that subtree (``assign_node``).

Numbered shards (``assign_shard``) stand in a tree that grows by whole subtrees: link 0 holds ``REGION`` slots, and each
further link as many as all before it, in regions of two racks of four. A row draws between a link and the tree before
it, by the link's slots and the weight before it; inside the link it descends region, rack and slot, whose weights never
change. A slot takes the row with a probability of its shard's weight; if it does not, or has no shard yet, the row draws anew.
So a shard that is added takes rows only into itself, for any number of shards, and a shard's weight changes move rows
only into or out of its link. After ``ATTEMPTS`` draws (more than one row in 10**12 past link 0) the tree before the link has the row,
in link 0 one weighted draw over its shards. Draws grow with the links, which are logarithmic in the shards.

DataFrame functions only. Nulls: a null key is a key of its own, which goes to one shard; a null text has size 1 and checksum 0.
Whole texts count, however long. Repeated rows go to the same shard and get different slots; rows that tie in all of key, size
and checksum are alike. Existing columns named ``shard``, ``grown_shard`` or ``slot`` are replaced, others stay. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, read_table

SEED = "bl1"
#: Slots of a rack, racks of a region, slots of a region.
PER_RACK, RACKS = 4, 2
REGION = PER_RACK * RACKS
ATTEMPTS = 40


@dataclass(frozen=True)
class Node:
    """A tree node: leaves have a shard number, inner nodes children; an inner weight defaults to its leaves' sum."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float | None = None

    @property
    def weight(self) -> float:
        return self.own_weight if self.own_weight is not None else float(sum(c.weight for c in self.children))


def _bits(*parts) -> Column:
    """48 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("bigint")


def _unit(bits: Column) -> Column:
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _pick(children: Column, *key) -> Column:
    """Index of the child (struct id, name, w) with the smallest draw; ties go to the smaller id."""
    drawn = lambda c: F.struct((-F.log(_unit(_bits(*key, c["name"]))) / c["w"]).alias("draw"), c["id"].alias("id"))
    return F.array_min(F.transform(children, drawn))["id"]


def _children(names: Sequence[str], weights: Sequence[float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(float(w)).alias("w")) for i, (n, w) in enumerate(zip(names, weights))])


def assign_node(key: Column, tree: Node, seed: str = SEED) -> Column:
    """Shard of ``key`` in a given tree of regions, racks and shards; a weight of 0 takes nothing."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    live = lambda nodes: [n for n in nodes if n.weight > 0]
    regions = live(tree.children)
    racks = [k for r in regions for k in live(r.children)]
    first_rack = [sum(len(live(r.children)) for r in regions[:i]) for i in range(len(regions))]
    made = lambda nodes: _children([n.name for n in nodes], [n.weight for n in nodes])
    racks_of = F.array(*[made(live(r.children)) for r in regions])
    leaves_of = F.array(*[made(live(k.children)) for k in racks])
    shard_of = F.array(*[F.array(*[F.lit(s.shard) for s in live(k.children)]) for k in racks])
    return _let(
        _pick(made(regions), F.lit(seed), key),
        lambda r: _let(
            F.array(*[F.lit(x) for x in first_rack])[r] + _pick(racks_of[r], F.lit(seed), key),
            lambda k: shard_of[k][_pick(leaves_of[k], F.lit(seed), key)],
        ),
    )


def links_of(shards: int) -> list[tuple[int, int]]:
    """(first slot, slots) of the links that hold ``shards`` shards."""
    out = [(0, REGION)]
    while sum(out[-1]) < shards:
        out.append((sum(out[-1]), sum(out[-1])))
    return out


def assign_shard(key: Column, shards: int | Sequence[float], seed: str = SEED) -> Column:
    """Shard of ``key`` among ``shards`` of equal weight, or of the given weights (above 0, at most 1)."""
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not weights or not all(0 < w <= 1 for w in weights):
        raise ValueError("one shard at least, with weights above 0 and at most 1")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    racks, slots = _children([f"k{i}" for i in range(RACKS)], [PER_RACK] * RACKS), _children([f"s{i}" for i in range(PER_RACK)], [1] * PER_RACK)
    undecided, lower = F.lit(-2), F.lit(-1)
    result = None
    for first, size in links_of(len(weights)):
        own, before = weights[first : first + size], sum(weights[:first])
        regions = _children([f"r{i}" for i in range(size // REGION)], [REGION] * (size // REGION))
        name = F.lit(f"{seed}|{first}")
        takes = F.array(*[F.lit(w) for w in own])

        def draw(a: Column) -> Column:
            at = (name, a.cast("string"), key)
            slot = F.lit(0) if size == REGION else _pick(regions, *at)
            slot = _let(slot * RACKS + _pick(racks, *at), lambda k: k * PER_RACK + _pick(slots, *at, k.cast("string")))
            fits = lambda s: s < len(own) if min(own) == 1 else (s < len(own)) & (_unit(_bits(*at, F.lit("take"))) < F.get(takes, s))
            found = _let(slot, lambda s: F.when(fits(s), s + first).otherwise(undecided))
            return F.when(_unit(_bits(*at, F.lit("link"))) * (size + before) < before, lower).otherwise(found) if first else found

        spent = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), undecided, lambda got, a: F.when(got != undecided, got).otherwise(draw(a)))
        if first:
            earlier = result
            result = _let(spent, lambda s: F.when(s >= 0, s).otherwise(earlier))
        else:
            last = _pick(_children([f"s{i}" for i in range(len(own))], own), name, key)
            result = _let(spent, lambda s: F.when(s >= 0, s).otherwise(last))
    return result


def shard(df: DataFrame, key: str, shards, grown=None, seed: str = SEED) -> DataFrame:
    """``df`` with ``shard`` and, if ``grown`` is given, ``grown_shard``: numbers of shards, weights, or trees of nodes."""
    place = lambda s: assign_node(F.col(key), s, seed) if isinstance(s, Node) else assign_shard(F.col(key), s, seed)
    return df.withColumn("shard", place(shards)).withColumn("grown_shard", place(grown) if grown is not None else F.lit(None).cast("int"))


def with_slots(df: DataFrame, key: str) -> DataFrame:
    """Gapless slot of each row in its shard, from 0, in the order of a hash of key, size and checksum; no task sorts a whole shard."""
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("null")), "size", "text_crc32"))
    marked = df.drop("slot").withColumn("__bl_mark", mark)
    bucket = F.conv(F.substring("__bl_mark", 1, 3), 16, 10).cast("int")
    return gapless_rank(marked, ["shard"], ["__bl_mark"], "slot", bucket).drop("__bl_mark")


SHARDS = 16


def op8_hash_tree_shards(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"))
    placed = shard(sized, "doc_id", SHARDS, SHARDS + 1)
    return with_slots(placed, "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def oracle(shards: int = SHARDS) -> str:
    """The query in SQL: every attempt of every link is drawn, and the first that decides counts."""
    bits = lambda text: f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"

    def pick(n: int, head: str, letter: str) -> str:
        drawn = f"list_transform(range({n}), lambda j: {bits(f'{head} || {chr(39)}|{letter}{chr(39)} || j')})"
        return f"list_position({drawn}, list_max({drawn})) - 1"

    steps, shown = [], {}
    for n in (shards, shards + 1):
        shown[n] = "NULL"
        for k, (first, size) in enumerate(links_of(n)):
            name, own = f"l{n}_{k}", min(size, n - first)
            at = f"'{SEED}|{first}|' || a || '|' || k"
            lower = f"({bits(f'{at} || {chr(39)}|link{chr(39)}')} + 0.5) / {float(1 << 48)} * {size + first}.0 < {first}.0" if first else "false"
            region = pick(size // REGION, at, "r") if size > REGION else "0"
            steps.append(f"""{name}_a AS (SELECT k, a, {lower} AS low, ({region}) * {RACKS} + {pick(RACKS, at, 'k')} AS rack FROM keys, range({ATTEMPTS}) t(a)),
{name}_b AS (SELECT k, a, low, rack * {PER_RACK} + {pick(PER_RACK, f"{at} || '|' || rack", 's')} AS slot FROM {name}_a),
{name} AS (SELECT k, arg_min(CASE WHEN low THEN -1 ELSE slot + {first} END, a) AS s FROM {name}_b WHERE low OR slot < {own} GROUP BY k)""")
            last = pick(own, f"'{SEED}|{first}|' || keys.k", "s")
            here = f"(SELECT s FROM {name} x WHERE x.k = keys.k)"
            shown[n] = f"CASE WHEN {here} >= 0 THEN {here} ELSE {shown[n]} END" if first else f"coalesce({here}, {last})"
    return f"""
WITH RECURSIVE bit AS (SELECT i AS b, CAST(i AS BIGINT) AS v, 0 AS n FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM bit WHERE n < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM bit WHERE n = 8),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, strlen(coalesce(text, '')) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, k, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
keys AS MATERIALIZED (SELECT DISTINCT k FROM d), {", ".join(steps)},
p AS (SELECT k, {shown[shards]} AS shard, {shown[shards + 1]} AS grown_shard FROM keys)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k || '|' || size || '|' || text_crc32)) - 1 AS slot, grown_shard FROM c JOIN p USING (k)
"""


ORACLE = oracle()
