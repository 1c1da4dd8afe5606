"""Packing by minimum bin slack: documents' token sequences fill windows of a fixed length.

Documents are cut at multiples of the window; whole windows stand alone. The remainders are packed from their
length histogram, whose size is bounded by the window whatever the corpus: a bitset subset-sum over the remaining
lengths (with multiplicities) finds the fill closest to capacity around the longest one left, backtracking gives how
many of each length it takes, and the pattern is applied as often as the counts allow. Pieces of a length are
numbered without gaps and matched to the patterns' slots.

Nulls: a null text is empty and gives one piece with the end id alone. Repeated rows are separate documents.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, local_table, read_table, staged
from .encode import ENCODE_BYTES, PieceEncoder, tokenizer_path
from .textbatch import chunked, lean

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths, with how many of each, whose sum is as close below or at ``capacity`` as the counts allow.

    Bit i of a stage's bitset: sum i can be reached. Each length enters in chunks 1, 2, 4, ... of its count.
    """
    stages: list[tuple[int, int, int]] = []  # length, copies, reach before the chunk
    reach, full, mask = 1, 1 << capacity, (1 << capacity + 1) - 1
    for length in sorted((k for k in counts if k <= capacity), reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left > 0 and not reach & full:
            chunk = min(chunk, left)
            stages.append((length, chunk, reach))
            reach |= reach << length * chunk & mask
            left -= chunk
            chunk *= 2
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, copies, before in reversed(stages):
        if not before >> at & 1:
            at -= length * copies
            taken[length] = taken.get(length, 0) + copies
    return taken


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) of each pattern, until every piece has a place. Lengths are 1 to ``window``."""
    left, patterns = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        pattern = {longest: 1}
        rest = dict(left)
        rest[longest] -= 1
        for length, copies in best_fill({k: v for k, v in rest.items() if v}, window - longest).items():
            pattern[length] = pattern.get(length, 0) + copies
        times = min(left[k] // c for k, c in pattern.items())
        patterns.append((times, pattern))
        for k, c in pattern.items():
            left[k] -= times * c
            if not left[k]:
                del left[k]
    return patterns


def plan_table(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Slots by length and rank: (length, first rank, end rank, copies in a sequence, first sequence, offset of the first copy)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        at = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            first = used.get(length, 0)
            used[length] = first + times * copies
            rows.append((length, first, used[length], copies, sequence, at))
            at += length * copies
        sequence += times
    return rows


def encoded_pieces(df: DataFrame, doc: str, text: str, path: str, end_id: int, window: int, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``window`` ids: document, start, length, checksum, the document's ids, and the ids if asked for."""
    kind = df.schema[doc].dataType.simpleString()
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path)
        for batch in batches:
            for part, texts in chunked(batch, "__bl_text", ENCODE_BYTES):
                ids, bounds = encoder.encode(texts, end_id)
                sizes = np.diff(bounds)
                pieces = -(-sizes // window)
                row = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, sizes[row] - start)
                begin = bounds[row] + start
                view = memoryview(ids.view(np.uint8))
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())), np.int64, len(row))
                columns = [part.column(0).take(pa.array(row)), start, length, crc, sizes[row]]
                if with_ids:
                    columns.append([ids[a : a + n].astype(np.int32) for a, n in zip(begin, length)])
                names = ["__bl_doc", *(n for n, _ in fields), *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    schema = f"__bl_doc {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return df.select(F.col(doc).alias("__bl_doc"), F.col(text).alias("__bl_text")).mapInArrow(lean(run, each=False), schema)


def pack(pieces: DataFrame, window: int, order: list[str]) -> DataFrame:
    """``pieces`` (a staged table with ``length``) with ``sequence_id`` and ``offset``.

    Only the histogram of lengths, at most ``window`` rows, reaches the driver; the plan that goes back is of its size.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_table(plan_windows(counts, window))
    slots = F.broadcast(local_table(spark, plan, ["__bl_len", "__bl_first", "__bl_end", "__bl_copies", "__bl_seq", "__bl_at"]))
    ranked = gapless_rank(pieces, ["length"], order, "__bl_rank")
    placed = ranked.join(slots, (F.col("length") == F.col("__bl_len")) & (F.col("__bl_rank") >= F.col("__bl_first")) & (F.col("__bl_rank") < F.col("__bl_end")))
    k = F.col("__bl_rank") - F.col("__bl_first")
    placed = placed.withColumn("sequence_id", F.col("__bl_seq") + F.floor((k - k % F.col("__bl_copies")) / F.col("__bl_copies")))
    placed = placed.withColumn("offset", F.col("__bl_at") + (k % F.col("__bl_copies")) * F.col("length"))
    return placed.drop("__bl_len", "__bl_first", "__bl_end", "__bl_copies", "__bl_seq", "__bl_at", "__bl_rank")


def pack_documents(df: DataFrame, doc: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places. ``with_ids`` adds each piece's token ids."""
    pieces = staged(encoded_pieces(df, doc, text, path or tokenizer_path(TOKENIZER), end_id, window, with_ids), "pieces")
    return pack(pieces, window, ["__bl_doc", "start", "ids_crc32"]).withColumnRenamed("__bl_doc", doc)


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op5_minimum_slack_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents")).select(*PIECE)


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents."""
    return pack_documents(docs).select(*PIECE)
