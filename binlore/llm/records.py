"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

Record: length (8 bytes), masked CRC-32C of the length (4), payload, masked CRC-32C of the payload (4); all little-endian,
so that readers of the public record format take the files. Masking rotates the checksum right by 15 bits and adds a constant, so
that checksums of data that hold checksums stay sound. Payload: the ids as unsigned integers of ``width`` bytes. Index file
``<data file>.idx``: one entry per record, its byte offset (8 bytes, unsigned) and its document id (8 bytes, signed), so that
records can be read in any order.

Files hold ascending document ids: file i before file i + 1; equal ids are ordered, and spread over files, by their text's CRC-32.
A retried task replaces its own file by a rename. Executors reach the files by Arrow's file systems (``store``).

Nulls: a null text is empty; a null document id sorts first and comes back as null. Ids are whole numbers above -2**63; other types
raise an error. Texts are encoded whole; a long one has one long record. Repeated rows are separate records. Only the id and text columns
are read, so that clashing names do no harm. An empty table gives no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import fresh_path, read_table
from .crc32c import crc32c
from .encode import ENCODE_BYTES, drop_shared, shared_encoder, tokenizer_path
from .textbatch import chunked, lean

#: Fixed value of the checksum mask in the public record format.
MASK_DELTA = 0xA282EAD8
NULL_ID = -(1 << 63)
INDEX = np.dtype([("at", "<u8"), ("doc", "<i8")])
#: Bytes of a file that are read at once; a longer record goes alone.
READ_BYTES = 2 << 20
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def masked(crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.uint64)
    return ((c >> np.uint64(15) | c << np.uint64(17)) + np.uint64(MASK_DELTA)).astype(np.uint32)


def _size_sums(sizes: np.ndarray) -> np.ndarray:
    return masked(crc32c(sizes.astype("<u8").view(np.uint8), np.arange(len(sizes)) * 8, np.full(len(sizes), 8)))


def frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Records of the parts of ``data`` (uint8)."""
    heads, sums, view = _size_sums(sizes).tolist(), masked(crc32c(data, starts, sizes)).tolist(), memoryview(data)
    return [b"".join((struct.pack("<QI", n, h), view[a : a + n], struct.pack("<I", c))) for a, n, h, c in zip(starts.tolist(), sizes.tolist(), heads, sums)]


def unframe(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the payloads of the records of ``data`` (uint8) at ``at``; raises ValueError if a checksum doesn't hold."""
    take = lambda first, n, kind: data[(first[:, None] + np.arange(n)).ravel()].view(kind)
    if len(at) and at[-1] + 16 > len(data):
        raise ValueError("a record is cut off")
    sizes = take(at, 8, "<u8")
    if (take(at + 8, 4, "<u4") != _size_sums(sizes)).any():
        raise ValueError("a length's checksum does not hold")
    sizes = sizes.astype(np.int64)
    if (at + 16 + sizes > len(data)).any():
        raise ValueError("a record is cut off")
    if (take(at + 12 + sizes, 4, "<u4") != masked(crc32c(data, at + 12, sizes))).any():
        raise ValueError("a payload's checksum does not hold")
    return at + 12, sizes


# URI schemes of Hadoop's connectors and those by which Arrow knows the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(uri: str) -> str:
    """The URI or path by which Arrow knows a folder that Spark names."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        return uri
    return "/dbfs/" + rest.lstrip("/") if scheme == "dbfs" else f"{SCHEMES.get(scheme, scheme)}:{rest}"


def store(uri: str):
    """(file system, path) of a folder that executors reach without Spark: a bare path, ``dbfs:/`` by its mount, or a store that Arrow knows."""
    from pyarrow import fs

    uri = arrow_uri(uri)
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


#: Bytes of the input that a file takes, by the plan's estimate, where Spark's default number of partitions does not do.
FILE_BYTES = 128 << 20


def _files(df: DataFrame) -> int | None:
    """Files beyond the session's shuffle partitions that a large input needs; None: the session's, which adapt."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if (n := -(-size // FILE_BYTES)) > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) and size < 1 << 60 else None


def write_records(df: DataFrame, folder: str, doc: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Encode all texts and write them as record files in ascending document order. Returns (file, records, tokens) rows.

    ``width`` is 2 where every id fits 16 bits, else 4. The range partitioning spreads documents over the files. Tasks that follow each
    other in a worker share its encoder.
    """
    path = path or tokenizer_path(TOKENIZER)
    kind, job = np.dtype(f"<u{width}"), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = store(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, tag = f"part-{task.partitionId():06d}.rec", f".{task.taskAttemptId()}"
        encoder, at, tokens, entries = None, 0, 0, 0
        data = index = None
        for batch in batches:
            for part, texts in chunked(batch, "__bl_text", ENCODE_BYTES):
                if encoder is None:
                    encoder = shared_encoder(job, path)
                    data, index = files.open_output_stream(f"{root}/{name}{tag}"), files.open_output_stream(f"{root}/{name}.idx{tag}")
                ids, bounds = encoder.encode(texts, end_id)
                if len(ids) and ids.max() >> 8 * width:
                    raise ValueError("an id needs more bytes than the records have")
                sizes = np.diff(bounds).astype(np.int64) * width
                data.write(b"".join(frames(ids.astype(kind).view(np.uint8), bounds[:-1].astype(np.int64) * width, sizes)))
                rows = np.zeros(len(sizes), INDEX)
                rows["at"], rows["doc"] = at + np.cumsum(sizes + 16) - (sizes + 16), part.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy()
                index.write(rows.tobytes())
                at += int((sizes + 16).sum())
                entries += len(rows)
                tokens += len(ids)
        if data is not None:
            data.close()
            index.close()
            for end in (".idx", ""):
                files.move(f"{root}/{name}{end}{tag}", f"{root}/{name}{end}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [entries], "tokens": [tokens]})

    if not isinstance(df.schema[doc].dataType, IntegralType):
        raise TypeError("document ids must be whole numbers")
    rows = df.select(F.col(doc).alias("__bl_doc"), F.col(text).alias("__bl_text"))
    order = [F.col("__bl_doc"), F.crc32(F.col("__bl_text").cast("binary"))]
    n = _files(rows)
    ordered = rows.repartitionByRange(*([n] if n else []), *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(lean(run, each=False), "file string, records long, tokens long")


def read_records(files: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """Per record of ``files`` (file, first): doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers).

    ``first``: ids in the files before. Every record is found by the index and checked.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_shared()
        for batch in batches:
            for name, first in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                fs, root = store(folder)
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                start = first
                with fs.open_input_file(f"{root}/{name}") as f:
                    total = f.size()
                    ends = np.append(index["at"][1:], total).astype(np.int64)
                    lo = 0
                    while lo < len(index):  # a bounded span of the file at a time
                        base = int(index["at"][lo])
                        hi = max(lo + 1, int(np.searchsorted(ends, base + READ_BYTES, "right")))
                        f.seek(base)
                        data = np.frombuffer(f.read(int(ends[hi - 1]) - base), np.uint8)
                        at, sizes = unframe(data, index["at"][lo:hi].astype(np.int64) - base)
                        sums = [zlib.crc32(data[a : a + n].view(kind).astype("<u4")) for a, n in zip(at.tolist(), sizes.tolist())]
                        tokens = sizes // width
                        docs = pa.array(index["doc"][lo:hi], mask=index["doc"][lo:hi] == NULL_ID)
                        yield pa.RecordBatch.from_arrays([docs, pa.array(start + np.cumsum(tokens) - tokens), pa.array(tokens), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(tokens.sum())
                        lo = hi

    return files.select("file", "first").mapInArrow(lean(run, each=False), "doc_id long, start long, n_tokens long, ids_crc32 long")


def file_starts(written: DataFrame) -> DataFrame:
    """(file, first): the ids before each file. One row per file, so the driver gathers file counts only."""
    spark = written.sparkSession
    rows = sorted((r["file"], r["tokens"]) for r in written.collect())
    out, first = [], 0
    for name, tokens in rows:
        out.append((name, first))
        first += tokens
    return spark.createDataFrame(out, "file string, first long").repartition(max(1, len(out)))


def op7_record_files(spark, sf_dir):
    folder = fresh_path(spark, "records")
    written = write_records(read_table(spark, sf_dir, "documents"), folder)
    return read_records(file_starts(written), folder)
