"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents in ascending doc_id order. Ids are stored in blocks of BLOCK: the block's
minimum is subtracted, the differences are packed at the width that PERCENTILE of them need, and larger ones go to the
block's exception list. File layout (little-endian): magic; blocks; index of block starts (u64 each); documents (i64 id,
u8 whether the id is null, u32 ids each); footer (u64 ids, u32 blocks, u32 documents, u64 place of the index, crc32 of
index and documents, magic). Block: u32 minimum, u8 width, u16 exceptions, packed bits, u16 positions, u32 values.

Files are named by doc_id range, written under a temporary name and renamed, so a task that runs again leaves one whole file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.common import materialize, scratch_dir, tidy
from tickloom.llm.encoding import encoder

MAGIC = b"TLPFOR01"
BLOCK = 4096
PERCENTILE = 0.95
FILE_IDS = 4_000_000  # a file is closed once it has so many
RANGES = 4  # of doc_id for each task that writes
NULL_ID = -(2**63)
_HEAD, _FOOT = struct.Struct("<IBH"), struct.Struct("<QIIQI8s")


def encode_block(ids: np.ndarray) -> bytes:
    """One to BLOCK unsigned 32-bit ids."""
    low = int(ids.min())
    d = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(d, k := min(len(d) - 1, int(len(d) * PERCENTILE)))[k]).bit_length()
    odd = np.flatnonzero(d >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    kept = d & np.uint32((1 << width) - 1) if width < 32 else d
    unit = 2 if width <= 16 else 4
    bits = kept.astype(f"<u{unit}").view(np.uint8).reshape(-1, unit)
    packed = np.packbits(np.unpackbits(bits, axis=1, bitorder="little")[:, :width], bitorder="little")
    return _HEAD.pack(low, width, len(odd)) + packed.tobytes() + odd.astype("<u2").tobytes() + d[odd].astype("<u4").tobytes()


def decode_block(data: memoryview, at: int, n: int) -> np.ndarray:
    low, width, odd = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    unit = 2 if width <= 16 else 4
    full = np.zeros((n, 8 * unit), np.uint8)
    full[:, :width] = bits
    d = np.packbits(full, axis=1, bitorder="little").view(f"<u{unit}").ravel().astype(np.uint32)
    at += size
    d[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return d + np.uint32(low)


def encode_file(documents: list[tuple[int | None, np.ndarray]]) -> bytes:
    ids = np.concatenate([x for _, x in documents]).astype(np.uint32)
    parts, starts, at = [MAGIC], [], len(MAGIC)
    for i in range(0, len(ids), BLOCK):
        block = encode_block(ids[i : i + BLOCK])
        parts.append(block)
        starts.append(at)
        at += len(block)
    tail = np.array(starts, "<u8").tobytes() + b"".join(struct.pack("<qBI", doc if doc is not None else 0, doc is None, len(x)) for doc, x in documents)
    return b"".join([*parts, tail, _FOOT.pack(len(ids), len(starts), len(documents), at, zlib.crc32(tail), MAGIC)])


class TokenFile:
    """Reads a file's bytes; ids(a, b) decodes only the blocks that hold positions a to b."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.size, blocks, docs, at, crc, magic = _FOOT.unpack_from(self.data, len(data) - _FOOT.size)
        tail = self.data[at : len(data) - _FOOT.size]
        if magic != MAGIC or data[: len(MAGIC)] != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a whole token file")
        self.starts = np.frombuffer(tail, "<u8", blocks)
        table = np.frombuffer(tail, np.dtype([("doc", "<i8"), ("null", "u1"), ("n", "<u4")]), docs, 8 * blocks)
        self.docs = [None if r["null"] else int(r["doc"]) for r in table]
        self.bounds = np.concatenate([[0], np.cumsum(table["n"].astype(np.int64))])

    def ids(self, a: int, b: int) -> np.ndarray:
        first, last = a // BLOCK, -(-b // BLOCK)
        blocks = [decode_block(self.data, int(self.starts[k]), min(BLOCK, self.size - k * BLOCK)) for k in range(first, last)]
        return np.concatenate(blocks)[a - first * BLOCK : b - first * BLOCK] if blocks else np.empty(0, np.uint32)


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _packed(ids: np.ndarray) -> bytes:
    """Ids for the shuffle: a byte with their width (2 or 4), then the ids."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\4" + ids.astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint32)


def _ranges(docs: DataFrame, parts: int) -> np.ndarray:
    """At most parts - 1 upper bounds of doc_id ranges with about as many rows each; a null counts as the smallest id."""
    at = F.percentile_approx(F.coalesce("doc_id", F.lit(NULL_ID)), [k / parts for k in range(1, parts)], F.lit(max(10_000, 4 * parts)))
    return np.array(docs.agg(at).first()[0] or [], np.int64) if parts > 1 else np.empty(0, np.int64)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, keep_space: bool = False) -> DataFrame:
    """Write docs (doc_id, text) to files in `folder`; returns the manifest (file, n_docs, n_ids).

    folder: a URI that all executors reach (file, hdfs, s3, gs). Files sort by name as their documents sort by doc_id; a
    null doc_id comes first, rows with the same doc_id are in an order that follows from their ids. A null or empty text
    has the end id alone. Texts are encoded where they are read; their ids are dealt out by ranges of doc_id, and a doc_id
    that fills several ranges is dealt out over them.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = _ranges(docs, tasks * RANGES)

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, keep_space)
        for batch in batches:
            every, upto = own.column(batch.column("text"))
            doc_id = batch.column("doc_id")
            at = doc_id.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, at), np.searchsorted(bounds, at, "right")
            ids = [_packed(np.append(every[a:b], np.uint32(end_id))) for a, b in zip(upto[:-1], upto[1:])]
            part = [int(k) if n < 2 else int(k) + zlib.crc32(x) % int(n) for k, n, x in zip(low, high - low, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc_id, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _fs(folder)
        open_part, made, size, waiting = -1, 0, 0, []

        def close() -> pa.RecordBatch:
            name = f"part-{open_part:06d}-{made:06d}.pfor"
            store.create_dir(base, recursive=True)
            own = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(encode_file(waiting))
            store.move(own, f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(waiting)], pa.int64()), pa.array([size], pa.int64())], ["file", "n_docs", "n_ids"])

        for batch in batches:
            for part, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if waiting and (part != open_part or size >= FILE_IDS):
                    yield close()
                    made, size, waiting = made + 1 if part == open_part else 0, 0, []
                open_part = part
                ids = _unpacked(packed)
                waiting.append((doc, ids))
                size += len(ids)
        if waiting:
            yield close()

    encoded = docs.mapInArrow(encode, "part int, doc_id long, ids binary").repartition(tasks, "part").sortWithinPartitions("part", "doc_id", "ids")
    return materialize(encoded.mapInArrow(write, "file string, n_docs long, n_ids long"))


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files; start counts the ids of all before it."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _fs(folder)
        for pdf in batches:
            for name, first in zip(pdf["file"], pdf["before"]):
                with store.open_input_stream(f"{base}/{name}") as data:
                    f = TokenFile(data.read())
                every, b = f.ids(0, f.size).astype("<u4"), f.bounds
                ids = [every[i:j] for i, j in zip(b[:-1], b[1:])]
                out = pd.DataFrame({"doc_id": pd.array(f.docs, "Int64"), "start": b[:-1] + int(first), "n_tokens": np.diff(b), "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]})
                yield out.assign(ids=[x.astype(np.int32) for x in ids]) if with_ids else out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "before").repartition(parts, "file").mapInPandas(run, schema)


def token_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to a new shared folder and read the documents back from them."""
    folder = scratch_dir(docs.sparkSession) + "-tokens"
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), folder)
