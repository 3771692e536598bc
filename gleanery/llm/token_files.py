"""Token-id files in patched frame-of-reference blocks.

Documents are ranged by doc_id, about ``PART_BYTES`` of text a range but at least as many
ranges as cores and at most ``MOST_PARTS``, encoded in order, each closed by an end id, and written as files of blocks of 1024 ids: a block's minimum is subtracted, the rest is
packed at the width that holds ``percentile`` of the block, and ids that need more
bits go whole to the block's exception list. Behind the blocks stand the index of
block starts and the index of documents.

File, little-endian:  b"GPF1" | blocks | index | footer
  block   u32 minimum, u8 width, u8 0, u16 exceptions e, 32 * width u32 packed, e u16 places, e u32 ids
  index   u64 byte start of each block, then i64 doc_id, u8 1 if the id is null, and u64 ids before, for each document
  footer  u64 blocks, u64 documents, u64 ids, u64 byte start of the index, b"GPF1"
Value i of a block stands in lane i % 32, row i // 32; row r of a lane takes bits
r * width and on of the lane's words. The last block is padded with its own minimum.

Tasks write to a name of their own and move it into place, so a task that runs again
leaves the same file. The driver sees one row per file.

Cases: a null text counts as empty, so the document is its end id; a null doc_id comes
first in order; rows of one doc_id keep an order by text and stand in one file, since
the order is by doc_id; a very long text is encoded in parts and spans blocks; an empty
table makes no file and reads back as no rows; other columns are left out.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, vocabulary_path

BLOCK = 1024
END_ID = 0
PART_BYTES = 32 << 20
MOST_PARTS = 10_000  # larger ranges end in several files
MAGIC = b"GPF1"
FOOTER = struct.Struct("<QQQQ4s")
MANIFEST = "part int, number int, file string, n_docs long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def _rows(width: int) -> list[tuple[int, int, int]]:
    return [(r, r * width // 32, r * width % 32) for r in range(32)]


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """The blocks of ids, whose number is a multiple of BLOCK."""
    blocks = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    at = int(np.ceil(percentile * BLOCK)) - 1
    tall = np.partition(rest, at, axis=1)[:, at].astype(np.uint64)
    widths = np.where(tall > 0, np.floor(np.log2(np.maximum(tall, 1))).astype(int) + 1, 0)
    out: list[bytes] = [b""] * len(blocks)
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        values = rest[which]
        big = values >> np.uint32(width) > 0 if width < 32 else np.zeros_like(values, bool)
        lanes = np.where(big, 0, values).reshape(-1, 32, 32)  # block, row, lane
        words = np.zeros((len(which), width + 1, 32), np.uint32)
        if width:
            for r, word, shift in _rows(width):
                words[:, word] |= lanes[:, r] << np.uint32(shift)
                if shift + width > 32:
                    words[:, word + 1] |= lanes[:, r] >> np.uint32(32 - shift)
        for k, b in enumerate(which.tolist()):
            places = np.flatnonzero(big[k])
            out[b] = struct.pack("<IBBH", int(low[b]), width, 0, len(places)) + words[k, :width].astype("<u4").tobytes() + places.astype("<u2").tobytes() + blocks[b, places].astype("<u4").tobytes()
    return out


def unpack_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at starts."""
    out = np.zeros((len(starts), BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBBH", raw, s) for s in starts.tolist()]
    widths = np.array([h[1] for h in heads], int)
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        if width:
            words = np.stack([np.frombuffer(raw, "<u4", 32 * width, starts[b] + 8) for b in which.tolist()]).reshape(-1, width, 32)
            mask = np.uint32((1 << width) - 1)
            lanes = np.empty((len(which), 32, 32), np.uint32)
            for r, word, shift in _rows(width):
                x = words[:, word] >> np.uint32(shift)
                if shift + width > 32:
                    x = x | words[:, word + 1] << np.uint32(32 - shift)
                lanes[:, r] = x & mask
            out[which] = lanes.reshape(-1, BLOCK)
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    for b, (_, width, _, n) in enumerate(heads):
        if n:
            at = int(starts[b]) + 8 + 128 * width
            out[b, np.frombuffer(raw, "<u2", n, at)] = np.frombuffer(raw, "<u4", n, at + 2 * n)
    return out.reshape(-1)


class FileWriter:
    """One file; ids are packed as they come, so only a few blocks and the index are held."""

    def __init__(self, out, percentile: float):
        self.out, self.percentile = out, percentile
        self.out.write(MAGIC)
        self.at, self.n_ids = len(MAGIC), 0
        self.block_starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.doc_starts: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.doc_starts.append(self.n_ids + np.cumsum(counts) - counts)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 256 * BLOCK:
            ids = np.concatenate(self.held)
            keep = len(ids) // BLOCK * BLOCK
            self._write(ids[:keep])
            self.held, self.n_held = [ids[keep:]], len(ids) - keep

    def _write(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), 256 * BLOCK):
            for block in pack_blocks(ids[i : i + 256 * BLOCK], self.percentile):
                self.block_starts.append(self.at)
                self.out.write(block)
                self.at += len(block)

    def close(self) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, np.uint32)])
        if len(ids):
            pad = -len(ids) % BLOCK
            self._write(np.concatenate([ids, np.full(pad, ids[len(ids) // BLOCK * BLOCK :].min() if pad else 0, np.uint32)]).astype(np.uint32))
        starts = np.concatenate([*self.doc_starts, np.zeros(0, np.int64)])
        self.out.write(np.array(self.block_starts, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.doc_ids], "u1").tobytes())
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(FOOTER.pack(len(self.block_starts), len(self.doc_ids), self.n_ids, self.at, MAGIC))
        self.out.close()


def read_file(source, blocks_at_once: int = 256) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, starts in the file, ids of these documents in a row), some documents at a time. source: a pyarrow random access file."""
    size = source.size()
    source.seek(size - FOOTER.size)
    n_blocks, n_docs, n_ids, index_at, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    source.seek(index_at)
    starts = np.append(np.frombuffer(source.read(8 * n_blocks), "<u8"), index_at).astype(np.int64)
    doc_ids = np.frombuffer(source.read(8 * n_docs), "<i8")
    nulls = np.frombuffer(source.read(n_docs), "u1")
    doc_starts = np.append(np.frombuffer(source.read(8 * n_docs), "<u8"), n_ids).astype(np.int64)
    left, doc, done = np.zeros(0, np.uint32), 0, 0
    for b in range(0, n_blocks, blocks_at_once):
        e = min(n_blocks, b + blocks_at_once)
        source.seek(int(starts[b]))
        raw = source.read(int(starts[e] - starts[b]))
        left = np.concatenate([left, unpack_blocks(raw, starts[b:e] - starts[b])])
        have = min(done + len(left), n_ids)
        end = int(np.searchsorted(doc_starts, have, "right")) - 1
        if end > doc:
            upto = int(doc_starts[end])
            ids = [None if z else int(d) for d, z in zip(doc_ids[doc:end].tolist(), nulls[doc:end].tolist(), strict=True)]
            yield ids, doc_starts[doc : end + 1], left[: upto - done]
            left, doc, done = left[upto - done :], end, upto


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(vocabulary: str, end_id: int, uri: str, percentile: float, ids_per_file: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        system, folder = _filesystem(uri)
        part, number, writer, done = TaskContext.get().partitionId(), 0, None, []

        def close() -> None:
            writer.close()
            name = f"{folder}/{part:06d}-{number:04d}.gpf"
            system.move(hidden, name)
            done.append((part, number, os.path.basename(name), len(writer.doc_ids), writer.n_ids))

        for whole in batches:
            for batch in common.slices(whole, "text"):
                if writer is None:
                    hidden = f"{folder}/.{part:06d}-{number:04d}-{uuid.uuid4().hex}"
                    writer = FileWriter(system.open_output_stream(hidden), percentile)
                ids, counts = encode([t or "" for t in batch.column("text").to_pylist()])
                writer.add(batch.column("doc_id").to_pylist(), np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1)
                if writer.n_ids >= ids_per_file:
                    close()
                    writer, number = None, number + 1
        if writer is not None:
            close()
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return run


def write(docs: DataFrame, uri: str, vocabulary: str | None = None, end_id: int = END_ID, parts: int | None = None, percentile: float = 0.9, ids_per_file: int = 1 << 27) -> DataFrame:
    """Writes the files below uri, a folder that all executors see, and returns their manifest. docs: doc_id, text."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    if not parts:
        parts = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // PART_BYTES)
        parts = min(MOST_PARTS, max(spark.sparkContext.defaultParallelism, parts))
    system, folder = _filesystem(uri)
    system.create_dir(folder)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ranged.mapInArrow(_writer(path, end_id, uri, percentile, ids_per_file), MANIFEST).collect()  # one row per file
    rows = sorted(tuple(r) for r in rows)
    return spark.createDataFrame(rows, MANIFEST)


def _reader(uri: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(uri)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with system.open_input_file(f"{folder}/{name}") as source:
                    for doc_ids, starts, ids in read_file(source):
                        n = len(doc_ids)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc_ids, pa.int64()),
                                pa.array(starts[:-1] + base),
                                pa.array(np.diff(starts)),
                                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(((starts - starts[0]) * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())]),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    return run


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of each document, from the files."""
    spark = manifest.sparkSession
    files, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r.part, r.number)):  # one row per file
        files.append((r.file, base))
        base += r.n_ids
    named = spark.createDataFrame(files, "file string, base long")
    return named.repartition(max(1, len(files))).mapInArrow(_reader(uri), DOCS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = common.fresh_path(spark, "token-files")
    manifest = write(common.table(spark, sf_dir, "documents"), uri)
    return read(manifest, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
