"""Packing by power-of-two decomposition.

Each document becomes its token ids and an end id. It is cut into as many pieces of
``max_length`` as fit, then into pieces whose lengths are the binary digits of the
rest, longest first. A piece is a sequence of its own, so no sequence crosses
documents and nothing is padded. ``bucket`` is log2 of the length; write_buckets()
gathers sequences of equal length into folders of files that hold one length alone,
which is what a trainer reads batches of one shape from. Cutting needs no shuffle, the
buckets one, whose tasks are levelled by size, since most pieces may be of one length.

Cases: a null text counts as empty, and gives the one piece that holds the end id;
repeated rows are packed once each; a null doc_id stays null; a very long text gives as
many pieces as it takes; an empty table gives no rows; other columns of the input are left out. sequence_id is unique over the
result: the number of the input's partition times 2**36, plus a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import encoder, vocabulary_path

MAX_LENGTH = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, bucket int, doc_tokens long, sequence_id long, offset long, ids binary"


def pieces(n: int, max_length: int) -> list[int]:
    """The lengths of the pieces of n ids."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(vocabulary: str, max_length: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        sequence = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in common.slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids, counts = encode(texts)
                cuts = [pieces(int(n) + 1, max_length) for n in counts]
                per_doc = np.array([len(c) for c in cuts], np.int64)
                lengths = np.array([x for c in cuts for x in c], np.int64)
                docs = np.repeat(np.arange(len(texts)), per_doc)
                whole_ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                ends = np.cumsum(lengths)
                doc_base = np.append(0, np.cumsum(counts + 1))[:-1]
                raw = whole_ids.tobytes()
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(docs)).cast(pa.int64()),
                        pa.array(ends - lengths - doc_base[docs]),
                        pa.array(lengths),
                        pa.array(np.log2(lengths).astype(np.int32)),
                        pa.array((counts + 1)[docs]),
                        pa.array(np.arange(sequence, sequence + n)),
                        pa.array(np.zeros(n, np.int64)),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int32)), pa.py_buffer(raw)]),
                    ],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )
                sequence += n

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row per piece, with its ids as little-endian unsigned 32-bit integers. docs: doc_id, text."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length has to be a power of two")
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    return docs.select("doc_id", "text").mapInArrow(_packer(path, max_length, end_id), SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Writes pieces below path, a folder bucket=b for each length 2**b, and reads them back. Each task has pieces of one
    or a few buckets, and large buckets are split over tasks (rebalanced by adaptive execution)."""
    spark = pieces.sparkSession
    pieces.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    back = spark.read.schema(SCHEMA).parquet(path)
    return back.select(*[x.split()[0] for x in SCHEMA.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = write_buckets(pack(common.table(spark, sf_dir, "documents")), common.fresh_path(spark, "packed"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
