"""What the operators of this subpackage share: tables, the shared folder, crc32 splits, Arrow slices.

Texts reach Python in Arrow batches of at most spark.sql.execution.arrow.maxBytesPerBatch
and are worked on in slices of a few MB. Operators leave the session's settings alone; the
registered queries and the pipeline, which own their sessions, lower that one by
small_batches(), since one MB a batch is what small executors can hold.
"""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import clean, cut, discard, fresh_path, shared_dir, spread, staged

__all__ = ["clean", "cut", "discard", "fresh_path", "held_out", "is_held_out", "kept", "let_go", "shared_dir", "slices", "small_batches", "spread", "staged", "table"]


def give_back() -> None:
    """Makes this process return large freed blocks to the system, which workers of a small executor need."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 19)  # M_MMAP_THRESHOLD: larger blocks are mapped, and unmapped when freed
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass
    pa.set_memory_pool(pa.system_memory_pool())


give_back()
_KEPT: dict = {}


def kept(key, make: Callable):
    """What a Python worker keeps between tasks, made when asked for first. One thing at a time: the next one takes its place."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drops what is kept, for tasks that need the room and keep nothing."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents, whose rows take long, are dealt to all cores where their file is too small to be split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def small_batches(spark: SparkSession, most_bytes: int = 1 << 20) -> None:
    """Lowers the session's bytes per Arrow batch. For applications, not for operators."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > most_bytes:
        spark.conf.set(key, most_bytes)


def held_out(doc_id: Column) -> Column:
    """The documents that no model learns from: crc32(doc_id as text) mod 4 is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text, so that what Python makes of them is bounded too. A longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (held + n > most_bytes or i - at >= most_rows):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)
