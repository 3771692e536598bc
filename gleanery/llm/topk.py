"""Exact top-k search by inner product, term at a time.

A vector's terms are its places, its weights the integers floor(scale * x). Vectors are
packed into blocks inside the tasks that read them. For a pair of a candidate block and
a query block, the candidates' postings (row, weight) of each term are scattered, times
the query rows' weights, into dense score arrays; the k best of each query come out by
partition selection, and the blocks' lists are merged. Rows meet by block pairs of an
equi-join, so a task holds two blocks, whatever the table's size. A block ends at a
number of rows or of ``MOST_VALUES`` components (32 MB of weights), whichever comes
first. Exhaustive search sends every candidate once to each query block.

Cases: rows with a null vec_id, a null vector, or a null or non-finite component take no
part; vectors may differ in length (a missing place is 0); a query's own row is every
row of its vec_id; rows that repeat count once; ties go to the smaller vec_id; a query
without candidates gives no rows; an empty table gives none; other columns are left
out. Scores have to fit in a signed 64-bit integer; a weight beyond 2**55 is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256.0
CANDIDATES_PER_BLOCK = 1 << 16
QUERIES_PER_BLOCK = 1 << 14
MOST_VALUES = 1 << 22
BLOCK = "block long, ids binary, lengths binary, weights binary"
FOUND = "query_id long, vec_id long, score long"


def _quantised(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths and weights (in a row) of the vectors of a batch that take part."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    keep = np.array(ids.is_valid()) & np.array(vectors.is_valid())
    vectors = vectors.filter(pa.array(keep))
    ids = np.array(ids.filter(pa.array(keep)).cast(pa.int64()))
    lengths = np.array(vectors.value_lengths()).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.zeros(len(ids), bool)
    bad[np.repeat(np.arange(len(ids)), lengths)[~np.isfinite(flat)]] = True
    flat = np.floor(scale * flat[np.repeat(~bad, lengths)])
    if len(flat) and np.abs(flat).max() >= 2.0**55:
        raise ValueError(f"a component times {scale} lies beyond 2**55")
    flat = flat.astype(np.int64)
    return ids[~bad], lengths[~bad], flat


def _packed(block: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row. Rows that repeat within the block are left out; the rest is ordered by id."""
    ids, lengths, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum(lengths)
    seen, order = set(), []
    for i in np.argsort(ids, kind="stable").tolist():
        key = (int(ids[i]), flat[ends[i] - lengths[i] : ends[i]].tobytes())
        if key not in seen:
            seen.add(key)
            order.append(i)
    at = np.concatenate([np.arange(ends[i] - lengths[i], ends[i]) for i in order]) if order else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), *(pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((ids[order], "<i8"), (lengths[order], "<i8"), (flat[at], _least(flat))))],
        names=["block", "ids", "lengths", "weights"],
    )


def _least(flat: np.ndarray) -> str:
    most = int(np.abs(flat).max(initial=0))
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def _block_packer(rows: int, scale: float, most_values: int = MOST_VALUES) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, n, values = [], 0, 0
        for batch in batches:
            at = 0
            wide = max(1, len(batch.column("embedding").flatten()) // max(1, batch.num_rows))
            while at < batch.num_rows:
                take = max(1, min(rows - n, (most_values - values) // wide))
                part = _quantised(batch.slice(at, take), scale)
                at += take
                held.append(part)
                n, values = n + len(part[0]), values + len(part[2])
                if n >= rows or values + wide > most_values:
                    yield _packed(block, held)
                    held, n, values, block = [], 0, 0, block + 1
        if n:
            yield _packed(block, held)

    return run


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """ids and the weights as a dense matrix, short vectors filled with 0."""
    ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
    size = len(row["weights"]) // max(1, int(lengths.sum()))
    flat = np.frombuffer(row["weights"], {2: "<i2", 4: "<i4"}.get(size, "<i8")).astype(np.int64)
    wide = int(lengths.max(initial=0))
    out = np.zeros((len(ids), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = flat
    return ids, out


def best(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int, rows: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and score of the k best candidates of each query, in no order. Candidates are ordered by id."""
    q_ids, q = queries
    c_ids, c = candidates
    terms = min(q.shape[1], c.shape[1])
    n = len(c_ids)
    small = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, terms) < 1 << 31
    kind = np.int32 if small else np.int64
    postings = [(np.flatnonzero(c[:, t]), c[c[:, t] != 0, t].astype(kind)) for t in range(terms)]
    q = q.astype(kind)
    rank = np.int64(n - 1) - np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    buffer = np.empty((rows, n), kind)
    for i in range(0, len(q_ids), rows):
        part, ids = q[i : i + rows], q_ids[i : i + rows]
        scores = np.zeros((len(part), n), kind)
        for t, (at, weight) in enumerate(postings):
            has = np.flatnonzero(part[:, t])
            if not len(has) or not len(at):
                continue
            if len(at) == n and len(has) == len(part):
                scores += np.multiply(part[:, t, None], weight, out=buffer[: len(part)])
            else:
                scores[has[:, None], at] += part[has, t, None] * weight
        order = scores.astype(object) * n + rank if not small and n * float(np.abs(scores).max(initial=0)) >= 2.0**62 else scores.astype(np.int64) * n + rank
        own = c_ids[None, :] == ids[:, None]
        keep = min(k + int(own.sum(axis=1).max(initial=0)), n)
        top = np.argpartition(order, n - keep, axis=1)[:, n - keep :] if order.dtype != object else np.argsort(order, axis=1)[:, n - keep :]
        row = np.arange(len(part))[:, None]
        fine = ~own[row, top]
        out.append((np.broadcast_to(ids[:, None], top.shape)[fine], c_ids[top][fine], scores[row, top][fine].astype(np.int64)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))


def _searcher(k: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [best(_matrix(q), c, k) for row in left.to_pylist() for c in [_matrix(row)] for q in right.to_pylist()]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE, candidates_per_block: int = CANDIDATES_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query. Both: vec_id, embedding (an array of numbers)."""
    pack = lambda df, rows: df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_block_packer(rows, scale), BLOCK)
    parts = max(1, math.ceil(queries.count() / queries_per_block))
    asked = common.staged(pack(queries.repartition(parts), queries_per_block), "topk-queries")
    held = common.staged(pack(vectors, candidates_per_block), "topk-candidates")
    n_asked, n_held = asked.count(), held.count()
    if not n_asked or not n_held:
        return spark_empty(vectors)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = _placed(held, "c").select("c", each(n_asked, "q"), "ids", "lengths", "weights")
    right = _placed(asked, "q").select(each(n_held, "c"), "q", "ids", "lengths", "weights")
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(_searcher(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _placed(blocks: DataFrame, name: str) -> DataFrame:
    """blocks with their places from 0. Only numbers of blocks, one for many thousand rows, are put in one order."""
    place = (F.row_number().over(Window.orderBy("block")) - 1).alias(name)
    return blocks.join(blocks.select("block", place), "block")


def spark_empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS t FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM p q JOIN p c ON q.t = c.t WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
