"""Ranked lexical search of all documents for every item of a benchmark, in integers, by sort-based accumulation.

Terms are the runs of digits, letters and characters beyond ASCII, A-Z lower-cased.
Items are dealt to parts by hash, as many as keep a part near ``PART_POSTINGS`` pairs of
term and item, and a part is a file in the shared folder: the terms' bytes, hashes and
postings. A worker holds one part at a time.

First scan: a document's terms are cut out of its bytes, hashed and looked up; bytes are
compared, so hashes decide nothing. Its length and the codes and counts of terms that some
item asks for are written, and document counts, total length and document frequencies
are added up from there. Second scan, over what is written: in blocks of documents of bounded work, the
lists (item, document, impact) of all matched terms are put in a row, their packed keys
sorted by radix (stable passes of 16 bits), and each key's impacts summed by reduceat.
Per item a heap keeps the best of the task; what it still
admits bounds the next block. The tasks' winners, k at most for an item and task, are
dealt by ranges of items and go through such heaps again, streaming.

Cases: a null text has no terms; a null doc_id is a document like others, after all
others of its score; documents that repeat are ranked each; items of one item_id are one
item with the terms of all its different texts, rows that repeat count once, and a null
item_id is an item like others; items without terms or without a document give no
rows; an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import heapq
import io
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import HashTable, hash_runs

K = 20
PART_POSTINGS = 1 << 20
PART_ITEMS = 1 << 15  # on average; packed keys leave 16 bits for an item of its part
BLOCK_PAIRS = 1 << 20
BLOCK_DOCUMENTS = 1 << 16
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
IS_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
MATCHED = "part int, doc_id long, n long, codes array<int>, counts array<int>"
FOUND = "part int, item int, doc_id long, score long"
RANKED = "part int, item int, doc_id long, score long, rank int"


def terms(text: Column) -> Column:
    """The terms of a text, in order; none of NULL."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def cut_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of texts in a row, the start and end of each term, and the number of each one's text."""
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    inside = np.concatenate(([False], IS_TERM[data], [False]))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(bounds, starts, "right")


class Part:
    """Terms of some items, and what they are to them. Code c stands for the bytes data[at[c]:at[c + 1]]; its items are items[upto[c]:upto[c + 1]]."""

    def __init__(self, data: np.ndarray, at: np.ndarray, upto: np.ndarray, items: np.ndarray, times: np.ndarray, weights: np.ndarray | None = None):
        self.data, self.at, self.upto, self.items, self.times = data, at, upto, items, times
        self.sizes = np.diff(upto)
        self.weights = weights
        self.table = None

    @classmethod
    def made(cls, items: np.ndarray, words: list[str], times: np.ndarray) -> Part:
        known = {w: None for w in sorted(set(words))}
        code = {w: i for i, w in enumerate(known)}
        codes = np.array([code[w] for w in words], np.int64)
        order = np.lexsort((items, codes))
        raw = [w.encode() for w in known]
        upto = np.append(0, np.cumsum(np.bincount(codes, minlength=len(raw))))
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])), upto, items[order], times[order])

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, data=self.data, at=self.at, upto=self.upto, items=self.items, times=self.times)
        return out.getvalue()

    @classmethod
    def loaded(cls, raw: bytes, weights: bytes | None) -> Part:
        with np.load(io.BytesIO(raw)) as f:
            return cls(*(f[name] for name in ("data", "at", "upto", "items", "times")), None if weights is None else np.frombuffer(weights, "<i8"))

    def codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The code of each term of data, -1 where it is none of this part's."""
        if self.table is None:
            known = np.maximum(hash_runs(self.data, self.at[:-1], self.at[1:]), np.uint64(1))
            if len(np.unique(known)) < len(known):
                raise ValueError("two terms of a part share a 64-bit hash")
            self.table = HashTable(max(10, int(len(known)).bit_length() + 1))
            self.table.add(known)
        out = self.table.find(hashes)
        met = np.flatnonzero(out >= 0)
        for i in range(0, len(met), 1 << 16):
            some = met[i : i + (1 << 16)]
            code, size = out[some], (ends - starts)[some]
            alike = size == (self.at[code + 1] - self.at[code])
            out[some[~alike]] = -1
            some, code, size = some[alike], code[alike], size[alike]
            if len(some):
                begin = np.cumsum(size) - size
                place = np.arange(int(size.sum()))
                unlike = data[place + np.repeat(starts[some] - begin, size)] != self.data[place + np.repeat(self.at[code] - begin, size)]
                out[some[np.add.reduceat(unlike, begin, dtype=np.int64) > 0]] = -1
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _store(uri: str, name: str, raw: bytes) -> None:
    """Under a name of its own first, so that a task that runs again leaves the same file."""
    system, folder = _filesystem(uri)
    system.create_dir(folder)
    hidden = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(raw)
    system.move(hidden, f"{folder}/{name}")


def _load(uri: str, part: int, weighted: bool) -> Part:
    def read(name: str) -> bytes:
        system, folder = _filesystem(uri)
        with system.open_input_stream(f"{folder}/{name}") as f:
            return f.read()

    return common.kept(("lexical", uri, part, weighted), lambda: Part.loaded(read(f"{part}.npz"), read(f"{part}.weights") if weighted else None))


def _builder(uri: str) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        keys = rows.column("item_id").to_pylist()
        ids = sorted(set(keys), key=lambda i: (i is None, i if i is not None else 0))
        if len(ids) > 1 << 16:
            raise ValueError("more than 65536 items in a part")
        number = {i: k for k, i in enumerate(ids)}
        items = np.array([number[i] for i in keys], np.int32)
        _store(uri, f"{part}.npz", Part.made(items, rows.column("term").to_pylist(), np.array(rows.column("times"), np.int64)).saved())
        return pa.table({"part": pa.array([part] * len(ids), pa.int32()), "item": pa.array(range(len(ids)), pa.int32()), "item_id": pa.array(ids, rows.column("item_id").type)})

    return run


def _matcher(uri: str, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch, "text"):
                texts = [(x or "").encode() for x in some.column("text").to_pylist()]
                data, starts, ends, doc = cut_terms(texts)
                n = np.bincount(doc, minlength=len(texts))
                hashes = hash_runs(data, starts, ends)
                for part in range(parts):
                    codes = _load(uri, part, False).codes(data, starts, ends, hashes)
                    met = codes >= 0
                    pairs, counts = np.unique(doc[met] << 32 | codes[met], return_counts=True)
                    per_doc = np.bincount(pairs >> 32, minlength=len(texts))
                    show = np.flatnonzero((per_doc > 0) | (n > 0) & (part == 0))
                    upto = pa.array(np.append(0, np.cumsum(per_doc[show])), pa.int32())
                    lists = [pa.ListArray.from_arrays(upto, pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, counts)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(show), part, np.int32)), some.column("doc_id").take(pa.array(show)), pa.array(n[show]), *lists], names=["part", "doc_id", "n", "codes", "counts"]
                    )

    return run


def _weigher(uri: str, documents: int) -> Callable:
    """Writes the weights of a part's terms: floor(1000 * ln((2 * N + 2) / (2 * df + 1)))."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        df = np.zeros(len(_load(uri, part, False).at) - 1, np.int64)
        df[np.array(rows.column("code"))] = np.array(rows.column("df"))
        weight = {x: math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in np.unique(df).tolist()}
        _store(uri, f"{part}.weights", np.array([weight[x] for x in df.tolist()], "<i8").tobytes())
        return pa.table({"part": pa.array([part], pa.int32())})

    return run


def radix_order(keys: np.ndarray, bits: int = 32) -> np.ndarray:
    """The stable order of unsigned keys: passes of 16 bits from below; numpy sorts 16-bit integers by radix. A digit that is in order is passed over."""
    order = None
    for shift in range(0, bits, 16):
        digit = (keys >> keys.dtype.type(shift)).astype(np.uint16)
        digit = digit if order is None else digit[order]
        if (digit[1:] < digit[:-1]).any():
            step = np.argsort(digit, kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


class Heaps:
    """The k best documents of each item: highest score first, then a document id before none, then the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, list[tuple[int, bool, int]]] = {}
        self.least = np.zeros(0, np.int64)

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if not len(items):
            return
        most = int(items.max()) + 1
        if most > len(self.least):
            self.least = np.append(self.least, np.ones(most - len(self.least), np.int64))  # scores of 0 are none
        fine = scores >= self.least[items]
        items, scores, ids, known = items[fine], scores[fine], ids[fine], known[fine]
        order = np.lexsort((ids, ~known, -scores, items))
        items, scores, ids, known = items[order], scores[order], ids[order], known[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        best = place < self.k
        for item, one in zip(items[best].tolist(), zip(scores[best].tolist(), known[best].tolist(), (-ids[best]).tolist(), strict=True), strict=True):
            heap = self.held.setdefault(item, [])
            if len(heap) < self.k:
                heapq.heappush(heap, one)
            else:
                heapq.heappushpop(heap, one)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int, int]]:
        """item, doc_id, score, rank."""
        for item in sorted(self.held):
            for rank, (score, known, ident) in enumerate(sorted(self.held[item], reverse=True), 1):
                yield item, -ident if known else None, score, rank


def accumulate(part: Part, n: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray, documents: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """item, place of the document and score of each pair that shares a term. sizes: of the documents' lists, which stand in codes and counts in a row."""
    m = np.array([75 + 25 * x * documents // length for x in n.tolist()], np.int64)  # of any size, so in Python's integers
    doc = np.repeat(np.arange(len(n)), sizes)
    impact = part.weights[codes] * (1_000_000_000 * counts // (1000 * counts + 12 * m[doc]))
    copies = part.sizes[codes]
    at = np.arange(int(copies.sum())) + np.repeat(part.upto[codes] - (np.cumsum(copies) - copies), copies)
    keys = part.items[at].astype(np.uint32) << np.uint32(16) | np.repeat(doc, copies).astype(np.uint32)
    impacts = np.repeat(impact, copies) * part.times[at]
    order = radix_order(keys)
    keys, impacts = keys[order], impacts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    scores = np.add.reduceat(impacts, first) if len(first) else np.zeros(0, np.int64)
    return (keys[first] >> np.uint32(16)).astype(np.int64), (keys[first] & np.uint32(0xFFFF)).astype(np.int64), scores


def _accumulator(uri: str, documents: int, length: int, k: int, block_pairs: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, Heaps] = {}
        for batch in batches:
            parts, n = np.array(batch.column("part")), np.array(batch.column("n"))
            known = np.array(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            sizes = np.array(batch.column("codes").value_lengths()).astype(np.int64)
            codes, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("codes", "counts"))
            begin = np.append(0, np.cumsum(sizes))
            for number in np.unique(parts).tolist():
                part = _load(uri, number, True)
                rows = np.flatnonzero((parts == number) & (sizes > 0))
                take = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows.tolist()]) if len(rows) < len(parts) and len(rows) else np.arange(len(codes) if len(rows) else 0)
                c, t, s = codes[take], counts[take], sizes[rows]
                upto = np.append(0, np.cumsum(s))
                work = np.append(0, np.cumsum(part.sizes[c]))[upto]
                a = 0
                while a < len(rows):
                    b = min(max(a + 1, int(np.searchsorted(work, work[a] + block_pairs, "right")) - 1), a + BLOCK_DOCUMENTS)
                    item, doc, score = accumulate(part, n[rows[a:b]], s[a:b], c[upto[a] : upto[b]], t[upto[a] : upto[b]], documents, length)
                    heaps.setdefault(number, Heaps(k)).add(item, score, ids[rows[a:b]][doc], known[rows[a:b]][doc])
                    a = b
        for number, held in heaps.items():
            yield _batch(number, held, False)

    return run


def _batch(part: int, held: Heaps, ranked: bool) -> pa.RecordBatch:
    rows = list(held.rows())
    columns = [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))]
    names = ["part", "item", "doc_id", "score"]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[3] for r in rows], pa.int32())], names=[*names, "rank"]) if ranked else pa.RecordBatch.from_arrays(columns, names=names)


def _selector(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, Heaps] = {}
        for batch in batches:
            parts, items, scores = (np.array(batch.column(c)).astype(np.int64) for c in ("part", "item", "score"))
            known, ids = np.array(batch.column("doc_id").is_valid()), batch.column("doc_id").fill_null(0).to_numpy()
            for number in np.unique(parts).tolist():
                at = parts == number
                heaps.setdefault(number, Heaps(k)).add(items[at], scores[at], ids[at], known[at])
        for number, held in heaps.items():
            yield _batch(number, held, True)

    return run


def search(documents: DataFrame, items: DataFrame, k: int = K, part_postings: int = PART_POSTINGS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item with a score above 0. documents: doc_id, text; items: item_id, text."""
    spark, kind = documents.sparkSession, items.schema["item_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    asked = items.select("item_id", "text").distinct().select("item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    asked = common.staged(asked, "lexical-terms")
    pairs, n_items = asked.agg(F.count("*"), F.count_distinct(F.struct("item_id"))).first()
    parts = max(math.ceil(pairs / part_postings), math.ceil(n_items / PART_ITEMS))
    if not parts:
        return empty
    uri = common.fresh_path(spark, "lexical-index")
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int"))
    known = common.staged(dealt.groupBy("part").applyInArrow(_builder(uri), f"part int, item int, item_id {kind}"), "lexical-items")
    common.discard(asked)
    # a hash may leave a part without items
    numbers = sorted(r["part"] for r in known.select("part").distinct().collect())
    if numbers != list(range(parts)):
        for missing in sorted(set(range(parts)) - set(numbers)):
            _store(uri, f"{missing}.npz", Part.made(np.zeros(0, np.int32), [], np.zeros(0, np.int64)).saved())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    matched = common.staged(rows.mapInArrow(_matcher(uri, parts), MATCHED), "lexical-matches")
    count, length = matched.where("part = 0").agg(F.count("*"), F.sum("n")).first()
    if not count:
        return empty
    df = matched.select("part", F.explode("codes").alias("code")).groupBy("part", "code").agg(F.count("*").alias("df"))
    weighed = {r["part"] for r in df.groupBy("part").applyInArrow(_weigher(uri, count), "part int").collect()}
    if not weighed:
        return empty
    found = matched.where(F.size("codes") > 0).mapInArrow(_accumulator(uri, count, length, k, block_pairs), FOUND)
    ranked = found.repartitionByRange("part", "item").mapInArrow(_selector(k), RANKED)
    return ranked.join(known, ["part", "item"]).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = rf"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM p, s GROUP BY 1),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * s.n) // s.l AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT q.item_id, m.doc_id, p.r, CAST(sum(q.times * f.wt * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m))) AS BIGINT) AS score
  FROM p JOIN m ON m.r = p.r JOIN f ON f.t = p.t JOIN q ON q.t = p.t GROUP BY 1, 2, 3),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM k WHERE rank <= {K}
"""
