"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts and documents are normalised alike (A-Z lower-cased, words of ASCII
letters, digits and all non-ASCII characters, one space between words). A window is
``window`` consecutive words of an item (an item with fewer words is one window).
Every window holds one of the blocks of (window + 1) // 2 words that an item is cut
into from its first word on, so the automaton holds the blocks, each word of the
benchmark once, and short items whole. A document is scanned once; where a block
ends, the windows around it are looked up by hash in a table of all windows and held
against the item's own bytes. What is found is mapped back to word numbers and to
character offsets of the original text.

A worker's memory is bounded by ``most_bytes`` of benchmark text: the automaton takes
about 40 bytes a byte of text at most, the table of windows about 5. A larger benchmark
is taken in parts of that size, one scan of the documents each, whose hits (not texts)
are merged.

Cases: a null or wordless text has no words and no hits; an item without words is
ignored; an item with a null id hits words but is not listed; repeated documents are
scanned each for itself, and repeated items count once; a very long text is scanned
whole; empty tables give no rows, or no hits; other columns of the documents are left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import hash_runs, mix

WINDOW = 10
MOST_BYTES = 4 << 20
#: Bytes to normalised bytes: separators become spaces, A-Z lower case, the rest stays.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN = "struct<first_word:int,end_word:int,first_char:int,end_char:int>"
FOUND = f"doc_id long, n_words long, spans array<{SPAN}>, items array<long>"
HIT = f"doc_id long, text_sha string, spans array<{SPAN}>, items array<long>"
Item = tuple[int | None, str | None]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Scanner:
    """The automaton of some items, and the table of their windows."""

    def __init__(self, items: list[Item], window: int = WINDOW):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        self.short: dict[bytes, set[int]] = {}
        long: list[tuple[int | None, list[bytes]]] = []
        for item_id, text in items:
            w = words(text)
            if 0 < len(w) < window:
                key = b" " + b" ".join(w) + b" "
                self.automaton.add_word(key.decode("latin-1"))
                self.short.setdefault(key, set()).update([] if item_id is None else [item_id])
            elif w:
                for i in range(0, len(w) - self.block + 1, self.block):
                    self.automaton.add_word((b" " + b" ".join(w[i : i + self.block]) + b" ").decode("latin-1"))
                long.append((item_id, w))
        self._list_windows(long)
        if len(self.automaton):
            self.automaton.make_automaton()

    def _list_windows(self, items: list[tuple[int | None, list[bytes]]]) -> None:
        """Distinct windows by hash, each with the place of one occurrence in the items' bytes and the ids of its items."""
        sizes = np.array([len(w) for _, w in items], np.int64)
        self.bytes = b" " + b" ".join(x for _, w in items for x in w) + b" " if items else b""
        spaces = np.flatnonzero(np.frombuffer(self.bytes, np.uint8) == 32)
        owner = np.repeat(np.arange(len(items)), sizes)
        starts = np.flatnonzero(owner[self.window - 1 :] == owner[: len(owner) - self.window + 1]) if len(owner) else np.zeros(0, np.int64)
        self.salt = 0
        while True:
            found = self._hashes(self.bytes, spaces, starts)
            order = np.argsort(found, kind="stable")
            found, at = found[order], starts[order]
            first, last = spaces[at] + 1, spaces[at + self.window]
            same = np.flatnonzero(found[1:] == found[:-1]).tolist() if len(found) else []
            if all(self.bytes[first[i] : last[i]] == self.bytes[first[i + 1] : last[i + 1]] for i in same):
                break  # one hash, one window
            self.salt += 1
        new = np.concatenate(([True], found[1:] != found[:-1])) if len(found) else np.zeros(0, bool)
        self.hashes, self.first, self.last = found[new], first[new], last[new]
        known = np.array([i is not None for i, _ in items], bool)
        ids = np.array([i or 0 for i, _ in items], np.int64)
        pairs = np.stack([np.cumsum(new) - 1, ids[owner[at]]], axis=1)[known[owner[at]]] if len(at) else np.zeros((0, 2), np.int64)
        pairs = np.unique(pairs, axis=0)
        self.items, self.items_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.hashes) + 1))

    def _hashes(self, normal: bytes, spaces: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of the windows that begin at words starts. Word k stands between spaces[k] and spaces[k + 1]."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        word = hash_runs(np.frombuffer(normal, np.uint8), spaces[:-1] + 1, spaces[1:])
        out = np.full(len(starts), self.salt, np.uint64)
        for k in range(self.window):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word[starts + k])
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
        """Number of words, merged (first, end) word ranges that are hit, and the items found."""
        w = words(text)
        if not w or not len(self.automaton):
            return len(w), [], []
        normal = b" " + b" ".join(w) + b" "
        hits = list(self.automaton.iter(normal.decode("latin-1")))
        if not hits:
            return len(w), [], []
        spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
        ends, sizes = np.array(hits, np.int64).T
        first = np.searchsorted(spaces, ends - sizes + 1)
        n = np.searchsorted(spaces, ends) - first
        ranges: set[tuple[int, int]] = set()
        found: set[int] = set()
        if self.short:
            for e, size, a, k in zip(ends.tolist(), sizes.tolist(), first.tolist(), n.tolist(), strict=True):
                ids = self.short.get(normal[e - size + 1 : e + 1])
                if ids is not None:
                    ranges.add((a, a + k))
                    found |= ids
        around = first[n == self.block][:, None] - np.arange(self.window - self.block + 1)
        starts = np.unique(around[(around >= 0) & (around <= len(w) - self.window)])
        if len(starts) and len(self.hashes):
            h = self._hashes(normal, spaces, starts)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            fine = self.hashes[at] == h
            for s, g in zip(starts[fine].tolist(), at[fine].tolist(), strict=True):
                if normal[spaces[s] + 1 : spaces[s + self.window]] == self.bytes[self.first[g] : self.last[g]]:
                    ranges.add((s, s + self.window))
                    found.update(self.items[self.items_from[g] : self.items_from[g + 1]].tolist())
        merged: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return len(w), merged, sorted(found)


def _scanner(items: Broadcast) -> Scanner:
    """One for each part of the benchmark and Python worker."""
    key, held, window = items.value
    return common.kept(key, lambda: Scanner(held, window))


def _scan(items: Broadcast, hits_only: bool) -> Callable:
    """doc_id, then n_words of each document, or text_sha of those that are hit, then spans and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items)
        span = pa.struct([(n, pa.int32()) for n in ("first_word", "end_word", "first_char", "end_char")])
        for whole in batches:
            for batch in common.slices(whole, "text"):
                counts, spans, listed = [], [], []
                for text in batch.column("text").to_pylist():
                    n, merged, ids = scanner.scan(text)
                    at = [m.span() for m in WORD.finditer(text)] if merged else []
                    counts.append(n)
                    spans.append([{"first_word": a, "end_word": b, "first_char": at[a][0], "end_char": at[b - 1][1]} for a, b in merged])
                    listed.append(ids)
                second = batch.column("text_sha") if hits_only else pa.array(counts, pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), second, pa.array(spans, pa.list_(span)), pa.array(listed, pa.list_(pa.int64()))],
                    names=["doc_id", "text_sha" if hits_only else "n_words", "spans", "items"],
                )
                yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if hits_only else out

    return run


def parts(benchmark: DataFrame, most_bytes: int) -> Iterator[list[Item]]:
    """The items, at most most_bytes of text at a time (a longer item is a part of its own)."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len((r.text or "").encode())
        if held and size + n > most_bytes:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    yield held


def _sent(spark: SparkSession, items: list[Item], window: int) -> Broadcast:
    return spark.sparkContext.broadcast((uuid.uuid4().hex, items, window))


def _one_part(benchmark: DataFrame, most_bytes: int) -> list[Item] | None:
    """The whole benchmark, if it is one part."""
    two = parts(benchmark, most_bytes)
    first = next(two)
    return first if next(two, None) is None else None


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, most_bytes: int) -> DataFrame:
    """What each part of the benchmark hits, by doc_id and text. One part is sent at a time."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _sha(F.col("text")).alias("text_sha"))
    out = None
    for items in parts(benchmark, most_bytes):
        sent = _sent(docs.sparkSession, items, window)
        found = common.staged(source.mapInArrow(_scan(sent, True), HIT), "decontamination-hits")
        sent.destroy()
        out = found if out is None else out.union(found)
    return out


def _merged(spans: Column) -> Column:
    """Spans of all parts, in order, those that overlap or touch made one."""

    def add(held: Column, s: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        end = lambda name: F.when(s["end_word"] > last["end_word"], s[name]).otherwise(last[name]).alias(name)
        joined = F.struct(last["first_word"].alias("first_word"), end("end_word"), last["first_char"].alias("first_char"), end("end_char"))
        return F.when(s["first_word"] <= last["end_word"], F.concat(F.slice(held, 1, F.size(held) - 1), F.array(joined))).otherwise(F.concat(held, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as array<{SPAN}>)"), add)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word and character ranges that are hit) and items of each document."""
    whole = _one_part(benchmark, most_bytes)
    if whole is not None:
        return docs.select("doc_id", "text").mapInArrow(_scan(_sent(docs.sparkSession, whole, window), False), FOUND)
    hits = _hits(docs, benchmark, window, most_bytes).groupBy("doc_id", "text_sha").agg(F.collect_set("spans").alias("s"), F.collect_set("items").alias("i"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_sha").alias("hit_sha"), _merged(F.flatten("s")).alias("s"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("i"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count("text", F.lit(WORD_SQL)).cast("long").alias("n"), _sha(F.col("text")).alias("sha"))
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("sha") == F.col("hit_sha")), "left")
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_words"), F.coalesce("s", none(SPAN)).alias("spans"), F.coalesce("i", none("long")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    whole = _one_part(benchmark, most_bytes)
    if whole is not None:
        return docs.mapInArrow(_filter(_sent(docs.sparkSession, whole, window)), docs.schema)
    hits = _hits(docs, benchmark, window, most_bytes).select(F.col("doc_id").alias("hit_id"), F.col("text_sha").alias("hit_sha")).distinct()
    return docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["hit_id"]) & (_sha(docs["text"]) == hits["hit_sha"]), "left_anti")


def _filter(items: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                yield batch.filter(pa.array([not scanner.scan(t)[1] for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda k: array_to_string(list_slice(w, k, k + 9), ' '))) AS s FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.k, p.n, i.item_id FROM p JOIN i ON i.n = p.n AND i.s = array_to_string(list_slice(p.w, p.k, p.k + p.n - 1), ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
