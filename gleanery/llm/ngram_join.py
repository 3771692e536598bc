"""N-gram Jaccard join of documents: exact, with rare-first prefix filtering.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; words end at
ASCII white space; with fewer words, the whole sequence is one). Two documents link
when 100 * intersection >= 80 * union. Documents of one word sequence are one node
(a 64-bit hash), so copies are never expanded into pairs.

1. A scan gives each document's node and set size, and adds every node's shingles to a
   table of 2**22 counters, which orders all shingles by rarity (any order is exact; a
   rare-first one keeps lists short). Tasks' counters are summed as a stream, in two steps.
2. A second scan writes the prefix of each node's ordered set, n - ceil(0.8 n) + 1
   shingles, as packed entries (shingle, node, n, position), dealt by shingle to as many
   buckets as the set sizes of step 1 ask for, and a signature of each node for the
   suffix filter. A bucket that a frequent shingle fills beyond its size is dealt once
   more, by node, and each part of a long list goes on as its head alone.
3. Where entries meet, each list of nodes that share a prefix shingle gives pairs that
   pass the length and the positional filter. A list of more than ``LONG`` nodes gives
   only an edge from each node to the list's smallest; the components of these edges
   are groups, which step 6 works on. (So a list of k copies never gives k * k pairs.)
4. Pairs, once each, meet their signatures: both sets are split at fixed hash pivots, and
   the parts whose parities differ bound the sets' distance from below (suffix filter).
5. A third scan computes the sets of the nodes that are left. Pairs are verified once each.
6. A group is cut into classes of like set size, a factor 1.3 apart, so that only sets of
   one class or of neighbours can link (length filter). Each node is verified against the
   smallest of its class, its base, and each base against the next one. Nodes that link
   with their base are one component, and no pair of them is looked at again. What is
   left, pairs with a node that doesn't link with its base and pairs of neighbour classes
   whose bases don't link, is dealt in blocks of bounded size; each pair meets in one
   task, which counts shared shingles by inverted lists and gives a spanning forest. So no
   link of a group is lost, no pair is verified twice, and no pair leaves its task.
7. Components of all links, by the smallest doc_id.

Cases: a text that is null or has no words has no set, n_shingles 0, and is linked with
nothing; repeated rows and copies share a node; rows of one doc_id with different texts
stay rows of their own, each with its text's component; rows with a null doc_id take no
part in links and have a null component_id; an empty table gives no rows; other columns
are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from ..operators.components import components
from .hashing import hash_runs, mix

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
SKETCH_BITS, CHUNKS = 22, 64
LONG = 32
#: A block holds a sixteenth of its class, but LEAST_BLOCK nodes at least, and BLOCK nodes or BLOCK_BYTES of sets at most.
LEAST_BLOCK, BLOCK, BLOCK_BYTES, SHARES = 32, 512, 2 << 20, 16
BUCKET_BYTES = 4 << 20
CLASS_RATIO = 1.3
SALTS = 32
#: A node is hot from so many pairs on. So many hot nodes are sent to all tasks; with more, adaptive skew joins have to do.
HOT, MOST_HOT = 256, 100_000
MOST_BITMAP_BITS, BITMAP_CHUNK = 27, 17
SLICE = 1 << 19
#: In ENTRY.at: this entry stands for nodes that already have an edge to it.
HEAD = np.uint32(1 << 31)
ENTRY = np.dtype([("s", "<u8"), ("node", "<i8"), ("n", "<u4"), ("at", "<u4")])
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15


def shingles(texts: list[str | None]) -> list[tuple[int, np.ndarray] | None]:
    """(node, sorted hashes of the distinct shingles) of each text, None where there are no words."""
    raw = [(t or "").encode() for t in texts]
    joined = b" ".join(raw) + b" "
    data = np.frombuffer(joined.translate(LOWER), np.uint8)
    inside = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [None] * len(texts)
    word = hash_runs(data, starts, ends)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(starts, bounds)
    counts = np.diff(first)
    place = (np.arange(len(word)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    placed = mix(word + place * np.uint64(0xA0761D6478BD642F))
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(placed, out=sums[1:])
    nodes = mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(counts.astype(np.uint64))).view(np.int64)
    if len(word) >= WORDS:
        many = len(word) - WORDS + 1
        grams = np.zeros(many, np.uint64)
        for k in range(WORDS):
            grams = mix(grams * np.uint64(_BASE) + word[k : k + many])
    out: list[tuple[int, np.ndarray] | None] = []
    for d, (a, n) in enumerate(zip(first[:-1].tolist(), counts.tolist(), strict=True)):
        if not n:
            out.append(None)
        elif n < WORDS:
            out.append((int(nodes[d]), nodes[d : d + 1].view(np.uint64)))
        else:
            s = np.sort(grams[a : a + n - WORDS + 1])
            out.append((int(nodes[d]), s[np.concatenate(([True], s[1:] != s[:-1]))] if n > WORDS else s))
    return out


def need(n: int | np.ndarray) -> int | np.ndarray:
    """The least overlap of a set of n with any set that it links with."""
    return -(-n * NUMERATOR // DENOMINATOR)


def links(n_a, n_b, overlap):
    return overlap * DENOMINATOR >= NUMERATOR * (n_a + n_b - overlap)


def ordered(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set, rarest first; ties by hash."""
    shift = np.uint64(64 - (len(counts).bit_length() - 1))
    return found[np.argsort(counts[found >> shift], kind="stable")]


def signature(found: np.ndarray) -> bytes:
    """Parities of the parts of a set, split at as many fixed pivots as make about one part a shingle."""
    bits = max(6, min(16, int(len(found)).bit_length()))
    part = (found >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=1 << bits).astype(np.uint8) & 1).tobytes()


def least_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(len(y), -1), axis=1)
    return int((x ^ y).sum())


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    common.let_go()
    for whole in batches:
        for batch in common.slices(whole, "text", SLICE):
            yield batch, shingles(batch.column("text").to_pylist())


class _Once:
    """Whether a node is new here; forgets what it knows when it is full."""

    def __init__(self, most: int = 200_000):
        self.seen: set[int] = set()
        self.most = most

    def __call__(self, node: int) -> bool:
        if node in self.seen:
            return False
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen.add(node)
        return True


NODES = "kind int, doc_id long, node long, n int, chunk int, payload binary"


def _table(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def _first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (kind 0), then the task's counters in chunks (kind 1)."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    held, n_held, new = [], 0, _Once()
    shift = np.uint64(64 - SKETCH_BITS)

    def add() -> None:
        at, n = np.unique(np.concatenate(held) >> shift, return_counts=True)
        counts[at.astype(np.int64)] += n.astype(np.uint32)

    for batch, found in _docs(batches):
        for f in found:
            if f and new(f[0]):
                held.append(f[1])
                n_held += len(f[1])
        if n_held > 1 << 20:
            add()
            held, n_held = [], 0
        k = len(found)
        yield _table(NODES, [pa.array([0] * k, pa.int32()), batch.column("doc_id").cast(pa.int64()), pa.array([f and f[0] for f in found], pa.int64()), pa.array([len(f[1]) if f else 0 for f in found], pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())])
    if held:
        add()
    if counts.any():
        parts = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in counts.reshape(CHUNKS, -1)]
        yield _table(NODES, [pa.array([1] * CHUNKS, pa.int32()), *(pa.nulls(CHUNKS, pa.int64()) for _ in "ab"), pa.nulls(CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())])


CHUNK_ROW = "chunk int, payload binary"


def _reduced(kind: str, add: np.ufunc) -> Callable:
    """Streams rows of CHUNK_ROW into one array a chunk, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.let_go()
        total: dict[int, np.ndarray] = {}
        most = np.iinfo(kind).max
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(payload), kind).astype(np.uint64)
                total[chunk] = np.minimum(add(total[chunk], part), most) if chunk in total else part
        yield _table(CHUNK_ROW, [pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.astype(kind).tobytes(), 1) for x in total.values()], pa.binary())])

    return run


def _collected(parts: DataFrame, kind: str, add: np.ufunc, chunks: int, size: int) -> np.ndarray:
    """The arrays of all tasks as one: reduced by chunk and task, then by chunk; `chunks` rows come to the driver."""
    first = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("chunk", "salt").select("chunk", "payload").mapInArrow(_reduced(kind, add), CHUNK_ROW)
    rows = first.repartition("chunk").mapInArrow(_reduced(kind, add), CHUNK_ROW).collect()
    found = {r.chunk: np.frombuffer(zlib.decompress(r.payload), kind) for r in rows}
    none = np.zeros(size, kind)
    return np.concatenate([found.get(k, none) for k in range(chunks)])


def rarity(first: DataFrame) -> np.ndarray:
    """The summed counters: 2**SKETCH_BITS numbers, whatever the size of the input."""
    return _collected(first.where("kind = 1").select("chunk", "payload"), "<u4", np.add, CHUNKS, (1 << SKETCH_BITS) // CHUNKS)


def buckets_for(told: DataFrame) -> int:
    """How many buckets of BUCKET_BYTES the prefixes of all sets fill."""
    prefix = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    total = told.where("n > 0").agg(F.sum(prefix)).first()[0] or 0
    return max(8, -(-int(total) * ENTRY.itemsize // BUCKET_BYTES))


ENTRIES = "bucket int, node long, n int, payload binary"


def _second_scan(counts: Broadcast, buckets: int) -> Callable:
    """Packed prefix entries by bucket, and a signature of each node (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, new = counts.value, _Once()
        held, n_held = [], 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            bucket = (mix(entries["s"]) % np.uint64(buckets)).astype(np.int64)
            at = np.argsort(bucket, kind="stable")
            entries = entries[at]
            which, begin = np.unique(bucket[at], return_index=True)
            ends = [*begin[1:].tolist(), len(entries)]
            parts = [entries[a:b].tobytes() for a, b in zip(begin.tolist(), ends, strict=True)]
            return _table(ENTRIES, [pa.array(which, pa.int32()), pa.nulls(len(which), pa.int64()), pa.nulls(len(which), pa.int32()), pa.array(parts, pa.binary())])

        for _, found in _docs(batches):
            some = [f for f in found if f and new(f[0])]
            for node, s in some:
                n = len(s)
                prefix = ordered(s, order)[: n - need(n) + 1]
                e = np.empty(len(prefix), ENTRY)
                e["s"], e["node"], e["n"], e["at"] = prefix, node, n, np.arange(len(prefix))
                held.append(e)
                n_held += len(e)
            if some:
                k = len(some)
                yield _table(ENTRIES, [pa.array([-1] * k, pa.int32()), pa.array([f[0] for f in some], pa.int64()), pa.array([len(f[1]) for f in some], pa.int32()), pa.array([signature(f[1]) for f in some], pa.binary())])
            if n_held > 1 << 19:
                yield flush()
                held, n_held = [], 0
        if held:
            yield flush()

    return run


PAIRS = "a long, b long, whole boolean"
PARTS = "bucket int, part int, payload binary"


def _dealt_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of full buckets, by node."""
    for batch in batches:
        for bucket, k, payload in zip(batch.column("bucket").to_pylist(), batch.column("k").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            entries = np.frombuffer(payload, ENTRY)
            part = (mix(entries["node"].view(np.uint64)) % np.uint64(k)).astype(np.int64)
            which = np.unique(part).tolist()
            yield _table(PARTS, [pa.array([bucket] * len(which), pa.int32()), pa.array(which, pa.int32()), pa.array([entries[part == x].tobytes() for x in which], pa.binary())])


def thin(entries: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of which each list longer than `long` is its head alone, and edges from the head to the others."""
    entries, begin, size = _lists(entries)
    kept, edges = [entries[:0]], [np.zeros((0, 2), np.int64)]
    for b, m in zip(begin.tolist(), size.tolist(), strict=True):
        own = entries[b : b + m]
        if m > long:
            edges.append(np.stack([np.full(m - 1, own["node"][0]), own["node"][1:]], axis=1))
            own = own[:1].copy()
            own["at"] |= HEAD
        kept.append(own)
    return np.concatenate(kept), _distinct(np.concatenate(edges))


def _thinner(long: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        kept, edges = thin(np.concatenate([np.frombuffer(p, ENTRY) for p in table.column("payload").to_pylist()]), long)
        n = len(edges)
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] + [None] * n, pa.int32()), "payload": pa.array([kept.tobytes()] + [None] * n, pa.binary()), "a": pa.array([None, *edges[:, 0].tolist()], pa.int64()), "b": pa.array([None, *edges[:, 1].tolist()], pa.int64())})

    return run


def _lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by shingle and node, once each, and where each shingle's list begins and how long it is. Heads come before their copies."""
    entries = entries[np.lexsort((~entries["at"], entries["node"], entries["s"]))]
    if not len(entries):
        return entries, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = entries["s"][1:] != entries["s"][:-1]
    entries = entries[np.concatenate(([True], new | (entries["node"][1:] != entries["node"][:-1])))]
    begin = np.flatnonzero(np.concatenate(([True], entries["s"][1:] != entries["s"][:-1])))
    return entries, begin, np.diff(np.append(begin, len(entries)))


def candidates(entries: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Of packed entries: pairs (a < b) of nodes that share a prefix shingle and pass the length and the positional filter, from lists of at most `long` nodes; and edges from longer lists and from those that hold a head."""
    by = np.argsort(entries["s"], kind="stable")
    entries = entries[by]
    same = entries["s"][1:] == entries["s"][:-1]
    entries, begin, size = _lists(entries[np.concatenate(([False], same)) | np.concatenate((same, [False]))])
    headed = np.logical_or.reduceat(entries["at"] >= HEAD, begin) if len(begin) else np.zeros(0, bool)
    whole = (size > long) | (headed & (size > 1))
    pairs, edges = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for m in np.unique(size[(size > 1) & ~whole]).tolist():
        rows = entries[begin[(size == m) & ~whole][:, None] + np.arange(m)]
        i, j = np.triu_indices(m, 1)
        for k in range(0, len(rows), max(1, (1 << 20) // len(i))):
            x, y = rows[k : k + max(1, (1 << 20) // len(i))][:, i].ravel(), rows[k : k + max(1, (1 << 20) // len(i))][:, j].ravel()
            nx, ny, ax, ay = (z.astype(np.int64) for z in (x["n"], y["n"], x["at"], y["at"]))
            most = np.minimum(ax, ay) + np.minimum(nx - ax, ny - ay)  # before, at and after the shared shingle
            fine = links(nx, ny, np.minimum(most, np.minimum(nx, ny)))
            pairs.append(np.stack([x["node"][fine], y["node"][fine]], axis=1))
    for b, m in zip(begin[whole].tolist(), size[whole].tolist(), strict=True):
        node = entries["node"][b : b + m]
        edges.append(np.stack([np.full(m - 1, node[0]), node[1:]], axis=1))
    return _distinct(np.concatenate(pairs)), _distinct(np.concatenate(edges))


def _distinct(pairs: np.ndarray) -> np.ndarray:
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))]


def _meeter(long: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        common.let_go()
        pairs, edges = candidates(np.concatenate([np.frombuffer(p, ENTRY) for p in table.column("payload").to_pylist()]), long)
        both = np.concatenate([pairs, edges])
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1]), "whole": pa.array(np.arange(len(both)) >= len(pairs))})

    return run


def _suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.let_go()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "sig_a", "sig_b")]
        fine = []
        for n_a, n_b, a, b in zip(*columns, strict=True):
            fine.append(bool(links(n_a, n_b, (n_a + n_b - least_distance(a, b)) // 2)))
        kept = batch.filter(pa.array(fine, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


SETS = "node long, members binary"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.column("at").to_numpy()
        for chunk in np.unique(at >> BITMAP_CHUNK).tolist():
            own = at[at >> BITMAP_CHUNK == chunk] & ((1 << BITMAP_CHUNK) - 1)
            chunks.setdefault(chunk, np.zeros(1 << BITMAP_CHUNK, bool))[own] = True
    yield _table(CHUNK_ROW, [pa.array(list(chunks), pa.int32()), pa.array([zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1) for x in chunks.values()], pa.binary())])


def bitmap_bits(n: int) -> int:
    """Bits (a power of two) that mark n ids, 16 bits an id, up to 16 MB; of more than some 30 million, more and more others pass, which a join takes out."""
    return min(MOST_BITMAP_BITS, max(BITMAP_CHUNK, (16 * n).bit_length()))


def bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of hashes of the column `id`: 2**bits bits."""
    at = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("at"))
    return _collected(at.mapInArrow(_marked, CHUNK_ROW), "u1", np.bitwise_or, 1 << (bits - BITMAP_CHUNK), 1 << (BITMAP_CHUNK - 3))


def _third_scan(wanted: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, new = wanted.value, _Once()
        for whole in batches:
            at = whole.column("at").to_numpy()
            whole = whole.filter(pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for _, found in _docs(iter([whole])):
                some = [f for f in found if f and new(f[0])]
                yield _table(SETS, [pa.array([f[0] for f in some], pa.int64()), pa.array([f[1].astype("<u8").tobytes() for f in some], pa.binary())])

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.let_go()
    for whole in batches:
        fine = []
        for i in range(0, whole.num_rows, 256):
            part = whole.slice(i, 256)
            for a, b in zip(part.column("members_a").to_pylist(), part.column("members_b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                fine.append(bool(links(len(x), len(y), overlap(x, y))))
        kept = whole.filter(pa.array(fine, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


def forest(nodes: list[int], sets: list[np.ndarray], right: list[bool] | None = None, label: list[int] | None = None, done: Callable = lambda i, j: False) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets; with `right`, of those between a set that is not right
    and one that is. Each set counts the shingles that it shares with those before it through inverted
    lists, so every pair is decided exactly. Sets of one label are one already; pairs that are done are left out."""
    sizes = np.array([len(s) for s in sets])
    split = right is not None
    right = np.array(right if split else [False] * len(sets), bool)
    order = np.lexsort((np.array(nodes), sizes, right))
    nodes, sets, sizes, right = [nodes[i] for i in order], [sets[i] for i in order], sizes[order], right[order]
    label = [label[i] for i in order] if label is not None else list(range(len(sets)))
    n_left = int((~right).sum())
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.lexsort((owner, token))
    listed = owner[by]  # owners by token, ascending
    begin = np.searchsorted(token[by], np.arange(token.max() + 1))
    rank = np.empty(len(token), np.int64)
    rank[by] = np.arange(len(token))
    if split:  # only owners on the left are counted
        lefts = np.append(0, np.cumsum(listed < n_left))
    ends = np.cumsum(sizes)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i in range(n_left if split else 1, len(sets)):
        own = slice(ends[i] - sizes[i], ends[i])
        a = begin[token[own]]
        n = lefts[rank[own]] - lefts[a] if split else rank[own] - a  # how many owners before it each token has
        total = int(n.sum())
        if not total:
            continue
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        most = n_left if split else i
        shared = np.bincount(listed[at], minlength=most)[:most]
        for j in np.flatnonzero(links(sizes[:most], sizes[i], shared)).tolist():
            x, y = root(label[i]), root(label[j])
            if x != y and not done(nodes[i], nodes[j]):
                parent[max(x, y)] = min(x, y)
                out.append((nodes[i], nodes[j]))
    return out


def _links_table(found: list[tuple[int, int]]) -> pa.Table:
    edges = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})


def _verify_star(table: pa.Table) -> pa.Table:
    """Links of the base with the other nodes of a block: length filter, suffix filter, then the sets."""
    common.let_go()
    rows = list(zip(table.column("node").to_pylist(), [np.frombuffer(s, "<u8") for s in table.column("members").to_pylist()], table.column("is_base").to_pylist(), strict=True))
    out = []
    for base, b, _ in (r for r in rows if r[2]):
        sig = signature(b)
        for node, x, is_base in rows:
            if is_base or not links(len(b), len(x), min(len(b), len(x))) or not links(len(b), len(x), (len(b) + len(x) - least_distance(sig, signature(x))) // 2):
                continue
            if links(len(b), len(x), overlap(b, x)):
                out.append((base, node))
    return _links_table(out)


def _verify_block(table: pa.Table) -> pa.Table:
    """Links between the two sides of a task, or within its one side. Pairs with a base of the same class, and of
    the bases of two neighbour classes, have been verified before."""
    one = all(table.column(x + "1")[0] == table.column(x + "2")[0] for x in "cp") and table.column("i")[0] == table.column("j")[0]
    nodes, right = table.column("node").to_pylist(), None if one else table.column("right").to_pylist()
    sets = [np.frombuffer(s, "<u8") for s in table.column("members").to_pylist()]
    base = dict(zip(nodes, table.column("is_base").to_pylist(), strict=True))
    cls = dict(zip(nodes, table.column("class").to_pylist(), strict=True))
    core = table.column("core").to_pylist()
    heads: dict[int, int] = {}  # of each class: a node of the core stands for all of it
    label = [heads.setdefault(cls[x], x) if c else x for x, c in zip(nodes, core, strict=True)]
    done = lambda x, y: (base[x] or base[y]) and (cls[x] == cls[y] or (base[x] and base[y]))
    return _links_table(forest(nodes, sets, right, label, done))


def _salted_join(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """rows (with a column node, many of one key) with the one or few rows of table of each key: the key is salted by node."""
    salted = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def _hot(ends: DataFrame, most: int = 0) -> DataFrame | None:
    """The values of the column node that stand in many rows, a table of bounded size; None if there are none, or too many for that."""
    counts = ends.where("node is not null").groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > (most or HOT))
    found = [(r.node,) for r in counts.limit(MOST_HOT + 1).collect()]
    return F.broadcast(ends.sparkSession.createDataFrame(found, "node long")) if 0 < len(found) <= MOST_HOT else None


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _joined(rows: DataFrame, table: DataFrame, key: str, spread: str, hot: DataFrame | None) -> DataFrame:
    """rows with the columns of the one row of table of each key. Rows of a hot key are dealt over SALTS tasks by the column `spread`, and the key's row is there in each."""
    if hot is None:
        return rows.join(table, key)
    mark = hot.select(F.col("node").alias(key), F.lit(True).alias("hot"))
    rows = rows.join(mark, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(table.join(mark, key, "left").withColumn("salt", F.explode(copies)).drop("hot"), [key, "salt"]).drop("salt")


def _both_ends(pairs: DataFrame, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """pairs with the columns of table (node, ...) for a and for b."""
    for side, other in (("a", "b"), ("b", "a")):
        rows = table.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in table.columns if c != "node"))
        pairs = _joined(pairs, rows, side, other, hot)
    return pairs


def _blocks() -> Column:
    n = F.count("*")
    return F.greatest(F.least(F.lit(SHARES), F.ceil(n / F.lit(LEAST_BLOCK))), F.ceil(n / F.lit(BLOCK)), F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES))).cast("int")


def _at(k: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(k)).cast("int")


def star_tasks(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups: g, node, n, class. The classes (g, class, base, next base), and the rows g, class, i, node, is_base of
    tasks: each holds some nodes of a class and its base. The next class's base is a node of the first task."""
    classes = groups.groupBy("g", "class").agg(F.min("node").alias("base"), _blocks().alias("k"))
    up = classes.select("g", (F.col("class") - 1).alias("class"), F.col("base").alias("next_base"))
    classes = classes.join(up, ["g", "class"], "left")
    nodes = _salted_join(groups.select("g", "class", "node"), classes, ["g", "class"]).where("node <> base").select("g", "class", _at("k").alias("i"), "node", F.lit(False).alias("is_base"))
    bases = classes.select("g", "class", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), F.col("base").alias("node"), F.lit(True).alias("is_base"))
    ups = classes.where("next_base is not null").select("g", "class", F.lit(0).alias("i"), F.col("next_base").alias("node"), F.lit(False).alias("is_base"))
    return classes.drop("k"), nodes.union(bases).union(ups)


def block_tasks(groups: DataFrame, classes: DataFrame, stars: DataFrame) -> DataFrame:
    """What the stars (a, b: links with bases) leave: rows of tasks, each the two sides of a pair of blocks of one class or
    of neighbours, or the one side of a block with itself. No task has a core on both sides of one class, or of two whose bases link."""
    bases = classes.select(F.col("base").alias("node")).distinct()
    linked = stars.select(F.col("b").alias("node")).join(bases, "node", "left_anti").withColumn("linked", F.lit(True))
    nodes = groups.join(linked, "node", "left").join(bases.withColumn("is_base", F.lit(True)), "node", "left")
    nodes = nodes.select("g", "node", "n", "class", F.coalesce("is_base", F.lit(False)).alias("is_base"), (F.coalesce("linked", F.lit(False)) | F.coalesce("is_base", F.lit(False))).alias("core"))
    joined = classes.join(stars.select(F.col("a").alias("base"), F.col("b").alias("next_base"), F.lit(True).alias("up")), ["base", "next_base"], "left").select("g", "class", F.coalesce("up", F.lit(False)).alias("up"))
    parts = nodes.groupBy("g", "class", "core").agg(_blocks().alias("k")).join(joined, ["g", "class"])
    x = parts.select("g", F.col("class").alias("c1"), F.col("core").alias("p1"), F.col("k").alias("k1"), "up")
    y = parts.select("g", F.col("class").alias("c2"), F.col("core").alias("p2"), F.col("k").alias("k2"))
    both = F.col("p1") & F.col("p2")
    near = (F.col("c1") == F.col("c2")) & ~both & (F.col("p1") <= F.col("p2")) | (F.col("c2") == F.col("c1") + 1) & ~(both & F.col("up"))
    wanted = x.join(y, "g").where(near).select("g", "c1", "p1", "k1", "c2", "p2", "k2", ((F.col("c1") == F.col("c2")) & (F.col("p1") == F.col("p2"))).alias("self"))
    key = ["g", "c1", "p1", "c2", "p2", "i", "j"]
    rest = ["node", "class", "is_base", "core"]
    own = lambda c, p: nodes.withColumns({c: F.col("class"), p: F.col("core")})
    left = _salted_join(own("c1", "p1"), wanted, ["g", "c1", "p1"]).withColumn("i", _at("k1"))
    left = left.withColumn("j", F.explode(F.sequence(F.when(F.col("self"), F.col("i")).otherwise(F.lit(0)), F.col("k2") - 1)))
    right = _salted_join(own("c2", "p2"), wanted, ["g", "c2", "p2"]).withColumn("j", _at("k2")).where("not self or j > 0")
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("self"), F.col("j") - 1).otherwise(F.col("k1") - 1))))
    return left.select(*key, *rest, F.lit(False).alias("right")).union(right.select(*key, *rest, F.lit(True).alias("right")))


TASK = ["g", "c1", "p1", "c2", "p2", "i", "j"]


def _thinned(second: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Entries by bucket, full buckets thinned, and the edges that this gives."""
    entries = second.where("bucket >= 0").select("bucket", "payload")
    sizes = entries.groupBy("bucket").agg(F.sum(F.octet_length("payload")).alias("size")).where(F.col("size") > 4 * BUCKET_BYTES)
    if sizes.isEmpty():
        return entries, None
    full = sizes.select("bucket", F.ceil(F.col("size") / BUCKET_BYTES).cast("int").alias("k"))
    again = entries.join(full, "bucket").mapInArrow(_dealt_again, PARTS)
    thin_ = common.staged(again.groupBy("bucket", "part").applyInArrow(_thinner(LONG), "bucket int, payload binary, a long, b long"), "ngram-thinned")
    left = entries.join(full, "bucket", "left_anti").union(thin_.where("bucket is not null").select("bucket", "payload"))
    return left, thin_.where("a is not null").select("a", "b")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, node, n) and all links needed to connect nodes (a, b). docs: doc_id, text."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = common.staged(source.mapInArrow(_first_scan, NODES), "ngram-nodes")
    told = first.where("kind = 0").select("doc_id", "node", "n")

    second = source.where("doc_id is not null").mapInArrow(_second_scan(sc.broadcast(rarity(first)), buckets_for(told)), ENTRIES)
    second = common.staged(second, "ngram-entries")
    entries, thinned = _thinned(second)
    met = entries.groupBy("bucket").applyInArrow(_meeter(LONG), PAIRS).distinct()
    met = common.staged(met if thinned is None else met.union(thinned.select("a", "b", F.lit(True).alias("whole"))), "ngram-candidates")

    marks = second.where("bucket = -1").select("node", "n", F.col("payload").alias("sig")).dropDuplicates(["node"])
    found = components(met.where("whole").select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("v").alias("g"), F.col("u").alias("node"))
    groups = found.union(found.select("g", F.col("g").alias("node")).distinct()).join(marks.select("node", "n"), "node")
    groups = common.staged(groups.select("g", "node", "n", F.floor(F.log("n") / F.log(F.lit(CLASS_RATIO))).cast("int").alias("class")), "ngram-groups")
    inside = lambda x: groups.select(F.col("node").alias(x), F.col("g").alias(f"g_{x}"))
    pairs = met.where("not whole").select("a", "b").join(inside("a"), "a", "left").join(inside("b"), "b", "left")
    apart = common.staged(pairs.where("g_a is null or g_b is null or g_a <> g_b").select("a", "b"), "ngram-apart")  # the rest is in a group
    hot = _hot(_ends(apart))
    pairs = common.staged(_both_ends(apart, marks, hot).mapInArrow(_suffix_filter, "a long, b long"), "ngram-pairs")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(groups.select("node")).distinct()
    least = told.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("id"))
    ids = common.staged(least.join(wanted, "node", "left_semi").select("node", "id"), "ngram-wanted")
    bits = bitmap_bits(ids.count())
    scanned = source.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("at"))
    sets = scanned.mapInArrow(_third_scan(sc.broadcast(bitmap(ids.select("id"), bits))), SETS).join(ids.select("node"), "node", "left_semi")
    sets = common.staged(sets.dropDuplicates(["node"]), "ngram-sets")

    linked = _both_ends(pairs, sets, hot).mapInArrow(_verify_pairs, "a long, b long")
    classes, tasks = star_tasks(groups)
    stars = common.staged(tasks.join(sets, "node").groupBy("g", "class", "i").applyInArrow(_verify_star, "a long, b long"), "ngram-stars")
    rest = block_tasks(groups, classes, stars).join(sets, "node").groupBy(*TASK).applyInArrow(_verify_block, "a long, b long")
    links_ = common.staged(linked.union(stars).union(rest), "ngram-links")
    common.discard(second, met, groups, apart, pairs, ids, sets, stars)
    return told, links_


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document."""
    told, found = find(docs)
    least = told.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("id"))
    ends = _both_ends(found, least, _hot(_ends(found)))
    reached = components(ends.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))).select(F.col("u").alias("id"), F.col("v").alias("component"))
    named = least.join(reached, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    whole = told.where("node is not null and doc_id is not null")
    rows = _joined(whole, named, "node", "doc_id", _hot(whole))  # many copies of one text share a node
    alone = told.where("node is null or doc_id is null").withColumn("component", F.col("doc_id"))
    return rows.unionByName(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns; and all documents
    without an id. Rows that share the kept doc_id are one document and stay together."""
    first = join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(first, docs["doc_id"] == first["kept_id"], "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM e JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
t(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, t.c FROM t JOIN l ON l.a = t.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(t.c) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN t ON t.v = d.doc_id GROUP BY 1, 2
"""
