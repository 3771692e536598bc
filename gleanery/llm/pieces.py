"""SentencePiece encoding of whole texts with the original bytes of every piece, and decoding.

The model file gives the pieces and the compiled character map: a double-array trie
of byte strings and their replacements. A text is normalised through the longest prefix
that the trie holds at each place, spaces become the space sign, and each normalised byte
keeps the place of the original byte that it comes from. Byte-pair merges then run on
units: stretches that end before a space sign, if no piece holds one behind another character, and in
them on runs that end where two characters stand side by side in no piece, since no merge
crosses such a place. A worker keeps the pieces of the units that it has met, known by a
64-bit hash, up to a number of them. Piece ends in normalised bytes are projected through
the kept places, which gives spans of original bytes; those of a text's pieces follow each
other without gaps. A byte piece spans its byte; where a replacement made several, the
last one gets all.

Ids become texts with the sentencepiece library's decode; a very long list is decoded in
parts behind a piece whose text is taken off again, cut where no byte pieces meet.

Handled are BPE models of normal, byte, control and unknown pieces; one with user-defined or unused
pieces, or of another kind, is an error.

Cases: a null text counts as empty and gives no pieces; a null doc_id stays null and
rows that repeat are encoded each; a text of a few MB is encoded as one slice; an empty
table gives no rows; other columns are left out, also those named like a result.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import vocabulary_path
from .hashing import HashTable, hash_runs

FILE = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
DECODED_AT_ONCE = 1 << 18
RESULT = "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
        yield key >> 3, raw[at : at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacements of byte strings, from a compiled map: the trie's bytes, the trie, texts that end in a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if size else ()
        self.texts = compiled[4 + size :]
        first = bytes(b for b in range(256) if self.units and self._step(self._child(0), b) is not None)
        self.candidate = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in first) + b"]") if first else None

    def _child(self, node: int) -> int:
        """Where the node's children stand."""
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & (1 << 31 | 255) == byte else None

    def longest(self, raw: bytes, at: int, end: int) -> tuple[int, bytes] | None:
        """Where the longest known string from `at` ends, and what replaces it."""
        base, found = self._child(0), None
        for i in range(at, end):
            node = self._step(base, raw[i])
            if node is None:
                break
            base = self._child(node)
            if self.units[node] >> 8 & 1:
                start = self.units[base] & ((1 << 31) - 1)
                found = i + 1, self.texts[start : self.texts.index(b"\0", start)]
        return found

    def spots(self, raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        """Start, end and replacement of what changes in raw[at:end]."""
        while self.candidate and (met := self.candidate.search(raw, at, end)):
            at = met.start()
            found = self.longest(raw, at, end)
            if found:
                yield at, *found
                at = found[0]
            else:
                at += 1
                while at < end and raw[at] & 0xC0 == 0x80:
                    at += 1


class PieceModel:
    """What a model file says: pieces, scores and how texts are normalised."""

    def __init__(self, raw: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer |= dict(_fields(value))
            elif number == 3:
                normaliser |= dict(_fields(value))
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models without user-defined or unused pieces are handled")
        texts = [p[1].decode() for p in pieces]
        self.scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        self.numbers = {t: i for i, (t, kind) in enumerate(zip(texts, kinds, strict=True)) if kind == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = [i for i, kind in enumerate(kinds) if kind == BYTE] if trainer.get(35) else []
        self.is_byte = np.array([kind == BYTE for kind in kinds])
        self.map = CharacterMap(normaliser.get(2, b""))
        self.prefix, self.tidy, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        pairs = {t[i : i + 2] for t in self.numbers for i in range(len(t) - 1)}
        self.spaced = self.escape and not any(p[1] == SPACE and p[0] != SPACE for p in pairs)
        self.pair_keys = np.array(sorted(ord(p[0]) << 32 | ord(p[1]) for p in pairs), np.int64)
        self.piece_bytes = np.array([len(t.encode()) for t in texts])
        self._compile_merges()

    def _compile_merges(self) -> None:
        """Symbols are pieces, by number, and characters that are none, behind them. A merge is a pair of symbols that make a piece."""
        n = len(self.scores)
        self.symbol_of = n + np.arange(0x110000)
        for text, i in self.numbers.items():
            if len(text) == 1:
                self.symbol_of[ord(text)] = i
        symbol = lambda t: self.numbers.get(t, n + ord(t) if len(t) == 1 else None)
        places = {score: k for k, score in enumerate(sorted(set(self.scores), reverse=True))}
        found = sorted((a << 32 | b, i) for text, i in self.numbers.items() for k in range(1, len(text)) if (a := symbol(text[:k])) is not None and (b := symbol(text[k:])) is not None)
        self.merge_keys = np.array([k for k, _ in found] or [-1], np.int64)
        self.merge_results = np.array([i for _, i in found] or [0])
        self.merge_ranks = np.array([places[self.scores[i]] for _, i in found] or [0])
        self.merges = {(k >> 32, k & 0xFFFFFFFF): m for m, (k, _) in enumerate(found)}

    def normalised(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts that stand in raw from bounds[k] to bounds[k + 1]: their normalised bytes in a row, the place in raw of each, and the new bounds.
        A place more stands behind the last byte of each text: places of text k are those from bounds[k] + k."""
        data, source = np.frombuffer(raw, np.uint8), np.arange(len(raw))
        if self.map.candidate:
            data, source, bounds = self._mapped(raw, bounds)
        upto = np.append(source, len(raw))[bounds] if len(bounds) else bounds
        full = np.diff(np.append(0, np.cumsum(data != 32))[bounds] if self.tidy else bounds) > 0
        if self.tidy:
            data, source, bounds, stop = self._tidied(data, source, bounds, upto)
        else:
            stop = upto[1:].copy()
        if self.prefix:
            full = full if self.suffix else np.diff(bounds) > 0
            at = bounds[1:][full] if self.suffix else bounds[:-1][full]
            places = stop[full] if self.suffix else source[at]
            data, source = np.insert(data, at, 32), np.insert(source, at, places)
            bounds = bounds + np.append(0, np.cumsum(full))
        if self.escape:
            size = np.where(data == 32, 3, 1)
            start = np.append(0, np.cumsum(size))
            spaces = start[:-1][data == 32]
            data, source = np.repeat(data, size), np.repeat(source, size)
            for k, byte in enumerate(SPACE.encode()):
                data[spaces + k] = byte
            bounds = start[bounds]
        return data, np.insert(source, bounds[1:], stop), bounds

    def _mapped(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, source, sizes = [], [], []
        whole, places = np.frombuffer(raw, np.uint8), np.arange(len(raw))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at, n = a, 0
            for start, end, text in [*self.map.spots(raw, a, b), (b, b, b"")]:
                data += [whole[at:start], np.frombuffer(text, np.uint8)]
                source += [places[at:start], np.full(len(text), start)]
                n += start - at + len(text)
                at = end
            sizes.append(n)
        return np.concatenate([*data, whole[:0]]), np.concatenate([*source, places[:0]]), np.append(0, np.cumsum(sizes)).astype(np.int64)

    def _tidied(self, data: np.ndarray, source: np.ndarray, bounds: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Without spaces at either end or behind another; the place behind a text is that of the spaces taken off its end."""
        space = data == 32
        keep = ~(space & np.append(True, space[:-1])[: len(space)])
        first = bounds[:-1][np.diff(bounds) > 0]
        keep[first] = ~space[first]
        stop = upto[1:].copy()
        sign = SPACE.encode()
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            while b > a:
                if space[b - 1] or not keep[b - 1]:
                    n = 1
                elif self.escape and b - a >= 3 and data[b - 3 : b].tobytes() == sign:
                    n = 3
                else:
                    break
                if keep[b - n]:
                    stop[k] = source[b - n]
                b -= n
                keep[b : b + n] = False
        upto = np.append(0, np.cumsum(keep))
        return data[keep], source[keep], upto[bounds], stop

    def merged(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths in bytes of the pieces of normalised units in a row, and the number of pieces of each. Units are
        cut into runs at pairs that no piece holds; runs of one width merge together, a pair a run at a time, and long ones by a heap."""
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        bounds = np.append(0, np.cumsum([len(u) for u in units]))
        symbols = self.symbol_of[points]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~_within(self.pair_keys, points[:-1] << 32 | points[1:])
        cut[bounds] = True
        starts = np.flatnonzero(cut[:-1])
        lengths = np.diff(np.append(starts, len(points)))
        left = np.ones(len(points), bool)  # symbols that remain at their first character's place
        for wide in (2, 4, 8, 16, 32, 64):
            rows = np.flatnonzero((lengths > wide // 2) & (lengths <= wide) & (lengths > 1))
            for i in range(0, len(rows), 1 << 14):
                self._merge_rows(symbols, left, starts[rows[i : i + (1 << 14)]], lengths[rows[i : i + (1 << 14)]], wide)
        for k in np.flatnonzero(lengths > 64).tolist():
            self._merge_long(symbols, left, int(starts[k]), int(lengths[k]))
        found = symbols[left]
        known = found < len(self.scores)
        chars = np.where(known, 0, found - len(self.scores))
        in_bytes = np.where(known, self.piece_bytes[np.where(known, found, 0)], 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))
        copies = np.where(known, 1, in_bytes) if self.bytes else np.ones(len(found), np.int64)
        ids, sizes, plain = np.repeat(np.where(known, found, self.unknown), copies), np.repeat(in_bytes, copies), np.repeat(known, copies)
        if self.bytes:
            raw = np.frombuffer("".join(map(chr, chars[~known].tolist())).encode(), np.uint8)
            ids[~plain], sizes[~plain] = np.array(self.bytes)[raw], 1
        return ids, sizes, np.diff(np.append(0, np.cumsum(copies))[np.append(0, np.cumsum(left))[bounds]])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place in merges of each pair of symbols; the number of merges where there is none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == keys, at, len(self.merge_keys))

    def _merge_rows(self, symbols: np.ndarray, left: np.ndarray, starts: np.ndarray, lengths: np.ndarray, wide: int) -> None:
        """Merges runs of up to `wide` symbols in place: each step takes the best pair of every run, the leftmost of equals."""
        place = np.arange(wide)
        inside = place < lengths[:, None]
        at = np.where(inside, starts[:, None] + place, 0)
        now = np.where(inside, symbols[at], -1)
        best_of = np.append(self.merge_ranks, np.iinfo(np.int64).max)
        merge = self._ranks(now[:, :-1], now[:, 1:])
        rows = np.arange(len(now))
        while len(rows):
            rank = best_of[merge[rows]]
            best = rank.argmin(axis=1)
            going = rank[np.arange(len(rows)), best] < best_of[-1]
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            left[at[rows, best + 1]] = False
            now[rows, best] = self.merge_results[merge[rows, best]]
            take = np.minimum(place + (place > best[:, None]), wide - 1)
            now[rows] = np.take_along_axis(now[rows], take, 1)
            at[rows] = np.take_along_axis(at[rows], take, 1)
            now[rows, -1] = -1
            shifted = np.take_along_axis(merge[rows], np.minimum(take[:, :-1], wide - 2), 1)
            shifted[:, -1] = len(self.merge_keys)
            shifted[np.arange(len(rows)), best] = self._ranks(now[rows, best], now[rows, np.minimum(best + 1, wide - 1)])
            inner = np.flatnonzero(best > 0)
            shifted[inner, best[inner] - 1] = self._ranks(now[rows[inner], best[inner] - 1], now[rows[inner], best[inner]])
            merge[rows] = shifted
        keep = now >= 0
        symbols[at[keep]] = now[keep]

    def _merge_long(self, symbols: np.ndarray, left: np.ndarray, start: int, length: int) -> None:
        """One run with a heap of its pairs."""
        parts: list[int | None] = symbols[start : start + length].tolist()
        after, before = list(range(1, length + 1)), list(range(-1, length - 1))
        ranks = self._ranks(symbols[start : start + length - 1], symbols[start + 1 : start + length])
        heap = [(int(self.merge_ranks[m]), i, int(m)) for i, m in enumerate(ranks.tolist()) if m < len(self.merge_keys)]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < length and (m := self.merges.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(heap, (int(self.merge_ranks[m]), i, m))

        while heap:
            _, i, m = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= length or self.merges.get((parts[i], parts[j])) != m:
                continue  # one side has been merged meanwhile
            parts[i], parts[j] = int(self.merge_results[m]), None
            after[i] = after[j]
            if after[i] < length:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        stay = np.array([p is not None for p in parts])
        left[start : start + length] = stay
        symbols[start + np.flatnonzero(stay)] = [p for p in parts if p is not None]


def _within(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


class PieceEncoder:
    """Encodes lists of texts. most_units: of the cache."""

    def __init__(self, path: str, most_units: int = 500_000):
        with open(path, "rb") as f:
            raw = f.read()
        import sentencepiece

        self.model = PieceModel(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.lead = next((i for t, i in self.model.numbers.items() if t.isascii() and t.isalpha()), None)
        self.lead_text = self.library.decode([self.lead]) if self.lead is not None else ""
        self.most_units = most_units
        self.table = HashTable(21)
        self.forget()

    def forget(self) -> None:
        self.table.clear()
        self.ids, self.sizes = (np.zeros(1 << 16, np.int32) for _ in range(2))
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, units: list[str], hashes: np.ndarray) -> None:
        ids, sizes, counts = self.model.merged(units)
        n, k, more = self.table.n, len(units), int(counts.sum())
        while self.used + more > len(self.ids):
            self.ids, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.sizes))
        while n + k > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.ids[self.used : self.used + more], self.sizes[self.used : self.used + more] = ids, sizes
        self.starts[n : n + k], self.counts[n : n + k] = self.used + np.cumsum(counts) - counts, counts
        self.used += more
        self.table.add(hashes)

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the units: of texts and, where no merge crosses them, of space signs behind another character."""
        cut = np.zeros(len(data) + 1, bool)
        if self.model.spaced and len(data) >= 3:
            a, b, c = SPACE.encode()
            sign = np.zeros(len(data), bool)
            sign[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            cut[:-1] = sign
            cut[3:-1] &= ~sign[:-3]
        cut[bounds] = True
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the number of ids of each, and the start and end of each piece in the bytes of its text."""
        encoded = [t.encode() for t in texts]
        raw, begins = b"".join(encoded), np.append(0, np.cumsum([len(e) for e in encoded])).astype(np.int64)
        data, places, bounds = self.model.normalised(raw, begins)
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, np.zeros(len(texts), np.int64), none, none
        starts = self._cuts(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes = hash_runs(data, starts, ends)
        if self.table.n > self.most_units or not self.table.room(len(hashes)):
            self.forget()
        codes = self.table.find(hashes)
        new = np.flatnonzero(codes < 0)
        if len(new):
            fresh, first = np.unique(np.maximum(hashes[new], np.uint64(1)), return_index=True)
            at, joined = new[first], data.tobytes()
            self._learn([joined[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], fresh)
            codes[new] = self.table.find(hashes[new])
        counts = self.counts[codes]
        upto = np.append(0, np.cumsum(counts))
        at = np.arange(int(upto[-1])) + np.repeat(self.starts[codes] - upto[:-1], counts)
        per_text = np.diff(upto[np.searchsorted(starts, bounds)])
        text = np.repeat(np.arange(len(texts)), per_text)
        ids, stop = self.ids[at], np.cumsum(self.sizes[at], dtype=np.int64)
        begin = stop - self.sizes[at]
        if not self.model.bytes:  # neighbours that are unknown are one
            again = np.append(False, (ids[1:] == self.model.unknown) & (ids[:-1] == self.model.unknown) & (text[1:] == text[:-1]))
            ids, text, begin, stop = ids[~again], text[~again], begin[~again], stop[np.append(~again[1:], True)]
            per_text = np.bincount(text, minlength=len(texts))
        return ids, per_text, places[begin + text] - begins[text], places[stop + text] - begins[text]

    def decode(self, ids: np.ndarray, at_once: int = DECODED_AT_ONCE) -> str:
        if len(ids) <= at_once or self.lead is None:
            return self.library.decode(ids.tolist())
        out, at = [], 0
        while at < len(ids):
            end = min(len(ids), at + at_once)
            while end < len(ids) and (self.model.is_byte[ids[end]] and self.model.is_byte[ids[end - 1]]):
                end += 1
            out.append(self.library.decode(ids[at:end].tolist()) if not at else self.library.decode([self.lead, *ids[at:end].tolist()])[len(self.lead_text) :])
            at = end
        return "".join(out)


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker."""
    return common.kept(("pieces", path), lambda: PieceEncoder(path))


def _encoding(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids, counts, starts, ends = tool.encode(texts)
                upto = np.append(0, np.cumsum(counts))
                lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, starts, ends)]
                decoded = pa.array([tool.decode(ids[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists, decoded], names=["doc_id", "ids", "starts", "ends", "decoded"])

    return run


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts and ends (bytes of the UTF-8 text, ends behind the last) of the pieces of every whole text, and the decoded text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoding(path or vocabulary_path(FILE)), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(common.table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
