"""Token ids of whole texts by a public tokenizer, with a bounded cache of text units.

A unit is a piece of text at whose ends the tokenizer always cuts, whatever stands
around it, so the ids of a text are those of its units in a row. Cuts are found on
UTF-8 bytes, and only where they are sure; where one is not, the unit is longer:

* before a full stop or comma that follows an ASCII or Latin letter;
* byte-level files: before a space, and around a line feed, that stand alone between
  two printable ASCII or Latin characters;
* files whose words end in ``</w>``: at ASCII white space, which has no tokens.

Units are known by a 64-bit hash. Strings of special tokens inside a text are ordinary
text. A text of more than ``LONG`` characters is taken in parts, cut before a space
between ASCII letters.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import kept
from .hashing import HashTable, hash_runs

LONG = 1 << 20
SURE_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")
PLAIN = re.compile(r" ?[A-Za-z]+").fullmatch
#: Classes of bytes: 1 ASCII letter, 2 other printable ASCII, 3 full stop or comma, 4 space, 5 line feed,
#: 6 other ASCII white space, 7 first byte of a Latin letter (U+00C0 to U+027F, with two signs), 8 later byte, 0 the rest.
CLASS = np.array([
    4 if c == 32 else 5 if c == 10 else 6 if 9 <= c <= 13 else 3 if c in b".," else 1 if chr(c).isalpha() and c < 128
    else 2 if 33 <= c <= 126 else 8 if 128 <= c < 192 else 7 if 195 <= c <= 201 else 0 for c in range(256)
], np.uint8)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _units(data: np.ndarray, bounds: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of texts that stand in data from bounds[k] to bounds[k + 1]."""
    n = len(data)
    kind = CLASS[data]
    latin = np.zeros(n, bool)  # the second byte of a Latin character
    latin[1:] = (kind[1:] == 8) & (kind[:-1] == 7)
    sign = np.zeros(n, bool)  # of the two that are no letters, and of the one whose lower case ends in a mark
    sign[1:] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    letter_end = (kind == 1) | (latin & ~sign)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (kind[1:] == 3) & letter_end[:-1]
    cut[bounds] = True
    if spaced:
        shown = (kind >= 1) & (kind <= 3)
        before, after = shown | latin, shown | (kind == 7)
        alone = np.zeros(n, bool)
        alone[1:-1] = before[:-2] & after[2:]
        cut[:n] |= alone & ((kind == 4) | (kind == 5))
        cut[1:] |= alone & (kind == 5)
        cut[n] = True
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]
    blank = np.concatenate(([True], (kind >= 4) & (kind <= 6), [True]))
    starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | cut[:n]))
    ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | cut[1:])) + 1
    return starts, ends


class UnitEncoder:
    """Encodes lists of texts. most_units: of the cache."""

    def __init__(self, path: str, most_units: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most_units = most_units
        size = self.tokenizer.get_vocab_size()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.spaced = sum(t.endswith("</w>") for t in tokens) < size // 4
        self.edge = np.array([t.startswith("Ġ") if self.spaced else t.endswith("</w>") for t in tokens])
        self.token_bytes = np.array([len(t) for t in tokens])  # of byte-level files, whose tokens write each byte as one character
        self.table = HashTable(21)
        self.forget()

    def forget(self) -> None:
        self.table.clear()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = self.table.n, len(hashes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + k > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + k] = lengths
        self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.table.add(hashes)

    def _learn(self, units: list[str], hashes: np.ndarray) -> None:
        """New units. Words are encoded together, since their tokens show where each begins or ends."""
        lead = " " if self.spaced else ""
        is_word = np.array([PLAIN(u) is not None and u.startswith(lead) for u in units], bool)
        words = [units[i] for i in np.flatnonzero(is_word).tolist()]
        rows = [words[i : i + 256] for i in range(0, len(words), 256)]
        joined = self.tokenizer.encode_batch_fast([("" if self.spaced else " ").join(r) for r in rows], add_special_tokens=False)
        ids, lengths = [], []
        for row, e in zip(rows, joined, strict=True):
            own = np.array(e.ids, np.uint32)
            at = np.flatnonzero(self.edge[own])
            if len(at) != len(row):  # a tokenizer that doesn't mark words so
                one = [x.ids for x in self.tokenizer.encode_batch_fast(row, add_special_tokens=False)]
                own, size = np.array(list(chain.from_iterable(one)), np.uint32), np.array([len(x) for x in one])
            else:
                size = np.diff(np.append(at, len(own))) if self.spaced else np.diff(np.append(-1, at))
            ids.append(own)
            lengths.append(size)
        other = [units[i] for i in np.flatnonzero(~is_word).tolist()]
        one = [x.ids for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)] if other else []
        ids.append(np.fromiter(chain.from_iterable(one), np.uint32))
        lengths.append(np.array([len(x) for x in one], np.int64))
        self._add(np.concatenate([hashes[is_word], hashes[~is_word]]), np.concatenate(ids), np.concatenate(lengths))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        if any(len(t) > LONG for t in texts):
            return self._encode_long(texts)
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        joined = b"".join(raw)
        bounds = np.cumsum([0, *map(len, raw)])
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(joined, np.uint8)
        starts, ends = _units(data, bounds, self.spaced)
        hashes = hash_runs(data, starts, ends)
        if self.table.n > self.most_units or not self.table.room(len(hashes)):
            self.forget()
        codes = self.table.find(hashes)
        new = np.flatnonzero(codes < 0)
        if len(new):
            fresh, first = np.unique(np.maximum(hashes[new], np.uint64(1)), return_index=True)
            at = new[first]
            self._learn([joined[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], fresh)
            codes[new] = self.table.find(hashes[new])
        lengths = self.lengths[codes].astype(np.int64)
        upto = np.append(0, np.cumsum(lengths))
        at = np.arange(int(upto[-1])) + np.repeat(self.starts[codes] - upto[:-1], lengths)
        return self.ids[at], np.diff(upto[np.searchsorted(starts, bounds)])

    def _encode_long(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], []
        for text in texts:
            at, n = 0, 0
            while at < len(text):
                found = SURE_CUT.search(text, at + LONG - 2) if len(text) - at > LONG else None
                end = found.end() if found else len(text)
                own, _ = self._encode([text[at:end]])
                ids.append(own)
                n += len(own)
                at = end
            counts.append(n)
        return np.concatenate(ids), np.array(counts, np.int64)


def encoder(path: str) -> UnitEncoder:
    """One for each Python worker."""
    return kept(path, lambda: UnitEncoder(path))
