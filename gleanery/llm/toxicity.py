"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words (runs of letters and digits, lower-cased) are cut into windows of
``WINDOW`` words, one every ``STRIDE`` words, so that each word lies in two windows and
the last window ends with the text. A word's input is an embedding of the word (by a
hash) beside the sum of embeddings of its character trigrams. Two gated recurrent
layers read a window forwards and backwards; attention pools their states; a logistic
unit scores the window. A document's score is that of its highest window.

The network is trained here, in numpy, on a sample of labelled documents: about
``positives`` of label 1 and ``negatives`` of label 0, taken by a hash of doc_id among
those whose crc32(doc_id) mod 4 isn't 2, with at most ``longest_sample`` bytes of text.
Labels stand for documents, so each update learns from each document's window that the
network scores highest so far. The number of updates doesn't depend on the sample.

Cases: a null text, or one without words, has score 0; a document with several labels
is toxic if one of them is 1; null labels are left out; without labelled documents all
scores are 0; repeated rows are scored alike; a very long text is scored window by window
to its end; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE = 64, 32
HIDDEN, WORD_SIZE, CHAR_SIZE = 8, 8, 8
WORD_SLOTS, CHAR_SLOTS = 1 << 15, 1 << 14
THRESHOLD = 0.3
POSITIVES, NEGATIVES = 1200, 2400
LONGEST_SAMPLE = 30_000
UPDATES, BATCH = 1200, 64
RATE = 0.01
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
WORD = re.compile(r"\w+")
Params = dict[str, np.ndarray]


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def window_starts(n: int) -> list[int]:
    """Where the windows of n words begin."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: slot of each word, slots of all trigrams in a row, and where each word's trigrams begin."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    place = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29))
    spread = mix(codes + (place.astype(np.uint64) << np.uint64(32)))
    word_slots = (np.add.reduceat(spread, ends - lengths) >> np.uint64(40)) % np.uint64(WORD_SLOTS)
    padded = np.append(codes, np.zeros(2, np.uint64))
    three = mix(padded[:-2] + (padded[1:-1] << np.uint64(21)) + (padded[2:] << np.uint64(42)))
    inside = place < np.repeat(lengths - 2, lengths)
    char_slots = (three[inside] >> np.uint64(36)) % np.uint64(CHAR_SLOTS)
    return word_slots.astype(np.int64), char_slots.astype(np.int64), np.cumsum(lengths - 2) - (lengths - 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_params(seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    size, h = WORD_SIZE + CHAR_SIZE, HIDDEN
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    p = {"word": draw(WORD_SLOTS, WORD_SIZE, scale=0.1), "char": draw(CHAR_SLOTS, CHAR_SIZE, scale=0.1)}
    for d in "fb":
        p |= {f"W{d}": draw(size, 3 * h, scale=size**-0.5), f"U{d}": draw(h, 3 * h, scale=h**-0.5), f"c{d}": np.zeros(3 * h, np.float32)}
    p |= {"A": draw(2 * h, 2 * h, scale=(2 * h) ** -0.5), "v": draw(2 * h, scale=(2 * h) ** -0.5), "o": draw(2 * h, scale=0.3), "b": np.full(1, -1.0, np.float32)}
    return p


def inputs(p: Params, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The input vector of each distinct word."""
    word, char, at = features
    return np.concatenate([p["word"][word], np.add.reduceat(p["char"][char], at)], axis=1)


def recur(gates: np.ndarray, at: np.ndarray, fine: np.ndarray, U: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [step, row, unit] of one direction. gates: each word's input to the three gates; at: [step, row] numbers of words; fine: where there is a word."""
    h = HIDDEN
    state = np.zeros((at.shape[1], h), np.float32)
    out = np.empty((*at.shape, h), np.float32)
    for t in range(len(at)):
        x, u = gates[at[t]], state @ U
        zr = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
        new = n + z * (state - n)
        if not fine[t].all():
            new = np.where(fine[t][:, None], new, state)
        if keep is not None:
            keep.append((state, z, r, n, u[:, 2 * h :]))
        out[t] = state = new
    return out


def forward(p: Params, gates: tuple[np.ndarray, np.ndarray], at: np.ndarray, fine: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The log odds of each window. at, fine: [step, window]."""
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    f = recur(gates[0], at, fine, p["Uf"], kept["f"])
    b = recur(gates[1], at[::-1], fine[::-1], p["Ub"], kept["b"])[::-1]
    h = np.concatenate([f, b], axis=2)
    a = np.tanh(h @ p["A"])
    s = np.where(fine, a @ p["v"], -1e9)
    e = np.exp(s - s.max(axis=0))
    w = e / e.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", w, h)
    if keep is not None:
        keep |= {"h": h, "a": a, "w": w, "pooled": pooled, "kept": kept}
    return pooled @ p["o"] + p["b"][0]


def gradients(p: Params, features: tuple, x: np.ndarray, at: np.ndarray, fine: np.ndarray, keep: dict, d_out: np.ndarray) -> Params:
    """Of the sum of d_out times the log odds. x: the inputs of the distinct words."""
    hid = HIDDEN
    h, a, w, pooled = keep["h"], keep["a"], keep["w"], keep["pooled"]
    g = {"o": pooled.T @ d_out, "b": np.array([d_out.sum()], np.float32)}
    d_pooled = d_out[:, None] * p["o"]
    d_h = w[:, :, None] * d_pooled
    d_w = np.einsum("bh,tbh->tb", d_pooled, h)
    d_s = w * (d_w - (w * d_w).sum(axis=0))
    g["v"] = np.einsum("tb,tbh->h", d_s, a)
    d_a = d_s[:, :, None] * p["v"] * (1 - a * a)
    g["A"] = np.einsum("tbi,tbj->ij", h, d_a)
    d_h = d_h + d_a @ p["A"].T
    d_x = np.zeros_like(x)
    for d, part in (("f", d_h[:, :, :hid]), ("b", d_h[::-1, :, hid:])):
        where, ok = (at, fine) if d == "f" else (at[::-1], fine[::-1])
        U, W = p[f"U{d}"], p[f"W{d}"]
        d_gates = np.zeros((len(x), 3 * hid), np.float32)
        g[f"U{d}"] = np.zeros_like(U)
        carry = np.zeros((at.shape[1], hid), np.float32)
        for t in range(len(at) - 1, -1, -1):
            state, z, r, n, un = keep["kept"][d][t]
            total = carry + part[t]
            live = total * ok[t][:, None]
            d_z = live * (state - n) * z * (1 - z)
            d_n = live * (1 - z) * (1 - n * n)
            d_r = d_n * un * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
            carry = live * z + d_u @ U.T + total * ~ok[t][:, None]
            g[f"U{d}"] += state.T @ d_u
            np.add.at(d_gates, where[t], np.concatenate([d_z, d_r, d_n], axis=1))
        g[f"c{d}"] = d_gates.sum(axis=0)
        g[f"W{d}"] = x.T @ d_gates
        d_x += d_gates @ W.T
    word, char, starts = features
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], word, d_x[:, :WORD_SIZE])
    np.add.at(g["char"], char, np.repeat(d_x[:, WORD_SIZE:], np.diff(np.append(starts, len(char))), axis=0))
    return g


def gate_inputs(p: Params, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]


def layout(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """at and fine, [step, window], of windows that begin in codes at begins and have sizes words."""
    step = np.arange(int(sizes.max(initial=1)))[:, None]
    fine = step < sizes
    return codes[np.minimum(begins + step, len(codes) - 1)], fine


def train(samples: list[tuple[str, int]], updates: int = UPDATES, seed: int = 0) -> Params | None:
    """samples: (text, label). Adam on the windows that score highest in their documents; these are chosen anew some times."""
    docs = [(w, y) for t, y in samples for w in [text_words(t)] if w]
    if len({y for _, y in docs}) < 2:
        return None
    numbers: dict[str, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for d, _ in docs for w in d), np.int64)
    vocabulary = list(numbers)
    features = word_features(vocabulary)
    base, begins, sizes, owner = 0, [], [], []
    for k, (d, _) in enumerate(docs):
        for s in window_starts(len(d)):
            begins.append(base + s)
            sizes.append(min(WINDOW, len(d)))
            owner.append(k)
        base += len(d)
    begins, sizes, owner = np.array(begins), np.array(sizes), np.array(owner)
    labels = np.array([y for _, y in docs], np.float32)
    groups = [np.flatnonzero(labels == y) for y in (0, 1)]
    first = np.flatnonzero(np.diff(np.append(-1, owner)))
    spread = np.diff(np.append(first, len(owner)))
    rng = np.random.default_rng(seed)
    p = new_params(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    rounds = 8
    for step in range(updates):
        if step % (updates // rounds or 1) == 0:
            gates = gate_inputs(p, inputs(p, features))
            odds = score_windows(p, gates, codes, begins, sizes) + rng.random(len(begins)) * (1e-3 if step else 10)
        pick = np.concatenate([rng.choice(groups[0], BATCH // 2), rng.choice(groups[1], BATCH // 2)])
        chosen = [first[k] + int(odds[first[k] : first[k] + spread[k]].argmax()) for k in pick]
        at, fine = layout(codes, begins[chosen], sizes[chosen])
        local, at = np.unique(at, return_inverse=True)
        at = at.reshape(fine.shape)
        some = _subset(features, local)
        x = inputs(p, some)
        keep: dict = {}
        out = forward(p, gate_inputs(p, x), at, fine, keep)
        d_out = ((sigmoid(out) - labels[pick]) / len(pick)).astype(np.float32)
        g = gradients(p, some, x, at, fine, keep, d_out)
        rate = RATE * (1 - step / updates) + RATE / 50
        for k in p:
            if k in ("word", "char"):  # only what was touched
                rows = np.unique(some[0] if k == "word" else some[1])
                m[k][rows] = 0.9 * m[k][rows] + 0.1 * g[k][rows]
                v[k][rows] = 0.99 * v[k][rows] + 0.01 * g[k][rows] ** 2
                p[k][rows] -= rate * m[k][rows] / (np.sqrt(v[k][rows]) + 1e-6)
            else:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-6)).astype(np.float32)
    return p


def _subset(features: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, char, starts = features
    lengths = np.diff(np.append(starts, len(char)))[rows]
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts[rows], lengths)
    return word[rows], char[at], ends - lengths


def score_windows(p: Params, gates: tuple[np.ndarray, np.ndarray], codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Log odds of all windows. Windows of like size go together."""
    out = np.empty(len(begins), np.float32)
    order = np.argsort(sizes, kind="stable")
    for i in range(0, len(order), rows):
        some = order[i : i + rows]
        at, fine = layout(codes, begins[some], sizes[some])
        out[some] = forward(p, gates, at, fine)
    return out


class Scorer:
    """Scores texts; what a word brings to the gates is computed once and kept, up to most_words words."""

    def __init__(self, p: Params | None, most_words: int = 200_000):
        self.p, self.most_words = p, most_words
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.gates = [np.zeros((1 << 14, 3 * HIDDEN), np.float32) for _ in "fb"]

    def _add(self, words: list[str]) -> None:
        n = len(self.known)
        while n + len(words) > len(self.gates[0]):
            self.gates = [np.concatenate([x, np.zeros_like(x)]) for x in self.gates]
        for x, new in zip(self.gates, gate_inputs(self.p, inputs(self.p, word_features(words))), strict=True):
            x[n : n + len(words)] = new
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        found = [text_words(t) for t in texts] if self.p else []
        words = list(chain.from_iterable(found))
        if not words:
            return out
        if len(self.known) > self.most_words:
            self.forget()
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(codes < 0)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            self._add(list(dict.fromkeys(missing)))
            codes[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        starts = [window_starts(len(f)) for f in found]
        per = np.array([len(s) for s in starts])
        base = np.cumsum([len(f) for f in found]) - [len(f) for f in found]
        begins = np.repeat(base, per) + np.fromiter(chain.from_iterable(starts), np.int64)
        sizes = np.repeat(np.minimum([len(f) for f in found], WINDOW), per)
        odds = score_windows(self.p, tuple(self.gates), codes, begins, sizes)
        has = np.flatnonzero(per)
        out[has] = sigmoid(np.maximum.reduceat(odds.astype(float), (np.cumsum(per) - per)[has]))
        return out


def _scorer(model: Broadcast) -> Scorer:
    """One for each model and Python worker."""
    key, p = model.value
    return common.kept(key, lambda: Scorer(p))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, longest_sample: int = LONGEST_SAMPLE) -> Broadcast:
    """A broadcast model of fixed size, trained on the sample that the module's text describes."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    share = lambda most, y: min(1.0, most / n[y]) if n.get(y) else 0.0
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = marks.where(chance < F.when(F.col("toxic") == 1, share(positives, 1)).otherwise(share(negatives, 0)))
    rows = {r.doc_id: int(r.toxic == 1) for r in chosen.collect()}  # about positives + negatives
    spark = docs.sparkSession
    samples: list[tuple[str, int]] = []
    if rows:
        asked = F.broadcast(spark.createDataFrame(list(rows.items()), "doc_id long, toxic int"))
        texts = docs.select("doc_id", "text").where(F.octet_length("text") <= longest_sample).join(asked, "doc_id")
        once = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # rows that share an id are one document, however many
        samples = sorted((r.text, r.toxic) for r in once.select("text", "toxic").where("text is not null").collect())
    return spark.sparkContext.broadcast((uuid.uuid4().hex, train(samples)))


def _predict(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model).score
        for whole in batches:
            for batch in common.slices(whole, "text"):
                scores = score(batch.column("text").to_pylist())
                ids = batch.column("doc_id").cast(pa.int64())
                held = pa.array([common.is_held_out(i) for i in ids.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def predict(docs: DataFrame, model: Broadcast) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_predict(model), SCHEMA)


def keep_clean(docs: DataFrame, model: Broadcast, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model).score
        for whole in batches:
            for batch in common.slices(whole, "text"):
                yield batch.filter(pa.array(score(batch.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, common.table(spark, sf_dir, "labels")))
