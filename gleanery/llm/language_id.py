"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language. A word's
probability is the sum, over all ways to cut it into pieces, of the product of their
probabilities; the forward algorithm gives it without listing the ways. A text's log
probability is the sum over its words (runs of letters of any length, lower-cased, with
the word mark in front), and the score is the posterior of the best language under equal
priors. The forward pass looks back no farther than the longest piece: words of up to
``TOGETHER`` characters go through it together, those of one length at a time, and
longer ones, as in scripts without spaces, one by one with as many sums held as a piece
is long. Words are scored once per Python worker and kept in a cache of bounded size.

Learning is EM on the expected piece counts of a sample: of each language about
``per_language`` documents, taken by a hash of doc_id among those with a language, at
most ``longest_sample`` bytes of text, and a crc32(doc_id) mod 4 other than 2. The
``most_languages`` values of lang with the most such documents are learned (ties to the
smaller value), since the model has a number for each piece and language: with 22 500
pieces, 200 languages are 36 MB.

Cases: a null text, or one without a letter, gives `und` with score 0, as does a table
from which no language can be learned; ties go to the first language in order;
repeated rows are scored alike; a very long text is read whole; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import vocabulary_path

UNKNOWN = "und"
PER_LANGUAGE = 300
LONGEST_SAMPLE = 100_000
MOST_LANGUAGES = 200
TOGETHER = 48
ROUNDS = 4
SMOOTH = 0.05
OUTSIDE = 1e-8
#: A probability below 1 / LIFT is multiplied by it. A power of two, so that nothing is rounded.
LIFT = 2.0**300
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
WORD = re.compile(r"[^\W\d_]+")


def load_pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces that can occur in a lower-cased word, numbered from 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or not piece:
            continue
        if piece == piece.lower() and (piece[0] == "▁" or piece[0].isalpha()) and "▁" not in piece[1:]:
            found.setdefault(piece, len(found))
    return found


def longest_piece(pieces: dict[str, int]) -> int:
    return max(map(len, pieces), default=1)


def text_words(text: str | None) -> list[str]:
    found = WORD.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


class Lattice:
    """The pieces of words of one length: ids[w, i, l - 1] is the piece of l characters from i, or the number of pieces if there is none; a single character that is no piece has the number after that."""

    def __init__(self, words: list[str], pieces: dict[str, int], longest: int | None = None):
        """longest: characters of the longest piece, if known."""
        n, get, none = len(words[0]) + 1, pieces.get, len(pieces)
        most = min(longest or longest_piece(pieces), n)
        spans = [(i, l) for i in range(n) for l in range(1, min(most, n - i) + 1)]
        flat = [get(m[i : i + l], none) for w in words for m in ("▁" + w,) for i, l in spans]
        self.n, self.most = n, most
        self.ids = np.full((len(words), n, most), none, np.int32)
        at = np.array(spans)
        self.ids[:, at[:, 0], at[:, 1] - 1] = np.array(flat, np.int32).reshape(len(words), -1)
        single = self.ids[:, :, 0]
        single[single == none] = none + 1

    def forward(self, p: np.ndarray, lifts: np.ndarray | None = None) -> np.ndarray:
        """alpha[position, word, language]; p: probability of each piece number in each language. With lifts, of alpha's shape, no value underflows: lifts counts how often each has been multiplied by LIFT."""
        alpha = np.zeros((self.n + 1, len(self.ids), p.shape[1]))
        alpha[0] = 1
        for j in range(1, self.n + 1):
            for l in range(1, min(self.most, j) + 1):
                alpha[j] += alpha[j - l] * p[self.ids[:, j - l, l - 1]]
            if lifts is not None:
                lift(alpha, lifts, j, j - 1, slice(max(0, j + 1 - self.most), j + 1))
        return alpha

    def backward(self, p: np.ndarray, lifts: np.ndarray | None = None) -> np.ndarray:
        beta = np.zeros((self.n + 1, len(self.ids), p.shape[1]))
        beta[self.n] = 1
        for i in range(self.n - 1, -1, -1):
            for l in range(1, min(self.most, self.n - i) + 1):
                beta[i] += beta[i + l] * p[self.ids[:, i, l - 1]]
            if lifts is not None:
                lift(beta, lifts, i, i + 1, slice(i, i + self.most))
        return beta

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        """Of each word in each language."""
        lifts = np.zeros((self.n + 1, len(self.ids), p.shape[1]), np.int16)
        return np.log(self.forward(p, lifts)[self.n]) - lifts[self.n] * np.log(LIFT)

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces; weight[word, language]: how often each word occurs."""
        up, down = (np.zeros((self.n + 1, len(self.ids), p.shape[1]), np.int16) for _ in range(2))
        alpha, beta = self.forward(p, up), self.backward(p, down)
        scale, lifted = weight / alpha[self.n], bool(up.any() or down.any())
        out = np.zeros_like(p)
        for i in range(self.n):
            for l in range(1, min(self.most, self.n - i) + 1):
                ids = self.ids[:, i, l - 1]
                mass = alpha[i] * p[ids] * beta[i + l] * scale
                if lifted:
                    mass *= LIFT ** (up[self.n] - up[i] - down[i + l]).astype(float)
                for k in range(p.shape[1]):
                    out[:, k] += np.bincount(ids, mass[:, k], len(p))
        return out


def lift(values: np.ndarray, lifts: np.ndarray, at: int, before: int, reach: slice) -> None:
    """Multiplies by LIFT where values[at] is small, over the positions that the next step still reads. What is summed at a position has the lifts of the one before."""
    lifts[at] = lifts[before]
    low = values[at] < 1 / LIFT
    if low.any():
        values[reach] *= np.where(low, LIFT, 1.0)
        lifts[reach] += low


def long_log_probability(word: str, pieces: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """Of one word of any length in each language. sums[l - 1] belongs to the place l characters back."""
    marked, get, none = "▁" + word, pieces.get, len(pieces)
    sums, lifts = np.zeros((longest, p.shape[1])), np.zeros(p.shape[1])
    sums[0] = 1
    for j in range(1, len(marked) + 1):
        ids = [get(marked[j - l : j], none) for l in range(1, min(longest, j) + 1)]
        if ids[0] == none:
            ids[0] = none + 1
        new = (sums[: len(ids)] * p[ids]).sum(axis=0)
        sums[1:] = sums[:-1].copy()
        sums[0] = new
        low = new < 1 / LIFT
        if low.any():
            sums[:, low] *= LIFT
            lifts += low
    return np.log(sums[0]) - lifts * np.log(LIFT)


def by_length(words: list[str], most: int = 2048) -> Iterator[list[int]]:
    """Numbers of words of one length, at most `most` at a time, and fewer of long ones."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, g in groups.items():
        some = max(1, min(most, most * TOGETHER // max(1, n)))
        for i in range(0, len(g), some):
            yield g[i : i + some]


def learn(samples: list[tuple[str, str]], pieces: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece number in each. samples: (text, lang)."""
    counts: dict[str, Counter] = {}
    for text, lang in samples:
        counts.setdefault(lang, Counter()).update(text_words(text))
    langs = sorted(k for k, c in counts.items() if c)
    words = sorted(set(chain.from_iterable(counts[k] for k in langs)))
    weight = np.array([[counts[k].get(w, 0) for k in langs] for w in words], float).reshape(len(words), len(langs))
    size = len(pieces)
    p = np.full((size + 2, max(1, len(langs))), 1 / size)
    p[size], p[size + 1] = 0, OUTSIDE
    if not langs:
        return [], p
    longest = longest_piece(pieces)
    lattices = [(Lattice([words[i] for i in g], pieces, longest), weight[g]) for g in by_length(words)]
    for _ in range(rounds):
        total = sum(lattice.expected(p, w) for lattice, w in lattices)[:size] + SMOOTH
        p[:size] = total / total.sum(axis=0) * (1 - OUTSIDE)
    return langs, p


class Identifier:
    def __init__(self, langs: list[str], p: np.ndarray, vocabulary: str, most_words: int = 300_000):
        self.langs, self.p, self.most_words = langs, p, most_words
        self.pieces = load_pieces(vocabulary)
        self.longest = longest_piece(self.pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.long_held = 0  # characters of long words in the cache
        self.scores = np.zeros((1 << 14, max(1, len(self.langs))))

    def _add(self, words: list[str]) -> None:
        n = len(self.known)
        while n + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
        for g in by_length([words[i] for i in short]):
            at = [short[i] for i in g]
            lattice = Lattice([words[i] for i in at], self.pieces, self.longest)
            self.scores[n + np.array(at)] = lattice.log_probability(self.p)
        for i, w in enumerate(words):
            if len(w) > TOGETHER:
                self.scores[n + i] = long_log_probability(w, self.pieces, self.longest, self.p)
                self.long_held += len(w)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and score of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(self.known) > self.most_words or self.long_held > 4 * self.most_words:
            self.forget()
        found = [text_words(t) for t in texts]
        words = list(chain.from_iterable(found))
        codes = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(codes < 0)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            self._add(list(dict.fromkeys(missing)))
            codes[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        sizes = np.array([len(f) for f in found])
        has = np.flatnonzero(sizes)
        total = np.zeros((len(texts), len(self.langs)))
        if len(has):
            total[has] = np.add.reduceat(self.scores[codes], (np.cumsum(sizes) - sizes)[has])
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        score = odds.max(axis=1) / odds.sum(axis=1)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)], np.where(sizes > 0, score, 0.0)


def _identifier(model: Broadcast) -> Identifier:
    """One for each model and Python worker."""
    key, langs, p, vocabulary = model.value
    return common.kept(key, lambda: Identifier(langs, p, vocabulary))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, vocabulary: str | None = None, longest_sample: int = LONGEST_SAMPLE, most_languages: int = MOST_LANGUAGES) -> Broadcast:
    """A broadcast model (vocabulary size times languages numbers), from the sample that the module's text describes."""
    import uuid

    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    counted = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages)
    sizes = {r.lang: r.n for r in counted.collect()}
    spark = docs.sparkSession
    samples: list[tuple[str, str]] = []
    if sizes:
        shares = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, share double")
        chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
        chosen = usable.join(F.broadcast(shares), "lang").where((chance < F.col("share")) & (F.octet_length("text") <= longest_sample))
        once = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # rows that share an id are one document, however many
        samples = sorted((r.text, r.lang) for r in once.select("text", "lang").collect())  # about per_language documents a language
    langs, p = learn(samples, load_pieces(path))
    return spark.sparkContext.broadcast((uuid.uuid4().hex, langs, p, path))


def _predict(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = _identifier(model).identify
        for whole in batches:
            for batch in common.slices(whole, "text"):
                langs, scores = identify(batch.column("text").to_pylist())
                ids = batch.column("doc_id").cast(pa.int64())
                held = pa.array([common.is_held_out(i) for i in ids.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Broadcast) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_predict(model), SCHEMA)


def keep_known(docs: DataFrame, model: Broadcast) -> DataFrame:
    """The documents whose language is one of the model's, whatever the score; all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = _identifier(model).identify
        for whole in batches:
            for batch in common.slices(whole, "text"):
                langs, _ = identify(batch.column("text").to_pylist())
                yield batch.filter(pa.array([k != UNKNOWN for k in langs], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
