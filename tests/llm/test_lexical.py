"""Ranked search against plain counting."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import lexical
from gleanery.llm.hashing import HashTable

WORD = re.compile(lexical.TERM)


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    asked = {}
    for item, text in {(i, t) for i, t in items}:
        asked.setdefault(item, Counter()).update(terms(text))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item, words in asked.items():
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * total // length
            score = sum(times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in words.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1):
            out.add((item, rank, None if none else i, -score))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "und", "é", "naïve", "x1", "42", "日本", "a-b", "foo_bar", "ÉTÉ"] + [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(n)]


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return lexical.search(d, spark.createDataFrame(items, "item_id long, text string"), **more)


@pytest.mark.parametrize("more", [{}, {"part_postings": 40}, {"block_pairs": 50}, {"k": 3, "part_postings": 25, "block_pairs": 7}])
def test_equals_plain_counting(spark, more):
    docs, items = corpus(1, 150), [(i, t) for i, t in corpus(2, 12)]
    got = run(spark, docs, items, **more).collect()
    assert set(map(tuple, got)) == plain(docs, items, more.get("k", 20)) and len(got) == len(plain(docs, items, more.get("k", 20)))


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, " .,! "), (4, "alpha"), (4, "alpha"), (5, "ALPHA beta"), (6, "beta " * 30_000), (7, "alphaé"), (None, "alpha beta"), (-8, "alpha")]
    items = [(1, "Alpha"), (1, "Alpha"), (1, "beta beta"), (2, None), (3, ""), (4, "nowhere"), (None, "alpha alphaé"), (-5, "...")]
    got = run(spark, docs, items).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(docs, items), key=str) or set(map(tuple, got)) == plain(docs, items)
    assert {r.item_id for r in got} == {1, None}


def test_many_equal_scores_go_to_small_ids(spark):
    docs = [(i, "same text here") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(50)]
    got = run(spark, docs, [(7, "text"), (8, "same here other")], block_pairs=64).where("item_id = 7").orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(20)) and [r["rank"] for r in got] == list(range(1, 21))


def test_empty_tables_names_and_kinds(spark):
    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string").withColumns({"item_id": F.lit("x"), "score": F.lit(1), "part": F.lit(None), "codes": F.lit("y")})
    items = spark.createDataFrame([("b", "alpha"), ("a", "gamma alpha")], "item_id string, text string").withColumns({"rank": F.lit(3), "doc_id": F.lit("z"), "term": F.lit(1)})
    got = lexical.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and {r.item_id for r in got.collect()} == {"a", "b"}
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items), (docs, items.withColumn("text", F.lit("?!")))):
        assert lexical.search(d, i).count() == 0


def test_terms_agree_in_spark_and_in_bytes(spark):
    texts = ["A-b_c", "É é ÀB", "x\x00y\x7fz", "12 34", "日本　語", "@[`{", "", "Kelvin K ﬁ"]
    said = spark.createDataFrame([(t,) for t in texts], "t string").select(lexical.terms(F.col("t")).alias("w")).collect()
    data, starts, ends, doc = lexical.cut_terms([t.encode() for t in texts])
    own = [[] for _ in texts]
    for s, e, d in zip(starts, ends, doc, strict=True):
        own[d].append(data[s:e].tobytes().decode())
    assert own == [r.w for r in said] == [terms(t) for t in texts]


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        keys = rng.integers(0, 1 << 32, n).astype(np.uint32) & np.uint32(0x7003F)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()


def test_equal_hashes_do_not_decide(monkeypatch):
    part = lexical.Part.made(np.array([0, 0], np.int32), ["alpha", "beta"], np.array([1, 1]))
    data, starts, ends, _ = lexical.cut_terms([b"alpha gamma betas beta alphb"])
    part.codes(data, starts, ends, np.zeros(5, np.uint64))
    monkeypatch.setattr(HashTable, "find", lambda self, hashes: np.array([0, 0, 1, 1, 0]))
    assert part.codes(data, starts, ends, np.zeros(5, np.uint64)).tolist() == [0, -1, -1, 1, -1]
