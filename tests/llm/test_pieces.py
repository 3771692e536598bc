"""Pieces, spans and decoded texts against the sentencepiece library, for the given model and for altered ones."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gleanery.llm import pieces
from gleanery.llm.encoding import vocabulary_path

PATH = vocabulary_path(pieces.FILE)
ODD = [
    "", " ", "   ", " a", "a ", "  a  b   c  ", "▁", "▁▁x ▁ y▁", "日本語のテスト　漢字", "\n\n\t x\r\n", "𝒳 😀😀 é́ é", "<s> </s> <0x0A> <unk>", "x" * 3000, "ab" * 700 + " " + "é" * 90, "\0a\0 b",
    "ﬁ ① ２ ｱﾊﾟｰﾄ ㌀ ﷺ", "Ⅷ½ ™ ​　end", "aé" * 50, "İstanbul K Å", "́ lone mark", "the  the  the ", "ĳ ﬃ ſt",
]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def altered(rule=None, trainer=b"", normaliser=b""):
    """The given model with another character map; later fields of a message win."""
    with open(PATH, "rb") as f:
        raw = f.read()
    spec = b""
    if rule:
        told = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = told.serialized_normalizer_spec()
    return raw + field(3, spec + normaliser) + field(2, trainer)


def noise(seed, n):
    rng = random.Random(seed)
    parts = ["the ", "The", "er", "ing ", "  ", " ", "é", "é", "ﬁ", "①", "日本", "　", "▁", "\n", "ÅÅ", "<s>", "123", "ſ", "‍", "a" * 70, "zq", "½", "ｱﾊﾟ", "가", "가", "😀"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def same(tmp_path, raw, texts):
    path = tmp_path / "m.model"
    path.write_bytes(raw)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.PieceEncoder(str(path))
    ids, counts, starts, ends = own.encode(texts)
    upto = np.append(0, np.cumsum(counts))
    for k, text in enumerate(texts):
        a, b = upto[k], upto[k + 1]
        told = library.encode(text, return_type="proto").pieces
        assert ids[a:b].tolist() == library.encode(text) == [p.id for p in told], text
        assert own.decode(ids[a:b]) == library.decode(ids[a:b].tolist())
        for p, s, e in zip(told, starts[a:b].tolist(), ends[a:b].tolist(), strict=True):
            if not own.model.is_byte[p.id]:
                assert (s, e) == (p.begin, p.end), (text, p.piece)
        assert (starts[a:b][1:] == ends[a:b][:-1]).all() or own.model.tidy


def test_given_model(tmp_path):
    with open(PATH, "rb") as f:
        same(tmp_path, f.read(), ODD + noise(1, 200))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("tidy", [0, 1])
def test_compiled_maps(tmp_path, rule, tidy):
    raw = altered(rule, normaliser=field(4, tidy) + field(3, 1) + field(5, 1))
    model = pieces.PieceModel(raw)
    assert model.map.candidate and model.tidy == bool(tidy)
    same(tmp_path, raw, ODD + noise(2, 200))


@pytest.mark.parametrize("trainer, normaliser", [(field(24, 1), b""), (b"", field(3, 0)), (b"", field(4, 1)), (field(24, 1), field(4, 1)), (b"", field(5, 0)), (b"", field(5, 0) + field(4, 1))])
def test_settings(tmp_path, trainer, normaliser):
    same(tmp_path, altered(None, trainer, normaliser), ODD + noise(3, 150))


@pytest.mark.parametrize("rule", [None, "nfkc"])
def test_without_byte_pieces(tmp_path, rule):
    with open(PATH, "rb") as f:
        parts = list(pieces._fields(f.read()))
    plain = b"".join(field(1, v + field(3, pieces.CONTROL)) if n == 1 and dict(pieces._fields(v)).get(3) == pieces.BYTE else field(n, v) for n, v in parts)
    same(tmp_path, plain + altered(rule, field(35, 0))[len(b"".join(field(n, v) for n, v in parts)) :], ODD + noise(6, 150))


def test_the_longest_prefix_wins_and_keeps_its_place():
    found = pieces.CharacterMap(sentencepiece_map("nmt_nfkc"))
    raw = "xe\u0301ｱ".encode()
    assert list(found.spots(raw, 0, len(raw))) == [(1, 4, "\u00e9".encode()), (4, 7, "ア".encode())]
    assert list(found.spots(raw, 0, 2)) == []
    assert pieces.CharacterMap(b"").candidate is None


def sentencepiece_map(rule):
    spec = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()))
    return spec[2]


def test_other_models_are_an_error():
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.PieceModel(altered(None, trainer=field(3, 1)))


def test_full_cache_is_dropped_and_long_ids_decode_in_parts():
    small = pieces.PieceEncoder(PATH, most_units=3)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in noise(4, 60):
        ids, *_ = small.encode([text])
        assert ids.tolist() == library.encode(text)
        for n in (1, 2, 5):
            assert small.decode(ids, n) == library.decode(ids.tolist())


def test_table(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "é"), (3, None), (4, ""), (5, "\n" * 5 + "word " * 60_000), (6, "漢" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "starts": F.lit(1), "decoded": F.lit(2.0), "n_tokens": F.lit(None)})
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = pieces.encode(df.repartition(3)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0], r[1])
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == want
    for r in got:
        if r.ids:
            size = len({i: t for i, t in rows}[r.doc_id].encode())
            assert r.starts[0] == 0 and r.ends[-1] == size and r.starts[1:] == r.ends[:-1]
    assert pieces.encode(df.limit(0)).count() == 0


def test_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for d in docs:
        ids = library.encode(d.text or "")
        want.add((d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = pieces.query(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert set(map(tuple, got.collect())) == want and len(want) == len(docs)
