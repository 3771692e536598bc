"""The training-data operators against brute force, on small tables with the odd cases."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import chat, common, decontamination, encoding, hashing, language_id, ngram_join, packing, sharding, token_counts, token_files, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ta re mi no sol du ka pe lor in vas ten qui ab ek um".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    texts = [sentence(rnd, rnd.randint(1, 80)) for _ in range(n)]
    for i in range(10, 25):  # near copies, exact copies in other case, shared passages
        w = texts[i].split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3].upper(), texts[3], texts[4] + " " + texts[5], "", None, "one two", "One two", "...", "é ü　x", "a  b\n\nc 'd's", texts[0] * 40]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def odd(spark):
    """Nulls, repeated rows, and no rows at all; columns whose names the operators use themselves."""
    rows = [(1, "some text of seven words in all"), (1, "some text of seven words in all"), (None, "some text of seven words in all"), (2, None), (3, "")]
    df = frame(spark, rows)
    for name in ("node", "n", "ids", "start", "slot", "shard", "kept_id", "score", "spans"):
        df = df.withColumn(name, F.lit("x"))
    return df, df.where("false")


def test_every_operator_takes_odd_tables(spark):
    some, none = odd(spark)
    bench = spark.createDataFrame([(1, "seven words in all"), (None, None), (2, "...")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    model, judge = language_id.fit(some), toxicity.fit(some, labels)
    for df, n in ((some, 5), (none, 0)):
        assert packing.pack(df).where("offset <> 0").count() == 0
        assert packing.pack(df).agg(F.count_distinct("sequence_id")).first()[0] == packing.pack(df).count()
        assert sharding.shard(df).count() == n
        assert token_counts.count(df).select("doc_id", "section").count() == n
        uri = common.fresh_path(spark, "odd")
        assert token_files.read(token_files.write(df, uri, parts=2), uri).count() == n
        assert decontamination.find(df, bench).count() == n and decontamination.keep_clean(df, bench).columns == df.columns
        assert language_id.predict(df, model).count() == n and language_id.keep_known(df, model).columns == df.columns
        assert toxicity.predict(df, judge).count() == n and toxicity.keep_clean(df, judge).count() <= n
        got = ngram_join.join(df)
        assert got.count() == n and ngram_join.keep_first(df).columns == df.columns
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(some).collect()}
    assert rows == {(1, 3, 1), (None, 3, None), (2, 0, 2), (3, 0, 3)}
    assert ngram_join.keep_first(some).count() == 5  # copies of one id stay together; a null id is never dropped
    assert language_id.predict(none, language_id.fit(none)).count() == 0 and toxicity.predict(some, toxicity.fit(some, labels.where("false"))).agg(F.max("score")).first()[0] == 0
    assert {r.contaminated for r in decontamination.find(some, bench).select((F.size("spans") > 0).alias("contaminated")).collect()} == {True, False}


def test_held_out(spark):
    ids = [0, 1, 17, -3, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select(common.held_out(F.col("i")).alias("h"))
    assert [r.h for r in df.collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids] == [common.is_held_out(i) for i in ids]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(name, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encoding.vocabulary_path(name))
    plain.encode_special_tokens = True
    rnd = random.Random(5)
    parts = [*"ab. ,'\n\té×²1-!", "  ", " ", "́", "日", "'s", "\u0085", "\x1c", "<|endoftext|>", "İ", "ß"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(500)] + [t or "" for _, t in corpus()]
    e = encoding.UnitEncoder(encoding.vocabulary_path(name), most_units=300)  # so that the cache is emptied on the way
    for long in (1 << 20, 40):
        monkeypatch.setattr(encoding, "LONG", long)
        for k in range(0, len(texts), 50):
            ids, counts = e.encode(texts[k : k + 50])
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in texts[k : k + 50]]


def test_packing_and_token_files(spark):
    from tokenizers import Tokenizer

    rows = corpus()
    df = frame(spark, rows).repartition(3)
    word, byte = (Tokenizer.from_file(encoding.vocabulary_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    got: dict = {}
    for r in packing.pack(df, max_length=64).collect():
        got.setdefault(r.doc_id, {})[r.start] = r
    for i, t in rows:
        ids, at = [*word.encode(t or "", add_special_tokens=False).ids, 1], 0
        while at < len(ids):
            r = got[i][at]
            assert r.length in (1, 2, 4, 8, 16, 32, 64) and 1 << r.bucket == r.length and r.doc_tokens == len(ids)
            assert list(struct.unpack(f"<{r.length}I", r.ids)) == ids[at : at + r.length]
            at += r.length
    uri = common.fresh_path(spark, "t")
    manifest = token_files.write(df, uri, parts=3, ids_per_file=500)
    assert manifest.count() >= 3
    back = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read(manifest, uri).collect()}
    start = 0
    for i, t in rows:
        ids = [*byte.encode(t or "", add_special_tokens=False).ids, 0]
        assert back[i] == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encoding.vocabulary_path("byte_bpe_50k.json"))
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice(["the cat", ".", "\n", "\n\n", "\n\n\n", " x", "  "]) for _ in range(rnd.randint(0, 12)))) for i in range(80)]
    got: dict = {}
    for r in token_counts.count(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.first_char, r.n_chars, r.n_tokens)
    crossed = 0
    for i, t in rows:
        lines = t.split("\n")
        sections = [len(x) + (k + 1 < len(lines)) for k, x in enumerate(lines)]
        begins = [sum(sections[:k]) for k in range(len(sections))]
        n = [0] * len(sections)
        for a, b in plain.encode(t, add_special_tokens=False).offsets:
            held = [max(0, min(b, s + m) - max(a, s)) for s, m in zip(begins, sections, strict=True)]
            crossed += sum(h > 0 for h in held) > 1
            n[held.index(max(held))] += 1
        assert got[i] == {k: (begins[k], sections[k], n[k]) for k in range(len(n))}
    assert crossed > 20
    rows = corpus()
    sums = {r.doc_id: r.n_tokens for r in token_counts.per_document(token_counts.count(frame(spark, rows), separator=". ")).collect()}
    assert sums == {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    wide = token_counts.count(frame(spark, [(1, "é😀\nß")])).orderBy("section").collect()
    assert [(r.first_char, r.n_chars) for r in wide] == [(0, 3), (3, 1)]


def test_pfor_blocks():
    rng = np.random.default_rng(0)
    for top, share in ((1, 0), (7, 0.01), (50_257, 0.5), (2**32 - 1, 0.1), (2**32 - 1, 1)):
        ids = np.where(rng.random(4096) < share, rng.integers(0, top, 4096, endpoint=True), rng.integers(5, 9, 4096)).astype(np.uint32)
        for p in (0.5, 0.9, 1.0):
            blocks = token_files.pack_blocks(ids, p)
            starts = np.cumsum([0, *map(len, blocks)])[:-1]
            assert (token_files.unpack_blocks(b"".join(blocks), starts) == ids).all()


def test_sharding(spark):
    rows = corpus()
    df = frame(spark, rows)
    got = sharding.shard(df, slots=256).collect()
    texts = dict(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for s in range(8):
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places)))
    sizes = [tuple(r) for r in sharding.slot_sizes(sharding.records(df, 256)).collect()]
    now = sharding.assign(sizes, 8)
    assert sharding.edit(sizes, now, 8).keys() == now.keys()
    grown = sharding.edit(sizes, now, 9)
    moved = [s for s in now if grown[s] != now[s]]
    assert moved and all(grown[s] == 8 for s in moved)  # one more shard takes slots only into itself
    assert set(sharding.edit(sizes, now, 5).values()) == set(range(5))


def brute_decontamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = decontamination.WINDOW) -> list[tuple]:
    """What the query gives, word by word."""
    out = []
    patterns = [(i, w[k : k + window]) for i, t in items for w in [decontamination.words(t)] for k in range(max(1, len(w) - window + 1) if w else 0)]
    for doc_id, text in docs:
        w, hit, ids = decontamination.words(text), set(), set()
        for i, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    ids.add(i)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    rows = [(i, t) for i, t in corpus() if i < 40] + [(99, None), (100, "Zwölf kurze!"), (100, "Zwölf kurze!"), (None, "Zwölf kurze!"), (101, rows_text(40) * 300)]
    items = [(7, rows[3][1]), (70, "x " + rows[3][1].upper()), (8, " ".join(rows[5][1].split()[2:30])), (9, "zwölf, KURZE"), (5, "..."), (6, None), (8, "other words, same id"), (None, rows[6][1]), (11, rows_text(40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_decontamination(rows, [(i, t) for i, t in items if i is not None])
    hit = {w[0] for w in brute_decontamination(rows, [(i or 0, t) for i, t in items]) if w[5]}
    for most in (1 << 20, 60):  # one automaton, or one for each part of the benchmark
        found = decontamination.find(frame(spark, rows), bench, most_bytes=most).collect()
        plain = sorted(((r.doc_id, r.n_words, len(r.items)) for r in found), key=str)
        assert plain == sorted(((w[0], w[1], w[3]) for w in want), key=str) and len(found) == len(rows)
        texts = dict(rows)
        for r in found:
            assert (len(r.spans) > 0) == (r.doc_id in hit) and r.items == sorted(r.items)
            for s in r.spans:
                assert len(decontamination.words(texts[r.doc_id][s.first_char : s.end_char])) == s.end_word - s.first_word
        words_hit = {r.doc_id: sum(s.end_word - s.first_word for s in r.spans) for r in found}
        assert words_hit == {w[0]: w[2] for w in brute_decontamination(rows, [(i or 0, t) for i, t in items])}
        kept = [r.doc_id for r in decontamination.keep_clean(frame(spark, rows), bench, most_bytes=most).collect()]
        assert sorted(kept) == sorted(i for i, _ in rows if i not in hit)


def rows_text(n):
    return sentence(random.Random(n), n) + " "


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_windows_by_blocks_equal_windows_by_brute_force(window):
    rnd = random.Random(window)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(i % 17, text(rnd.randint(0, 25))) for i in range(30)]
    scanner = decontamination.Scanner(items, window)
    rows = [(i, text(rnd.randint(0, 60))) for i in range(60)] + [(99, text(20_000))]
    for (_, t), want in zip(rows, brute_decontamination(rows[:60], items, window), strict=False):
        n, ranges, ids = scanner.scan(t)
        assert (n, sum(b - a for a, b in ranges), len(ids)) == want[1:4]
        assert hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest() == want[4]
    assert decontamination.Scanner([], window).scan("a b") == (2, [], [])


def test_the_automaton_grows_by_a_bounded_factor():
    rnd = random.Random(0)
    text = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(3, 9))) for _ in range(30_000))
    scanner = decontamination.Scanner([(1, text)])
    assert scanner.automaton.get_stats()["total_size"] < 45 * len(text) and len(scanner.hashes) == 30_000 - 9


def exact_join(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(ngram_join.LOWER).split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("block", "long", "bucket", "hot"), [(512, 32, 1 << 23, 256), (8, 3, 1 << 23, 1), (8, 3, 600, 256)])  # groups whole; in blocks, nodes salted; buckets dealt again
def test_ngram_join(spark, monkeypatch, block, long, bucket, hot):
    for name, value in (("BLOCK", block), ("LONG", long), ("BUCKET_BYTES", bucket), ("HOT", hot)):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(2)
    base = sentence(rnd, 60).split()
    rows = corpus()
    for i in range(200, 260):  # a large group of near copies, some of them far apart
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, " ".join(w[: 60 - i % 14])))
    rows += [(300 + i, f"sign up for our letter {rnd.choice(WORDS)} {rnd.choice(WORDS)}") for i in range(60)]  # short texts with a frequent shingle
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, rows).repartition(5)).collect()}
    assert got == exact_join(rows)


def test_ngram_join_of_very_long_texts(spark):
    long = sentence(random.Random(9), 30_000)
    rows = [(5, long), (3, long + " one more word or two here"), (4, long[: len(long) // 2]), (6, "short")]
    assert {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, rows)).collect()} == {3: 3, 4: 4, 5: 3, 6: 6}


def test_each_pair_of_a_group_meets_once(spark, monkeypatch):
    """The tasks of groups, counted: every pair of one class or of neighbour classes once, but those of one core."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rnd = random.Random(6)
    nodes = [(g, 1000 * g + i, 10, rnd.choice([3, 4, 5, 7])) for g in (1, 2, 3) for i in range(25)]
    groups = spark.createDataFrame(nodes, "g long, node long, n int, class int")
    classes, tasks = ngram_join.star_tasks(groups)
    met: dict = {}
    held: dict = {}
    for r in tasks.collect():
        held.setdefault((r.g, r["class"], r.i), []).append(r)
    for task in held.values():
        (base,) = [r.node for r in task if r.is_base]
        assert len(task) <= 4 * 3
        for r in task:
            if not r.is_base:
                met[base, r.node] = met.get((base, r.node), 0) + 1
    linked = {p for p in met if rnd.random() < 0.6}
    stars = spark.createDataFrame(sorted(linked), "a long, b long")
    at = {x: (g, c) for g, x, _, c in nodes}
    bases = {r.base for r in classes.collect()}
    core = bases | {b for _, b in linked}
    held = {}
    for r in ngram_join.block_tasks(groups, classes, stars).collect():
        held.setdefault(tuple(r[k] for k in ngram_join.TASK), []).append(r)
    for (_, c1, p1, c2, p2, i, j), task in held.items():
        sides = [[r for r in task if r.right == side] for side in (False, True)]
        one = (c1, p1, i) == (c2, p2, j)
        pairs = [(x, y) for k, x in enumerate(sides[0]) for y in sides[0][:k]] if one else [(x, y) for x in sides[0] for y in sides[1]]
        for x, y in pairs:
            if (x.is_base or y.is_base) and (x["class"] == y["class"] or (x.is_base and y.is_base)):
                continue
            key = (min(x.node, y.node), max(x.node, y.node))
            met[key] = met.get(key, 0) + 1
    met = {(min(k), max(k)): n for k, n in met.items()}
    up = {at[a] for a, b in linked if b in bases}
    for x in at:
        for y in at:
            (g, c), (h, d) = sorted((at[x], at[y]))
            if x < y and g == h and d - c <= 1:
                one = x in core and y in core and not {x, y} & bases and (c == d or (g, c) in up)
                maybe = x in core and y in core and (x in bases) != (y in bases) and c < d and (g, c) in up
                assert met.get((x, y), 0) == (0 if one or maybe else 1), (x, y)
            elif x < y:
                assert (x, y) not in met


def test_ngram_candidates_and_bounds():
    rng = np.random.default_rng(4)
    universe = hashing.mix(np.arange(1, 400, dtype=np.uint64))
    sets, base = [], np.sort(rng.choice(universe, 40, replace=False))
    for _ in range(60):
        keep = base[rng.random(40) > 0.1]
        sets.append(np.unique(np.concatenate([keep, rng.choice(universe, rng.integers(0, 6))])))
    counts = np.zeros(1 << 10, np.uint32)
    entries = []
    for k, s in enumerate(sets):
        prefix = ngram_join.ordered(s, counts)[: len(s) - ngram_join.need(len(s)) + 1]
        e = np.empty(len(prefix), ngram_join.ENTRY)
        e["s"], e["node"], e["n"], e["at"] = prefix, k, len(s), np.arange(len(prefix))
        entries.append(e)
    links = {(i, j) for j in range(60) for i in range(j) if ngram_join.links(len(sets[i]), len(sets[j]), ngram_join.overlap(sets[i], sets[j]))}
    pairs, edges = ngram_join.candidates(np.concatenate(entries), long=1000)
    assert links and links <= {tuple(p) for p in pairs.tolist()} and not len(edges)
    halves = [ngram_join.thin(np.concatenate([e for e in entries if e["node"][0] % 2 == k]), 5) for k in (0, 1)]  # dealt by node, then met
    pairs, edges = ngram_join.candidates(np.concatenate([h[0] for h in halves]), long=5)
    met = {tuple(p) for p in pairs.tolist()}
    joined = {i: i for i in range(60)}
    for x, y in [*edges.tolist(), *halves[0][1].tolist(), *halves[1][1].tolist()]:
        joined = {k: min(joined[x], joined[y]) if v in (joined[x], joined[y]) else v for k, v in joined.items()}
    assert all((i, j) in met or joined[i] == joined[j] for i, j in links)
    for i in range(60):
        for j in range(60):
            distance = len(sets[i]) + len(sets[j]) - 2 * ngram_join.overlap(sets[i], sets[j])
            assert ngram_join.least_distance(ngram_join.signature(sets[i]), ngram_join.signature(sets[j])) <= distance
    forest = ngram_join.forest(list(range(60)), sets)
    assert {tuple(sorted(e)) for e in forest} <= links
    groups = {i: i for i in range(60)}
    for es, into in ((links, dict(groups)), (forest, dict(groups))):
        for a, b in es:
            x, y = into[a], into[b]
            into = {k: min(x, y) if v in (x, y) else v for k, v in into.items()}
        groups = into if es is links else groups
        assert groups == into


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "<|end|> <\\|x <\\\\| |>"), (1, 3, "assistant", "<|end|> <\\|x <\\\\| |>"), (2, None, None, None), (2, 0, "<|text|>\n", "<"), (None, 1, "assistant", "<|next|><"), (3, 1, "assistant", ""), (3, 2, "assistant", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = chat.format_chats(df)
    assert got.columns == ["conv_id", "formatted", "loss_spans"]
    back = {r.conv_id: r for r in got.select("conv_id", "formatted", chat.read_chats(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for key in (1, 2, 3, None):
        want = [(r or "", t or "") for c, k, r, t in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in back[key].turns] == want
        assert back[key].loss == "".join(t for r, t in want if r == "assistant")
    assert back[1].formatted.count(chat.TURN) == 2  # adjacent turns of one role are one block
    assert chat.format_chats(df.where("false")).count() == 0


def test_long_chats(spark):
    """A conversation of thousands of turns: spans behind the first chunk are right, too."""
    rows = [(1, k, ("user", "assistant", "assistant")[k % 3], "x<|" * (k % 5) + str(k)) for k in range(3000)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = got.select(chat.read_chats(F.col("formatted")).alias("turns"), "loss_spans", chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in back.turns] == [(r, t) for _, _, r, t in rows]
    assert back.loss == "".join(t for _, _, r, t in rows if r == "assistant") and len(back.loss_spans) == 2000


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")]), (None, [1.0] * 6), (204, []), (205, [1.0]), rows[7], (206, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    fine = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in fine if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q)
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    got: dict = {}
    for r in topk.search(df, df.where("vec_id % 50 = 0"), candidates_per_block=16, queries_per_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == want
    assert topk.search(df.where("false"), df.where("false")).count() == 0


def test_language_id(spark):
    rnd = random.Random(0)
    stems = {"de": ["ung", "sch", "der", "keit"], "en": ["the", "ing", "tion", "wh"], "es": ["ción", "que", "los", "mente"]}
    rows = [(i, " ".join(rnd.choice(stems[k]) + rnd.choice(stems[k]) for _ in range(30)), k) for i in range(300) for k in [rnd.choice(list(stems))]]
    rows += [(900, None, "de"), (901, "12 … !", "en"), (902, "½ ²", "en"), (903, "der" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.fit(df)).collect()}
    right = [got[i].lang_pred == k for i, _, k in rows if got[i].held_out and i < 900]
    assert len(right) > 40 and np.mean(right) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "de"
    kept = {r.doc_id for r in language_id.keep_known(df, language_id.fit(df)).collect()}
    assert {900, 901, 902}.isdisjoint(kept) and len(kept) > 295


def test_segmentations_are_summed():
    pieces = {"▁a": 0, "▁ab": 1, "b": 2, "▁": 3, "ab": 4}
    p = np.array([[0.3], [0.2], [0.1], [0.25], [0.15], [0.0], [1e-8]])
    whole = language_id.Lattice(["ab"], pieces).forward(p)[3, 0, 0]
    assert whole == pytest.approx(0.2 + 0.3 * 0.1 + 0.25 * 0.15 + 0.25 * 1e-8 * 0.1)
    expected = language_id.Lattice(["ab"], pieces).expected(p, np.array([[2.0]]))
    assert expected[1, 0] == pytest.approx(2 * 0.2 / whole)


def test_short_documents_stay(spark):
    said = {"de": "hund", "en": "dog", "es": "perro", "fr": "chien"}
    rows = [(i, said[k] + " taxi", k) for i, k in enumerate(list(said) * 8)]
    rows += [(900, "taxi", None), (901, "12 …", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert {r.doc_id: r.score for r in language_id.predict(df, model).collect()}[900] < 0.5
    assert {r.doc_id for r in language_id.keep_known(df, model).collect()} == {r[0] for r in rows} - {901}


def test_long_pieces_count():
    pieces = language_id.load_pieces(encoding.vocabulary_path("piece_bpe_32k.model"))
    assert {"▁government", "▁information", "▁development"} <= set(pieces)
    p = np.full((len(pieces) + 2, 1), 1e-9)
    p[-2:], p[pieces["▁government"]] = [[0.0], [1e-8]], 0.25
    assert language_id.Lattice(["government"], pieces).forward(p)[-1, 0, 0] == pytest.approx(0.25)


def test_long_runs_outside_the_vocabulary():
    path = encoding.vocabulary_path("piece_bpe_32k.model")
    pieces, run = language_id.load_pieces(path), "\ua500" * 48
    samples = [("the cat sat on the mat and the dog was there " + run, "en"), ("der hund und die katze sind nicht hier gewesen", "de")]
    langs, p = language_id.learn(samples, pieces)
    assert langs == ["de", "en"] and np.isfinite(p).all() and p[: len(pieces)].sum(axis=0) == pytest.approx(1)
    said, scores = language_id.Identifier(langs, p, path).identify([f"{run} the dog sat there", f"der hund {run}{run} nicht", run])
    assert said[:2] == ["en", "de"] and (scores[:2] > 0.9).all() and ((scores >= 0) & (scores <= 1)).all()
    rare = np.full((len(pieces) + 2, 1), 1e-7)
    rare[-2:] = [[0.0], [1e-8]]
    lattice = language_id.Lattice([run], pieces)
    assert lattice.log_probability(rare)[0, 0] == pytest.approx(np.log(1e-7) + 48 * np.log(1e-8))
    assert lattice.expected(rare, np.array([[3.0]]))[[pieces["▁"], -1], 0] == pytest.approx([3, 144])


def test_toxicity_gradients_and_windows():
    rng = np.random.default_rng(1)
    features = toxicity.word_features(["abc", "de", "idiot", "x", "foo", "scum"])
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(1).items()}
    at = rng.integers(0, 6, (5, 3))
    fine = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    d = np.array([0.3, -0.7, 1.1])
    value = lambda: float(toxicity.forward(p, toxicity.gate_inputs(p, toxicity.inputs(p, features)), at, fine) @ d)
    keep: dict = {}
    x = toxicity.inputs(p, features)
    toxicity.forward(p, toxicity.gate_inputs(p, x), at, fine, keep)
    g = toxicity.gradients(p, features, x, at, fine, keep, d)
    for k in p:
        where = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = p[k][where]
        p[k][where] = old + 1e-3
        up = value()
        p[k][where] = old - 1e-3
        assert g[k][where] == pytest.approx((up - value()) / 2e-3, rel=1e-3, abs=1e-5)
        p[k][where] = old
    for n in (1, 63, 64, 65, 200):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and starts[-1] + min(n, toxicity.WINDOW) == n


def test_toxicity_learns_words_and_stems():
    rnd = random.Random(0)
    rows = []
    for k in range(500):
        w = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(rnd.randint(20, 150))]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["scum", "idiot", "zzq" + rnd.choice(WORDS)]))
        rows.append((" ".join(w), int(toxic)))
    scorer = toxicity.Scorer(toxicity.train(rows[:400], updates=400))
    scores = scorer.score([t for t, _ in rows[400:]])
    right = (scores >= toxicity.THRESHOLD) == np.array([y for _, y in rows[400:]], bool)
    assert right.mean() > 0.95 and scorer.score([None, "", "..."]).tolist() == [0, 0, 0]


def test_samples_take_an_id_once(spark, monkeypatch):
    """Rows that share an id, or have none, come to the driver once, however many they are."""
    rows = [(1, f"first text {k}") for k in range(300)] + [(None, f"nobody {k}") for k in range(300)] + [(k, f"plain text {k}") for k in range(2, 12)]
    df, labels = frame(spark, rows), spark.createDataFrame([(k, 1, k % 2) for k in range(1, 12)], "doc_id long, quality int, toxic int")
    seen: dict = {}
    learn = language_id.learn
    monkeypatch.setattr(language_id, "learn", lambda samples, pieces: seen.update(lang=samples) or learn(samples, pieces))
    monkeypatch.setattr(toxicity, "train", lambda samples: seen.update(toxic=samples))
    language_id.fit(df, per_language=10_000)
    toxicity.fit(df, labels)
    learned = sorted(k for k in range(2, 12) if not common.is_held_out(k))
    plain = {f"plain text {k}" for k in learned}
    once = {"first text 0"} - ({"first text 0"} if common.is_held_out(1) else set())
    assert len(seen["lang"]) == len({t for t, _ in seen["lang"]}) and {t for t, _ in seen["lang"]} == plain | once | {"nobody 0"}
    assert len(seen["toxic"]) == len(plain | once) and {t for t, _ in seen["toxic"]} == plain | once


def test_a_stored_map_is_edited(spark):
    """Version 1 is new, version 2 edits it for a grown table, version 3 for one more shard; bytes stay near equal."""
    rnd = random.Random(4)
    rows = [(i, sentence(rnd, rnd.randint(1, 60))) for i in range(3000)] + [(7, sentence(rnd, 40)) for _ in range(1500)] + [(None, "same")] * 5
    path = common.fresh_path(spark, "maps")
    levels = {}
    placed: dict = {}
    for version, (part, shards) in enumerate([(rows[:2000], 8), (rows, 8), (rows, 9)], 1):
        got = sharding.shard(frame(spark, part), shards, path=path).collect()
        assert sharding.newest(spark, path)[0] == version and len(got) == len(part)
        held = [sum(r.size for r in got if r.shard == s) for s in range(shards)]
        assert max(held) - min(held) < 0.1 * sum(held) / shards, held
        for s in range(shards):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        placed, levels = {r.virtual_slot: r.shard for r in got}, placed
        moved = [v for v in levels if placed[v] != levels[v]]
        assert len(moved) < (1, 0.3 * len(placed), 0.3 * len(placed))[version - 1] or version == 1
    assert all(placed[v] == 8 for v in moved)  # the new shard takes slots from the others, and nothing else moves
    assert len({r.shard for r in got if r.doc_id == 7}) > 1  # many texts of one id spread


def test_buckets_hold_one_length(spark):
    df = frame(spark, corpus()).repartition(3)
    path = common.fresh_path(spark, "buckets")
    pieces = packing.pack(df, max_length=64)
    back = packing.write_buckets(pieces, path)
    key = lambda r: (r.doc_id, r.start, r.length, r.bucket, r.sequence_id, bytes(r.ids))
    assert sorted(map(key, back.collect())) == sorted(map(key, pieces.collect()))
    for b in range(7):
        files = spark.read.parquet(f"{path}/bucket={b}")
        assert {r.length for r in files.collect()} == {1 << b}
    assert packing.write_buckets(pieces.where("false"), common.fresh_path(spark, "buckets")).count() == 0


def test_wide_vectors_fill_small_blocks(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=40).tolist()) for i in range(60)], "vec_id long, embedding array<double>").coalesce(1)
    packed = df.mapInArrow(topk._block_packer(1000, 256.0, 400), topk.BLOCK).collect()
    assert len(packed) == 6 and sum(len(r.ids) // 8 for r in packed) == 60
    ids, matrix = topk._matrix(packed[0].asDict())
    assert ids.tolist() == list(range(10)) and matrix.shape == (10, 40)


def test_tokens_of_many_bytes_across_a_boundary(spark):
    """Against loops over bytes: sections end with a sign of two or three bytes, which tokens swallow."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encoding.vocabulary_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    rnd = random.Random(12)
    for separator, alphabet in (("é", ["é", "éé", "caf", "és", " déjà", "è", "ü"]), ("…", ["…", "……", "x", " …", "日本", "😀", "…\n"])):
        rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
        got: dict = {}
        for r in token_counts.count(frame(spark, rows), separator=separator).collect():
            got.setdefault(r.doc_id, {})[r.section] = (r.first_char, r.n_chars, r.n_tokens, r.n_crossing)
        crossed = 0
        for i, t in rows:
            lines = t.split(separator)
            sections = [x + separator * (k + 1 < len(lines)) for k, x in enumerate(lines)]
            owner = [k for k, x in enumerate(sections) for _ in x.encode()]
            n, over, at = [0] * len(sections), [0] * len(sections), 0
            for token in plain.encode(t, add_special_tokens=False).tokens:
                own = owner[at : at + len(token)]
                at += len(token)
                best = max(sorted(set(own)), key=own.count)
                n[best] += 1
                over[best] += len(set(own)) > 1
            assert at == len(owner)
            firsts = [sum(map(len, sections[:k])) for k in range(len(sections))]
            assert got[i] == {k: (firsts[k], len(sections[k]), n[k], over[k]) for k in range(len(sections))}
            crossed += sum(over)
        assert crossed > 5


def test_scorer_equals_windows_one_by_one():
    """With a cache that is emptied on the way, against each window by itself and plain loops over its words."""
    rnd = random.Random(3)
    p = toxicity.new_params(5)
    texts = [sentence(rnd, n) for n in (1, 5, 63, 64, 65, 97, 200, 1000)] + [None, "", "...", "ÜBER über", sentence(rnd, 9)]
    scorer = toxicity.Scorer(p, most_words=40)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def one(words):
        x = toxicity.inputs(p, toxicity.word_features(words)).astype(float)
        states = []
        for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
            h, out = np.zeros(toxicity.HIDDEN), {}
            for t in order:
                g, u = x[t] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                k = toxicity.HIDDEN
                z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
                n = np.tanh(g[2 * k :] + r * u[2 * k :])
                h = out[t] = (1 - z) * n + z * h
            states.append([out[t] for t in range(len(words))])
        h = np.concatenate(states, axis=1)
        w = np.exp(np.tanh(h @ p["A"]) @ p["v"])
        return sig((w / w.sum()) @ h @ p["o"] + p["b"][0])

    want = []
    for t in texts:
        words = toxicity.text_words(t)
        want.append(max((one(words[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(words))), default=0.0))
    got = [scorer.score([t])[0] for t in texts]
    assert got == pytest.approx(want, abs=1e-5) and scorer.score(texts).tolist() == pytest.approx(want, abs=1e-5)


def test_identifier_equals_all_segmentations():
    """Words one by one, every way to cut each, by recursion; ties go to the first language in order."""
    path = encoding.vocabulary_path("piece_bpe_32k.model")
    pieces = language_id.load_pieces(path)
    rng = np.random.default_rng(2)
    p = rng.random((len(pieces) + 2, 3)) * 1e-3
    p[-2:] = [[0.0] * 3, [language_id.OUTSIDE] * 3]
    p[:, 2] = p[:, 1]  # two languages that always tie
    said = language_id.Identifier(["a", "b", "c"], p, path, most_words=5)

    def ways(word, at=0):
        if at == len(word):
            return np.ones(3)
        total = np.zeros(3)
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end]
            if piece in pieces:
                total += p[pieces[piece]] * ways(word, end)
            elif len(piece) == 1:
                total += language_id.OUTSIDE * ways(word, end)
        return total

    texts = ["The government", "naïve Zürich", "x", "a b c d e f g h", "ꔀz", None, "12 !", "the " * 400]
    langs, scores = said.identify(texts)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        words = language_id.text_words(t)
        if not words:
            assert (lang, score) == ("und", 0)
            continue
        logs = sum(np.log(ways("▁" + w)) for w in words)
        odds = np.exp(logs - logs.max())
        assert score == pytest.approx(odds.max() / odds.sum(), abs=1e-6) and lang == ("a" if logs[0] >= logs[1] else "b")
    assert [said.identify([t])[0][0] for t in texts] == langs


def test_long_words_are_summed_whole():
    """A run of 60 letters by recursion, and longer ones against the words that go together."""
    from functools import lru_cache

    pieces = language_id.load_pieces(encoding.vocabulary_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    p = rng.random((len(pieces) + 2, 2)) * 1e-3
    p[-2:] = [[0.0] * 2, [language_id.OUTSIDE] * 2]
    longest = language_id.longest_piece(pieces)
    word = ("theinternationalisation" * 3)[:60]
    marked = "▁" + word

    @lru_cache(None)
    def ways(at):
        if at == len(marked):
            return (1.0, 1.0)
        total = [0.0, 0.0]
        for end in range(at + 1, len(marked) + 1):
            row = pieces.get(marked[at:end], len(pieces) + 1 if end == at + 1 else None)
            if row is not None:
                total = [t + x * y for t, x, y in zip(total, p[row].tolist(), ways(end), strict=True)]
        return tuple(total)

    got = language_id.long_log_probability(word, pieces, longest, p)
    assert np.allclose(got, np.log(ways(0)), rtol=1e-12)
    for w in (word[:7], "ꔀ" * 700, word * 40):  # beyond what a double holds
        assert np.allclose(language_id.long_log_probability(w, pieces, longest, p), language_id.Lattice([w], pieces, longest).log_probability(p)[0], rtol=1e-12)
    said = language_id.Identifier(["a", "b"], p, encoding.vocabulary_path("piece_bpe_32k.model"), most_words=20)
    alone = [said.identify([t])[1][0] for t in (word * 3, "the", word * 2)]
    assert np.allclose(said.identify([word * 3, "the", word * 2])[1], alone)


def test_blocks_have_no_literals_in_the_plan(spark):
    rows = [(i, [float(i % 7), float(i % 5) - 2.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.search(df, df.where("vec_id % 50 = 0"), candidates_per_block=10, queries_per_block=2)
    assert found.count() == 30 and len(found._jdf.queryExecution().toString()) < 60_000
    with pytest.raises(Exception, match="beyond"):
        topk.search(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"), df)


def test_languages_are_bounded(spark):
    rows = [(i, "the dog and the cat " * 3, "en") for i in range(40)] + [(100 + i, "der hund und die katze " * 3, "de") for i in range(40)] + [(200 + i, f"noise {i}", f"x{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, langs, p, _ = language_id.fit(df, most_languages=2).value
    assert langs == ["de", "en"] and p.shape[1] == 2


def test_very_long_texts(spark):
    """One text of some MB among short ones: every operator takes it whole."""
    from tokenizers import Tokenizer

    long = sentence(random.Random(1), 200_000)
    rows = [(1, long), (2, "short text of a few plain words here now ok"), (3, long[-300:])]
    df = frame(spark, rows)
    word, byte = (Tokenizer.from_file(encoding.vocabulary_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    n = len(word.encode(long, add_special_tokens=False).ids) + 1
    got = packing.pack(df).where("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert tuple(got) == (n, n)
    uri = common.fresh_path(spark, "long")
    ids = byte.encode(long, add_special_tokens=False).ids + [0]
    back = {r.doc_id: r for r in token_files.read(token_files.write(df, uri), uri).collect()}
    assert bytes(back[1].ids) == struct.pack(f"<{len(ids)}I", *ids) and back[2].start == len(ids)
    assert token_counts.per_document(token_counts.count(df)).where("doc_id = 1").first().n_tokens == len(ids) - 1
    assert {r.doc_id: r.size for r in sharding.shard(df).collect()}[1] == len(long) + 1
    tail = " ".join(long.split()[-20:])
    bench = spark.createDataFrame([(4, tail)], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.find(df, bench).collect()}
    assert found[1].spans[-1].end_char >= len(long) - 1 and found[1].n_words == 200_000 and found[3].items == [4] and not found[2].spans
    model = language_id.fit(spark.createDataFrame([(k, sentence(random.Random(k), 20), "en") for k in range(20)], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()} == {1: "en", 2: "en", 3: "en"}
    p = toxicity.new_params(2)
    scores = toxicity.Scorer(p).score([long, " ".join(long.split()[-64:])])
    assert scores[0] >= scores[1] - 1e-6 > 0
