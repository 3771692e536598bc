"""Literal expectations for the parts of the engine."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery import fixed, queries
from gleanery.functions import dates, numbers, similarity, text, urls
from gleanery.operators import components, evaluate, export, filters, history, merge, resolve
from gleanery.plans import payloads, pipeline, scan
from gleanery.sources import datasource, providers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("said", "n"), [("25 applicants", 25), ("1.2k applicants", 1200), ("Over 100 applicants", 101), ("51+ applicants", 52), ("none", None), (None, None), ("3 of 1,000", 1000)])
def test_applicants(spark, said, n):
    assert one(spark, said, numbers.applicant_count) == n


def test_html(spark):
    assert one(spark, "<p>Hello<br>World</p><ul><li>GIS</li><li>Python</li></ul>", text.html_to_text) == "Hello\nWorld\n* GIS\n* Python"
    assert one(spark, "a &lt;b&gt; &amp;amp; &eacute;", text.html_unescape) == "a <b> &amp; é"


def test_all_entities(spark):
    said = "<p>Caf&eacute; &Auml;rzte&rsquo;s &#228;&#8211;&#x20AC; &amp;lt;</p>"
    want = "Café Ärzte’s ä–€ &lt;"
    assert one(spark, said, text.html_to_text) == want
    for source, key in (("stepstone", "description"), ("xing", "description_html")):
        items = spark.createDataFrame([(json.dumps({"title": "T", key: said}),)], "json string")
        assert providers.normalise(items, source).first().description.split("\n\n")[0] == want


@pytest.mark.parametrize(("value", "want"), [("1e999", None), ("2026-05-06T07:15:00Z", datetime(2026, 5, 6, 7, 15)), ("1767225600", datetime(2026, 1, 1)), ("1767225600000", datetime(2026, 1, 1)), ("3 days ago", None), ("20260512", datetime(1970, 8, 23, 11, 55, 12)), (None, None)])
def test_dates(spark, value, want):
    assert one(spark, value, dates.parse_datetime) == want


def test_local_dates(spark):
    assert one(spark, "2026-07-01 12:00:00", lambda c: dates.parse_datetime(c, "Europe/Berlin")) == datetime(2026, 7, 1, 10)
    assert one(spark, "2026-05-06 08-30-00 (2)", dates.run_started_at) == datetime(2026, 5, 6, 8, 30)
    assert one(spark, "Notes", dates.run_started_at) is None


@pytest.mark.parametrize(("said", "want"), [("EUR 60.000 - 76,000 / year", (60000, 76000, "EUR", "year")), ("50k-60k $", (50000, 60000, "USD", "year")), ("20,5 € per hour", (20.5, 20.5, "EUR", "hour")), ("competitive", (None, None, None, None))])
def test_salary(spark, said, want):
    assert one(spark, said, numbers.parse_salary)[:4] == want


def test_fold_and_tokens(spark):
    assert one(spark, "Straße ÇA Ĳ ﬁ", text.fold) == "strasse ca ij fi"
    assert one(spark, "Straße ÇA", text.fold_full) == "strasse ca"
    assert one(spark, "ẞ Ａｂ９ ½ № e\u0301ﬃ 𝐛 ℌ x² İ", text.fold) == "ss ab9 1⁄2 No effi b H x2 i"
    assert one(spark, "C++ & GIS-Analyst (m/w/d)", text.tokens) == ["c", "gis", "analyst", "m", "w", "d"]
    assert one(spark, "München, Germany", text.normalize_location) == "munchen"
    assert one(spark, "Cologne", text.normalize_location) == one(spark, "Köln", text.normalize_location) == one(spark, "Koeln", text.normalize_location) == "koln"
    assert one(spark, "Remote", text.normalize_location) == "remote"
    assert one(spark, "Vollzeit", text.normalize_job_type) == one(spark, "Full-time", text.normalize_job_type) == "fulltime"
    assert one(spark, "Acme GmbH", text.normalize_company) == "acme" and one(spark, "Group", text.normalize_company) == "group"


def test_fold_equals_the_rule_for_all_characters(spark):
    """Whatever stands between two letters: the tokens are those of the rule, and what fold_full gives differs in no ASCII."""
    import re

    rows = [(c, f"x{chr(c)}Y") for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or text._folded(chr(c)) != chr(c).lower())]
    got = spark.createDataFrame(rows, "c int, t string").repartition(8).select("c", text.tokens(F.col("t")).alias("w")).collect()
    assert {r.c: r.w for r in got} == {c: re.findall(text.TOKEN, text._folded(t)) for c, t in rows} and len(rows) > 20_000


def test_urls(spark):
    key = lambda u: one(spark, u, urls.canonical_url)
    assert key("https://www.example.com//a/B/?utm_source=x&b=2&A=1#t") == "//example.com/a/b?a=1&b=2"
    assert key("https://de.indeed.com/viewjob?jk=ABC") == "indeed:job:abc" and key("no url") is None and key(None) is None
    assert one(spark, "https://www.xing.com/jobs/x-123", urls.external_apply_key) is None
    assert one(spark, "https://jobs.xing.de/x", urls.external_apply_key) is None
    assert key("https://a.b/Straße%20x~*/?q=a+b%26&Q=%C3%A9&q=~*") == "//a.b/stra%c3%9fe%20x~%2a?q=a+b%26&q=~%2A&q=%C3%A9"
    assert key("https://www.linkedin.com/jobs/view/12/?x=1") == "linkedin:job:12" and key("https://linkedin.com/jobs/view/a-12") == "//linkedin.com/jobs/view/a-12"
    assert key("https://www.xing.com/jobs/berlin-x-148355491.3c4997") == "//xing.com/jobs/berlin-x-148355491.3c4997"
    old = lambda u: one(spark, u, urls.older_key)
    assert old("https://www.LinkedIn.com/jobs/view/12/?x=1") == "linkedin:12" and old("https://de.indeed.com/viewjob?jk=Ab") == "indeed:ab"
    assert old("https://www.xing.com/Jobs/x-1/") == "www.xing.com/jobs/x-1" and old("no url") is None and old(None) is None
    assert one(spark, "https://www.stepstone.de/a--77-inline.html", urls.job_id_from_url) == "77" and one(spark, "https://a.b/c", urls.job_id_from_url) is None
    assert one(spark, 'https://x.y/"q"', lambda c: text.hyperlink_url(text.hyperlink_formula(c, "Open Job"))) == 'https://x.y/"q"'


def test_terms(spark):
    rows = ["ZEISS Group", "BCG X", "Fraunhofer IOSB", "German Aerospace Center (DLR)", "GeoSoft GmbH", "Airbus-Aircraft GmbH", "I.B.M. Consulting", None]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    left = [r.c for r in filters.exclude_terms(df, "c", ["zeiss", "BCG", "Fraunhofer", "DLR", "Airbus Aircraft", "IBM"]).collect()]
    assert left == ["GeoSoft GmbH", None]
    assert filters.cap(df, F.lit(3), 0).count() == len(rows)
    kept, seen = filters.observed(df.where("c is not null"), "kept")
    kept.collect()
    assert seen.get["rows"] == len(rows) - 1


def test_window_keeps_ends_and_unknown(spark):
    df = spark.createDataFrame([(1, datetime(2026, 5, 6)), (2, datetime(2026, 5, 7)), (3, None), (4, datetime(2026, 5, 8))], "id int, ts timestamp")
    got = filters.within(df, F.col("ts"), F.lit(datetime(2026, 5, 6)), F.lit(datetime(2026, 5, 7)))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]


def test_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(200, 100), (100, 150), (7, 7)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {200: 100, 150: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


JOBS = [
    ("linkedin", "GIS Analyst (m/f/d)", "GeoCo GmbH", "Berlin, Germany", "Full-time", "2026-01-01", "https://geoco.com/apply?id=1&utm_source=a"),
    ("indeed", "GIS Analyst", "GeoCo", "Berlin", "Vollzeit", "2026-01-02", "https://geoco.com/apply?id=1"),
    ("xing", "Senior Data Analyst", "Acme", "Berlin", None, None, None),
    ("xing", "Senior Data Engineer", "Acme", "Berlin", None, None, None),
    ("stepstone", "Planner", "Acme", "Berlin (Hybrid)", "Full-time", "2026-01-01", None),
    ("stepstone", "Planner", "Acme", "Berlin, Germany", "Full-time", "2026-01-03", None),
    ("stepstone", "Planner", "Acme", "Berlin", "Internship", "2026-01-03", None),
    ("stepstone", "Surveyor", "Acme", "Berlin", None, "2026-01-01", None),
    ("stepstone", "Surveyor", "Acme", "Berlin", None, "2026-05-01", None),
    ("indeed", None, None, None, None, None, None),
]


def listing(spark):
    rows = [(i, s, t, c, p, k, d, a) for i, (s, t, c, p, k, d, a) in enumerate(JOBS)]
    df = spark.createDataFrame(rows, "idx long, source string, title string, company string, location string, job_type string, posted string, apply_url string")
    none = F.lit(None).cast("string")
    return df.withColumns({"source_label": text.source_label(F.col("source")), "job_id": F.col("idx").cast("string"), "job_url": none, "salary": none, "description": none, "keyword": F.lit("GIS")})


def test_greedy_clusters(spark):
    got = {r.idx: r.cluster_id for r in resolve.clusters(resolve.features(listing(spark))).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}


def test_blocked_pairs_of_all_parts(spark, sf):
    parts = [(r.p_partkey, r.p_brand, set(r.p_name.split())) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, m, x in parts for b, n, y in parts if a < b and m == n and x & y}
    told = {(r.a, r.b): r.title_overlap for r in queries.queries()["q28_blocked_pairs_scored"](spark, sf).collect()}
    first = {b: a for (a, b), x in told.items() if x == 1}  # copies of a class's first part
    members = {a: [a, *(b for b in first if first[b] == a)] for a in {i for pair in told for i in pair} - set(first)}
    got = {(min(x, y), max(x, y)): told[a, b] for a, b in told if b not in first for x in members[a] for y in members[b]}
    got |= {(x, y): 1.0 for some in members.values() for x in some for y in some if x < y}
    assert got == want and len(want) == 176


class Plain:
    """Matching said once more, in plain loops over all rows, with nothing of the engine in it."""

    WEIGHTS = {"company": 0.30, "title": 0.34, "location": 0.18, "job_type": 0.10, "posted": 0.08}
    LEAST = {"company": 0.90, "title": 0.82, "location": 0.82, "job_type": 0.70, "posted": 0.55}

    @staticmethod
    def alike(a, b):
        from difflib import SequenceMatcher

        if a and a == b:
            return 1.0
        seq = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        x, y = set(a.split()), set(b.split())
        return max(seq, 0.65 * (len(x & y) / len(x | y) if x and y else 0) + 0.35 * seq)

    @staticmethod
    def place(a, b):
        x, y = set(a.split()), set(b.split())
        return 0.75 if not a or not b else 1.0 if a == b else 0.92 if x <= y or y <= x else Plain.alike(a, b)

    @classmethod
    def sure(cls, new, old):
        """Of (title, company, location): how sure a match is; None without one. Job types and links are missing, all are posted on one day."""
        scores = {"company": cls.alike(new[1], old[1]), "title": cls.alike(new[0], old[0]), "location": cls.place(new[2], old[2]), "job_type": 0.75, "posted": 1.0}
        fine = all(scores[k] >= n for k, n in cls.LEAST.items())
        if all(new) and new == old:
            return 0.96 if fine else None
        total = sum(scores[k] * w for k, w in cls.WEIGHTS.items())
        return total if fine and total >= 0.88 else None

    @classmethod
    def near(cls, new, old):
        """Whether two rows share a key: the profile, the company with a title word, or the title with the company's words."""
        words = lambda t: sorted(set(t.split()))
        return bool(new[1] == old[1] and set(words(new[0])[:8]) & set(words(old[0])[:8])) or (new[0] == old[0] and words(new[1])[:3] == words(old[1])[:3])

    @classmethod
    def clusters(cls, rows):
        found = {}
        for i, mine in rows:
            best = None
            for c, members in sorted(found.items()):
                if any(cls.near(mine, m) for m in members):
                    said = [x for m in members if (x := cls.sure(mine, m)) is not None]
                    if said and (best is None or max(said) > best[0]):
                        best = (max(said), c)
            found.setdefault(best[1] if best else i, []).append(mine)
            yield i, best[1] if best else i


def test_greedy_clusters_equal_a_plain_greedy(spark, sf):
    parts = sorted((r.p_partkey, (r.p_name, f"{r.p_brand} {r.p_type}".lower(), r.p_type.lower())) for r in spark.read.parquet(f"{sf}/part.parquet").collect())
    got = {r.idx: r.cluster_id for r in queries.queries()["q30_greedy_clusters"](spark, sf).collect()}
    assert got == dict(Plain.clusters(parts)) and len(set(got.values())) < len(parts)


def test_canonical_rows_equal_a_plain_greedy(spark, tmp_path):
    import random

    rnd = random.Random(5)
    parts = [(1, "cold bolt", "Brand#1", "STEEL"), (2, "old bolt", "Brand#1", "STEEL"), (3, "cold bolt", "Brand#2", "STEEL")]
    parts += [(i, f"{rnd.choice(['cold', 'old', 'gold', 'red'])} {rnd.choice(['bolt', 'bolts', 'nut'])}", rnd.choice(["Brand#1", "Brand#2"]), rnd.choice(["STEEL", "TIN"])) for i in range(4, 40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want: dict[int, int] = {}
    for _, c in Plain.clusters([(i, (name, brand.lower(), kind.lower())) for i, name, brand, kind in parts]):
        want[c] = want.get(c, 0) + 1
    got = {r.cluster_id: r for r in queries.queries()["q45_canonical_rows"](spark, str(tmp_path)).collect()}
    assert {c: r.input_rows for c, r in got.items()} == want
    assert 2 not in got and 3 in got and {c: r.company for c, r in got.items()} == {c: dict((p[0], p[2]) for p in parts)[c] for c in want}


def test_pace_and_retries():
    slept, now = [], [0.0]
    pace = evaluate.Pace(2.0, lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)), lambda: now[0])
    for _ in range(3):
        pace.wait()
    assert slept == [2.0, 2.0]
    left = [OSError("a"), type("Busy", (Exception,), {"retry_after": 7})("b"), None]

    def model(prompt):
        if e := left.pop(0):
            raise e
        return prompt.upper()

    waited: list = []
    assert evaluate.asked(model, "x", evaluate.Pace(0), 3, 1.0, sleep=waited.append) == "X" and 0.5 <= waited[0] <= 1 and waited[1] == 7
    left[:] = [OSError("a"), OSError("b")]
    assert evaluate.asked(model, "x", evaluate.Pace(0), 2, sleep=waited.append) == "Error: b"
    left[:] = [evaluate.QuotaSpent("no")]
    with pytest.raises(evaluate.QuotaSpent):
        evaluate.asked(model, "x", evaluate.Pace(0), sleep=waited.append)


def test_ratio_is_asymmetric_and_blended(spark):
    df = spark.createDataFrame([("abcd", "bcde", ["a"], ["a", "b"])], "a string, b string, x array<string>, y array<string>")
    r = df.select(similarity.sequence_ratio("a", "b").alias("r"), similarity.jaccard(F.col("x"), F.col("y")).alias("j"), similarity.blend(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("m")).first()
    assert (r.r, r.j) == (0.75, 0.5) and r.m == 0.75


def test_merge(spark):
    feats = resolve.features(listing(spark))
    got = {r.cluster_id: r for r in merge.merge(feats.join(resolve.clusters(feats).select("idx", "cluster_id"), "idx")).collect()}
    assert got[0].app == "LinkedIn | Indeed" and got[0].input_rows == 2 and got[0].keywords == ["GIS"] and len(got[0].provenance) == 2
    assert got[0].title == "GIS Analyst (m/f/d)" and got[0].posted == "2026-01-02"
    rows = export.export_rows(spark.createDataFrame([("A", "=t", None, "l", None, "<b>x</b>", "2026-01-01", ["k"], "https://u", None)], "app string, title string, company string, location string, job_type string, description string, posted string, keywords array<string>, job_url string, apply_url string"))
    assert rows.columns == fixed.EXPORT_COLUMNS
    r = rows.first()
    assert (r["Job Title"], r["Company"], r["Job URL"], r["Apply URL"], r["Posted"]) == ("'=t", "N/A", '=HYPERLINK("https://u", "Open Job")', "N/A", "2026-01-01 00:00:00")
    m = spark.sql("select array(map('a', '1', 'b', 'n/a', 'c', '3'), map('a', '0')) as m").select(merge.merge_maps(F.col("m")).alias("m")).first().m
    assert m == {"a": "0", "c": "3"}


def test_history(spark, tmp_path):
    rows = listing(spark).where("idx < 2")
    keys = history.identity_keys()
    seen = rows.where("idx = 0").select(F.explode(keys).alias("key"))
    assert history.not_seen(rows, keys, seen, "idx").count() == 0  # the apply link is the same
    assert history.not_seen(rows.withColumn("apply_url", F.lit(None).cast("string")), keys, seen, "idx").count() == 1  # another day
    legacy = history.expand_legacy(F.lit("profile|linkedin|gis analyst|geoco|berlin"))
    assert spark.range(1).select(legacy.alias("k")).first().k == ["profile|linkedin|gis analyst|geoco|berlin", "profile|any|geoco|gis analyst|berlin||"]
    out, old = f"file://{tmp_path}/runs", f"file://{tmp_path}/seen"
    for _ in range(2):
        export.write_run(rows.select("title"), seen, "2026-05-06 08-30-00", out, old)
    assert spark.read.parquet(old).count() == seen.distinct().count() and spark.read.parquet(out).count() == 2


def test_history_of_all_apply_links(spark):
    rows = listing(spark).where("idx < 3").withColumns({"apply_url": F.concat(F.lit("https://apply.example/"), F.when(F.col("idx") != 1, F.col("idx"))), "cluster_id": F.lit(0), "job_id": F.when(F.col("idx") == 0, F.lit("7")), "source": F.lit("linkedin")})
    again = rows.where("idx = 0").withColumns({"idx": F.lit(9), "apply_url": F.lit(None).cast("string"), "job_id": F.lit("7")})
    more = rows.where("idx = 2").withColumns({"idx": F.lit(8), "apply_url": F.lit("https://apply.example/8")})
    merged = merge.merge(resolve.features(rows.union(more).unionByName(again)))
    got = merged.select(history.canonical_keys().alias("k")).first().k
    assert sorted(k for k in got if k.startswith("apply|")) == [f"apply|//apply.example/{i}" for i in (0, 2, 8)]
    seen = spark.createDataFrame([("apply|//apply.example/8",)], "key string")
    assert history.not_seen(merged, history.canonical_keys(), seen, "cluster_id").count() == 0


def test_evaluation(spark):
    response = "1. Fit Evaluation\nVerdict: ❌ Not Suitable\nFit Score: 7/26\nGood, but far.\n\n\nUnsuitable Reasons: No SQL; Too far\n- no remote\nCustomized CV (LaTeX):\n```latex\n\\documentclass{x}\n```"
    r = one(spark, response, evaluate.parse_response)
    assert (r.verdict, r.fit_score, r.unsuitable_reasons, r.tailored_cv, r.error) == ("Not Suitable", 7, "No SQL; Too far\n- no remote", "\\documentclass{x}", "")
    assert r.reason == "Good, but far.\n\nNo SQL; Too far\n- no remote"
    assert one(spark, "Verdict: Maybe\nFit Score: 12", evaluate.parse_response).verdict == "Not Suitable"
    assert one(spark, "Verdict: Suitable\nFit Score: 27", evaluate.parse_response).verdict == "Error"
    assert one(spark, "no", evaluate.parse_response).error.startswith("Parsing failed: missing")
    assert one(spark, "1. a; b\n- c", evaluate.label_count) == 3
    queue = spark.createDataFrame([(2, "ad one"), (3, "ad two")], "row_number long, advertisement string")
    got = {r.row_number: r.response for r in evaluate.evaluate(queue, lambda p: f"Verdict: Suitable\nFit Score: {len(p) % 20}", "M", "CV").collect()}
    assert set(got) == {2, 3} and got[2].startswith("Verdict: Suitable")
    assert evaluate.dropped_columns(["Job Title", "Job Description", "AI Reason"]) == ["Job Description", "AI Reason"]
    said = spark.createDataFrame([("GIS Analyst", "Acme", "N/A", "x")], "`Job Title` string, Company string, Location string, `AI Verdict` string")
    assert said.select(evaluate.advertisement(said.columns)).first()[0] == "Job Title: GIS Analyst\nCompany: Acme"


def test_scan_plan(spark):
    assert scan.providers("xing jobs, linked in") == ["linkedin", "xing"] and scan.providers("?") == ["linkedin"] and len(scan.providers("all")) == 4
    now, before = datetime(2026, 5, 7, 9, 30), datetime(2026, 5, 6, 8, 30)
    assert scan.pushed_window("since_previous_run", now, before) == (25 * 3600 + 3600, True)
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["c"])], "id int, candidate_urls array<string>")
    plan = spark.createDataFrame([("a", 0), ("b", 1)], "url string, search_idx int")
    assert {r.id: r.search_idx for r in scan.attributed(rows, plan).collect()} == {1: 0, 2: None, 3: None}
    with pytest.raises(ValueError):
        scan.window_name("someday")


def test_payloads(spark):
    """Of each provider, against what its search takes."""
    told = "source string, keyword string, place string, seconds long, max_items int, geo_id string, levels array<string>, kinds array<string>, category string, direct_urls array<string>"

    def payload(source, keyword="", place="", seconds=None, max_items=9, geo_id=None, levels=None, kinds=None, category=None, direct_urls=None):
        df = spark.createDataFrame([(source, keyword, place, seconds, max_items, geo_id, levels, kinds, category, direct_urls)], told)
        return json.loads(payloads.with_payloads(df).first().payload)

    assert payload("indeed", "k", seconds=90_000, max_items=1500) == {"country": "de", "title": "k", "location": "", "limit": 1000, "datePosted": "3"}
    assert "datePosted" not in payload("indeed", "k", seconds=2_592_000) and payload("indeed", "k", max_items=0)["limit"] == 1
    url = "https://www.linkedin.com/jobs/search/?keywords=a+b&location=K%C3%B6ln&geoId=7&f_E=2%2C3&f_JT=F&position=1&pageNum=0&f_TPR=r3600"
    assert payload("linkedin", "a b", "Köln", 3600, 50, "7", ["2", "3"], ["F"]) == {"urls": [url], "count": 50, "scrapeCompany": False, "useIncognitoMode": True, "splitByLocation": False}
    assert "f_TPR" not in payload("linkedin", "a*~")["urls"][0] and "keywords=a%2A~&" in payload("linkedin", "a*~")["urls"][0]
    base = {"maxItems": 9, "maxConcurrency": 10, "minConcurrency": 1, "maxRequestRetries": 3, "proxy": {"useApifyProxy": True}}
    assert payload("stepstone", seconds=None, direct_urls=["u", "v"]) == base | {"startUrls": [{"url": "u"}, {"url": "v"}]}
    assert payload("stepstone", "GIS  Analyst", "Köln ", 90_000) == base | {"keyword": "gis-analyst", "location": "k%C3%B6ln", "postedWithin": "3"}
    assert payload("stepstone", category="IT") == base | {"category": "it"}
    assert payload("xing", direct_urls=["u"]) == {"startUrl": "u", "results_wanted": 9, "max_pages": 10, "proxyConfiguration": {"useApifyProxy": True}}
    assert payload("xing", "k", "Berlin", 60) == {"keyword": "k", "location": "Berlin", "results_wanted": 9, "max_pages": 10, "proxyConfiguration": {"useApifyProxy": True}}
    x = F.lit("x")
    more = spark.range(1).select(payloads.linkedin(F.array(x, x), F.lit(50), country="DE").alias("a"), payloads.stepstone(x, x, x, F.lit(None).cast("array<string>"), F.lit(None).cast("long"), F.lit(9), (20, 10), proxy_groups=["G"]).alias("b"), payloads.xing(x, x, F.lit(None).cast("string"), F.lit(9), max_pages=2, remote="FULL", proxy=False).alias("c")).first()
    assert json.loads(more.a) == {"urls": ["x", "x"], "count": 100, "scrapeCompany": False, "useIncognitoMode": True, "splitByLocation": True, "splitCountry": "DE"}
    assert json.loads(more.b)["minConcurrency"] == 10 and json.loads(more.b)["proxy"] == {"useApifyProxy": True, "apifyProxyGroups": ["G"]}
    assert json.loads(more.c) == {"results_wanted": 9, "max_pages": 2, "proxyConfiguration": {"useApifyProxy": False}, "keyword": "x", "location": "x", "remote": "FULL"}
    for source, urls in (("indeed", ["u"]), ("xing", ["u", "v"]), ("other", None)):
        with pytest.raises(Exception, match="direct addresses|unknown source"):
            payload(source, "k", direct_urls=urls)
    plan = spark.createDataFrame([(i, s) for i, s in enumerate(["linkedin"] * 3 + ["indeed"] * 2 + ["linkedin"] * 2)], "search_idx long, source string")
    assert [r.batch for r in payloads.batches(plan, 2).orderBy("search_idx").collect()] == [0, 0, 2, 3, 4, 5, 5]


def test_numbers_over_a_whole_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    assert sorted((r.k, r.row_number) for r in evaluate.numbered(df, "k").collect()) == [(i, i + 2) for i in range(1000)]
    assert {(r.k, r.batch) for r in scan.tiles(df, "k", 40).collect()} == {(i, i // 40) for i in range(1000)}
    assert evaluate.numbered(df.where("false"), "k").count() == 0


def test_configuration(spark, tmp_path):
    for name, said in {"good.json": '{"final_filters": {"max_applicants": 3}}', "list.json": "[1]", "bad.json": "{", "empty.txt": " \n"}.items():
        (tmp_path / name).write_text(said)
    assert scan.filter_config(spark, f"{tmp_path}/good.json")["final_filters"] == {"max_applicants": 3}
    for name in ("list.json", "bad.json", "empty.txt"):
        with pytest.raises(ValueError):
            scan.filter_config(spark, f"{tmp_path}/{name}")
    assert evaluate.header_places(["Job Title", "", "job-title", "App", None]) == {"job title": 0, "app": 3}


INDEED = {"key": "abc123", "url": "https://de.indeed.com/viewjob?jk=abc123", "jobUrl": "https://acme.example/apply", "title": "Data Engineer", "employer": {"name": "Acme Data", "ratingsValue": 4.1, "ratingsCount": 120}, "location": {"city": "Berlin", "admin1Code": "BE", "countryName": "Germany"}, "description": {"text": "Build."}, "datePublished": "2026-05-06", "baseSalary": {"minValue": 75000, "maxValue": "95000", "currencyCode": "EUR", "unitOfWork": "YEAR"}, "jobTypes": {"a": "Full-time"}, "attributes": {"0": "Python", "1": "SQL", "2": "3+ years experience", "3": "Hybrid work"}}
STEPSTONE = {"id": 12424623, "title": "GIS Analyst (Full-time)", "labels": [{"label": "Schnelle Bewerbung", "type": "x"}], "topLabels": ["Top Job"], "url": "/stellenangebote--x--12424623-inline.html", "companyName": "GeoCo", "location": "Berlin", "unifiedSalary": {"min": 60000, "max": 76000, "currency": "EUR", "period": "year"}, "workFromHome": "Remote"}
XING = {"job_id": "148355491.3c4997", "title": "Planner", "company": "City", "location": "Berlin", "location_country": "Germany", "matching_facts": [{"label": "Hybrid work"}], "url": "https://www.xing.com/jobs/x-1", "top_job": True}


def test_providers(spark):
    def row(source, item):
        return providers.normalise(spark.createDataFrame([(json.dumps(item),), ("[1]",), ("no json",)], "json string"), source).collect()

    (r,) = row("indeed", INDEED)
    assert (r.job_id, r.company, r.location, r.job_type, r.salary, r.work_mode, r.skills) == ("abc123", "Acme Data", "Berlin, BE, Germany", "Full-time", "EUR 75,000-95,000 / year", "Hybrid", ["Python", "SQL"])
    assert r.description.startswith("Build.\n\nIndeed structured metadata:\n- Salary: ")
    (r,) = row("stepstone", STEPSTONE)
    assert (r.job_id, r.job_type, r.job_url, r.salary, r.work_mode, r.tags) == ("12424623", "full-time", "https://www.stepstone.de/stellenangebote--x--12424623-inline.html", "EUR 60,000-76,000 / year", "Remote", ["Schnelle Bewerbung", "Top Job"])
    (r,) = row("xing", XING)
    assert (r.job_id, r.location, r.work_mode, r.tags) == ("148355491.3c4997", "Berlin, Germany", "Hybrid", ["Hybrid work"])
    (r,) = row("linkedin", {"jobTitle": "T", "companyDetails": {"name": "C"}, "postedAt": "2026-01-01", "id": 5, "flag": True})
    assert (r.title, r.company, r.posted, r.job_id) == ("T", "C", "2026-01-01", "5")
    with pytest.raises(ValueError):
        row("other", {})


def test_pipeline(spark):
    items = [(0, "indeed", "GIS", 0, INDEED), (1, "linkedin", "Data", 0, {"title": "Data Engineer", "companyName": "Acme Data GmbH", "location": "Berlin, BE, Germany", "employmentType": "Full-time", "postedAt": "2026-05-06", "applyUrl": "https://acme.example/apply?utm_source=l"}), (2, "xing", "Plan", 0, XING)]
    df = spark.createDataFrame([(a, b, c, d, json.dumps(e)) for a, b, c, d, e in items], "search_idx int, source string, keyword string, pos int, json string")
    seen = spark.createDataFrame([], "key string")
    got = pipeline.gather(df, seen, title_terms=["nothing"])
    assert sorted(r.app for r in got.collect()) == ["LinkedIn | Indeed", "Xing"]
    keys = got.select(F.explode(history.identity_keys(source="app")).alias("key"))
    assert history.not_seen(got, history.identity_keys(source="app"), keys, "cluster_id").count() == 0


def test_applicant_cap(spark):
    said = [{"applicantsCount": "51 applicants"}, {"applicantsCount": 50}, {}, {"applicantsLabel": "be early", "applicants": {"count": 20, "id": 999}}, {"applicants": [{"label": "Over 50 applicants"}]}, {"numApplicants": True}]
    items = [(i, s, "k", 0, json.dumps({"title": f"Role{i} {'abcdef'[i] * 8}", "companyName": f"Co{'uvwxyz'[i] * 6}", "company": f"Co{'uvwxyz'[i] * 6}", "location": "Berlin"} | a)) for i, (s, a) in enumerate(zip(["linkedin", "indeed", "xing", "stepstone", "linkedin", "indeed"], said, strict=True))]
    df = spark.createDataFrame(items, "search_idx int, source string, keyword string, pos int, json string")
    none = spark.createDataFrame([], "key string")
    got = pipeline.gather(df, none).collect()
    assert {r.title[:5]: r.applicant_count for r in got} == {"Role0": 51, "Role1": 50, "Role2": None, "Role3": 20, "Role4": 51, "Role5": None}
    kept = pipeline.gather(df, none, most_applicants=50)
    told = {r["Job Title"][:5]: r["Applicants"] for r in export.export_rows(kept).collect()}
    assert told == {"Role1": "50", "Role2": "N/A", "Role3": "be early", "Role5": "N/A"}


def test_data_sources(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "a.xlsx")
    datasource.write_sheet(path, "run", [["Job Title", "Company", ""], ["A & B", '=HYPERLINK("u", "x")'], ["", "C"]])
    got = spark.read.format("worksheet").option("path", path).load().collect()
    assert [(r.row_number, r.cells) for r in got] == [(2, ["A & B", '=HYPERLINK("u", "x")']), (3, ["", "C"])]
    assert datasource.column_name(28) == "AB" and datasource.column_number("AB7") == 27


def test_streaming(spark, tmp_path):
    from gleanery.streaming import incremental

    source, base = str(tmp_path / "in"), f"file://{tmp_path}"
    listing(spark).where("idx < 2").select("idx", "source_label", "title", "company", "location", "job_type", "posted", "apply_url").write.parquet(source)
    for more in ((0,), (5, 6)):
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        q = incremental.new_listings(stream, history.identity_keys(), "idx", f"{base}/keys", f"{base}/out", f"{base}/state")
        q.awaitTermination()
        n = spark.read.parquet(f"{base}/out").count()
        assert n == (2 if more == (0,) else 4)
        listing(spark).where("idx in (0, 5, 6)").select("idx", "source_label", "title", "company", "location", "job_type", "posted", "apply_url").write.mode("append").parquet(source)


def test_export_order_and_names(spark):
    df = spark.createDataFrame([(1, "2026-01-01", "a"), (2, None, "a"), (3, "3 days ago", "b")], "i int, p string, n string")
    assert [r.i for r in export.newest_first(df, "p", "i").collect()] == [3, 1, 2]
    assert sorted(r.unique_name for r in export.unique_names(df, "n", "i").collect()) == ["a", "a (2)", "b"]
