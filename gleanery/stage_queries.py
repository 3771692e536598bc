"""Queries on the edges of the stages: pairs that are kept apart, exported rows, provenance, answers, documents and run folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import filenames, text
from .operators import deltas, documents, evaluate, export, merge, resolve
from .registry import query, t
from .session import dealt, fresh_path


def _word(block, letters: str):
    return F.translate(F.lpad(block.cast("string"), 8, "0"), "0123456789", letters)


@query("""SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 6 = 5 THEN s_suppkey - 5 ELSE s_suppkey END AS cluster_id, CASE WHEN s_suppkey % 6 = 5 THEN 'equal_profile' ELSE 'first' END AS stage FROM supplier""")
def q80_blocked_clusters(s, d):
    """Six listings of each employer, alike but for what forbids a match: seniority, role (with one apply link), place, time; the last has none of these."""
    k = F.col("s_suppkey")
    m, block = k % 6, F.floor(k / 6)
    kind = F.when(m == 1, "Junior Platform Engineer").when(m == 2, "Senior Platform Analyst").otherwise("Senior Platform Engineer")
    rows = dealt(t(s, d, "supplier"), "s_suppkey").select(
        k.alias("idx"), F.concat(kind, F.lit(" for International Operations "), _word(block, "klmnopqrst")).alias("title"), F.concat(F.lit("Firm "), _word(block, "abcdefghij")).alias("company"), F.when(m == 3, "Bonn").otherwise("Berlin").alias("location"),
        F.when(m == 4, "2026-09-01").otherwise("2026-05-01").alias("posted"), F.when(m.isin(0, 2), F.concat(F.lit("https://apply.example/"), block.cast("string"))).alias("apply_url"),
    )
    return resolve.clusters(resolve.features(rows)).select("idx", "cluster_id", "stage")


@query("""SELECT '' AS "Application Status", 'LinkedIn | Xing' AS App, CASE WHEN s_suppkey % 4 = 0 THEN '''=' || s_name ELSE s_name END AS "Job Title", 'Firm ' || s_suppkey AS Company, 'Berlin' AS Location, CASE WHEN s_suppkey % 3 = 0 THEN 'N/A' ELSE 'Full-time' END AS "Job Type",
 'About' || chr(10) || '* ' || s_name AS "Job Description", CASE WHEN s_suppkey % 2 = 0 THEN '2026-05-01 08:00:00' ELSE '3 days ago' END AS Posted, CASE WHEN s_suppkey % 5 = 0 THEN 'N/A' ELSE CAST(s_suppkey AS VARCHAR) END AS Applicants, 'GIS, Data' AS "Keywords Matched",
 '=HYPERLINK("https://jobs.example/' || s_suppkey || '", "Open Job")' AS "Job URL", CASE WHEN s_suppkey % 3 = 0 THEN 'N/A' ELSE '=HYPERLINK("https://a.example/""' || s_suppkey || '", "Open Apply")' END AS "Apply URL",
 '' AS "AI Verdict", '' AS "AI Fit Score", '' AS "AI Unsuitable Reasons", '' AS "AI Tailored CV", '' AS "AI CV PDF" FROM supplier""")
def q81_export_rows(s, d):
    """Suppliers as canonical rows, in all columns of the export."""
    k = F.col("s_suppkey")
    key = k.cast("string")
    rows = t(s, d, "supplier").select(
        F.lit("LinkedIn | Xing").alias("app"), F.when(k % 4 == 0, F.concat(F.lit("="), "s_name")).otherwise(F.col("s_name")).alias("title"), F.concat(F.lit("Firm "), key).alias("company"), F.lit(" Berlin ").alias("location"), F.when(k % 3 == 0, None).otherwise("Full-time").alias("job_type"),
        F.concat(F.lit("<p>About</p><ul><li>"), "s_name", F.lit("</li></ul>")).alias("description"), F.when(k % 2 == 0, "2026-05-01T08:00:00Z").otherwise("3 days ago").alias("posted"), F.when(k % 5 == 0, None).otherwise(key).alias("applicants"),
        F.array(F.lit("GIS"), F.lit("Data")).alias("keywords"), F.concat(F.lit("https://jobs.example/"), key).alias("job_url"), F.when(k % 3 == 0, None).otherwise(F.concat(F.lit('https://a.example/"'), key)).alias("apply_url"),
    )
    return export.export_rows(rows)


@query("""WITH k AS (SELECT s_suppkey AS k, s_suppkey // 2 AS c, CASE WHEN s_suppkey % 2 = 0 THEN 'Xing' ELSE 'LinkedIn' END AS label, s_name FROM supplier), j AS (SELECT c, label, '{"label":"' || label || '","source":"' || lower(label) || '","job_id":"J' || k || '","job_url":"https://jobs.example/' || k || '?utm_source=x","job_url_key":"//jobs.example/' || k ||
 CASE WHEN label = 'Xing' THEN '","apply_url":"https://a.example/' || k || '","apply_url_key":"//a.example/' || k ELSE '' END || '","title":"' || s_name || '","company":"Co","location":"Berlin","keywords":["' || CASE WHEN label = 'Xing' THEN 'GIS","Data' ELSE 'GIS' END || '"]}' AS one FROM k)
SELECT c AS cluster_id, '[' || string_agg(one, ',' ORDER BY label) || ']' AS provenance FROM j GROUP BY 1""")
def q82_provenance_json(s, d):
    """Suppliers as hits of two sources, each heard of by two keywords or one; a cluster's provenance as JSON."""
    k = F.col("s_suppkey")
    key, xing = k.cast("string"), k % 2 == 0
    link = F.when(xing, F.concat(F.lit("https://a.example/"), key))
    rows = t(s, d, "supplier").select(
        F.floor(k / 2).cast("long").alias("cluster_id"), "s_suppkey", F.when(xing, "xing").otherwise("linkedin").alias("source"), F.concat(F.lit("J"), key).alias("job_id"), F.concat(F.lit("https://jobs.example/"), key, F.lit("?utm_source=x")).alias("job_url"),
        link.alias("apply_url"), F.when(xing, F.concat(F.lit("//a.example/"), key)).alias("apply_key"), F.col("s_name").alias("title"), F.lit("Co").alias("company"), F.lit("Berlin").alias("location"), F.posexplode(F.when(xing, F.array(F.lit("GIS"), F.lit("Data"), F.lit("gis"))).otherwise(F.array(F.lit("GIS")))).alias("pos", "keyword"),
    )
    rows = rows.withColumns({"idx": k * 4 + F.col("pos"), "source_label": text.source_label(F.col("source"))})
    return merge.provenance(rows).select("cluster_id", merge.provenance_json(F.col("provenance")).alias("provenance"))


@query(r"""SELECT doc_id, CASE WHEN toxic = 1 THEN 'Not Suitable' ELSE 'Suitable' END AS verdict, 'Reason of ' || doc_id || CASE WHEN toxic = 1 THEN chr(10) || chr(10) || 'No SQL' ELSE '' END AS reason, CASE WHEN toxic = 0 AND quality = 1 THEN '\documentclass{cv} ' || doc_id ELSE '' END AS cv,
 CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END AS asks_again FROM labels""")
def q83_answers_parsed(s, d):
    """Answers of a model on each labelled document: the reason without lines that are read by machine, the CV apart from it, and which are asked again."""
    q, x, key = F.col("quality"), F.col("toxic"), F.col("doc_id").cast("string")
    head = F.when(x == 1, "Verdict: Not Suitable").otherwise("Verdict: Suitable")
    reasons = F.when(x == 1, "\n\n\n\nUnsuitable Reasons: No SQL").otherwise("\nUnsuitable reasons:")
    cv = F.when((x == 0) & (q == 1), F.concat(F.lit("\n2. Customized CV (LaTeX):\n```latex\n\\documentclass{cv} "), key, F.lit("\n```"))).otherwise("")
    answer = F.concat(F.lit("1. Fit Evaluation\n"), head, F.lit("\nFit Score: 7/26\nReason of "), key, reasons, cv)
    told = t(s, d, "labels").select("doc_id", answer.alias("answer"), evaluate.parse_response(answer).alias("r"))
    again = (F.col("r.verdict") == "Suitable") & F.contains(evaluate.retry_prompt("M", F.lit(" ad "), "CV", F.when(F.col("r.tailored_cv") == "", F.col("answer"))), F.lit("\n\n# Job advertisement\n\nad\n\n# Master CV (LaTeX)\n\nCV"))
    return told.select("doc_id", "r.verdict", "r.reason", F.col("r.tailored_cv").alias("cv"), F.coalesce(again, F.lit(False)).cast("int").alias("asks_again"))


@query(r"""SELECT p_partkey + 2 AS row_number, (p_partkey + 2) || '_CV_Ada_Lovelace_' || replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '_') || '.pdf' AS file_name, CASE WHEN p_partkey % 4 = 0 THEN '\input' ELSE '' END AS unsafe FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 > 0""")
def q84_document_candidates(s, d):
    """Parts as evaluated rows: which get a document, under what name, and which sources may not be compiled."""
    n = F.col("p_partkey")
    rows = t(s, d, "part").select((n + 2).alias("row_number"), F.concat_ws(" / ", "p_name", "p_brand").alias("display_name"))
    cv = F.when(n % 3 > 0, F.concat(F.lit("\\documentclass{a}\n"), F.when(n % 4 == 0, "\\input{x}").otherwise(""), F.col("p_name"))).otherwise("no source")
    done = t(s, d, "part").select((n + 2).alias("row_number"), F.when(n % 2 == 0, "Suitable").otherwise("Not Suitable").alias("verdict"), cv.alias("tailored_cv"))
    return documents.candidates(rows, done, "Ada Lovelace").select("row_number", "file_name", F.coalesce("unsafe", F.lit("")).alias("unsafe"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS folder FROM events")
def q85_run_folders(s, d):
    return t(s, d, "events").select("event_id", filenames.run_folder(F.col("ts")).alias("folder"))


@query("""SELECT s_suppkey, s_name AS "Job Title", '' AS "AI Fit Score", '' AS "AI Unsuitable Reasons", '' AS "AI Tailored CV", '' AS "AI CV PDF", 'old' AS "ai verdict" FROM supplier""")
def q86_output_columns(s, d):
    """Rows of an older sheet get the evaluation's columns that they lack, and lose those that are done with."""
    rows = t(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("Job Title"), F.lit("old").alias("ai verdict"), F.lit("r").alias("AI Reason"), F.lit("d").alias("Job Description"), F.lit("m").alias("AI Model"))
    out = evaluate.with_output_columns(rows)
    return out.drop(*evaluate.dropped_columns(out.columns))


@query("SELECT d.doc_id, d.source, coalesce(l.q, d.lang) AS lang FROM documents d LEFT JOIN (SELECT doc_id, 'q' || quality AS q FROM labels) l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.doc_id % 7 > 0")
def q87_upserts_in_deltas(s, d):
    """Documents as a table of ranged files, labels as a delta, and a second delta that takes every seventh labelled document out; half of it compacted."""
    at = fresh_path(s, "deltas")
    docs, labels = t(s, d, "documents").select("doc_id", "source", "lang"), t(s, d, "labels")
    deltas.create(docs, at, "doc_id", 16)
    new = labels.join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "source", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    deltas.upsert(new, at, "doc_id")
    deltas.compact(s, at, "doc_id")
    deltas.upsert(new.limit(0), at, "doc_id", labels.where("doc_id % 7 = 0").select("doc_id"))
    return deltas.read(s, at, "doc_id")
