"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by turn, and adjacent turns of
one role are merged into one block. A block is

    <|turn|>role<|text|>text<|next|>text of the next turn of that role<|end|>

and blocks follow each other. In roles and texts, ``<``, any backslashes and ``|`` in a
row get one backslash more, so no control string can occur in them; taking one
backslash away gives the text back. The loss mask is the list of character spans of
the assistant's texts, without control strings.

Cases: a null text or role is empty; turns that tie are ordered by role and text, and
a null turn comes first; repeated rows are turns of their own; a null conv_id is a
conversation; an empty table gives no rows; other columns are left out. A conversation
becomes one string, so it has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
LOSS_ROLE = "assistant"
CHUNK = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (first: from 0, n_chars). turns: conv_id, turn, role, text."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.col("turns")[i - 1]["role"] != F.col("turns")[i - 2]["role"]))
    told = told.withColumn("starts", starts)
    after = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns") + 1)
    merged = F.transform("starts", lambda i, k: F.struct(F.col("turns")[i - 1]["role"].alias("role"), F.transform(F.slice("turns", i, after(k) - i), lambda t: escape(t["text"])).alias("texts")))
    told = told.select("conv_id", merged.alias("blocks"))
    head = lambda b: F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    told = told.select("conv_id", formatted.alias("formatted"), _pieces(head).alias("pieces"))
    chunk = lambda c: F.slice("pieces", c * CHUNK + 1, F.lit(CHUNK))
    told = told.withColumn("chunks", F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / CHUNK).cast("int")), lambda c: _chunk_spans(chunk(c))))
    bases = F.aggregate("chunks", F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c["at"])))
    told = told.withColumn("bases", F.slice(bases, F.lit(1), F.size("chunks")))
    spans = F.flatten(F.zip_with("chunks", "bases", lambda c, base: F.transform(c["spans"], lambda s: F.struct((s["first"] + base).alias("first"), s["n_chars"].alias("n_chars")))))
    return told.select("conv_id", "formatted", spans.alias("loss_spans"))


def _pieces(head) -> Column:
    """Each text in order: characters before it and behind it that are the template's, its own, and whether it is under the mask."""

    def of(b: Column) -> Column:
        return F.transform(
            b["texts"],
            lambda t, i: F.struct(
                F.when(i == 0, F.length(head(b))).otherwise(len(NEXT)).alias("before"), F.length(t).alias("n"),
                F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("behind"), (b["role"] == LOSS_ROLE).alias("loss"),
            ),
        )

    return F.flatten(F.transform("blocks", of))


def _chunk_spans(pieces: Column) -> Column:
    """Spans of some pieces, from the first one's begin, and all their characters. Chunks keep this growing in proportion: spans are appended to a short list."""
    none = F.expr("cast(array() as array<struct<first:int,n_chars:int>>)")

    def through(s: Column, p: Column) -> Column:
        span = F.array(F.struct((s["at"] + p["before"]).alias("first"), p["n"].alias("n_chars")))
        return F.struct((s["at"] + p["before"] + p["n"] + p["behind"]).alias("at"), F.when(p["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), through)


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted string: an array of structs of role and text, merged turns apart again."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substring_index(b, TEXT, -1), r"<\|next\|>"),
            lambda t: F.struct(unescape(F.substring(F.substring_index(b, TEXT, 1), F.lit(len(TURN) + 1), F.length(b))).alias("role"), unescape(t).alias("text")),
        ),
    )
    return F.flatten(turns)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["first"] + 1, s["n_chars"]))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = format_chats(turns).select("conv_id", "formatted", read_chats(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)
), u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
v AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS last_role,
    length(role) + len(regexp_extract_all(role, '<\\*\|')) AS role_chars, length(text) + len(regexp_extract_all(text, '<\\*\|')) AS text_chars
  FROM u)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN last_role IS NOT DISTINCT FROM role THEN 8 ELSE 23 + role_chars END) AS BIGINT) AS formatted_chars
FROM v GROUP BY conv_id
"""
