"""Text functions as Columns. Missing is NULL inside; "" and N/A belong to the export."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed

#: White space as Python's \s, in Java's and DuckDB's dialects alike.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[a-z0-9]+(?:[+#][a-z0-9]+)?"


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def none_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def is_meaningful(c: Column) -> Column:
    return c.isNotNull() & ~F.lower(normalize_space(c)).isin(fixed.MISSING)


def meaningful(c: Column) -> Column:
    return let(c, lambda x: F.when(is_meaningful(x), x))


def first_of(*columns: Column) -> Column:
    """The first meaningful text."""
    return F.coalesce(*(meaningful(normalize_space(c)) for c in columns))


def _folded(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch.casefold()) if not unicodedata.combining(x))


@lru_cache(1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """By rule from the Unicode database: characters below U+2000 that fold to one, to what; longer foldings and later
    ones that hold ASCII; and what folds to nothing (accents on their own) as a class of a pattern."""
    single, more, ranges = {}, {}, []
    for code in (c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000):
        ch = chr(code)
        to = _folded(ch)
        if not to:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
        elif to != ch and code < 0x2000 and len(to) == 1:
            single[ch] = to
        elif to != ch and any(x < "\x80" for x in to):
            more[ch] = to
    return "".join(single), "".join(single.values()), more, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


#: Text that one pass folds: up to U+024F, without the longer foldings there but for the German one.
FOLDS_AT_ONCE = r"^[\x00-\xa7\xa9-\xae\xb0-\xb3\xb5-\xb7\xb9-\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u01c3\u01cd-\u01f0\u01f4-\u024f]*$"


def fold(c: Column) -> Column:
    """Case and accents folded inside the JVM. What is left of other scripts may differ from fold_full, ASCII never does."""
    source, target, more, nothing = _fold_tables()
    short = "".join(ch for ch in source if ch < "\u0250")
    at_once = F.replace(F.translate(c, short, target[: len(short)]), F.lit("ß"), F.lit("ss"))
    table = F.map_from_arrays(F.split(F.lit("\x00".join(more)), "\x00"), F.split(F.lit("\x00".join(more.values())), "\x00"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"  # before the rest: a few signs fold to capitals
    letters = F.regexp_extract_all(F.translate(F.regexp_replace(c, nothing, ""), upper + source, lower + target), F.lit("(?s)(.)"), F.lit(1))
    # a map is searched from its start, so only letters beyond ASCII are looked up
    rare = F.array_join(F.transform(letters, lambda x: F.when(x < "\x80", x).otherwise(F.coalesce(F.try_element_at(table, x), x))), "")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).when(c.rlike(FOLDS_AT_ONCE), F.lower(at_once)).otherwise(rare)


@F.pandas_udf(StringType())
def fold_full(s: pd.Series) -> pd.Series:
    """Folding for all of Unicode, in Arrow batches."""
    return s.map(lambda x: None if x is None else _folded(x))


def tokens(c: Column, folded: bool = False) -> Column:
    """The normalizers below take text that is folded already, too: a plan then folds each column once."""
    return F.regexp_extract_all(c if folded else fold(c), F.lit(f"({TOKEN})"), F.lit(1))


def without(array: Column, values: list[str]) -> Column:
    listed = words(values)
    return F.filter(array, lambda t: ~F.array_contains(listed, t))


def or_else(array: Column, other: Column) -> Column:
    return let(array, lambda a: F.when(F.size(a) > 0, a).otherwise(other))


def unique_ordered(array: Column) -> Column:
    """Meaningful values in first-seen order; case doesn't tell values apart."""
    pairs = F.transform(F.filter(F.transform(array, normalize_space), is_meaningful), lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    return let(pairs, lambda kept: F.transform(F.filter(kept, lambda x, i: F.array_position(kept["low"], x["low"]) == i + 1), lambda x: x["x"]))


def source_key(c: Column) -> Column:
    alias = F.create_map(*(F.lit(x) for kv in fixed.SOURCE_ALIASES.items() for x in kv))
    text = let(normalize_space(c), lambda x: F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " ")))
    return let(text, lambda t: F.coalesce(F.try_element_at(alias, t), none_if_blank(F.replace(t, F.lit(" "), F.lit("_"))), F.lit("unknown")))


def source_label(c: Column) -> Column:
    label = F.create_map(*(F.lit(x) for kv in fixed.SOURCE_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(label, source_key(c)), none_if_blank(normalize_space(c)), F.lit("Unknown"))


def source_rank(key: Column) -> Column:
    at = F.array_position(words(fixed.SOURCE_ORDER), key).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(fixed.SOURCE_ORDER))


def normalize_company(c: Column, folded: bool = False) -> Column:
    return let(tokens(c, folded), lambda found: F.array_join(or_else(without(found, fixed.LEGAL_SUFFIXES), found), " "))


def normalize_title(c: Column, folded: bool = False) -> Column:
    return let(tokens(c, folded), lambda found: F.array_join(or_else(without(found, fixed.TITLE_NOISE), found), " "))


def any_in(text: Column, values: list[str]) -> Column:
    return F.exists(words(values), lambda w: F.contains(text, w))


def remote_mode(c: Column, folded: bool = False) -> Column:
    mode = lambda t: F.when(any_in(t, fixed.HYBRID_WORDS), "hybrid").when(any_in(t, fixed.REMOTE_WORDS), "remote").when(any_in(t, fixed.ONSITE_WORDS), "onsite")
    return mode(c) if folded else let(fold(c), mode)


def normalize_location(c: Column, folded: bool = False) -> Column:
    if not folded:
        return let(fold(c), lambda x: normalize_location(x, True))
    alias = F.create_map(*(F.lit(x) for kv in fixed.CITY_ALIASES.items() for x in kv))
    kept = F.transform(without(tokens(c, True), fixed.LOCATION_NOISE), lambda t: F.coalesce(F.try_element_at(alias, t), t))
    named = let(kept, lambda k: F.array_join(or_else(without(k, fixed.COUNTRY_TOKENS), k), " "))
    return let(named, lambda n: F.when(n != "", n).when(remote_mode(c, True).isNotNull(), "remote").otherwise(""))


def normalize_job_type(c: Column, folded: bool = False) -> Column:
    if not folded:
        return let(fold(c), lambda x: normalize_job_type(x, True))
    hits = F.array_compact(F.array(*(F.when(F.contains(c, F.lit(k)), F.lit(v)) for k, v in fixed.JOB_TYPES.items())))
    types = F.create_map(*(F.lit(x) for kv in fixed.JOB_TYPES.items() for x in kv))

    def spoken(hits: Column) -> Column:
        fine = lambda t: ~(t.isin("full", "time") & F.array_contains(hits, "fulltime")) & ~(t.isin("part", "time") & F.array_contains(hits, "parttime")) & ~t.isin(fixed.JOB_TYPE_NOISE)
        return F.concat(hits, F.transform(F.filter(tokens(c, True), fine), lambda t: F.coalesce(F.try_element_at(types, t), t)))

    return F.when(is_meaningful(c), F.array_join(unique_ordered(let(hits, spoken)), " ")).otherwise("")


HYPERLINK = r'(?i)^=HYPERLINK\("((?:[^"]|"")*)"\s*[,;]\s*"((?:[^"]|"")*)"\)'


def hyperlink_url(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(HYPERLINK), F.trim(F.replace(F.regexp_extract(text, HYPERLINK, 1), F.lit('""'), F.lit('"')))).otherwise(text)


def hyperlink_label(c: Column) -> Column:
    return F.when(F.trim(c).rlike(HYPERLINK), F.replace(F.regexp_extract(F.trim(c), HYPERLINK, 2), F.lit('""'), F.lit('"')))


def hyperlink_formula(url: Column, label: str) -> Column:
    return F.when(url.isNull() | url.isin("", "N/A"), "N/A").otherwise(F.concat(F.lit('=HYPERLINK("'), F.replace(url, F.lit('"'), F.lit('""')), F.lit(f'", "{label}")')))


def sheet_safe(c: Column) -> Column:
    """A cell's text: N/A if blank, cut at the cell limit, and no formula."""
    text = F.trim(c)
    return (
        F.when(text.isNull() | (text == ""), "N/A")
        .when(F.length(text) > fixed.MAX_CELL, F.concat(F.substring(text, 1, fixed.MAX_CELL - 20), F.lit(" ... [truncated]")))
        .when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text))
        .otherwise(text)
    )


def identity_value(c: Column) -> Column:
    text = normalize_space(c)
    return F.when(text.isNull() | text.isin("", "N/A", "Open Job", "Open Apply"), "").otherwise(F.lower(text))


def normalize_header(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def clean_cell(c: Column) -> Column:
    text = normalize_space(c)
    return F.when(text.isNull() | (text == "N/A"), "").otherwise(text)


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def matches_terms(c: Column, terms: list[str]) -> Column:
    """Whether a text holds one of the terms, as it stands or by letters and digits alone."""
    plain = [t.casefold() for t in terms if t]
    bare = [x for t in terms if (x := "".join(ch for ch in t.casefold() if ch.isalnum()))]
    tests = [F.contains(F.lower(c), F.lit(t)) for t in plain] + [F.contains(alnum(c), F.lit(t)) for t in bare]
    found = F.lit(False)
    for t in tests:
        found = found | t
    return F.coalesce(found, F.lit(False))


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\xa0", "&copy;": "©", "&reg;": "®", "&euro;": "€", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&szlig;": "ß", "&amp;": "&"}


def decode_listed_entities(c: Column) -> Column:
    """Only those of ENTITIES, which SQL can say too; html_unescape takes all."""
    for name, ch in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """All entities, in Arrow batches."""
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


def strip_tags(c: Column) -> Column:
    """HTML to text lines, entities as they stand."""
    for pattern, to in ((r"(?i)<\s*br\s*/?\s*>", "\n"), (r"(?i)<\s*li[^>]*>", "\n* "), (r"(?i)</\s*(p|div|li|ul|ol|h[1-6]|tr|section|article)\s*>", "\n"), (r"<[^>]+>", " ")):
        c = F.regexp_replace(c, pattern, to)
    return c


def tidy_lines(c: Column) -> Column:
    for pattern, to in ((r"[ \t\r\f\x0b]+", " "), (r" *\n *", "\n"), (r"\n{2,}", "\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def html_to_text(c: Column) -> Column:
    return tidy_lines(html_unescape(strip_tags(c)))


def html_to_text_listed(c: Column) -> Column:
    """html_to_text with the entities of ENTITIES alone."""
    return tidy_lines(decode_listed_entities(strip_tags(c)))


def format_money(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_number(c, 2), r"0$", ""), r"\.0?$", "")
