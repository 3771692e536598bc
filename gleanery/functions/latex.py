"""LaTeX sources as columns: sections, fonts, safety, compiler logs. All of it is JVM expressions.

A source is an array of parts, cut before each line that begins a section, so what other engines do with
offsets is slicing here, and counts code points throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from . import text

HEADING = r"[ \t]*\\section\*?\{([^}]+)\}"
CV = r"\\(?:documentclass|begin\{document\}|section\*?\{|textbf\{)"
FENCED = r"(?is)```(?:latex)?\s*(.*?)```"
LINE = r"(?:(?<=\n)|\A)"


def looks_like_cv(c: Column) -> Column:
    """False for null, too."""
    c = text.strip(F.coalesce(c, F.lit("")))
    return c.rlike(CV) & ~F.lower(c).isin(*fixed.NO_CV)


def fenced(c: Column) -> Column:
    """The first code block; null where there is none."""
    return F.when(c.rlike(FENCED), text.strip(F.regexp_extract(c, FENCED, 1)))


def parts(source: Column) -> Column:
    """The source before its first section, if it isn't empty, then each section."""
    return F.split(source, rf"(?md)(?=^{HEADING})")


def _title(c: Column) -> Column:
    return F.lower(text.normalize_space(c))


def place(array: Column, titles: list[str]) -> Column:
    """The number of the first part under one of the titles, from 1; 0 where there is none."""
    wanted = text.words([" ".join(t.split()).lower() for t in titles])
    found = F.transform(array, lambda p: F.array_contains(wanted, _title(F.regexp_extract(p, rf"\A{HEADING}", 1))))
    return F.array_position(found, True).cast("int")


def _glued(array: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(array, first, n), "")


def section_span(source: Column, titles: list[str]) -> Column:
    """A struct of start and end, from 0, of the first section under one of the titles; null where there is none."""
    array = parts(source)
    at = place(array, titles)
    before = F.length(_glued(array, F.lit(1), at - 1))
    return F.when(at > 0, F.struct(before.alias("start"), (before + F.length(F.get(array, at - 1))).alias("end")))


def section(source: Column, titles: list[str]) -> Column:
    array = parts(source)
    at = place(array, titles)
    return F.when(at > 0, text.strip(F.get(array, at - 1))).otherwise("")


def _before_end(source: Column) -> Column:
    """What stands before the line that ends the document: all of it where there is none."""
    ends = rf"(?sd)\A(.*?)(?={LINE}[ \t]*\\end\{{document\}})"
    return F.when(source.rlike(ends), F.regexp_extract(source, ends, 1)).otherwise(source)


def _rest(whole: Column, head: Column) -> Column:
    return F.substring(whole, F.length(head) + 1, F.length(whole))


def insertion_place(source: Column, before: list[str]) -> Column:
    """Where a section that is missing goes, from 0: before one of the titles, else before the document's end, else last."""
    array = parts(source)
    at = place(array, before)
    return F.when(at > 0, F.length(_glued(array, F.lit(1), at - 1))).otherwise(F.length(_before_end(source)))


def put_section(source: Column, new: Column, titles: list[str], before: list[str]) -> Column:
    """The source with the section under one of the titles replaced, or put in where it is missing."""
    array = parts(source)
    at = place(array, titles)
    have = at > 0
    cut = insertion_place(source, before)
    head = F.when(have, _glued(array, F.lit(1), at - 1)).otherwise(F.substring(source, F.lit(1), cut))
    tail = F.when(have, F.array_join(F.slice(array, at + 1, F.size(array)), "")).otherwise(F.substring(source, cut + 1, F.length(source)))
    pieces = F.array(F.regexp_replace(head, r"(?U)\s+\z", ""), new, F.regexp_replace(tail, r"\A\n+", ""))
    return text.strip(F.array_join(F.filter(pieces, lambda p: p != ""), "\n\n"))


def protect(source: Column, master: Column, titles: list[str] = fixed.PROTECTED_SECTIONS) -> Column:
    """The source with the master's protected sections."""
    out = text.strip(source)
    for title in titles:
        own = section(master, [title])
        names, before = (fixed.EDUCATION_TITLES, fixed.EDUCATION_BEFORE) if title == "Ausbildung" else ([title], [])
        out = F.when(own != "", put_section(out, own, names, before)).otherwise(out)
    return out


def with_fonts(source: Column) -> Column:
    """The source with Unicode fonts behind its document class, unless it chooses fonts itself."""
    bare = text.strip(source)
    own = bare.rlike(r"(?md)^[ \t]*(?:\\usepackage(?:\[[^\]]*\])?\{fontspec\}|\\setmainfont\b)")
    plain = F.regexp_replace(bare, r"(?md)^[ \t]*\\usepackage(?:\[[^\]]*\])?\{(?:inputenc|fontenc)\}[ \t]*(?:%[^\n]*)?\n?", "")
    to_class = rf"(?sd)\A(.*?{LINE}[ \t]*\\documentclass(?:\[[^\]]*\])?\{{[^}}]+\}}[ \t]*(?:%[^\n]*)?\n?)"
    head = F.regexp_extract(plain, to_class, 1)
    tail = F.regexp_replace(_rest(plain, head), r"\A\n+", "")
    block = F.lit(fixed.FONT_BLOCK)
    fonted = F.when(head == "", F.concat_ws("\n", block, plain)).otherwise(F.concat_ws("\n", F.regexp_replace(head, r"(?U)\s+\z", ""), block, tail))
    return F.when(own, bare).otherwise(text.strip(fonted))


def unsafe_command(source: Column) -> Column:
    """The first command that reaches for files; empty where there is none."""
    return F.regexp_extract(F.coalesce(source, F.lit("")), rf"(\\(?:{'|'.join(fixed.UNSAFE_LATEX)})\b)", 1)


def page_count(log: Column) -> Column:
    return F.regexp_extract(log, r"(?i)Output written on [^(]*\(\s*(\d+)\s+pages?\b", 1).try_cast("int")


def tail(log: Column, most: int = fixed.MAX_LOG) -> Column:
    log = text.strip(log)
    return F.when(F.length(log) <= most, log).otherwise(F.concat(F.lit("[truncated]\n"), F.right(log, F.lit(most))))


def error_cell(what: str | Column, details: Column, most: int = fixed.MAX_LOG) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    details = text.strip(F.coalesce(details, F.lit("")))
    message = F.when(details == "", what).otherwise(F.concat_ws(": ", what, details))
    short = F.concat(F.regexp_replace(F.left(message, F.lit(most - 25)), r"(?U)\s+\z", ""), F.lit(" ... [truncated]"))
    return F.when(F.length(message) <= most, message).otherwise(short)
