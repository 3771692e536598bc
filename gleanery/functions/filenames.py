"""File names: stems safe for any store, ASCII tokens, the name of a row's document, the folder of a run."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed
from . import text


@F.pandas_udf(StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Unicode's form NFKC, which the JVM's functions lack."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def ascii_only(s: pd.Series) -> pd.Series:
    """Letters without their marks; what ASCII lacks goes."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def safe_stem(value: Column, most: int = fixed.MAX_FILE_NAME) -> Column:
    ends = r"^[ ._-]+|[ ._-]+$"
    clean = text.normalize_space(F.regexp_replace(compatible(F.coalesce(value, F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]+', " "))
    stem = F.regexp_replace(clean, ends, "")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(stem, F.lit(most)), r"[ ._-]+$", ""), F.lit("")), F.lit("CV"))


def safe_token(value: Column, most_words: int | None = None, drop: list[str] = (), otherwise: str = "CV") -> Column:
    found = F.regexp_extract_all(ascii_only(F.coalesce(value, F.lit(""))), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    if drop:
        found = F.filter(found, lambda w: ~F.lower(w).isin(*drop))
    if most_words is not None:
        found = F.slice(found, 1, most_words)
    return F.coalesce(F.nullif(F.array_join(found, "_"), F.lit("")), F.lit(otherwise))


def role_and_company(name: Column) -> Column:
    """A struct of role and company, which ` / ` parts once."""
    both = F.transform(F.split(F.coalesce(name, F.lit("")), " / ", 2), text.strip)
    return F.struct(F.coalesce(F.get(both, 0), F.lit("")).alias("role"), F.coalesce(F.get(both, 1), F.lit("")).alias("company"))


def document_name(row_id: Column, name: Column, applicant: str = "Applicant") -> Column:
    """id_CV_applicant_role_company.pdf, of at most 156 characters before the ending."""
    row_id, said = row_id.cast("string"), role_and_company(name)
    tokens = [safe_token(F.lit(applicant), 4), safe_token(said["role"], 5, otherwise=""), safe_token(said["company"], 4, fixed.COMPANY_SUFFIXES, "")]
    stem = F.concat_ws("_", row_id, F.lit("CV"), *(F.nullif(x, F.lit("")) for x in tokens))
    short = F.regexp_replace(F.left(stem, F.lit(fixed.MAX_STEM)), "_+$", "")
    return F.concat(F.when(F.length(stem) > fixed.MAX_STEM, short).otherwise(stem), F.lit(".pdf"))


def run_folder(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")


def duration(seconds: Column) -> Column:
    """1h 2m 3s, 2m 3s or 3s; halves go to the even second."""
    n = F.bround(seconds, 0).cast("long")
    h, m, s = (F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60)
    said = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    return F.concat_ws(" ", F.when(h > 0, said(h, "h")), F.when(n >= 60, said(m, "m")), said(s, "s"))
