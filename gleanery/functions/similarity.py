"""Similarity of listings: Columns where built-ins say it, one Arrow UDF for the sequence ratio."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import fixed
from .text import words


def ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts; no built-in equals it."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def blend(text_a: Column, text_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    seq = sequence_ratio(text_a, text_b)
    return F.when((text_a == text_b) & (text_a != ""), 1.0).otherwise(F.greatest(seq, 0.65 * jaccard(tokens_a, tokens_b) + 0.35 * seq))


#: The characters that bounds tell apart; all others count as one.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789+# "


def letters(text: Column) -> Column:
    """A number for each character of a text: which of LETTERS it is (all others are one), and the how many-eth of them. Two texts
    share as many numbers as they share letters, each as often as the text that has fewer of it."""
    count = lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    upto = lambda k, n: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: k * F.lit(1 << 24) + i))
    told = F.array_compact(F.transform(F.array(*map(F.lit, LETTERS)), lambda c, k: upto(k, count(c))))
    rest = F.length(F.translate(text, LETTERS, ""))
    return F.concat(F.flatten(told), F.coalesce(upto(F.lit(len(LETTERS)), rest), F.array().cast("array<int>")))


def length_bound(a: Column, b: Column) -> Column:
    """Never below the ratio of texts of two lengths: matching blocks are no longer than the shorter text."""
    return 2.0 * F.least(a, b) / F.greatest(a + b, F.lit(1))


def letter_bound(a: Column, b: Column) -> Column:
    """Never below the ratio of texts with these letters(): no letter is matched more often than both texts hold it."""
    return 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))


def blend_reaches(ratio_bound: Column, overlap: Column, least: float) -> Column:
    """Whether blend() of unequal texts may reach `least`: it is never above the larger of the ratio and the overlap."""
    return (ratio_bound >= least) | (overlap >= least - 1e-9)


def conflicting_seniority(a: Column, b: Column) -> Column:
    junior, senior = words(fixed.SENIORITY_JUNIOR), words(fixed.SENIORITY_SENIOR)
    return (F.arrays_overlap(a, junior) & F.arrays_overlap(b, senior)) | (F.arrays_overlap(b, junior) & F.arrays_overlap(a, senior))


def conflicting_role(a: Column, b: Column) -> Column:
    roles = words(fixed.ROLE_FAMILIES)
    x, y = F.array_intersect(a, roles), F.array_intersect(b, roles)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


def confidence(scores: dict[str, Column]) -> Column:
    return sum((w * scores[k] for k, w in fixed.WEIGHTS.items()), F.lit(0.0))
