"""Pairs of texts that may be alike, by keys that such texts must share and bounds that need no Python.

Texts whose blend reaches `least` have a word overlap or a matching-block ratio that does.

* Overlap: of the words of both, in one order of rarity, the first ones meet: all but as
  many as the overlap asks for, and one.
* Ratio: matching blocks are a common subsequence of at least L = least * s / 2 characters,
  s being both lengths. At most s - 2 L of its L - 1 neighbours are torn apart in one text or
  the other, so 3 L - 1 - s bigrams or more stand in both, and prefixes of rare bigrams meet likewise.

Rarity is counted within a group, so a word that is common in one group may lead in
another. A mark that more than ``HOT`` texts of a group have brings nobody together by
itself: texts that have to share two marks or more share two of those that lead when one more
leads, so a hot mark is joined with each other one, and only such pairs meet. (Two hot marks
of the same texts still make one long list.) What meets goes through the length bound, then
through letter counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity

SLACK = 1e-9
HOT = 1000


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def _marks(least: float) -> Column:
    """Words and bigrams of `text`, each with how many of its kind lead."""
    told, size = words(F.col("text")), F.length("text")
    pairs = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(F.col("text"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    shared = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * 2 * size / (2 - least) - 1 - SLACK))
    lead = {"w": F.size(told) - F.ceil(F.size(told) * least - SLACK) + 1, "g": size - 1 - shared + 1}
    mark = lambda kind, x: F.transform(x, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("mark"), lead[kind].cast("int").alias("lead")))
    return F.concat(mark("w", told), mark("g", F.array_distinct(pairs)))


def _keys(hot: int) -> Column:
    """What brings a text together with others, of its marks `m` (n, mark; rare ones first), of which `lead` lead."""
    lead, several = F.greatest("lead", F.lit(1)), F.col("lead") < F.size("m")
    alone = F.transform(F.filter(F.slice("m", 1, lead), lambda x: (x["n"] > 1) & ((x["n"] <= hot) | ~several)), lambda x: x["mark"])
    more = F.filter(F.slice("m", 1, lead + 1), lambda x: x["n"] > 1)
    joined = lambda x, y: F.concat(F.least(x["mark"], y["mark"]), F.lit("\x00"), F.greatest(x["mark"], y["mark"]))
    pairs = F.flatten(F.transform(F.filter(more, lambda x: x["n"] > hot), lambda x: F.transform(F.filter(more, lambda y: y["mark"] != x["mark"]), lambda y: joined(x, y))))
    return F.concat(alone, F.when(several, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>")))


def keyed(texts: DataFrame, least: float, hot: int = HOT) -> DataFrame:
    """grp, kind, mark and text: texts of a group that may reach `least` share a mark of a kind. texts: grp, text, each once."""
    marked = texts.select("grp", "text", F.explode(_marks(least)).alias("m")).select("grp", "text", "m.*")
    rare = marked.groupBy("grp", "kind", "mark").agg(F.count("*").alias("n")).where("n > 1")  # what one text has leads to none
    ordered = marked.join(rare, ["grp", "kind", "mark"], "left").groupBy("grp", "text", "kind").agg(F.first("lead").alias("lead"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "mark"))).alias("m"))
    return ordered.select("grp", "text", "kind", F.explode(_keys(hot)).alias("mark"))


def close_pairs(texts: DataFrame, least: float, hot: int = HOT) -> DataFrame:
    """grp, a and b of all pairs a < b of different texts of one group whose blend may reach `least` (0.8 or more). texts: grp, text."""
    if least < 0.8:
        raise ValueError("texts of a lower likeness need not share a bigram")
    once = texts.where(F.col("text") != "").select("grp", "text").distinct()
    first = keyed(once, least, hot)
    a, b = first.withColumnRenamed("text", "a"), first.withColumnRenamed("text", "b")
    sized = similarity.length_bound(F.length("a"), F.length("b")) >= least
    met = a.join(b, ["grp", "kind", "mark"]).where((F.col("a") < F.col("b")) & ((F.col("kind") == "w") | sized)).select("grp", "a", "b").distinct()
    told = once.select("grp", "text", words(F.col("text")).alias("w"), similarity.letters(F.col("text")).alias("l"))
    side = lambda x: told.select("grp", F.col("text").alias(x), F.col("w").alias(f"{x}_w"), F.col("l").alias(f"{x}_l"))
    both = met.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"])
    may = similarity.blend_reaches(similarity.letter_bound(F.col("a_l"), F.col("b_l")), similarity.jaccard(F.col("a_w"), F.col("b_w")), least)
    return both.where(may).select("grp", "a", "b")
