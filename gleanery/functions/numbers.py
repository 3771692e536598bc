"""Numbers in text: salaries and applicant counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, let, normalize_space


def salary_number(text: Column) -> Column:
    """A number with American or European separators and an optional k."""
    return let(F.lower(F.replace(F.trim(text), F.lit(" "), F.lit(""))), lambda t: let(F.regexp_replace(t, "k$", ""), _plain_number) * F.when(F.endswith(t, F.lit("k")), 1000).otherwise(1))


def _plain_number(t: Column) -> Column:
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    bare = F.regexp_replace(t, "[.,]", "")
    plain = (
        F.when(both & comma_last, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"[.,]\d{3}$"), bare)
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )
    return plain.try_cast("double")


PLAUSIBLE = {"hour": (5, 1_000), "month": (100, 100_000), "year": (1_000, 1_000_000)}


def parse_salary(value: Column) -> Column:
    """A struct of minimum, maximum, currency, period and raw; only raw if no number is plausible."""
    return let(normalize_space(value), lambda raw: let(fold(raw), lambda low: _salary(raw, low)))


def _salary(raw: Column, low: Column) -> Column:
    has = lambda *xs: low.rlike("|".join(xs))
    period = F.when(has("hour", "stunde"), "hour").when(has("month", "monat"), "month").otherwise("year")
    currency = F.when(F.contains(raw, F.lit("€")) | has("eur"), "EUR").when(F.contains(raw, F.lit("$")) | has("usd"), "USD").when(F.contains(raw, F.lit("£")) | has("gbp"), "GBP")
    found = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:[.,]\d+)?\s*k?)"), F.lit(1)), salary_number)

    def told(period: Column) -> Column:
        low_end, high_end = (F.when(period == "hour", PLAUSIBLE["hour"][i]).when(period == "month", PLAUSIBLE["month"][i]).otherwise(PLAUSIBLE["year"][i]) for i in (0, 1))
        return let(F.filter(found, lambda n: n.between(low_end, high_end)), lambda numbers: ranged(period, numbers))

    def ranged(period: Column, numbers: Column) -> Column:
        fit = F.size(numbers) > 0
        return F.struct(
            F.when(fit, F.array_min(numbers)).alias("minimum"), F.when(fit, F.array_max(numbers)).alias("maximum"),
            F.when(fit, currency).alias("currency"), F.when(fit, period).alias("period"), F.when(raw != "", raw).alias("raw"),
        )

    return let(period, told)


def midpoint(salary: Column) -> Column:
    return F.coalesce((salary["minimum"] + salary["maximum"]) / 2, salary["minimum"], salary["maximum"])


def applicant_count(value: Column) -> Column:
    """The largest number in a text; k means thousands; over, more than, > before it or + behind it add one."""
    text = F.lower(F.trim(value))
    at = lambda g: F.regexp_extract_all(text, F.lit(r"(\d[\d,.]*)\s*(k?)\s*(\+?)"), F.lit(g))
    before = F.split(text, r"\d[\d,.]*\s*k?\s*\+?")
    parts = F.arrays_zip(at(1).alias("n"), at(2).alias("k"), at(3).alias("p"), F.slice(before, 1, F.greatest(F.size(at(1)), F.lit(0))).alias("b"))

    def one(x: Column) -> Column:
        thousands = (F.replace(x["n"], F.lit(","), F.lit(".")).try_cast("double") * 1000).cast("long")
        plain = F.regexp_replace(x["n"], "[,.]", "").try_cast("long")
        more = (x["p"] == "+") | F.right(x["b"], F.lit(20)).rlike("over|more than|>")
        return F.when(x["k"] == "k", thousands).otherwise(plain) + F.when(more, 1).otherwise(0)

    return F.array_max(F.transform(parts, one))
