"""Time expressions in text and their normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_M = "|".join(MONTHS)
_BEFORE = r"(?:(?:on|in|at|during|by)\s+)?"
#: family -> (pattern with one group around the expression, precision), in any case. A date is found by every family that
#: fits it (fixed values).
FAMILIES = {
    "iso_day": (r"\b(\d{4}-\d{2}-\d{2})\b", "day"),
    "iso_month": (r"\b(\d{4}-\d{2})\b", "month"),
    "year": (r"\b(\d{4})\b", "year"),
    "month_day_year": (rf"{_BEFORE}((?:{_M})\s+\d{{1,2}},?\s+\d{{4}})\b", "day"),
    "month_year": (rf"{_BEFORE}((?:{_M})\s+\d{{4}})\b", "month"),
    "age": (_BEFORE + r"(\d{1,4}\s+(?:T\.?A\.?|S\.?A\.?|F\.?A\.?|Fo\.?A\.?|Third\s+Age|Second\s+Age|First\s+Age|Fourth\s+Age))(?:\b|(?=\W)|$)", "year"),
    "about_year": (r"(?:on|in|at|during|by)\s+(\d{4})\b", "approximate"),
}


def time_expressions(text: Column) -> Column:
    """array<struct<family, precision, expression>> of one text, family by family."""
    found = []
    for family, (pattern, precision) in FAMILIES.items():
        found.append(_tagged(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1)), family, precision))
    return F.flatten(F.array(*found))


def first_position(text: Column, family: str) -> Column:
    """Where the first match of a family begins, prepositions included; null for none."""
    at = F.regexp_instr(text, F.lit("(?i)" + FAMILIES[family][0]))
    return F.when(at > 0, at - 1)


def without_preposition(expression: Column) -> Column:
    """struct<text, offset>: the expression without a leading preposition, and how many characters that was."""
    lead = F.length(F.regexp_extract(expression, r"(?i)^(\s*(?:on|in|at|during|by)\s+)", 1))
    return F.struct(F.substring(expression, lead + 1, F.length(expression)).alias("text"), lead.alias("offset"))


def _tagged(hits: Column, family: str, precision: str) -> Column:
    return F.transform(hits, lambda x: F.struct(F.lit(family).alias("family"), F.lit(precision).alias("precision"), x.alias("expression")))


def normalized(expression: Column, family: Column) -> Column:
    """YYYY-MM-DD; the first of the month or year where the day is open; "year-age" for invented calendars; else null."""
    month = F.lit(None).cast("string")
    for i, name in enumerate(MONTHS, 1):
        month = F.when(F.lower(expression).startswith(name.lower()), F.lit(f"{i:02d}")).otherwise(month)
    year = F.regexp_extract(expression, r"(\d{4})$", 1)
    day = F.lpad(F.regexp_extract(expression, r"\s(\d{1,2}),?\s", 1), 2, "0")
    low = F.lower(expression)
    age = (
        F.when(low.contains("third"), "TA").when(low.contains("second"), "SA").when(low.contains("first"), "FA").when(low.contains("fourth"), "FO").when(low.rlike(r"fo\.?a"), "FO")
        .otherwise(F.upper(F.replace(F.regexp_extract(expression, r"(?i)([TSF]\.?A)", 1), F.lit("."), F.lit(""))))
    )
    return (
        F.when(family == "iso_day", expression)
        .when(family == "iso_month", F.concat(expression, F.lit("-01")))
        .when(family == "year", F.concat(expression, F.lit("-01-01")))
        .when(family == "month_day_year", F.concat_ws("-", year, month, day))
        .when(family == "month_year", F.concat_ws("-", year, month, F.lit("01")))
        .when(family == "age", F.concat_ws("-", F.regexp_extract(expression, r"^(\d{1,4})", 1), age))
    )


def sortable_year(text: Column) -> Column:
    """The first run of one to five digits if it is a year from 1 to 9999, else null."""
    y = F.regexp_extract(text, r"(\d{1,5})", 1)
    n = F.when(y != "", y.cast("int"))
    return F.when(n.between(1, 9999), n)


def discourse_order(chapter: Column, paragraph: Column, sentence: Column) -> Column:
    """chapter * 100000 + paragraph * 1000 + sentence, missing parts as 0."""
    zero = F.lit(0)
    return F.coalesce(chapter, zero) * 100000 + F.coalesce(paragraph, zero) * 1000 + F.coalesce(sentence, zero)


def least_year(values: Column) -> Column:
    """The smallest year of an array of texts; null for none."""
    return F.array_min(F.transform(values, sortable_year))


def anchor_order(kind: Column, chapter: Column, paragraph: Column, sentence: Column, date: Column) -> Column:
    """A struct that sorts time anchors: absolute ones by date, then those in the text by place, then unknown ones."""
    rank = F.when(kind == "ABSOLUTE", 0).when(kind == "DISCOURSE", 1).otherwise(2)
    return F.struct(rank.alias("rank"), F.when(rank == 0, date).alias("date"), F.when(rank == 1, discourse_order(chapter, paragraph, sentence)).alias("place"))
