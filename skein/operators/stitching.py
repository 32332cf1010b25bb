"""Spans that belong together become one; texts are rewritten by offsets, with a map between old and new offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .mentions import mention_spans
from .spans import asof_previous

#: Words in lower case that may stand inside a name (fixed values).
CONNECTORS = ("of", "the", "and", "de", "di", "del", "la", "le", "st", "st.", "mt", "mt.")
#: Types, the one that wins first (fixed values).
TYPES = ("PERSON", "PLACE", "ORG", "ARTIFACT", "ITEM", "WORK", "EVENT", "HOUSE", "TRIBE", "SPECIES", "TITLE")


def stitched(spans: DataFrame) -> DataFrame:
    """doc_id, start, end, text, type, n: runs of neighbouring spans (doc_id, ord, gap, surface, start, end, type).

    A span joins the one before it where only blanks, or blanks and one word that is a connector or has a capital, are between
    them and all their own words are such words; "and" does not join spans of one type (Harry and Ron are two). A run takes
    the type that ranks first; n is how many spans it is made of, 1 where nothing joined. ``gap`` is the text before a span;
    null surfaces are left out; doc_id must be unique to a text. One window by document, as the order in it is the result.
    """
    proper = F.forall(F.split("surface", r"\s+"), lambda w: F.lower(w).isin(*CONNECTORS) | w.rlike("^[A-Z]"))
    rows = spans.where("surface is not null").withColumn("_ok", proper).withColumn("_r", F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")).cast("int"), F.lit(0)))
    w = Window.partitionBy("doc_id").orderBy("ord")
    word = F.trim(F.regexp_replace("gap", r"\s+", " "))
    near = F.col("gap").rlike(r"^\s+([A-Za-z.'’]+\s+)?$") & ((word == "") | F.lower(word).isin(*CONNECTORS) | word.rlike("^[A-Z]"))
    apart = (F.lower(word) == "and") & F.lag("type").over(w).eqNullSafe(F.col("type"))
    joined = F.coalesce(near & F.col("_ok") & F.lag("_ok").over(w) & ~apart, F.lit(False))
    rows = rows.withColumn("_joined", joined).withColumn("_run", F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(w))
    part = F.struct("ord", F.when(F.col("_joined"), F.concat("gap", "surface")).otherwise(F.col("surface")).alias("t"))
    rank = F.when(F.col("_r") > 0, F.col("_r")).otherwise(len(TYPES) + 1)
    runs = rows.groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(part)).alias("parts"), F.min(F.struct(rank.alias("r"), F.col("type"))).alias("best"), F.count("*").alias("n"))
    return runs.select("doc_id", "start", "end", F.array_join(F.transform("parts", lambda x: x["t"]), "").alias("text"), F.col("best.type").alias("type"), "n")


def placed(edits: DataFrame) -> DataFrame:
    """doc_id, start, end, replacement, new_start, new_end: the edits (doc_id, start, end, replacement) that take effect, and
    where in the new text the replacement stands. Offsets are code points, end exclusive, within the text.

    In order of start (ties: the longer, then the replacement) an edit takes effect unless it overlaps any edit before it, so
    the result does not depend on the order of rows. Repeated edits count once; a null replacement is empty; edits with null
    or crossed offsets are left out. Running sums by document; no text is read.
    """
    rows = edits.where("start >= 0 and end >= start").select("doc_id", "start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")).distinct()
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "replacement").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.max("end").over(w)).where("_before is null or start >= _before").drop("_before")
    shift = F.coalesce(F.sum(F.length("replacement") - F.col("end") + F.col("start")).over(w), F.lit(0)).cast("int")
    rows = rows.withColumn("new_start", F.col("start") + shift)
    return rows.withColumn("new_end", F.col("new_start") + F.length("replacement"))


@F.pandas_udf(StringType())
def _cut_and_joined(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch in parts:
        out = []
        for text, starts, ends, words in zip(*batch, strict=True):
            at, pieces = 0, []
            for a, b, word in zip(starts, ends, words, strict=True):
                pieces += [text[at:a], word]
                at = b
            out.append("".join([*pieces, text[at:]]))
        yield pd.Series(out, dtype=object)


def rewritten(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the text after the edits that take effect (see ``placed``); null texts, and texts without
    edits, stay. A text's edits are joined to it once and applied in one pass, in time that grows with the text."""
    mine = placed(edits).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("new_start", "start", "end", "replacement"))).alias("_e"))
    rows = docs.join(mine, "doc_id", "left")
    field = lambda name: F.transform("_e", lambda x: x[name])
    changed = rows.where("_e is not null and text is not null")
    new = changed.withColumn("text", _cut_and_joined("text", field("start"), field("end"), field("replacement")))
    return new.unionByName(rows.where("_e is null or text is null")).select(*docs.columns)


def to_old(points: DataFrame, edits: DataFrame) -> DataFrame:
    """points (doc_id, at, ...), offsets in the new text, with ``old``: the offset of that code point in the old text, or, within
    a replacement, the start of what was replaced. ``edits`` as ``placed`` gives them; one union and one window by document."""
    ends = edits.select("doc_id", (F.col("new_end") - 1).alias("_end"), (F.col("new_start") - 1).alias("at"), F.struct("start", "end", "new_start", "new_end").alias("edit"))
    # The last edit of an offset: a later one, even of no length, begins further to the right or at the same place.
    last = ends.groupBy("doc_id", "at").agg(F.max(F.struct("edit.new_end", "edit.end", "edit")).alias("m")).select("doc_id", "at", F.col("m.edit").alias("edit"))
    found = asof_previous(points, last, ["doc_id"], "at", "edit")
    e = F.col("previous_edit")
    old = F.when(e.isNull(), F.col("at")).when(F.col("at") < e["new_end"], e["start"]).otherwise(F.col("at") - e["new_end"] + e["end"])
    return found.withColumn("old", old).drop("previous_edit")


def deictic_edits(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Edits that put "in" and the last place before it for every "there" of docs; places (doc_id, start, name)."""
    there = mention_spans(docs, r"(\b(?i:there)\b)").select("doc_id", "start", "end")
    found = asof_previous(there, places.select("doc_id", "start", "name"), ["doc_id"], "start", "name")
    return found.where("previous_name is not null").select("doc_id", "start", "end", F.concat(F.lit("in "), "previous_name").alias("replacement"))
