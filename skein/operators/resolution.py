"""Mentions -> entities: conflicts of spans, promotion, kinds by headword, described entities, suppression of relations, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import BLOCKED
from .gates import ROLES
from .paging import encode_cursor

#: Types that win over others, the first most (fixed values).
CORE = ("PERSON", "ORG", "PLACE", "ITEM")
#: Headword -> type of a name that ends with it (fixed values).
HEADS = {"spell": "SPELL", "potion": "DRUG", "ring": "ARTIFACT", "sword": "ARTIFACT", "crown": "ARTIFACT", "river": "PLACE", "forest": "PLACE", "guild": "ORG", "council": "ORG", "festival": "EVENT", "widget": "ITEM", "gadget": "ITEM", "bolt": "ITEM", "anvil": "ITEM", "rod": "ITEM"}


def _rank(kind: Column) -> Column:
    out = F.lit(len(CORE))
    for i, k in enumerate(CORE):
        out = F.when(kind == k, i).otherwise(out)
    return out


def span_winners(spans: DataFrame) -> DataFrame:
    """One entity for each (doc_id, start, end) that several claim (id, type, confidence): the surest, then the better type, then
    the smaller id. A struct minimum, so the claims aggregate before the shuffle."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), _rank(F.col("type")).alias("r"), F.col("id"), F.col("type")))
    return spans.groupBy("doc_id", "start", "end").agg(best.alias("b"), F.countDistinct("id").alias("n_claims")).select("doc_id", "start", "end", F.col("b.id").alias("id"), F.col("b.type").alias("type"), (-F.col("b.c")).alias("confidence"), "n_claims")


def surest_by_start(mentions: DataFrame) -> DataFrame:
    """The surest mention (doc_id, start, id, confidence) of each start; ties to the smaller id."""
    best = mentions.groupBy("doc_id", "start").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("id"))).alias("b"))
    return best.select("doc_id", "start", F.col("b.id").alias("id"), (-F.col("b.c")).alias("confidence"))


def promoted(clusters: DataFrame, whitelist: tuple[str, ...] = ()) -> DataFrame:
    """clusters (name, n, strong, introduced) with ``reason`` of promotion: mentions (two or more), whitelist, strong_ner,
    introduced; null defers."""
    low = [w.lower() for w in whitelist]
    reason = F.when(F.col("n") >= 2, "mentions").when(F.lower("name").isin(low) if low else F.lit(False), "whitelist").when(F.col("strong"), "strong_ner").when(F.col("introduced"), "introduced")
    return clusters.withColumn("reason", reason)


def kind_of(name: Column, votes: Column) -> Column:
    """The type with most votes (array of types; ties to the first in order of the alphabet), else that of the headword, else MISC."""
    counted = F.transform(F.array_sort(F.array_distinct(votes)), lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("v")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))["v"]
    head = F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv])[F.lower(F.substring_index(name, " ", -1))]
    return F.coalesce(best, head, F.lit("MISC"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, name, tier, confidence: the distinct "the (adjective) role" of each text, as entities of tier C."""
    pattern = rf"(?i)\b(the (?:[a-z]+ )?(?:{'|'.join([*ROLES, 'father', 'mother', 'son', 'daughter'])}))\b"
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))).alias("name"))
    return found.select("doc_id", "name", F.lit("TIER_C").alias("tier"), F.lit(0.4).alias("confidence"))


def raised(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities (doc_id, name, tier, ...) of tier C that a relation of their document has at either end rise to tier B."""
    ends = relations.select("doc_id", F.explode(F.array(F.lower("subj"), F.lower("obj"))).alias("name")).distinct().withColumn("_in", F.lit(True))
    rows = entities.join(ends, ["doc_id", "name"], "left")
    return rows.withColumn("tier", F.when((F.col("tier") == "TIER_C") & F.col("_in"), "TIER_B").otherwise(F.col("tier"))).select(entities.columns)


def without_young_teachers(relations: DataFrame) -> DataFrame:
    """Relations less teaches_at of those who are a child in any relation."""
    children = relations.where("pred = 'child_of'").select("subj").unionByName(relations.where("pred = 'parent_of'").select(F.col("obj").alias("subj"))).distinct()
    other, teaches = relations.where("pred <> 'teaches_at'"), relations.where("pred = 'teaches_at'")
    return other.unionByName(teaches.join(children, "subj", "left_anti").select(relations.columns))


#: A name that is told apart from brothers and sisters right behind it (fixed values).
SIBLING = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*,\s*(?i:(?:the\s+)?(?:eldest|oldest|younger|youngest|twin|middle)\s+(?:son|daughter|child|brother|sister|sibling))\b"


def without_siblings_as_parents(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """Relations (doc_id, subj, pred, obj as names, ...) less parent_of whose subject, and child_of whose object, is called the
    eldest, twin or another of several children in the same document ("Tom, the eldest son"). Case matters for the name
    alone, where a looser pattern takes the words before it for a part of it; a word that begins sentences ("Then Tom") may or
    may not be one. An anti-join on document and name; null texts name
    nobody, and relations with null ends stay."""
    whole = F.transform(F.regexp_extract_all("text", F.lit(SIBLING), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))
    bare = F.transform(whole, lambda x: F.regexp_replace(x, rf"^(?:{'|'.join(BLOCKED)}) ", ""))
    named = docs.select("doc_id", F.explode(F.array_union(whole, bare)).alias("_who"))
    parent = F.when(F.col("pred") == "parent_of", F.lower("subj")).when(F.col("pred") == "child_of", F.lower("obj"))
    asked = relations.where("pred in ('parent_of', 'child_of')").withColumn("_who", parent)
    return relations.where("pred is null or pred not in ('parent_of', 'child_of')").unionByName(asked.join(named.distinct(), ["doc_id", "_who"], "left_anti").select(relations.columns))


def first_of_appositives(relations: DataFrame, reach: int = 100) -> DataFrame:
    """Of relations (doc_id, pred, obj, start) with one predicate and object in a document: all where every next one begins within
    ``reach`` characters, else the first alone."""
    w = Window.partitionBy("doc_id", "pred", "obj")
    gap = F.col("start") - F.lag("start").over(w.orderBy("start", "subj"))
    rows = relations.withColumn("_gap", gap).withColumn("_r", F.row_number().over(w.orderBy("start", "subj")))
    rows = rows.withColumn("_far", F.coalesce(F.max("_gap").over(w), F.lit(0)) >= reach)
    return rows.where("not _far or _r = 1").drop("_gap", "_r", "_far")


def mode(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equal ones that which came first."""
    each = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return each.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("c"), F.col("first"), F.col(value))).getField(value).alias(value))


def connection(rows: DataFrame, key: str, after: str | None = None, first: int = 50) -> DataFrame:
    """key, cursor, has_next, has_previous: a page after a key, with whether rows lie on either side. One more row than the page is
    read, so nothing is counted."""
    more = rows.where(F.col(key) > after) if after is not None else rows
    page = more.orderBy(key).limit(first + 1)
    ranked = page.withColumn("_r", F.row_number().over(Window.orderBy(key)))  # first + 1 rows
    has_next = F.max("_r").over(Window.partitionBy()) > first
    cursor = F.base64(F.encode(F.concat(F.lit('{"k":"'), F.col(key), F.lit('"}')), "utf-8"))
    return ranked.withColumn("has_next", has_next).where(F.col("_r") <= first).select(key, cursor.alias("cursor"), "has_next", F.lit(after is not None).alias("has_previous"))


def cursor_of(key: str) -> str:
    return encode_cursor(key)


def with_ids(relations: DataFrame) -> DataFrame:
    """Relations with a null id filled in: the SHA-1 of subject, predicate and object."""
    return relations.withColumn("id", F.coalesce("id", F.sha1(F.concat_ws("|", "subj", "pred", "obj"))))


def lenient_json(text: Column, schema: str) -> Column:
    """The first object in braces of a text, whatever stands around it, with trailing commas taken out; null for none."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(body != "", F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), schema))
