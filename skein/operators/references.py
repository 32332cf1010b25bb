"""Mention references: entity and document numbers, positions, packed words; the store of them and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with ``name``, a number from 1 on without gaps by the hash and value of the distinct ``key``.

    Numbers are ranks inside 65,536 parts plus the sizes of the parts before, so no task ranks more than a part.
    """
    h = F.md5(F.col(key))
    rows = rows.withColumn("_h", h).withColumn("_part", F.substring("_h", 1, 4))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)))
    return ranked.join(before, "_part").withColumn(name, F.col("_r") + F.col("_before")).drop("_h", "_part", "_r", "_before")


def eid_registry(mentions: DataFrame) -> DataFrame:
    """eid, key, canonical, occurrence_count: a number for each normal form of the mentions (surface); canonical is the longest
    surface, ties the smallest."""
    keyed = mentions.select(T.surface_key(F.col("surface")).alias("key"), "surface").where(F.length("key") >= 2)
    grouped = keyed.groupBy("key").agg(F.min(F.struct((-F.length("surface")).alias("l"), F.col("surface"))).getField("surface").alias("canonical"), F.count("*").alias("occurrence_count"))
    return numbered(grouped, "key", "eid").select("eid", "key", "canonical", "occurrence_count")


def references(spans: DataFrame, eids: DataFrame) -> DataFrame:
    """eid, did, position, length, surface of the spans (doc_id, ord, start, end, surface) of registered entities."""
    rows = spans.select(F.col("doc_id").alias("did"), F.col("start").alias("position"), (F.col("end") - F.col("start")).alias("length"), "surface", T.surface_key(F.col("surface")).alias("key"))
    return rows.join(eids.select("key", "eid"), "key").select("eid", "did", "position", "length", "surface")


def add_many(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store (eid, did, position, length, surface) with new references; one that is there already is not added again."""
    return store.unionByName(new.join(store, ["eid", "did", "position", "length"], "left_anti"))


def of_entity(store: DataFrame, eid: int) -> DataFrame:
    return store.where(F.col("eid") == eid)


def of_document(store: DataFrame, did: int) -> DataFrame:
    return store.where(F.col("did") == did)


def find_mentions(store: DataFrame, eids: DataFrame, name: str, did: int | None = None, limit: int = 100) -> DataFrame:
    """The references of the entity with that name, in order, those of one document if given."""
    wanted = eids.where(F.col("key") == T.surface_key(F.lit(name))).select("eid", "canonical")
    rows = store.join(wanted, "eid")
    if did is not None:
        rows = rows.where(F.col("did") == did)
    return rows.orderBy("did", "position").limit(limit)


def find_relationships(relations: DataFrame, eids: DataFrame, name: str, role: str = "any") -> DataFrame:
    """Relations (subj, pred, obj as normal forms) of the entity with that name as subject, object or any; both ends must be
    registered."""
    known = eids.select(F.col("key").alias("subj"), F.col("eid").alias("subj_eid"))
    rows = relations.join(known, "subj").join(known.withColumnsRenamed({"subj": "obj", "subj_eid": "obj_eid"}), "obj")
    key = T.surface_key(F.lit(name))
    fits = {"subject": F.col("subj") == key, "object": F.col("obj") == key}
    return rows.where(fits.get(role, fits["subject"] | fits["object"]))


def entity_stats(store: DataFrame, relations: DataFrame, eids: DataFrame) -> DataFrame:
    """eid, canonical, n_mentions, n_documents, n_aliases, n_relationships of each registered entity."""
    seen = store.groupBy("eid").agg(F.count("*").alias("n_mentions"), F.countDistinct("did").alias("n_documents"), F.countDistinct("surface").alias("n_aliases"))
    ends = relations.select(F.explode(F.array_distinct(F.array("subj", "obj"))).alias("key")).groupBy("key").agg(F.count("*").alias("n_relationships"))
    rows = eids.join(seen, "eid", "left").join(ends, "key", "left")
    return rows.select("eid", "canonical", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_mentions", "n_documents", "n_aliases", "n_relationships")])


def global_stats(store: DataFrame, eids: DataFrame, relations: DataFrame) -> DataFrame:
    a = store.agg(F.count("*").alias("n_references"), F.countDistinct("did").alias("n_documents"), F.countDistinct("surface").alias("n_aliases"))
    b = eids.agg(F.count("*").alias("n_entities"), F.coalesce(F.max("occurrence_count"), F.lit(0)).alias("most_occurrences"))
    return a.crossJoin(b).crossJoin(relations.agg(F.count("*").alias("n_relations")))  # three rows of totals


def most_referenced(store: DataFrame, eids: DataFrame, top: int = 10) -> DataFrame:
    """The entities with most references; ties to the smaller name."""
    return store.groupBy("eid").agg(F.count("*").alias("n")).join(eids.select("eid", "canonical"), "eid").orderBy(F.desc("n"), "canonical").limit(top)


def location_hash(*parts: Column) -> Column:
    """31 times the hash so far plus each part in 32 bits; the lowest 20 bits. Missing parts are 0."""
    wrapped = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    out = F.lit(0).cast("long")
    for p in parts:
        out = wrapped(out * 31 + F.coalesce(p, F.lit(0)).cast("long"))
    return out.bitwiseAND(F.lit(0xFFFFF))


def confidence_bin(confidence: Column) -> Column:
    """0 to 7."""
    return F.least(F.lit(7), F.greatest(F.lit(0), F.floor(confidence * 7))).cast("int")


def varint_hex(value: Column) -> Column:
    """A number below 2 to the 35 in groups of seven bits, least first, as hexadecimal text: the high bit says that more follow."""
    out = F.lit("")
    for k in range(5):
        group = F.shiftright(value.cast("long"), 7 * k).bitwiseAND(F.lit(127))
        more = F.shiftright(value.cast("long"), 7 * (k + 1)) > 0
        here = F.lpad(F.hex(group + F.when(more, 128).otherwise(0)), 2, "0")
        out = F.concat(out, F.when(F.lit(k == 0) | (F.shiftright(value.cast("long"), 7 * k) > 0), here).otherwise(""))
    return out


def packed(eid: Column, did: Column, flags: Column, paragraph: Column, token: Column, length: Column) -> Column:
    """The binary form of a reference without senses, alias and meta: eid, no senses, did in eight bytes (least first), flags,
    paragraph, first token and length."""
    hexed = F.lpad(F.hex(did.cast("long")), 16, "0")
    little = F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
    return F.unhex(F.concat(varint_hex(eid), F.lit("00"), little, F.lpad(F.hex(flags.cast("long")), 2, "0"), varint_hex(paragraph), varint_hex(token), varint_hex(length)))


def readable(eid: Column, did: Column, paragraph: Column, token: Column, length: Column) -> Column:
    return F.concat(eid.cast("string"), F.lit(" @ d:"), did.cast("string"), F.lit(" @ p:"), paragraph.cast("string"), F.lit(" @ t:"), token.cast("string"), F.lit("+"), length.cast("string"))
