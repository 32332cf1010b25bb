"""Relation hygiene: filters, inverses, deduplication with survivorship, suppressions, conflicts.

Relations: (subj, pred, obj, confidence, extractor, doc_id, sent). All operators aggregate before they shuffle or join on
keys; none collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predicates that mean the same in the same direction (fixed values).
PREDICATE_ALIASES = {
    "heads": "leads", "runs": "leads", "directs": "leads", "manages": "leads",
    "employed_at": "works_at", "employed_by": "works_at",
    "resides_in": "lives_in", "dwells_in": "lives_in",
    "wed_to": "married_to", "spouse_of": "married_to",
}
#: Inverse of a predicate (the supplied tables' predicates among them).
INVERSES = {
    "parent_of": "child_of", "child_of": "parent_of", "mentored": "mentored_by", "mentored_by": "mentored", "rules": "ruled_by",
    "married_to": "married_to", "sibling_of": "sibling_of", "friends_with": "friends_with", "enemy_of": "enemy_of",
    "bought": "bought_by", "supplies": "supplied_by", "part_of": "contains",
}


def lookup(column: Column, mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[column]


def canonical_predicate(pred: Column) -> Column:
    return F.coalesce(lookup(pred, PREDICATE_ALIASES), pred)


def with_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """subj_name and obj_name; the id where an entity is unknown. The names are merged, not broadcast, for what ``drop_dangling``
    says, and replace the id before the next shuffle unless both are asked for."""
    named = relations
    for end in ("subj", "obj"):
        names = entities.select(F.col("id").alias(end), F.col("canonical").alias("_n")).hint("merge")
        named = named.join(names, end, "left").withColumn(f"{end}_name", F.coalesce("_n", end)).drop("_n")
    return named


def query(relations: DataFrame, entities: DataFrame, *, subj=None, pred=None, obj=None, subj_name=None, obj_name=None, min_confidence=None) -> DataFrame:
    """Relations that fit all conditions that are given; names are matched as parts, case left aside."""
    for column, value in (("subj", subj), ("pred", pred), ("obj", obj)):
        if value is not None:
            relations = relations.where(F.col(column) == value)
    if min_confidence is not None:
        relations = relations.where(F.col("confidence") >= min_confidence)
    for column, part in (("subj", subj_name), ("obj", obj_name)):
        if part is not None:
            fit = entities.where(F.lower("canonical").contains(part.lower())).select(F.col("id").alias(column))
            relations = relations.join(fit, column, "left_semi")
    return relations


def in_and_out(relations: DataFrame, entity_id: str) -> DataFrame:
    """Relations of one entity with direction out or in; a loop is both."""
    out = relations.where(F.col("subj") == entity_id).withColumn("direction", F.lit("out"))
    return out.unionByName(relations.where(F.col("obj") == entity_id).withColumn("direction", F.lit("in")))


def with_inverses(relations: DataFrame) -> DataFrame:
    """The relations and, for predicates that have one, their inverses."""
    swapped = {"subj": F.col("obj").alias("subj"), "obj": F.col("subj").alias("obj"), "pred": lookup(F.col("pred"), INVERSES).alias("pred")}
    back = relations.select(*[swapped.get(c, F.col(c)) for c in relations.columns]).where("pred is not null")
    return relations.withColumn("generated", F.lit(False)).unionByName(back.withColumn("generated", F.lit(True)))


def extractor_rank(extractor: Column) -> Column:
    return F.when(extractor == "dep", 0).when(extractor == "regex", 1).otherwise(2)


def deduplicate(relations: DataFrame) -> DataFrame:
    """One row for each (subj, canonical pred, obj), direction kept: highest confidence, best extractor, distinct evidence,
    and the first (doc_id, sent) as the place of the survivor."""
    keyed = relations.withColumn("pred", canonical_predicate(F.col("pred")))
    return keyed.groupBy("subj", "pred", "obj").agg(
        F.max("confidence").alias("confidence"),
        F.min(F.struct(extractor_rank(F.col("extractor")).alias("rank"), F.col("extractor"))).getField("extractor").alias("extractor"),
        F.countDistinct("doc_id", "sent").alias("n_evidence"),
        F.count("*").alias("n_merged"),
        F.min(F.struct("doc_id", "sent")).alias("first"),
    ).select("subj", "pred", "obj", "confidence", "extractor", "n_evidence", "n_merged", F.col("first.doc_id").alias("first_doc"), F.col("first.sent").alias("first_sent"))


def deduplication_stats(relations: DataFrame) -> DataFrame:
    groups = relations.withColumn("pred", canonical_predicate(F.col("pred"))).groupBy("subj", "pred", "obj").count()
    many = F.col("count") > 1
    return groups.agg(
        F.sum("count").alias("original"), F.count("*").alias("deduplicated"), F.coalesce(F.sum(many.cast("long")), F.lit(0)).alias("duplicate_groups"),
        F.coalesce(F.max("count"), F.lit(0)).alias("max_group"), F.avg(F.when(many, F.col("count"))).alias("avg_duplicate_group"),
    ).withColumn("removal_rate", F.when(F.col("original") > 0, (F.col("original") - F.col("deduplicated")) / F.col("original")).otherwise(0.0))


def stats(relations: DataFrame) -> DataFrame:
    """Counts by predicate, by extractor (null: unknown) and in all, with the average confidence: one pass."""
    r = relations.select("pred", F.coalesce("extractor", F.lit("unknown")).alias("extractor"), "confidence")
    grouped = r.groupingSets([["pred"], ["extractor"], []], "pred", "extractor").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
    kind = F.when(F.col("g") == 1, "predicate").when(F.col("g") == 2, "extractor").otherwise("all")
    return grouped.select(kind.alias("kind"), F.coalesce("pred", "extractor", F.lit("all")).alias("value"), "n", "avg_confidence")


def single_valued_conflicts(relations: DataFrame, predicates: list[str]) -> DataFrame:
    """Subjects with more than one object under a predicate that allows one."""
    return (
        relations.where(F.col("pred").isin(predicates)).groupBy("subj", "pred")
        .agg(F.countDistinct("obj").alias("n_objects"), F.min("obj").alias("first_object"), F.max("obj").alias("last_object"), F.count("*").alias("n_relations"))
        .where("n_objects > 1")
    )


def suppress_near(relations: DataFrame, target: str, near: str, distance: int, min_confidence: float) -> DataFrame:
    """Relations without those of ``target`` for which ``near`` holds between the same two (in either order), in the same
    document, at most ``distance`` sentences away, with a confidence above the minimum. Each place of ``near`` is put into
    the buckets that it reaches, so the join is on equal keys."""
    pair = F.struct(F.least("subj", "obj").alias("a"), F.greatest("subj", "obj").alias("b"))
    width = distance + 1
    bucket = F.floor(F.col("sent") / width)
    marks = (
        relations.where((F.col("pred") == near) & (F.col("confidence") > min_confidence))
        .select(pair.alias("pair"), "doc_id", F.col("sent").alias("_at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    )
    keyed = relations.withColumn("pair", pair).withColumn("bucket", F.when(F.col("pred") == target, bucket))
    return keyed.join(
        marks, (keyed.pair == marks.pair) & (keyed.doc_id == marks.doc_id) & (keyed.bucket == marks.bucket) & (F.abs(keyed.sent - marks["_at"]) <= distance), "left_anti"
    ).drop("pair", "bucket")


def suppress_family(relations: DataFrame, parent: str, social: list[str]) -> DataFrame:
    """Social relations between two that share a parent, or of which one is the other's parent, are dropped."""
    up = relations.where(F.col("pred") == parent).select(F.col("subj").alias("p"), F.col("obj").alias("k")).distinct()
    direct = up.select(F.col("p").alias("x"), F.col("k").alias("y"))
    found = relations.where(F.col("pred").isin(social))
    kin = found.select("subj", "obj").distinct()
    # Asked only of the pairs that occur: two semi-joins instead of a self-join of all children of a parent.
    sibling = (
        kin.join(up.withColumnsRenamed({"k": "subj", "p": "p1"}), "subj").join(up.withColumnsRenamed({"k": "obj", "p": "p2"}), "obj").where("p1 = p2").select("subj", "obj")
    )
    parents = kin.join(direct.withColumnsRenamed({"x": "subj", "y": "obj"}), ["subj", "obj"], "left_semi").unionByName(
        kin.join(direct.withColumnsRenamed({"y": "subj", "x": "obj"}), ["subj", "obj"], "left_semi")
    )
    drop = sibling.unionByName(parents).distinct()
    return relations.where(~F.col("pred").isin(social)).unionByName(found.join(drop, ["subj", "obj"], "left_anti").select(relations.columns))


def drop_dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of which both ends are known and have a name. The ids are merged, not broadcast: their files are small for
    what they are as a hash table in every task's memory."""
    known = entities.where(F.coalesce(F.trim("canonical"), F.lit("")) != "").select("id").hint("merge")
    return relations.join(known.withColumnRenamed("id", "subj"), "subj", "left_semi").join(known.withColumnRenamed("id", "obj"), "obj", "left_semi")


def temporal_order(a: Column, b: Column) -> Column:
    return F.when(a < b, "before").when(a > b, "after").otherwise("same")
