"""Rows -> text: sentences of relations, pages, indexes, timelines, digests. A line is a row wherever a group may be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.lineage import written
from . import relations as R

#: Predicate -> (before the verb when sure, the same when not, the verb, whether a time may follow) (fixed values).
TEMPLATES = {
    "married_to": ("", "reportedly ", "married", True), "parent_of": ("is ", "is said to be ", "the parent of", False), "child_of": ("is ", "is said to be ", "the child of", False),
    "sibling_of": ("is ", "is reportedly ", "a sibling of", False), "member_of": ("", "reportedly ", "was a member of", True), "lives_in": ("", "reportedly ", "lived in", True),
    "born_in": ("was ", "was reportedly ", "born in", True), "dies_in": ("", "reportedly ", "died in", True), "traveled_to": ("", "reportedly ", "traveled to", True), "fought_in": ("", "reportedly ", "fought in", True),
    "wields": ("", "reportedly ", "wields", True), "owns": ("", "reportedly ", "owns", False), "uses": ("", "reportedly ", "uses", False), "studies_at": ("", "reportedly ", "studied at", True),
    "teaches_at": ("", "reportedly ", "taught at", True), "friends_with": ("is ", "is reportedly ", "friends with", False), "ally_of": ("is ", "is reportedly ", "an ally of", True),
    "enemy_of": ("is ", "is reportedly ", "an enemy of", True), "leads": ("", "reportedly ", "leads", True), "rules": ("", "reportedly ", "rules", True), "authored": ("", "reportedly ", "authored", True),
    "mentions": ("", "reportedly ", "mentions", False), "alias_of": ("", "", "is also known as", False), "part_of": ("is ", "is reportedly ", "part of", False), "attended": ("", "reportedly ", "attended", True),
    "advised_by": ("was ", "was reportedly ", "advised by", False), "invested_in": ("", "reportedly ", "invested in", False), "acquired": ("", "reportedly ", "acquired", True), "spoke_to": ("", "reportedly ", "spoke to", True),
    "met": ("", "reportedly ", "met", True), "mentored": ("", "reportedly ", "mentored", True), "mentored_by": ("was ", "was reportedly ", "mentored by", True), "guards": ("", "reportedly ", "guards", True),
    "seeks": ("", "reportedly ", "seeks", True), "possesses": ("", "reportedly ", "possesses", True), "defeated": ("", "reportedly ", "defeated", True), "killed": ("", "reportedly ", "killed", True),
    "imprisoned_in": ("was ", "was reportedly ", "imprisoned in", True), "freed_from": ("was ", "was reportedly ", "freed from", True), "summoned": ("", "reportedly ", "summoned", True),
    "located_at": ("is ", "is reportedly ", "located at", True), "located_beneath": ("is ", "is reportedly ", "located beneath", False), "hidden_in": ("is ", "is reportedly ", "hidden in", True),
}
#: How much an event of a predicate weighs in a timeline (fixed values).
WEIGHTS = {
    "married_to": 1.0, "rules": 0.95, "leads": 0.9, "fought_in": 0.85, "traveled_to": 0.8, "authored": 0.75, "lives_in": 0.7, "parent_of": 0.65, "child_of": 0.65, "born_in": 0.6, "dies_in": 0.6, "enemy_of": 0.5,
    "friends_with": 0.45, "ally_of": 0.4, "member_of": 0.35, "sibling_of": 0.3, "studies_at": 0.25, "teaches_at": 0.25, "wields": 0.2, "owns": 0.2, "uses": 0.15, "mentions": 0.1, "alias_of": 0.05, "part_of": 0.05,
    "attended": 0.3, "advised_by": 0.35, "invested_in": 0.4, "acquired": 0.6, "spoke_to": 0.2, "met": 0.25, "mentored": 0.7, "mentored_by": 0.7, "guards": 0.65, "seeks": 0.75, "possesses": 0.55, "defeated": 0.9,
    "killed": 0.95, "imprisoned_in": 0.8, "freed_from": 0.85, "summoned": 0.5, "located_at": 0.4, "located_beneath": 0.3, "hidden_in": 0.6,
}
HEDGED = 0.7


def sentence(pred: Column, subj: Column, obj: Column, time: Column, confidence: Column) -> Column:
    """A relation in words, hedged below HEDGED; an unknown predicate is named."""
    known = F.create_map(*[F.lit(x) for p, t in TEMPLATES.items() for x in (p, "\x1f".join((t[0], t[1], t[2], "1" if t[3] else "")))])[pred]
    part = lambda i: F.split_part(known, F.lit("\x1f"), F.lit(i))
    when = F.when((part(4) == "1") & time.isNotNull(), F.concat(F.lit(" in "), time)).otherwise("")
    told = F.concat(subj, F.lit(" "), F.when(confidence < HEDGED, part(2)).otherwise(part(1)), part(3), F.lit(" "), obj, when, F.lit("."))
    return F.when(known.isNull(), F.concat(subj, F.lit(' has relation "'), pred, F.lit('" with '), obj, F.lit("."))).otherwise(told)


def biographies(told: DataFrame, dated: int = 10, undated: int = 5) -> DataFrame:
    """id, text of sentences (id, year, weight, line): the first ``dated`` with a year, by year and weight, or else the first
    ``undated`` by weight. Each kind has its own limit, which Spark applies before the shuffle too, so no task sorts a hub."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("year", F.desc("weight"), "line"))
    few = told.where("year is not null").withColumn("r", rank).where(F.col("r") <= dated).unionByName(told.where("year is null").withColumn("r", rank).where(F.col("r") <= undated))
    lines = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("r", "line")))), lambda x: x["line"]), " ")
    both = few.groupBy("id").agg(lines(F.col("year").isNotNull()).alias("a"), lines(F.col("year").isNull()).alias("b"))
    return both.select("id", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b")).alias("text"))


def index_lines(entities: DataFrame) -> DataFrame:
    """type, nth, line: a link to each entity's page, numbered by name (ties: id) inside its type.

    Entities are dealt by ranges of type, name and id and written with the number of their range; ranks are taken inside a
    range and raised by the sizes of those before it, so no task sorts all entities of a type."""
    rows = written(entities.select("type", "canonical", "id").repartitionByRange("type", "canonical", "id").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("type").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("type", "_range").agg(F.count("*").alias("_n")).select(F.col("type").alias("_type"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("type", "_range").orderBy("canonical", "id")))
    nth = (F.col("_r") + F.col("_before")).cast("int")
    return ranked.join(offsets, (F.col("_range") == F.col("_at")) & F.col("type").eqNullSafe(F.col("_type"))).select("type", nth.alias("nth"), F.concat(F.lit("- ["), "canonical", F.lit("]("), T.slug(F.col("canonical")), F.lit(".md)")).alias("line"))


def statistics(relations: DataFrame, entities: DataFrame, top: int = 10) -> DataFrame:
    """section, key, n: entities by type, relations by predicate, and the entities of highest degree."""
    by_type = entities.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), "key", "n")
    by_pred = relations.groupBy(F.col("pred").alias("key")).agg(F.count("*").alias("n")).select(F.lit("predicate").alias("section"), "key", "n")
    degree = relations.select(F.explode(F.array("subj", "obj")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return by_type.unionByName(by_pred).unionByName(degree.select(F.lit("degree").alias("section"), "key", "n"))


def digest(relations: DataFrame, each: int = 5) -> DataFrame:
    """subj, pred, n, first: how many objects each predicate has, and the ``each`` surest by name."""
    distinct = relations.groupBy("subj", "pred", "obj").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("subj", "pred").orderBy(F.desc("confidence"), "obj"))
    few = distinct.withColumn("r", rank).where(F.col("r") <= each).groupBy("subj", "pred").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "obj"))), lambda x: x["obj"]), ", ").alias("first"))
    return distinct.groupBy("subj", "pred").agg(F.count("*").alias("n")).join(few, ["subj", "pred"])


def mermaid(events: DataFrame) -> DataFrame:
    """section, line of a timeline diagram: events (section, at, label), colons taken out of labels."""
    return events.select("section", F.concat(F.lit("    "), F.date_format("at", "yyyy-MM-dd"), F.lit(" : "), F.replace("label", F.lit(":"), F.lit(" "))).alias("line"))


def clusters(events: DataFrame, by: str, at: str, gap_days: int = 30) -> DataFrame:
    """by, cluster, n, first, last: events of one subject whose distance is at most ``gap_days``."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.when(F.datediff(F.col(at), F.lag(at).over(w)) <= gap_days, 0).otherwise(1)
    return events.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).groupBy(by, "cluster").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def summary(asserted: DataFrame) -> DataFrame:
    """what, key, n: assertions by kind, modality and predicate, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("key")) for c in ("kind", "modality", "pred")]))
    return asserted.select(pairs.alias("p")).groupBy("p.what", "p.key").agg(F.count("*").alias("n"))


def meaning(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Meaning records: subject, relation, object by name, certainty in words and the source."""
    named = R.with_names(relations, entities)
    sure = F.when(F.col("confidence") >= 0.9, "certain").when(F.col("confidence") >= HEDGED, "likely").otherwise("possible")
    return named.select(F.col("subj_name").alias("subject"), F.col("pred").alias("relation"), F.col("obj_name").alias("object"), sure.alias("certainty"), F.concat_ws(":", "doc_id", "sent").alias("source"))


def json_lines(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """A JSON object for each entity and each relation."""
    e = entities.select(F.to_json(F.struct(F.lit("entity").alias("kind"), "id", "type", "canonical")).alias("line"))
    return e.unionByName(relations.select(F.to_json(F.struct(F.lit("relation").alias("kind"), "subj", "pred", "obj", "confidence")).alias("line")))


def linked_data(relations: DataFrame) -> DataFrame:
    """Relations as JSON-LD nodes."""
    return relations.select(F.to_json(F.struct(F.lit("Relation").alias("@type"), F.struct(F.col("subj").alias("@id")).alias("subject"), F.col("pred").alias("predicate"), F.struct(F.col("obj").alias("@id")).alias("object"))).alias("line"))


def csv_rows(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """subject, predicate, object, confidence (three places), time, place, evidence: first qualifier of each kind, first evidence.

    relations has qualifiers array<struct<type,value>> and evidence array<string>."""
    first = lambda kind: F.coalesce(F.try_element_at(F.filter("qualifiers", lambda q: q["type"] == kind), F.lit(1))["value"], F.lit(""))
    named = R.with_names(relations, entities)
    return named.select(
        F.col("subj_name").alias("subject"), F.col("pred").alias("predicate"), F.col("obj_name").alias("object"), F.format_string("%.3f", "confidence").alias("confidence"), first("time").alias("time"), first("place").alias("place"),
        F.coalesce(F.try_element_at(F.filter(F.transform("evidence", lambda x: T.normalize_evidence(x)), lambda x: x != ""), F.lit(1)), F.lit("")).alias("evidence"),
    )
