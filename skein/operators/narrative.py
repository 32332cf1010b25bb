"""Relations of texts -> assertions -> events -> facts, and the questions that are asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parse as P
from . import relations as R
from . import sentences as S
from .facts import SYMMETRIC

#: Predicate -> kind of event (fixed values).
EVENTS = {
    "travel_to": "MOVE", "move_to": "MOVE", "go_to": "MOVE", "die": "DEATH", "die_in": "DEATH", "give": "TRANSFER", "buy": "TRANSFER", "take": "TRANSFER",
    "fight": "ATTACK", "kill": "ATTACK", "destroy": "ATTACK", "meet": "MEET", "marry": "MEET", "tell": "TELL", "make": "CREATE", "found": "CREATE",
}
#: Verb and preposition -> predicate of the graph (fixed values).
GRAPH_PREDICATES = {"marry": "married_to", "live_in": "lives_in", "buy": "bought", "travel_to": "traveled_to", "move_to": "traveled_to", "go_to": "traveled_to", "die_in": "dies_in", "fight": "fought", "work_at": "works_at", "love": "loves"}
#: Modalities that a timeline may leave out.
UNSURE = ("RUMOR", "BELIEF", "UNCERTAIN", "HYPOTHETICAL")


def assertions(found: DataFrame) -> DataFrame:
    """id, doc_id, sent, subj, pred, obj, kind, modality, extraction, composite, source, reliability of relations (rule, negated,
    confidence). States: composite 0.9 of the confidence, relations 0.8. The narrator is the source of all, 0.9 reliable."""
    composite = F.col("confidence") * F.when(F.col("rule") == "state", 0.9).otherwise(0.8)
    return found.select(
        F.sha2(F.concat_ws("|", "doc_id", "sent", "subj", "pred", "obj"), 256).substr(1, 16).alias("id"), "doc_id", "sent", "subj", "pred", "obj",
        F.when(F.col("rule") == "state", "STATE").otherwise("RELATION").alias("kind"), F.when(F.col("negated"), "NEGATED").otherwise("FACT").alias("modality"),
        F.col("confidence").alias("extraction"), F.round(composite, 4).alias("composite"), F.lit("NARRATOR").alias("source"), F.lit(0.9).alias("reliability"),
    )


def events(asserted: DataFrame) -> DataFrame:
    """id, doc_id, sent, type, agent, target, modality, confidence of the assertions whose predicate is an event's."""
    kind = R.lookup(F.col("pred"), EVENTS)
    return asserted.select(F.concat(F.lit("e_"), "id").alias("id"), "doc_id", "sent", kind.alias("type"), F.col("subj").alias("agent"), F.col("obj").alias("target"), "pred", "modality", F.col("composite").alias("confidence")).where("type is not null")


def facts(happened: DataFrame, asserted: DataFrame, least: float = 0.3) -> DataFrame:
    """id, subj, pred, obj, ended, from_sent, doc_id, confidence, derived_from: MOVE gives located_in, DEATH alive = false and
    died_in, TRANSFER a gain and, where the giver is known, a loss (0.9 of the confidence); relations give themselves, and
    symmetric ones their mirror image. Equal facts of a document are one: highest confidence, latest place, all sources.
    """
    sure = happened.where((F.col("modality") != "NEGATED") & (F.col("confidence") >= least))

    def fact(subj, pred, obj, ended=False, share=1.0):
        return F.struct(subj.alias("subj"), F.lit(pred).alias("pred"), obj.alias("obj"), F.lit(ended).alias("ended"), (F.col("confidence") * share).alias("confidence"))

    agent, target = F.col("agent"), F.col("target")
    gives = F.when(F.col("pred") == "give", F.array(fact(agent, "possesses", target, True, 0.9))).otherwise(F.array(fact(agent, "possesses", target)))
    derived = (
        F.when(F.col("type") == "MOVE", F.array(fact(agent, "located_in", target)))
        .when(F.col("type") == "DEATH", F.when(F.col("pred") == "die_in", F.array(fact(agent, "alive", F.lit("false")), fact(agent, "died_in", target))).otherwise(F.array(fact(agent, "alive", F.lit("false")))))
        .when(F.col("type") == "TRANSFER", gives)
    )
    from_events = sure.select("id", "doc_id", "sent", F.explode(derived).alias("f")).select("id", "doc_id", "sent", "f.*")
    stated = asserted.where("modality <> 'NEGATED' and kind = 'RELATION'").withColumn("pred", F.coalesce(R.lookup(F.col("pred"), GRAPH_PREDICATES), "pred")).where(F.col("composite") >= least)
    ways = F.when(F.col("pred").isin(list(SYMMETRIC)), F.array(F.struct("subj", "obj"), F.struct(F.col("obj").alias("subj"), F.col("subj").alias("obj")))).otherwise(F.array(F.struct("subj", "obj")))
    from_relations = stated.select("id", "doc_id", "sent", "pred", F.col("composite").alias("confidence"), F.lit(False).alias("ended"), F.explode(ways).alias("e")).select("id", "doc_id", "sent", "e.subj", "pred", "e.obj", "ended", "confidence")
    rows = from_events.unionByName(from_relations)
    merged = rows.groupBy("doc_id", "subj", "pred", "obj", "ended").agg(F.max("sent").alias("from_sent"), F.round(F.max("confidence"), 4).alias("confidence"), F.array_sort(F.collect_set("id")).alias("derived_from"))
    digest = F.sha2(F.concat_ws("|", "subj", "pred", "obj", F.array_join("derived_from", "|")), 256)
    return merged.select(F.concat(F.lit("fact_"), "pred", F.lit("_"), F.substring(digest, 1, 16)).alias("id"), "doc_id", "subj", "pred", "obj", "ended", "from_sent", "confidence", "derived_from")


def of_entity(known: DataFrame, name: str) -> DataFrame:
    return known.where((F.col("subj") == name) | (F.col("obj") == name))


def by_predicate(known: DataFrame, pred: str) -> DataFrame:
    return known.where(F.col("pred") == pred)


def alive(known: DataFrame, people: DataFrame) -> DataFrame:
    """people (id) with alive: no fact says that they are not."""
    dead = known.where("pred = 'alive' and obj = 'false'").select(F.col("subj").alias("id")).distinct().withColumn("dead", F.lit(True))
    return people.join(dead, "id", "left").select("id", F.coalesce("dead", F.lit(False)).alias("dead")).select("id", (~F.col("dead")).alias("alive"))


def timeline(happened: DataFrame, entity: str | None = None, types: tuple[str, ...] = (), unsure: bool = True, first: int | None = None, last: int | None = None, least: float | None = None, limit: int = 200) -> DataFrame:
    """Events in order of telling (document, sentence, id) under all conditions that are given: agent or target, types, without
    unsure modalities, a range of sentences, a least confidence; ``limit`` of them at most."""
    rows = happened
    if entity is not None:
        rows = rows.where((F.col("agent") == entity) | (F.col("target") == entity))
    if types:
        rows = rows.where(F.col("type").isin(*types))
    if not unsure:
        rows = rows.where(~F.col("modality").isin(*UNSURE))
    if first is not None:
        rows = rows.where(F.col("sent") >= first)
    if last is not None:
        rows = rows.where(F.col("sent") <= last)
    if least is not None:
        rows = rows.where(F.col("confidence") >= least)
    return rows.orderBy(F.col("sent").isNull(), "doc_id", "sent", "id").limit(limit)


def rendered(happened: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """doc_id, sent, line: a Markdown line for each event; negated and unsure ones are marked."""
    verb = F.create_map(*[F.lit(x) for kv in {"MOVE": "moved to", "DEATH": "died in", "TRANSFER": "got or gave", "ATTACK": "attacked", "MEET": "met", "TELL": "told", "CREATE": "made"}.items() for x in kv])[F.col("type")]
    mark = F.when(F.col("modality") == "NEGATED", " (did not happen)").when(F.col("modality").isin(*UNSURE), F.concat(F.lit(" ("), F.lower("modality"), F.lit(")"))).otherwise("")
    return happened.select("doc_id", "sent", F.concat(F.lit("- **"), "agent", F.lit("** "), verb, F.lit(" **"), "target", F.lit("**"), mark).alias("line"))


def adapted(relations: DataFrame) -> DataFrame:
    """Relations (subj, pred, obj, confidence, extractor) of the graph as assertions: predicates of speech are claims, patterns
    alone make beliefs; composite = 0.85 of the confidence."""
    modality = F.when(F.col("pred").isin("mentions", "says", "claims"), "CLAIM").when(F.col("extractor") == "regex", "BELIEF").otherwise("FACT")
    return relations.select("subj", "pred", "obj", modality.alias("modality"), F.round(F.col("confidence") * 0.85, 6).alias("composite"), F.struct(F.col("confidence").alias("extraction"), F.lit(0.5).alias("semantic"), F.lit(0.5).alias("temporal")).alias("confidence"))


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, sent, subj, pred, obj, confidence, extractor of a text's relations: sentences, tokens, rules, pronouns, the
    graph's predicates. States and negated relations are left out."""
    found = P.resolved(P.relations(S.sentences(docs))).where("not negated and rule <> 'state'")
    return found.select("doc_id", "sent", "subj", F.coalesce(R.lookup(F.col("pred"), GRAPH_PREDICATES), "pred").alias("pred"), "obj", "confidence", F.when(F.col("rule").isin("svo", "passive", "role"), "dep").otherwise("regex").alias("extractor"))


def pipeline(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The graph of a collection, end to end: extraction, threshold, inverse relations, deduplication."""
    sure = extracted(docs).where(F.col("confidence") >= least)
    return R.deduplicate(R.with_inverses(sure).drop("generated"))
