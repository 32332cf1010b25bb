"""Features of relations and of names in their sentences: what rescoring and salience are computed from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parse as P

#: Verbs whose subject speaks (fixed values).
SPEECH = ("say", "tell", "ask")
#: Predicate -> family of patterns (fixed values).
FAMILIES = {
    "marry": "kinship", "parent_of": "kinship", "child_of": "kinship", "sibling_of": "kinship", "live_in": "location", "travel_to": "location", "die_in": "location", "marry_in": "location", "fight_near": "location",
    "buy": "possession", "buy_from": "possession", "give": "possession", "give_to": "possession", "fight": "conflict", "destroy": "conflict", "kill": "conflict", "is": "state",
}


def family(pred: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[pred], F.lit("other"))


def window_tier(subj_sent: Column, obj_sent: Column, subj_par: Column, obj_par: Column) -> Column:
    """How near the two ends are: same_sentence, same_paragraph or cross_paragraph."""
    return F.when((subj_sent == obj_sent) & (subj_par == obj_par), "same_sentence").when(subj_par == obj_par, "same_paragraph").otherwise("cross_paragraph")


def relation_features(sentences: DataFrame) -> DataFrame:
    """doc_id, sent, subj, pred, obj and, for each relation of the rules: token_distance, names_between, subject_first, negated, modal,
    passive, quoted, n_tokens, family, confidence. One row a sentence until the relations come out, no shuffle."""
    t = P.parsed(sentences)
    rows = t.select("doc_id", F.col("idx").alias("sent"), "t", F.explode(F.concat(F.expr(P._ACTIVE), F.expr(P._ROLE), F.expr(P._STATE))).alias("r"))
    place = lambda w: F.expr(f"array_position(transform(t, x -> x.w), r.{w}) - 1")
    rows = rows.withColumn("a", place("subj")).withColumn("b", place("obj"))
    between = F.expr("size(filter(t, x -> x.k = 'E' and x.i > least(a, b) and x.i < greatest(a, b)))")
    modal = F.expr("exists(t, x -> x.l in ('can', 'could', 'may', 'might', 'must', 'shall', 'should', 'will', 'would'))")
    quoted = F.expr("size(filter(t, x -> x.k = 'Q' and x.i < a)) % 2 = 1")
    base = F.create_map(*[F.lit(x) for kv in P.CONFIDENCE.items() for x in kv])[F.col("r.rule")]
    return rows.select(
        "doc_id", "sent", "r.subj", "r.pred", "r.obj", F.abs(F.col("a") - F.col("b")).alias("token_distance"), between.alias("names_between"), (F.col("a") < F.col("b")).alias("subject_first"), "r.negated", modal.alias("modal"),
        (F.col("r.rule") == "passive").alias("passive"), quoted.alias("quoted"), F.size("t").alias("n_tokens"), family(F.col("r.pred")).alias("family"), base.alias("confidence"),
    )


def csv(features: DataFrame) -> DataFrame:
    """line: a feature row as text, truth values as 0 and 1, the confidence with four places."""
    flags = [F.col(c).cast("int").cast("string") for c in ("subject_first", "negated", "modal", "passive", "quoted")]
    return features.select(F.concat_ws(",", "subj", "pred", "obj", F.col("token_distance").cast("string"), F.col("names_between").cast("string"), *flags, F.format_string("%.4f", "confidence")).alias("line"))


def subject_counts(found: DataFrame) -> DataFrame:
    """name, as_subject, as_speaker of relations: how often a name is the subject, and the subject of a verb of speech."""
    return found.groupBy(F.col("subj").alias("name")).agg(F.count("*").alias("as_subject"), F.count_if(F.substring_index("pred", "_", 1).isin(*SPEECH)).alias("as_speaker"))
