"""Events and assertions -> facts with validity, current state, timelines, review routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Predicates that hold both ways (fixed values).
SYMMETRIC = ("enemy_of", "sibling_of", "married_to", "ally_of", "friends_with", "cousin_of")


def relation_facts(assertions: DataFrame, symmetric=SYMMETRIC, least: float = 0.7) -> DataFrame:
    """A fact for each assertion that is not negated and sure enough, and its mirror image for symmetric predicates; equal
    facts become one with the highest confidence and the number of assertions behind it."""
    sure = assertions.where((F.col("modality") != "NEGATED") & (F.col("confidence") >= least))
    ends = F.struct("subj", "obj")
    mirror = F.struct(F.col("obj").alias("subj"), F.col("subj").alias("obj"))
    rows = sure.select("pred", "confidence", F.explode(F.when(F.col("pred").isin(list(symmetric)), F.array(ends, mirror)).otherwise(F.array(ends))).alias("e"))
    return rows.groupBy("e.subj", "pred", "e.obj").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_derived_from"))


def transfer_facts(transfers: DataFrame, loss: float = 0.9) -> DataFrame:
    """TRANSFER(item, giver, taker, at, confidence) -> gain of the taker and implied loss of the giver."""
    gain = F.struct(F.col("taker").alias("holder"), F.lit("gain").alias("kind"), F.col("confidence"))
    lose = F.struct(F.col("giver").alias("holder"), F.lit("loss").alias("kind"), (F.col("confidence") * loss).alias("confidence"))
    return transfers.select("item", "at", F.explode(F.array(gain, lose)).alias("f")).where("f.holder is not null").select("item", "at", "f.*")


def possessions(facts: DataFrame) -> DataFrame:
    """holder, item where the last gain is later than the last loss."""
    gained, lost = F.max(F.when(F.col("kind") == "gain", F.col("at"))), F.max(F.when(F.col("kind") == "loss", F.col("at")))
    return facts.groupBy("item", "holder").agg(gained.alias("gained"), lost.alias("lost")).where("gained is not null and (lost is null or gained > lost)").select("holder", "item", "gained")


def current_holder(facts: DataFrame) -> DataFrame:
    """item, n_holders, holder (the smallest), state: held by one, contested by several."""
    return possessions(facts).groupBy("item").agg(F.count("*").alias("n_holders"), F.min("holder").alias("holder")).withColumn("state", F.when(F.col("n_holders") > 1, "contested").otherwise("held"))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by the order columns, which it returns; a struct maximum, so the shuffle moves one row
    for each group and task."""
    return rows.groupBy(*by).agg(F.max(F.struct(*order)).alias("_m")).select(*by, "_m.*")


def temporal_edges(events: DataFrame, by: list[str], at: str, key: str, confidence: str) -> DataFrame:
    """Each event to the next of its group, where that is strictly later; the confidence is the smaller of the two."""
    w = Window.partitionBy(*by).orderBy(at, key)
    rows = events.select(*by, F.col(key).alias("source"), F.lead(key).over(w).alias("target"), F.col(at).alias("_a"), F.lead(at).over(w).alias("_b"), F.least(F.col(confidence), F.lead(confidence).over(w)).alias("confidence"))
    return rows.where("_b > _a").drop("_a", "_b")


def timeline(events: DataFrame, by: str, year: str, weight: str, key: str, most: int = 12) -> DataFrame:
    """The ``most`` weightiest distinct events of each subject, ranked by year again."""
    distinct = events.groupBy(by, key).agg(F.min(year).alias(year), F.max(weight).alias(weight))
    heavy = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(weight), year, key))).where(F.col("_r") <= most)
    return heavy.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(year, F.desc(weight), key))).drop("_r")


def routed(rows: DataFrame, confidence: Column, accept: float = 0.7, review: float = 0.4) -> DataFrame:
    """accepted, review or rejected by two thresholds."""
    return rows.withColumn("route", F.when(confidence >= accept, "accepted").when(confidence >= review, "review").otherwise("rejected"))


def rescored(rows: DataFrame, weights: dict[str, float], bias: float, negated: Column, threshold: float = 0.7) -> DataFrame:
    """Logistic score over feature columns, at most 0.4 under negation, and the decision."""
    logit = F.lit(bias)
    for name, w in weights.items():
        logit = logit + F.lit(w) * F.col(name)
    score = 1 / (1 + F.exp(-logit))
    return rows.withColumn("score", F.round(F.when(negated, F.least(score, F.lit(0.4))).otherwise(score), 6)).withColumn("accepted", F.col("score") >= threshold)


def threshold_sweep(scored: DataFrame, label: str, first: int = 30, last: int = 95, step: int = 5) -> DataFrame:
    """Precision, recall and F1 at each threshold (in hundredths): one pass that counts by score bucket, then a sum over
    at most a few dozen buckets."""
    cuts = F.sequence(F.lit(first), F.lit(last), F.lit(step))
    bucket = F.floor((F.col("score") * 100 - first) / step)
    counts = scored.groupBy(F.greatest(F.least(bucket, F.lit((last - first) // step)), F.lit(-1)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    total = counts.agg(F.collect_list(F.struct("bucket", "n", "pos")).alias("c"), F.sum("pos").alias("all_pos"))
    rows = total.select("c", "all_pos", F.explode(cuts).alias("threshold")).withColumn("from_bucket", (F.col("threshold") - first) / step)
    over = F.filter("c", lambda x: x["bucket"] >= F.col("from_bucket"))
    rows = rows.select(
        "threshold", "all_pos", F.aggregate(over, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("accepted"), F.aggregate(over, F.lit(0).cast("long"), lambda a, x: a + x["pos"]).alias("tp")
    )
    p = F.when(F.col("accepted") > 0, F.col("tp") / F.col("accepted")).otherwise(0.0)
    r = F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return rows.select("threshold", "accepted", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))
