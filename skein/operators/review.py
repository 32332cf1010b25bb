"""Review queue, job table, validation and comparison of record sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def approve(items: DataFrame, relations: DataFrame, symmetric: list[str]) -> DataFrame:
    """Approved items(subj, pred, obj, confidence, status) become relations unless they are there already; symmetric ones
    both ways."""
    chosen = items.where("status = 'approved'")
    ends = F.struct("subj", "obj")
    ways = F.when(F.col("pred").isin(symmetric), F.array(ends, F.struct(F.col("obj").alias("subj"), F.col("subj").alias("obj")))).otherwise(F.array(ends))
    new = chosen.select("pred", "confidence", F.explode(ways).alias("e")).groupBy("e.subj", "pred", "e.obj").agg(F.max("confidence").alias("confidence"))
    return new.join(relations.select("subj", "pred", "obj"), ["subj", "pred", "obj"], "left_anti")


def patched(rows: DataFrame, updates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Updates in order; a null leaves the value that was there. One aggregation of the updates, one join."""
    last = updates.groupBy(key).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(order, c))).getField(c).alias(f"_{c}") for c in columns])
    joined = rows.join(last, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in rows.columns])


def status_counts(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with repetitions."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def violations(relations: DataFrame, entities: DataFrame, allowed: dict[str, tuple[str, str]]) -> DataFrame:
    """How many relations break which rule: unknown ends, confidence outside 0 to 1, types that a predicate forbids."""
    kinds = entities.select("id", "type")
    typed = relations.join(kinds.withColumnsRenamed({"id": "subj", "type": "_s"}), "subj", "left").join(kinds.withColumnsRenamed({"id": "obj", "type": "_o"}), "obj", "left")
    wrong = reduce(lambda a, b: a | b, [(F.col("pred") == p) & ((F.col("_s") != s) | (F.col("_o") != o)) for p, (s, o) in allowed.items()], F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(F.col("_s").isNull() | F.col("_o").isNull(), "orphan"), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bad_confidence"), F.when(wrong, "type_mismatch")
        )
    )
    return typed.select("pred", F.explode(found).alias("rule")).groupBy("pred", "rule").agg(F.count("*").alias("n"))


def identity_report(entities: DataFrame, key, top: int = 20) -> DataFrame:
    """The largest groups of entities that share an identity key."""
    groups = entities.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.countDistinct("type").alias("n_types"), F.min("id").alias("first_id"))
    return groups.where("n > 1").orderBy(F.desc("n"), "key").limit(top)
