"""Entity profiles, coreference chains and character views, as aggregations of mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTEXTS = 20


def profiles(mentions: DataFrame) -> DataFrame:
    """id, n, first_seen, last_seen, confidence, contexts of mentions (id, at, context, descriptor): the last CONTEXTS contexts in
    order, the distinct descriptors, and min(0.95, 0.5 + 0.05 n). A rank in each group keeps the shuffle to those contexts."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("at"), "context"))
    last = mentions.withColumn("_r", rank).where(F.col("_r") <= CONTEXTS).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "context"))).alias("c"))
    totals = mentions.groupBy("id").agg(F.count("*").alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.array_sort(F.collect_set("descriptor")).alias("descriptors"))
    rows = totals.join(last, "id")
    return rows.select("id", "n", "first_seen", "last_seen", "descriptors", F.round(F.least(F.lit(0.95), 0.5 + 0.05 * F.col("n")), 6).alias("confidence"), F.transform("c", lambda x: x["context"]).alias("contexts"))


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles after further mentions: counts add up, sets are united, the last CONTEXTS contexts of both stay, those of ``new``
    being later. Associative, so a stream folds batch after batch."""
    n = new.withColumnsRenamed({c: f"_{c}" for c in new.columns if c != "id"})
    rows = old.join(n, "id", "full")
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("contexts", none), F.coalesce("_contexts", none))
    count = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return rows.select(
        "id", count.alias("n"), F.least("first_seen", "_first_seen").alias("first_seen"), F.greatest("last_seen", "_last_seen").alias("last_seen"),
        F.array_sort(F.array_union(F.coalesce("descriptors", none), F.coalesce("_descriptors", none))).alias("descriptors"),
        F.round(F.least(F.lit(0.95), 0.5 + 0.05 * count), 6).alias("confidence"), F.slice(both, F.greatest(F.size(both) - CONTEXTS + 1, F.lit(1)), CONTEXTS).alias("contexts"),
    )


def serialized(known: DataFrame) -> DataFrame:
    """id and the profile as JSON with its fields in alphabetical order."""
    return known.select("id", F.to_json(F.struct(*sorted(c for c in known.columns if c != "id"))).alias("json"))


def deserialized(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select("id", F.from_json("json", schema).alias("p")).select("id", "p.*")


def by_descriptor(known: DataFrame, words: list[str], top: int = 10) -> DataFrame:
    """Profiles that have any of the descriptors, by their share of the words x (1 + log10(n + 1) / 5) x confidence."""
    hits = F.size(F.array_intersect("descriptors", F.array(*[F.lit(w) for w in words])))
    score = hits / len(words) * (1 + F.log10(F.col("n") + 1) * 0.2) * F.col("confidence")
    return known.where(hits > 0).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def dominant(candidates: DataFrame, key: str, score: str, factor: float = 1.5) -> DataFrame:
    """key, id: the best candidate (key, id, score) where it is the only one or at least ``factor`` times the second."""
    two = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "id"))).where("_r <= 2")
    best = two.groupBy(key).agg(F.max(F.when(F.col("_r") == 1, F.col("id"))).alias("id"), F.max(F.when(F.col("_r") == 1, F.col(score))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("_b"))
    return best.where("_b is null or _a >= _b * " + str(factor)).select(key, "id")


def character_views(mentions: DataFrame, said: DataFrame) -> DataFrame:
    """id, n_names, n_pronouns, first, last, n_quotes, n_words of mentions (id, at, kind) and quotations (id, text)."""
    seen = mentions.groupBy("id").agg(F.count_if(F.col("kind") == "name").alias("n_names"), F.count_if(F.col("kind") == "pronoun").alias("n_pronouns"), F.min("at").alias("first"), F.max("at").alias("last"))
    spoken = said.where("id is not null").groupBy("id").agg(F.count("*").alias("n_quotes"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n_words"))
    rows = seen.join(spoken, "id", "left")
    return rows.select("id", "n_names", "n_pronouns", "first", "last", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


def chains(links: DataFrame) -> DataFrame:
    """id, length, methods, average_gap, largest_gap, score of the coreference links (id, at, surface, method, confidence).

    score: 0.4 of the mean confidence, 0.2 for length (5 and more count full), 0.2 for different methods (3 full), 0.2 for short
    gaps (none beyond 1,000)."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("id").orderBy("at", "surface"))
    rows = links.withColumn("gap", gap).groupBy("id").agg(
        F.count("*").alias("length"), F.countDistinct("method").alias("methods"), F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 6).alias("average_gap"),
        F.coalesce(F.max("gap"), F.lit(0)).alias("largest_gap"), F.avg("confidence").alias("sure"),
    )
    short = F.greatest(F.lit(0.0), 1 - F.col("average_gap") / 1000)
    score = 0.4 * F.col("sure") + 0.2 * F.least(F.col("length") / 5, F.lit(1.0)) + 0.2 * F.least(F.col("methods") / 3, F.lit(1.0)) + 0.2 * short
    return rows.select("id", "length", "methods", "average_gap", "largest_gap", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


def fact_profile(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """id, canonical, n_mentions, n_documents, n_out, n_in, top_places: the star join of an entity with its mentions (id, doc_id,
    paragraph) and relations; the three places with most mentions, as doc:paragraph."""
    per = mentions.groupBy("id", "doc_id", "paragraph").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "doc_id", "paragraph"))
    top = per.withColumn("r", rank).where("r <= 3").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "doc_id", "paragraph").alias("p")))).alias("t"))
    seen = per.groupBy("id").agg(F.sum("n").alias("n_mentions"), F.countDistinct("doc_id").alias("n_documents"))
    ends = relations.select(F.explode(F.array(F.struct(F.col("subj").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("obj").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))
    rows = entities.join(seen, "id", "left").join(top, "id", "left").join(ends, "id", "left")
    return rows.select("id", "canonical", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_mentions", "n_documents", "n_out", "n_in")], F.coalesce(F.array_join(F.transform("t", lambda x: x["p"]), ","), F.lit("")).alias("top_places"))


def contexts_conflict(a: Column, b: Column) -> Column:
    """Whether two contexts (occupations, relations, age, died) cannot be one person's: disjoint occupations, parent against child,
    retired against young, or just one of them dead."""
    jobs = (F.size(a["occupations"]) > 0) & (F.size(b["occupations"]) > 0) & ~F.arrays_overlap(a["occupations"], b["occupations"])
    has = lambda x, v: F.array_contains(x["relations"], v)
    kin = (has(a, "parent") & has(b, "child")) | (has(a, "child") & has(b, "parent"))
    age = ((a["age"] == "retired") & (b["age"] == "young")) | ((a["age"] == "young") & (b["age"] == "retired"))
    return F.coalesce(jobs | kin | age | (a["died"] != b["died"]), F.lit(False))
