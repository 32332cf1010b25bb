"""Entities over many documents: merging, provenance, conflicts; senses, aliases, corrections of relations, the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.lineage import written

#: Types that may be the same thing although they differ (fixed values).
SAME_TYPE = {"GPE": "PLACE", "LOC": "PLACE", "LOCATION": "PLACE", "ORGANIZATION": "ORG", "ORGANISATION": "ORG"}


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id that each end of the edges (a, b) reaches. Every node takes the smallest root among its own, its
    neighbours' and that root's, until nothing changes; each round is written, and the rounds grow with the logarithm of the
    longest path."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.withColumnsRenamed({"id": "b", "root": "r"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        low = roots.join(near, "id").select("id", "root", F.least("root", "r").alias("r"))
        # The roots themselves learn what their members found, and members take their root's new root.
        up = low.groupBy(F.col("root").alias("id")).agg(F.min("r").alias("up"))
        new = low.join(up, "id", "left").select("id", "root", F.least("r", F.coalesce("up", "r")).alias("new"))
        jump = new.select(F.col("id").alias("new"), F.col("new").alias("far"))
        new = written(new.join(jump, "new", "left").select("id", "root", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = new.where("root <> new").limit(1).count()
        roots = new.select("id", F.col("new").alias("root"))
        if not changed:
            return roots


def merge_candidates(entities: DataFrame) -> DataFrame:
    """a, b, score, method: pairs of entities (id, type, canonical, aliases) of one type that may be the same.

    Equal canonical names 0.95; a name that is the other's alias 0.93; a name that goes on with "the" as the only one to do so
    (Gandalf, Gandalf the Grey) 0.93, method epithet; all words of one among the other's 0.85; more than 0.7 of all words in
    common: that share. Of the entities with one name all are paired with the smallest id alone, so names meet, not rows: on
    a name or an alias; on the rarest word of the shorter among all words of the longer, which finds every contained name; and
    on the rarest words of both, as many as two names of such a share cannot but have in common. Candidates of a frequent
    word are dealt to tasks by the larger side of the join, which AQE splits.
    """
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in SAME_TYPE.items() for x in kv])[F.col("type")], "type")
    rows = entities.select("id", kind.alias("kind"), T.surface_key(F.col("canonical")).alias("name"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.surface_key).alias("aliases"))
    first = written(rows.groupBy("kind", "name").agg(F.min("id").alias("a")))
    same = rows.join(first, ["kind", "name"]).where("id <> a").select("a", F.col("id").alias("b"), F.lit(0.95).alias("score"), F.lit("canonical").alias("method"))
    called = rows.select("kind", "name", F.explode("aliases").alias("alias")).distinct().join(first.withColumnRenamed("a", "b"), ["kind", "name"])
    by_alias = called.select("kind", F.col("alias").alias("name"), "b").join(first, ["kind", "name"]).where("a <> b")
    by_alias = by_alias.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0.93).alias("score"), F.lit("alias").alias("method"))
    longer = first.select("kind", F.col("a").alias("b"), F.regexp_extract("name", r"^(.+?) the .", 1).alias("name")).where("name <> ''")
    epithet = longer.join(first, ["kind", "name"]).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1")
    epithet = epithet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0.93).alias("score"), F.lit("epithet").alias("method"))
    near = similar_names(first.select("kind", F.col("a").alias("id"), F.array_distinct(F.split("name", " ")).alias("w")))
    return same.unionByName(by_alias).unionByName(epithet).unionByName(near).groupBy("a", "b").agg(F.max(F.struct("score", "method")).alias("m")).select("a", "b", F.round("m.score", 6).alias("score"), "m.method")


def similar_names(names: DataFrame, least: float = 0.7) -> DataFrame:
    """a, b, score, method of the pairs of names (kind, id, w: different words) of one kind of which one holds all words of the
    other (substring, 0.85) or that share more than ``least`` of all their words (words, that share)."""
    each = names.select("kind", "id", "w", F.explode("w").alias("t"))
    df = each.groupBy("kind", "t").agg(F.count("*").alias("df"))
    ordered = each.join(df, ["kind", "t"]).groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("w"))
    ordered = written(ordered.select("kind", "id", F.transform("w", lambda x: x["t"]).alias("w")))
    small, all_words = ordered.select("kind", F.col("id").alias("a"), F.col("w").alias("wa"), F.col("w")[0].alias("t")), ordered.select("kind", F.col("id").alias("b"), F.col("w").alias("wb"), F.explode("w").alias("t"))
    held = small.join(all_words, ["kind", "t"]).where("a <> b and size(wa) <= size(wb)").where(F.size(F.array_except("wa", "wb")) == 0)
    held = held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0.85).alias("score"), F.lit("substring").alias("method"))
    # Two sets that share more than the least share have one of their size - ceil(share * size) + 1 rarest words in common.
    prefix = F.slice("w", F.lit(1), F.size("w") - F.ceil(F.lit(least) * F.size("w")).cast("int") + 1)
    rare = ordered.select("kind", "id", "w", F.explode(prefix).alias("t"))
    met = rare.select("kind", "t", F.col("id").alias("a"), F.col("w").alias("wa")).join(rare.select("kind", "t", F.col("id").alias("b"), F.col("w").alias("wb")), ["kind", "t"]).where("a < b")
    met = met.where((F.size("wa") >= least * F.size("wb")) & (F.size("wb") >= least * F.size("wa")))
    common = F.size(F.array_intersect("wa", "wb"))
    share = common / (F.size("wa") + F.size("wb") - common)
    near = met.select("a", "b", share.alias("score"), F.lit("words").alias("method"), common.alias("common"), F.least(F.size("wa"), F.size("wb")).alias("size")).where(F.col("score") > least)
    return held.unionByName(near.where("common < size").drop("common", "size")).distinct()


def merged(entities: DataFrame, least: float = 0.93) -> DataFrame:
    """id, global_id: entities of pairs that score ``least`` or more have the smallest id that they reach. Names that merely hold
    another's words score less: only an epithet makes them one."""
    roots = components(merge_candidates(entities).where(F.col("score") >= least).select("a", "b"))
    return entities.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("global_id"))


def global_entities(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """global_id, type, canonical, aliases, n_local: the longest name (ties: the smallest), the type most have, all other names."""
    rows = entities.join(ids, "id").select("global_id", "type", "canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"), "id")
    kinds = rows.groupBy("global_id", "type").agg(F.countDistinct("id").alias("n")).groupBy("global_id").agg(F.max(F.struct("n", "type")).getField("type").alias("type"))
    named = rows.groupBy("global_id").agg(
        F.min(F.struct((-F.length("canonical")).alias("l"), F.col("canonical"))).getField("canonical").alias("canonical"), F.array_sort(F.collect_set("name")).alias("names"), F.countDistinct("id").alias("n_local")
    )
    return named.join(kinds, "global_id").select("global_id", "type", "canonical", F.array_remove("names", F.col("canonical")).alias("aliases"), "n_local")


def provenance(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """global_id, doc_id, local_id, local_canonical of each local entity (id, doc_id, canonical)."""
    return entities.join(ids, "id").select("global_id", "doc_id", F.col("id").alias("local_id"), F.col("canonical").alias("local_canonical"))


def rewired(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with both ends as global ids; an id without one stays."""
    out = relations
    for end in ("subj", "obj"):
        out = out.join(ids.select(F.col("id").alias(end), F.col("global_id").alias("_g")), end, "left").withColumn(end, F.coalesce("_g", end)).drop("_g")
    return out.select(relations.columns)


def profile_similarity(a: str, b: str):
    """0.5, 0.3 and 0.2 times the Jaccard similarity of words, descriptors and titles, over the weights of those that either has."""
    total = weight = F.lit(0.0)
    for field, w in (("words", 0.5), ("descriptors", 0.3), ("titles", 0.2)):
        x, y = F.col(f"{a}.{field}"), F.col(f"{b}.{field}")
        union = F.size(F.array_union(x, y))
        total = total + F.when(union > 0, F.lit(w) * F.size(F.array_intersect(x, y)) / union).otherwise(0.0)
        weight = weight + F.when(union > 0, F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def discriminated(similarity, same_type) -> F.col:
    """struct<different, confidence> of two senses: other types 1.0, below 0.3 different with 0.9, below 0.5 with 0.6, else the
    same with 0.8."""
    row = lambda d, c: F.struct(F.lit(d).alias("different"), F.lit(c).alias("confidence"))
    return F.when(~same_type, row(True, 1.0)).when(similarity < 0.3, row(True, 0.9)).when(similarity < 0.5, row(True, 0.6)).otherwise(row(False, 0.8))


def discriminated_pairs(senses: DataFrame, size: int = 1024, salts: int = 16, most: int = 64) -> DataFrame:
    """a, b, different, confidence of every two senses (key, name, type, profile) of one name, a < b.

    Senses of equal name, type and profile are a class, kept as blocks of about ``size`` keys. Only blocks are shuffled and
    compared, once for all their keys; the pairs of keys are made where they leave the task, so nothing that is moved or held
    grows with their number: of ``most`` keys and a block at a time, as Spark holds all that explodes from one row, and from all
    matches of a row of a join that is compiled with the explode. The transform keeps the explodes out of the join's code. The
    blocks of a name are dealt to ``salts`` tasks, which see all blocks of that name."""
    spark = senses.sparkSession
    rows = senses.where("name is not null").select("key", "name", F.struct("type", "profile").alias("k"))
    sizes = rows.groupBy("name", "k").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / size)).alias("block")
    blocks = written(rows.join(sizes, ["name", "k"]).select("key", "name", "k", block).groupBy("name", "k", "block").agg(F.collect_list("key").alias("keys")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = blocks.select("name", F.pmod(F.xxhash64("k", "block"), F.lit(salts)).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_a") for c in ("k", "block", "keys")])
    theirs = blocks.select("name", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in ("k", "block", "keys")])
    met = mine.repartition(parts, "name", "salt").join(theirs.repartition(parts, "name", "salt").hint("merge"), ["name", "salt"])
    met = met.where(F.struct("k_a", "block_a") <= F.struct("k_b", "block_b")).withColumn("own", F.struct("k_a", "block_a") == F.struct("k_b", "block_b"))
    met = met.withColumns({"pa": F.col("k_a.profile"), "pb": F.col("k_b.profile")})
    told = met.select("own", "keys_a", "keys_b", discriminated(profile_similarity("pa", "pb"), F.col("k_a.type") == F.col("k_b.type")).alias("d"))
    few = F.transform(F.sequence(F.lit(0), F.size("keys_a") - 1, F.lit(most)), lambda i: F.slice("keys_a", i + 1, F.lit(most)))
    parts_a = told.select("own", "d.different", "d.confidence", "keys_b", F.explode(few).alias("xs"))
    each = parts_a.select("own", "different", "confidence", "keys_b", F.explode("xs").alias("x")).select("own", "different", "confidence", "x", F.explode("keys_b").alias("y"))
    pairs = each.where(F.when(F.col("own"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "different", "confidence")


def matching_sense(asked: DataFrame, senses: DataFrame, least: float = 0.7) -> DataFrame:
    """asked (key, name, type, words) with the best sense (name, type, sense, words) above ``least``; ties to the smaller number.

    Different sets of words are compared, not rows: of the senses with one set the smallest number counts, and what was found
    for a set holds for all that ask with it. Sets meet on the rarest words of both, as many as two of such a share cannot but
    have in common."""
    kind, words = ["name", "type"], F.array_sort(F.array_distinct("words")).alias("words")
    sets = asked.select(*kind, words).distinct()
    known = senses.groupBy(*kind, words).agg(F.min("sense").alias("sense"))
    # By their hash, a null word meets a null word.
    each = sets.unionByName(known.select(*kind, "words")).distinct().select(*kind, "words", F.explode("words").alias("w")).withColumn("t", F.xxhash64("w"))
    df = each.groupBy(*kind, "t").agg(F.count("*").alias("df"))
    ordered = each.join(df, [*kind, "t"]).groupBy(*kind, "words").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    prefix = F.slice("o", F.lit(1), F.size("o") - F.ceil(F.lit(least) * F.size("o")).cast("int") + 1)
    rare = written(ordered.select(*kind, "words", F.explode(F.array_distinct(F.transform(prefix, lambda x: x["t"]))).alias("t")))
    mine = rare.join(sets, [*kind, "words"], "left_semi")
    theirs = rare.join(known, [*kind, "words"]).withColumnRenamed("words", "_w")
    common = F.size(F.array_intersect("words", "_w"))
    scored = mine.join(theirs, [*kind, "t"]).withColumn("similarity", common / (F.size("words") + F.size("_w") - common)).where(F.col("similarity") > least)
    best = scored.groupBy(*kind, "words").agg(F.max(F.struct("similarity", (-F.col("sense")).alias("s"))).alias("b"))
    rows = asked.select("key", *kind, words).join(best, [*kind, "words"], "left").groupBy("key").agg(F.max("b").alias("b"))
    return rows.select("key", (-F.col("b.s")).alias("sense"), F.round("b.similarity", 6).alias("similarity"))


def sense_stats(senses: DataFrame) -> DataFrame:
    """names, ambiguous names (more than one sense) and the most senses of a name."""
    each = senses.groupBy("name").agg(F.countDistinct("sense").alias("n"))
    return each.agg(F.count("*").alias("names"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def alias_stats(aliases: DataFrame) -> DataFrame:
    """total, entities and the mean number of aliases of an entity, for aliases (alias, id)."""
    each = aliases.groupBy("id").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("entities"), F.round(F.avg("n"), 6).alias("average"))


def with_aliases(known: DataFrame, new: DataFrame) -> DataFrame:
    """id, alias, version: new aliases (id, alias) are added, and those of an entity that are there, capitals aside, count up."""
    rows = known.select("id", "alias", F.col("version")).unionByName(new.select("id", "alias", F.lit(1).alias("version")))
    return rows.groupBy("id", F.lower("alias").alias("low")).agg(F.min("alias").alias("alias"), F.sum("version").alias("version")).select("id", "alias", "version")


def without_aliases(known: DataFrame, removed: DataFrame) -> DataFrame:
    """known (id, alias, ...) less those that removed (id, alias) names, capitals aside."""
    gone = removed.select(F.col("id").alias("_id"), F.lower("alias").alias("_a"))
    return known.join(gone, (F.col("id") == F.col("_id")) & (F.lower("alias") == F.col("_a")), "left_anti")


def corrected_relations(relations: DataFrame, corrections: DataFrame, entities: DataFrame) -> DataFrame:
    """subj, pred, obj, confidence after corrections (seq, kind add or remove, subj, pred, obj, rolled_back): the last of a triple
    counts. Added ones have confidence 1, and only between known entities; one that is there already stays as it is."""
    last = corrections.where(~F.coalesce("rolled_back", F.lit(False))).groupBy("subj", "pred", "obj").agg(F.max(F.struct("seq", "kind")).getField("kind").alias("kind"))
    kept = relations.select("subj", "pred", "obj", "confidence").join(last.where("kind = 'remove'"), ["subj", "pred", "obj"], "left_anti")
    ids = entities.select("id")
    added = last.where("kind = 'add'").join(ids.withColumnRenamed("id", "subj"), "subj", "left_semi").join(ids.withColumnRenamed("id", "obj"), "obj", "left_semi")
    added = added.join(relations.select("subj", "pred", "obj"), ["subj", "pred", "obj"], "left_anti")
    return kept.unionByName(added.select("subj", "pred", "obj", F.lit(1.0).alias("confidence")))


def queued(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue (id, ..., status) with new items as pending; an id that is there is not queued again."""
    return queue.unionByName(new.withColumn("status", F.lit("pending")).join(queue.select("id"), "id", "left_anti"), allowMissingColumns=True)


def dismissed(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """Pending items among ids become rejected."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return queue.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit") & (F.col("status") == "pending"), "rejected").otherwise(F.col("status"))).select(queue.columns)


def cleaned(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'")


def bulk(queue: DataFrame, kind: str | None = None, least: float | None = None, name: str | None = None, most: int = 100) -> DataFrame:
    """Pending items of a kind, sure enough, with a part of the name; at most ``most`` (500), the surest first."""
    rows = queue.where("status = 'pending'")
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if least is not None:
        rows = rows.where(F.col("confidence") >= least)
    if name is not None:
        rows = rows.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return rows.orderBy(F.desc("confidence"), "id").limit(min(most or 100, 500))


def bulk_preview(queue: DataFrame, **conditions) -> DataFrame:
    """What ``bulk`` would touch: the number of items and the ids of the first ten."""
    rows = bulk(queue, **conditions)
    firsts = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "id"))), 1, 10)  # of 500 rows at most
    return rows.agg(F.count("*").alias("n"), F.array_join(F.transform(firsts, lambda x: x["id"].cast("string")), ",").alias("first"))


def conflicts(relations: DataFrame, single: list[str], opposite: list[tuple[str, str]]) -> DataFrame:
    """kind, subj, pred, n of the merged graph: several objects of a single-valued predicate, and pairs of predicates that
    exclude each other between one subject and object."""
    many = relations.where(F.col("pred").isin(single)).groupBy("subj", "pred").agg(F.countDistinct("obj").alias("n")).where("n > 1").select(F.lit("single_valued").alias("kind"), "subj", "pred", "n")
    out = many
    for x, y in opposite:
        both = relations.where(F.col("pred").isin(x, y)).groupBy("subj", "obj").agg(F.countDistinct("pred").alias("n")).where("n = 2")
        out = out.unionByName(both.groupBy("subj").agg(F.count("*").alias("n")).select(F.lit("contradiction").alias("kind"), "subj", F.lit(f"{x}/{y}").alias("pred"), "n"))
    return out
