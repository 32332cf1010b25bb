"""Clusters of mentions under constraints: links unite clusters, but never two titles or two types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import written
from .registry import SAME_TYPE, components

#: Words before a name that are no part of it (fixed values).
TITLES = (
    "mr", "mrs", "ms", "miss", "dr", "doctor", "prof", "professor", "sir", "madam", "madame", "lord", "lady", "king", "queen",
    "prince", "princess", "captain", "commander", "general", "colonel", "major", "sergeant", "lieutenant", "father", "mother",
    "brother", "sister", "coach", "detective", "officer", "nurse", "principal", "judge", "justice", "senator", "governor", "mayor",
    "president", "headmaster", "headmistress", "master", "mistress",
)


def title_of(name: Column) -> Column:
    """The title that a name of two words or more begins with, in lower case without its dot; else null."""
    words = F.split(F.trim(name), r"\s+")
    first = F.regexp_replace(F.lower(words[0]), r"\.$", "")
    return F.when((F.size(words) > 1) & first.isin(*TITLES), first)


def stripped(name: Column) -> Column:
    """The name in lower case, with single blanks and without its title."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    return F.when(title_of(name).isNotNull(), F.regexp_replace(low, r"^\S+ ", "")).otherwise(low)


def _signed(nodes: DataFrame) -> DataFrame:
    """id, type, title, weight: types by their one name; who has a title is a person."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in SAME_TYPE.items() for x in kv])[F.col("type")], "type")
    return nodes.select("id", F.when(F.col("title").isNotNull(), "PERSON").otherwise(kind).alias("type"), "title", F.col("weight").cast("long").alias("weight"))


def key_links(nodes: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links that tie all nodes (id, type, title, weight) with a key in common (id, key) together without pairing them.

    Beside the nodes stand a row for the key, one for the key with each type, and one for that with each title, linked from the
    special to the general; a node is linked to the row of its own type and title. So the links grow with the rows, a key that
    a third of all nodes bear included. Ids must be strings that do not begin with ``~``."""
    own = _signed(nodes)
    rows = keys.where("key is not null").distinct().join(own.select("id", "type", "title"), "id")
    name = lambda *parts: F.concat_ws("\x1f", F.lit("~"), *[F.coalesce(p, F.lit("")) for p in parts])
    key, kind, title = F.col("key"), F.col("type"), F.col("title")
    classes = rows.select("key", "type", "title").distinct()
    levels = classes.unionByName(classes.withColumn("title", F.lit(None).cast("string"))).unionByName(classes.select("key", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("title"))).distinct()
    middle = levels.select(name(key, kind, title).alias("id"), "type", "title", F.lit(0).cast("long").alias("weight"))
    none = F.lit(None).cast("string")
    up = levels.where("type is not null").select(name(key, kind, title).alias("a"), F.when(title.isNotNull(), name(key, kind, none)).otherwise(name(key, none, none)).alias("b"))
    return own.unionByName(middle), rows.select(F.col("id").alias("a"), name(key, kind, title).alias("b")).unionByName(up)


def united(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, root, type, title: the cluster (by its smallest id) of every node (id, type, title, weight), where links (a, b) unite
    clusters but no cluster has two types or two titles; null fits any. A title makes a PERSON, so clusters that fit each other
    are alike, or one of them says more.

    Each round unites, to the fixed point, linked clusters that are alike; then every cluster with a link to one that fits and
    says more joins the one of these with most weight (ties: the smallest id). A cluster follows one other only and what it
    follows says more, so no two titles meet; other clusters that it was linked with stay apart. Rounds end when no link is
    between clusters that fit: after three at most, as who says nothing has joined in the first and who has a type in the
    second. Repeated rows and links count once (of a node's several rows the one that says most); links to unknown ids and
    loops are left out; nodes without links stay alone. Rounds are written; joins are on ids, hubs split by AQE.
    """
    known = _signed(nodes.where("id is not null")).groupBy("id").agg(F.max(F.struct("title", "type", "weight")).alias("m")).select("id", "m.type", "m.title", F.coalesce("m.weight", F.lit(0)).alias("weight"))
    member = written(known.select("id", F.col("id").alias("root")))
    state = written(known.withColumnRenamed("id", "root"))
    links = written(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    while True:
        edges = _fitting(links, member, state)
        if not edges.limit(1).count():
            break
        member, state = _contracted(member, state, edges.where("la = lb").select("a", "b"))
        edges = _fitting(links, member, state)
        more = edges.select("a", "b", "la", "lb", "wb").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("lb").alias("la"), F.col("la").alias("lb"), F.col("wa").alias("wb"))).where("la < lb")
        best = more.groupBy("a").agg(F.min(F.struct((-F.col("wb")).alias("w"), F.col("b"))).alias("m"))
        member, state = _contracted(member, state, best.select("a", F.col("m.b").alias("b")))
    return member.join(state.drop("weight"), "root").select("id", "root", "type", "title")


def _fitting(links: DataFrame, member: DataFrame, state: DataFrame) -> DataFrame:
    """a, b, la, lb, wa, wb: linked clusters that fit each other, how much each says, their weights; written."""
    cluster = member.join(state, "root").withColumn("l", F.col("type").isNotNull().cast("int") + F.col("title").isNotNull().cast("int"))
    side = lambda s: cluster.select(F.col("id").alias(s), F.col("root").alias(f"r{s}"), F.col("type").alias(f"t{s}"), F.col("title").alias(f"h{s}"), F.col("l").alias(f"l{s}"), F.col("weight").alias(f"w{s}"))
    rows = links.join(side("a"), "a").join(side("b"), "b").where("ra <> rb")
    fit = F.coalesce(F.col("ta") == F.col("tb"), F.lit(True)) & F.coalesce(F.col("ha") == F.col("hb"), F.lit(True))
    return written(rows.where(fit).select(F.col("ra").alias("a"), F.col("rb").alias("b"), "la", "lb", "wa", "wb").distinct())


def _contracted(member: DataFrame, state: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and clusters after the clusters that the edges connect became one."""
    to = components(edges).select(F.col("id").alias("root"), F.col("root").alias("new"))
    new = F.coalesce("new", "root").alias("root")
    member = written(member.join(to, "root", "left").select("id", new))
    merged = state.join(to, "root", "left").select(new, "type", "title", "weight").groupBy("root")
    return member, written(merged.agg(F.max("type").alias("type"), F.max("title").alias("title"), F.sum("weight").alias("weight")))
