"""Readers, and the knowledge-graph tables derived from the supplied star schema.

entities(id, type, canonical), triples(subj, pred, obj, confidence, extractor, doc_id, sent): customers are people,
suppliers organisations, parts items, nations and regions places; orders and their lines are the documents and sentences
that the relations come from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each .txt or .md file below ``path``: uri, text, content_hash."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", True).text(path)
    return rows.select(F.input_file_name().alias("uri"), F.col("value").alias("text"), F.sha2("value", 256).alias("content_hash"))


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, letter, key, kind, label in (
        ("customer", "C", "c_custkey", "PERSON", "c_name"),
        ("supplier", "S", "s_suppkey", "ORG", "s_name"),
        ("part", "P", "p_partkey", "ITEM", "p_name"),
        ("nation", "N", "n_nationkey", "PLACE", "n_name"),
        ("region", "R", "r_regionkey", "PLACE", "r_name"),
    ):
        parts.append(table(spark, sf_dir, name).select(_id(letter, key).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("canonical")))
    return reduce(DataFrame.unionByName, parts)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("merge")  # a hash table of all orders is no small one
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    by_flag = F.when(F.col("l_returnflag") == "A", "dep").when(F.col("l_returnflag") == "R", "regex")

    def edge(df: DataFrame, subj: Column, pred: str, obj: Column, confidence: Column, extractor: Column, doc: Column, sent: Column) -> DataFrame:
        return df.select(
            subj.alias("subj"), F.lit(pred).alias("pred"), obj.alias("obj"), confidence.alias("confidence"),
            extractor.alias("extractor"), doc.cast("long").alias("doc_id"), sent.cast("int").alias("sent"),
        )

    one, dep, zero = F.lit(0.9), F.lit("dep"), F.lit(0)
    return reduce(
        DataFrame.unionByName,
        [
            edge(sold, _id("C", "o_custkey"), "bought", _id("P", "l_partkey"), F.round(1 - F.col("l_discount"), 2), by_flag, F.col("l_orderkey"), F.col("l_linenumber")),
            edge(lines, _id("S", "l_suppkey"), "supplies", _id("P", "l_partkey"), F.round(1 - F.col("l_tax"), 2), by_flag, F.col("l_orderkey"), F.col("l_linenumber")),
            edge(table(spark, sf_dir, "customer"), _id("C", "c_custkey"), "lives_in", _id("N", "c_nationkey"), one, dep, F.col("c_custkey"), zero),
            edge(table(spark, sf_dir, "supplier"), _id("S", "s_suppkey"), "located_in", _id("N", "s_nationkey"), one, dep, F.col("s_suppkey"), zero),
            edge(table(spark, sf_dir, "nation"), _id("N", "n_nationkey"), "part_of", _id("R", "n_regionkey"), one, dep, F.col("n_nationkey"), zero),
        ],
    )


def named(letter: str, key: Column) -> Column:
    """A name in letters for a number: 12 becomes Xxbc."""
    return F.concat(F.lit(letter), F.translate(key.cast("string"), "0123456789", "abcdefghij"))


#: The sentences of a story by the order's key modulo six; c customer, s supplier, p part, n nation, y year.
STORIES = (
    "{c} married {s} in {n}. {c} lives in {n}.",
    "{c} bought {p} from {s}. {s} did not visit {n}.",
    '"{p} is lost," said {c}. {s} travelled to {n}.',
    "Dr. {c} gave {p} to {s} in {y}. He lived in {n}.",
    "{c} is the father of {s}. {s} was tired. {p} was destroyed by {c}.",
    "{c} and {s} fought {p} near {n}. {s} died in {n} in {y}.",
)


def _cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with their customer, first supplier and first part (s, p)."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    return table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def told(patterns: Sequence[str], which: Column) -> Column:
    """The pattern of number ``which`` with the names of an order (see ``_cast``) in place of the letters in braces."""
    k = F.col("o_orderkey")
    who = {
        "c": named("Cu", F.col("o_custkey")), "s": named("Su", F.col("s")), "p": named("Pa", F.col("p")), "n": named("Na", F.col("c_nationkey")), "y": F.year("o_orderdate").cast("string"),
        "q": named("Qo", k % 97), "m": named("Mo", k % 31), "r": named("Re", k % 53),
    }
    text = F.lit(None).cast("string")
    for t, pattern in enumerate(patterns):
        parts, rest = [], pattern
        while "{" in rest:
            before, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(before), who[name]]
        text = F.when(which == t, F.concat(*parts, F.lit(rest))).otherwise(text)
    return text


#: What a sentence of ``grammar_texts`` is made of: how it begins, its subject, its predicate, its end.
LEADS = ("", "In {y}, ", "Then ")
SUBJECTS = ("{c}", "{c} and {s}", "{c}, {s} and {q}", "{c}, who ruled {n},", "{c}, son of {s},", "{c} of {n}", "{c}, the brother of {s}, who was not loved by {q},")
PREDICATES = (" visited {p}", " did not visit {p}", " was killed by the {p}", " visited {p} and married {m}", " travelled to {p}", " gave {p} to {m}", " met {p} and {m}")
ENDS = ("", " in 1999", ", and {r} met {q}", " near {r}")


def grammar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a sentence for each order, of one of 588 shapes that the order's key chooses."""
    k = F.col("o_orderkey")
    pick = lambda n: F.floor(k / n).cast("long")
    parts = [told(LEADS, pick(196) % 3), told(SUBJECTS, k % 7), told(PREDICATES, pick(7) % 7), told(ENDS, pick(49) % 4)]
    return _cast(spark, sf_dir).select(k.alias("doc_id"), F.concat(*parts, F.lit(".")).alias("text"))


#: The sentences of a dialogue; each dialogue begins with another one.
DIALOGUE = ("Mr. {c} met Mrs. {s} in {n}.", "She liked {p}.", "He bought it.", "{r} and {q} visited {m}.", "They thanked him.", "Then she left with {c}.")


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, text: a sentence for each order; six orders are a dialogue, with the same names in all its sentences."""
    k = F.col("o_orderkey")
    doc = F.floor(k / len(DIALOGUE)).cast("long")
    rows = table(spark, sf_dir, "orders").select(k.alias("_k"), doc.alias("o_orderkey"), (doc % 89).alias("o_custkey"), (doc % 83).alias("s"), (doc % 79).alias("p"), (doc % 25).alias("c_nationkey"), "o_orderdate")
    idx = (F.col("_k") % len(DIALOGUE)).cast("int")
    return rows.select(F.col("o_orderkey").alias("doc_id"), idx.alias("idx"), told(DIALOGUE, (idx + F.col("o_orderkey")) % len(DIALOGUE)).alias("text"))


#: Sentences on persons who share names; the first and the last say nothing that keeps persons apart.
NAMESAKES = (
    "{c} visited {n}.", "{c}, the wizard, visited {n}.", "{c} worked as a farmer in {n}.", "{c}, father of {s}, met the farmer.",
    "{c}, a young wizard, left {n}.", "{c}, son of {s}, left {n}.", "The retired judge {c} rested in {n}.", "{c} died in {n}.", "{c} saw {p}.",
)


def namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, text: a sentence for each order; 97 names, of which every third is one person's."""
    rows = _cast(spark, sf_dir)
    k = F.col("o_custkey")
    one = k % 97 % 3 == 0
    which = F.when(one, F.col("o_orderkey") % 2).otherwise((k + F.col("o_orderkey") % 3) % len(NAMESAKES))
    rows = rows.withColumn("which", which).withColumn("o_custkey", k % 97)
    return rows.select(F.col("o_orderkey").alias("doc_id"), named("Cu", k).alias("name"), told(NAMESAKES, F.col("which")).alias("text"))


#: Names in pieces, and words for places named before.
PIECES = (
    "{c} of {n} met {s} and {q}. They lived there.", "There {c} and {q} left {n} {p}. {m} stayed there, there alone.",
    "{c} de {q} of {n} saw {s}.", "{p} of {r} and {m} fell.",
)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text for each order; written, as stories are."""
    k = F.col("o_orderkey")
    return written(_cast(spark, sf_dir).select(k.alias("doc_id"), told(PIECES, k % len(PIECES)).alias("text")))


#: Sentences with and without a name that is told apart from brothers and sisters.
FAMILIES = ("{c}, the eldest son of {s}, visited {n}.", "{c} visited {s}, twin brother of {q}.", "{c} raised {s}, {q} and {m}.", "{m} saw {c} , youngest  daughter, with {q}.")


def families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) and relations (doc_id, subj, pred, obj), four of each order, some of which take a sibling for a parent."""
    k = F.col("o_orderkey")
    rows = _cast(spark, sf_dir)
    who = {"c": named("Cu", F.col("o_custkey")), "s": named("Su", F.col("s")), "q": named("Qo", k % 97), "m": named("Mo", k % 31)}
    edges = [F.struct(who[a].alias("subj"), F.lit(p).alias("pred"), who[b].alias("obj")) for a, p, b in (("c", "parent_of", "s"), ("q", "child_of", "s"), ("m", "child_of", "c"), ("s", "sibling_of", "c"))]
    return rows.select(k.alias("doc_id"), told(FAMILIES, k % len(FAMILIES)).alias("text")), rows.select(k.alias("doc_id"), F.explode(F.array(*edges)).alias("e")).select("doc_id", "e.*")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: an English text of two or three sentences for each order, told of its customer, nation, first supplier
    and first part. The supplied documents are invented words without grammar; these have relations to be found. They are
    written: what reads a text piece by piece numbers its rows, and numbers over a shuffle change when a task runs again."""
    rows = _cast(spark, sf_dir)
    text = told(STORIES, F.col("o_orderkey") % len(STORIES))
    return written(rows.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
