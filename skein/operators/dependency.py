"""Shortest paths between two words of a dependency tree, from head pointers, inside the row that holds the sentence.

In a tree the shortest path goes up from one word to the lowest common ancestor and down to the other. Both chains of
ancestors are arrays as long as the tree is deep, so no edge is a row and nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(tokens: Column, i: Column) -> Column:
    """i, its head, its head's head and so on to the root, which is its own head or has none (null, or outside of the tokens).
    A chain that comes back to a token of its own ends before it."""

    def step(acc: Column, _: Column) -> Column:
        head = F.get(tokens, F.element_at(acc, -1))["head"]
        return F.when(head.isNull() | (head < 0) | (head >= F.size(tokens)) | F.array_contains(acc, F.coalesce(head, F.lit(-1))), acc).otherwise(F.concat(acc, F.array(head)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), F.array(i.cast("int")), step)


def with_paths(pairs: DataFrame) -> DataFrame:
    """pairs (tokens: array of i, lemma, pos, dep, head, with i the place; a, b: places) with length (words), path, edges (labels),
    has_verb and has_preposition; all null where a is b, a place is none of the tokens, or no path joins them.

    path is "lemma:↑dep:lemma:↓dep:lemma": up from a by the labels of the words left, down to b by those of the words reached.
    """
    t = F.col("tokens")
    valid = (F.col("a") != F.col("b")) & F.col("a").between(0, F.size(t) - 1) & F.col("b").between(0, F.size(t) - 1)
    rows = pairs.withColumn("_up", F.when(valid, ancestors(t, F.col("a")))).withColumn("_down", F.when(valid, ancestors(t, F.col("b"))))
    rows = rows.withColumn("_top", F.get(F.array_intersect("_up", "_down"), F.lit(0)))
    rows = rows.withColumn("_up", F.slice("_up", F.lit(1), F.array_position("_up", F.col("_top")).cast("int"))).withColumn("_down", F.reverse(F.slice("_down", F.lit(1), F.greatest(F.array_position("_down", F.col("_top")).cast("int") - 1, F.lit(0)))))
    left = F.slice("_up", F.lit(1), F.greatest(F.size("_up") - 1, F.lit(0)))
    word = lambda i: F.get(t, i)
    up = F.transform(left, lambda i: F.concat(F.lit(":↑"), word(i)["dep"], F.lit(":"), word(word(i)["head"])["lemma"]))
    down = F.transform("_down", lambda i: F.concat(F.lit(":↓"), word(i)["dep"], F.lit(":"), word(i)["lemma"]))
    on = F.concat("_up", "_down")
    found = F.col("_top").isNotNull()
    out = rows.select(
        *pairs.columns, F.when(found, F.size("_up") + F.size("_down")).alias("length"), F.when(found, F.concat(word(F.col("a"))["lemma"], F.array_join(F.concat(up, down), ""))).alias("path"),
        F.when(found, F.transform(F.concat(left, F.col("_down")), lambda i: word(i)["dep"])).alias("edges"),
        F.when(found, F.exists(on, lambda i: word(i)["pos"].startswith("V"))).alias("has_verb"), F.when(found, F.exists(on, lambda i: word(i)["pos"] == "ADP")).alias("has_preposition"),
    )
    return out


def predicate_of(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """The predicate of the first pattern (a regular expression) that the path has a match of; null where none does."""
    out = F.lit(None).cast("string")
    for pattern, predicate in reversed(patterns):
        out = F.when(path.rlike(pattern), predicate).otherwise(out)
    return out
