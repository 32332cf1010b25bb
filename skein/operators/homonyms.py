"""Persons of one name: the context of a mention, conflicts of contexts, and the split of a name by greedy colouring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for what somebody does (fixed values).
OCCUPATIONS = (
    "doctor", "surgeon", "cardiologist", "neurologist", "physician", "nurse", "paramedic",
    "professor", "teacher", "researcher", "scientist", "lecturer", "scholar", "student",
    "ceo", "president", "manager", "director", "executive", "entrepreneur", "founder",
    "engineer", "programmer", "developer", "architect", "designer", "analyst",
    "lawyer", "attorney", "judge", "prosecutor", "counsel",
    "senator", "congressman", "mayor", "governor", "minister", "ambassador",
    "captain", "commander", "general", "admiral", "sergeant", "soldier",
    "keeper", "guard", "driver", "pilot", "sailor", "chef", "waiter",
    "writer", "author", "artist", "musician", "actor", "photographer",
    "farmer", "merchant", "trader", "priest", "wizard", "king", "queen",
)
#: Relation -> words for it (fixed values).
KIN = {
    "father": ("father", "dad", "daddy", "papa"), "mother": ("mother", "mom", "mommy", "mama"), "son": ("son", "boy"), "daughter": ("daughter", "girl"),
    "brother": ("brother",), "sister": ("sister",), "uncle": ("uncle",), "aunt": ("aunt",), "nephew": ("nephew",), "niece": ("niece",), "cousin": ("cousin",),
    "husband": ("husband", "spouse"), "wife": ("wife", "spouse"), "friend": ("friend",), "colleague": ("colleague", "coworker"),
}
#: Marker of age -> words for it (fixed values).
AGES = {"retired": ("retired", "retirement"), "young": ("young", "younger", "youngest"), "died": ("died", "deceased")}
#: Relations that one person has to another, not both (fixed values).
OPPOSITE = (("father", "son"), ("mother", "daughter"), ("uncle", "nephew"), ("aunt", "niece"))
#: A name with fewer mentions is never split (fixed value).
LEAST = 3


def context_of(sentence: Column) -> Column:
    """Struct of the occupations, relations and ages that the words of a sentence name, each in order of the alphabet; null and
    empty sentences have none. One pass over the words and set operations, all built in."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(sentence, F.lit(""))), F.lit(r"([a-z]+)"), F.lit(1)))
    groups = lambda table: F.array_sort(F.filter(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, w))), F.lit(k)) for k, w in table.items()]), lambda x: x.isNotNull()))
    return F.struct(F.array_sort(F.array_intersect(words, F.array(*map(F.lit, OCCUPATIONS)))).alias("occupations"), groups(KIN).alias("relations"), groups(AGES).alias("ages"))


def conflict(a: Column, b: Column) -> Column:
    """Whether two contexts cannot be one person's: no occupation in common, opposite relations, retired against young, or only
    one of them dead. Equal contexts never conflict, so that a context's person does not depend on how often it is met."""
    has = lambda x, field, v: F.array_contains(x[field], v)
    out = (F.size(a["occupations"]) > 0) & (F.size(b["occupations"]) > 0) & ~F.arrays_overlap(a["occupations"], b["occupations"])
    for x, y in OPPOSITE:
        out |= (has(a, "relations", x) & has(b, "relations", y)) | (has(a, "relations", y) & has(b, "relations", x))
    out |= (has(a, "ages", "retired") & has(b, "ages", "young")) | (has(a, "ages", "young") & has(b, "ages", "retired"))
    out |= has(a, "ages", "died") != has(b, "ages", "died")
    return out & (a != b)


def _mixed(n: Column, seen: Column) -> Column:
    """Whether a name with n mentions in these contexts is to be split at all."""
    every = lambda field: F.array_distinct(F.flatten(F.transform(seen, lambda x: x["context"][field])))
    kin, ages = every("relations"), every("ages")
    any_of = lambda x, *w: F.arrays_overlap(x, F.array(*map(F.lit, w)))
    both = any_of(kin, "father", "mother") & any_of(kin, "son", "daughter")
    return (n >= LEAST) & (both | (F.size(every("occupations")) > 1) | (any_of(ages, "died", "retired") & any_of(ages, "young")))


def persons(mentions: DataFrame) -> DataFrame:
    """name, context, person, n, at of mentions (name, at, context): the person, numbered from 0, that a context of a name is of.

    The contexts of a name are taken by their first mention (the smallest ``at``; ties by the context): each goes to the first
    person whose own first context does not conflict with it, or begins a new one. As persons are only added behind, an equal
    context always goes to the same person, so the mentions are counted by context before the shuffle and a row holds the
    different contexts of a name, whose words come from closed lists; a name with a third of all mentions is no larger.
    """
    seen = mentions.groupBy("name", "context").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    names = seen.groupBy("name").agg(F.sum("n").alias("_n"), F.array_sort(F.collect_list(F.struct("at", "context", "n"))).alias("seen"))
    contexts = F.transform("seen", lambda x: x["context"])
    first = F.aggregate(contexts, F.slice(contexts, 1, 0), lambda acc, c: F.when(F.exists(acc, lambda r: ~conflict(r, c)), acc).otherwise(F.concat(acc, F.array(c))))
    rows = names.withColumn("first", F.when(_mixed(F.col("_n"), F.col("seen")), first)).select("name", "first", F.explode("seen").alias("s"))
    fits = F.array_position(F.transform("first", lambda r: ~conflict(r, F.col("s.context"))), True)
    person = F.coalesce(fits - 1, F.lit(0)).cast("int")
    return rows.select("name", "s.context", person.alias("person"), "s.n", "s.at")


def split(mentions: DataFrame) -> DataFrame:
    """mentions (name, at, context, ...) with ``person``; rows with a null name are left out. The table of contexts is joined
    back: it has a row for each context of a name, and AQE splits names that most mentions bear."""
    return mentions.join(persons(mentions).select("name", "context", "person"), ["name", "context"])


def described(found: DataFrame) -> DataFrame:
    """name, person, label, n, first of the result of ``persons``: a person of a name that was split is told apart by the first
    of their occupations, else of their relations, else of their ages, in order of the alphabet; one that has none, and a
    name that was not split, keep the bare name."""
    word = lambda field: F.min(F.element_at(F.when(F.size(F.col("context")[field]) > 0, F.col("context")[field]), 1))
    rows = found.groupBy("name", "person").agg(F.coalesce(word("occupations"), word("relations"), word("ages")).alias("by"), F.sum("n").alias("n"), F.min("at").alias("first"))
    several = found.groupBy("name").agg((F.max("person") > 0).alias("several"))
    label = F.when(F.col("several") & F.col("by").isNotNull(), F.concat("name", F.lit(" ("), "by", F.lit(")"))).otherwise(F.col("name"))
    return rows.join(several, "name").select("name", "person", label.alias("label"), "n", "first")
