"""Pronouns and what they stand for: candidates of the sentences before, scored by recency, place, gender, number and type.

A k-best as-of join: for each pronoun the names of its own and the last REACH sentences, which a range frame of one window
by document holds. A frame is as large as the names of so many sentences, however long the document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Sentences back; what a sentence more costs; weights of a sentence's first name, of others, and of an unknown gender.
REACH, DECAY, FIRST, OTHER, UNKNOWN = 5, 0.5, 1.0, 0.6, 0.8
#: Pronoun -> gender, number, whether it is an object (fixed values).
PRONOUNS = {
    "he": ("m", "one", False), "him": ("m", "one", True), "his": ("m", "one", False), "she": ("f", "one", False), "her": ("f", "one", True), "hers": ("f", "one", False),
    "it": ("n", "one", False), "its": ("n", "one", False), "they": ("any", "many", False), "them": ("any", "many", True), "their": ("any", "many", False),
}
#: Title -> gender (fixed values).
TITLES = {"Mr.": "m", "Sir": "m", "Lord": "m", "King": "m", "Prince": "m", "Mrs.": "f", "Ms.": "f", "Miss": "f", "Lady": "f", "Queen": "f", "Princess": "f", "Madam": "f"}
_TITLE = "|".join(t.replace(".", r"\.") for t in TITLES)
_NAME = rf"(?:(?:{_TITLE}) )?(?!(?:{'|'.join(w.capitalize() for w in T.BLOCKED)})\b)[A-Z][a-z]+(?: [A-Z][a-z]+)*"
MENTION = rf"\b((?i:{'|'.join(PRONOUNS)})\b|{_NAME}(?: and {_NAME})*)"


def _look(mapping: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def mentions(sentences: DataFrame) -> DataFrame:
    """doc_id, sent, at, name, gender, number, pronoun (null for names) of the names and pronouns of sentences (doc_id, idx,
    text); at counts the mentions of a sentence. Names joined by "and" are one of number many, and each one of its own."""
    each = sentences.select("doc_id", F.col("idx").alias("sent"), F.posexplode(F.regexp_extract_all("text", F.lit(MENTION), F.lit(1))).alias("at", "m"))
    low = F.lower("m")
    parts = F.split("m", " and ")
    one = lambda name, number, pronoun, gender: F.struct(name.alias("name"), gender.alias("gender"), F.lit(number).alias("number") if isinstance(number, str) else number.alias("number"), pronoun.alias("pronoun"))
    none, title = F.lit(None).cast("string"), lambda w: F.regexp_extract(w, rf"^({_TITLE}) ", 1)
    bare = lambda w: F.regexp_replace(w, rf"^(?:{_TITLE}) ", "")
    single = F.transform(parts, lambda w: one(bare(w), "one", none, _look(TITLES, title(w))))
    group = F.array(one(F.array_join(F.transform(parts, bare), " and "), "many", none, none))
    said = F.array(one(none, _look({k: v[1] for k, v in PRONOUNS.items()}, low), low, _look({k: v[0] for k, v in PRONOUNS.items()}, low)))
    rows = each.select("doc_id", "sent", "at", F.explode(F.when(low.isin(*PRONOUNS), said).when(F.size(parts) > 1, F.concat(group, single)).otherwise(single)).alias("x"))
    return rows.select("doc_id", "sent", "at", "x.*")


def described(found: DataFrame, types: DataFrame) -> DataFrame:
    """The mentions with the gender that any mention of the name in the document has, and type from types (name, type)."""
    known = found.where("gender is not null and pronoun is null").groupBy("doc_id", "name").agg(F.max("gender").alias("_g"))
    rows = found.join(known, ["doc_id", "name"], "left").withColumn("gender", F.coalesce("gender", "_g")).drop("_g")
    return rows.join(types.select("name", "type"), "name", "left")


def resolved(found: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, sent, at, pronoun, antecedent, score, n_candidates for each pronoun of found (see ``described``); null where no
    candidate fits.

    A name scores FIRST where it begins its sentence, else OTHER, times DECAY for each sentence between, added up over its
    mentions, and times UNKNOWN if its gender is not known. "He" and "she" never mean an organisation, place or thing, nor a
    name of the other gender; "it" means no person and nobody of known gender; "they" a joined group or an organisation. An
    object pronoun does not mean its own sentence's first name. Of equal scores the latest name counts, then the smallest.
    """
    w = Window.partitionBy("doc_id").orderBy("sent").rangeBetween(-reach, 0)
    named = F.when(F.col("pronoun").isNull(), F.struct("sent", "at", "name", "gender", "number", "type"))
    rows = found.withColumn("near", F.collect_list(named).over(w)).where("pronoun is not null")
    objects = [p for p, v in PRONOUNS.items() if v[2]]

    def fits(c: Column) -> Column:
        c_kind = F.coalesce(c["type"], F.lit("PERSON"))
        before = (c["sent"] < F.col("sent")) | (c["at"] < F.col("at"))
        own = F.col("pronoun").isin(objects) & (c["sent"] == F.col("sent")) & (c["at"] == 0)
        person = (c["number"] == "one") & (c_kind == "PERSON") & (F.coalesce(c["gender"], F.col("gender")) == F.col("gender"))
        thing = (c["number"] == "one") & (c_kind != "PERSON") & c["gender"].isNull()
        many = (c["number"] == "many") | (c_kind == "ORG")
        return before & ~own & F.when(F.col("gender") == "n", thing).when(F.col("gender") == "any", many).otherwise(person)

    def scored(name: Column) -> Column:
        own = F.filter("near", lambda c: c["name"] == name)
        weight = lambda c: F.when(c["at"] == 0, FIRST).otherwise(OTHER) * F.pow(F.lit(DECAY), F.col("sent") - c["sent"])
        sure = F.when(F.col("gender").isin("m", "f") & F.exists(own, lambda c: c["gender"].isNull()), UNKNOWN).otherwise(1.0)
        total = F.aggregate(own, F.lit(0.0), lambda acc, c: acc + weight(c))
        last = F.array_max(F.transform(own, lambda c: F.struct(c["sent"].alias("sent"), c["at"].alias("at"))))
        return F.struct((-F.round(total * sure, 6)).alias("s"), (-last["sent"]).alias("ls"), (-last["at"]).alias("la"), name.alias("name"))

    rows = rows.withColumn("near", F.filter("near", fits)).withColumn("names", F.array_distinct(F.transform("near", lambda c: c["name"])))
    best = rows.withColumn("best", F.array_min(F.transform("names", scored)))
    return best.select("doc_id", "sent", "at", "pronoun", F.col("best.name").alias("antecedent"), (-F.col("best.s")).alias("score"), F.size("names").alias("n_candidates"))
