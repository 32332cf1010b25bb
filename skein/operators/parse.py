"""Sentences -> tokens -> relations and states by rules, without a shuffle: every sentence is one row, and higher-order
functions look at its array of tokens.

Kinds of tokens: E name, P pronoun, V verb of the lexicon, X auxiliary, N negation, R preposition, T title, A and, C comma,
Q quotation mark, D determiner, O other. A sentence's names are runs of capitalised words that are no function words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Verb form -> lemma (fixed values).
VERBS = {
    "married": "marry", "marries": "marry", "lives": "live", "lived": "live", "bought": "buy", "buys": "buy", "visit": "visit", "visited": "visit", "said": "say", "says": "say",
    "travelled": "travel", "traveled": "travel", "moved": "move", "went": "go", "gave": "give", "gives": "give", "fought": "fight", "died": "die", "destroyed": "destroy", "killed": "kill",
    "met": "meet", "told": "tell", "asked": "ask", "founded": "found", "ruled": "rule", "rules": "rule", "loves": "love", "loved": "love", "made": "make", "took": "take", "saw": "see", "works": "work", "worked": "work",
}
AUXILIARIES = ("is", "was", "are", "were", "be", "been", "did", "does", "do", "has", "had", "have", "will", "would", "can", "could")
PREPOSITIONS = ("in", "to", "from", "near", "at", "with", "by", "of", "on", "into", "against", "for")
PRONOUNS = ("he", "she", "it", "they", "him", "her", "them", "his", "hers", "their", "i", "we", "you")
DETERMINERS = ("the", "a", "an", "this", "that")
#: Role noun -> predicate of "X is the role of Y" (fixed values).
ROLES = {"father": "parent_of", "mother": "parent_of", "son": "child_of", "daughter": "child_of", "brother": "sibling_of", "sister": "sibling_of", "king": "rules", "queen": "rules", "friend": "friends_with"}
#: Confidence of the rules (fixed values).
CONFIDENCE = {"svo": 0.65, "conj": 0.60, "prep": 0.60, "passive": 0.60, "role": 0.70, "state": 0.70}
#: A run of capitalised words that does not begin with a function word; other words, numbers and marks one by one.
TOKEN = rf"((?!(?:{'|'.join(w.capitalize() for w in T.BLOCKED)})\b)[A-Z][a-z]+(?: [A-Z][a-z]+)*|[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9])"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _map(mapping: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in mapping.items()) + ")"


def tokens(text: Column) -> Column:
    """array<struct<i, w, l, k>>: number, word, lower case and kind of each token."""
    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))

    def token(w: Column, i: Column) -> Column:
        l = F.lower(w)
        kind = (
            F.when(l.isin(*PRONOUNS), "P").when(l.isin(*VERBS), "V").when(l.isin(*AUXILIARIES), "X").when(l.isin("not", "never"), "N").when(l.isin(*PREPOSITIONS), "R")
            .when(l.isin(*T.TITLES), "T").when(l == "and", "A").when(w == ",", "C").when(w.isin('"', "“", "”"), "Q").when(l.isin(*DETERMINERS), "D")
            .when(w.rlike("^[A-Z][a-z]") & ~l.isin(*T.BLOCKED), "E").otherwise("O")
        )
        return F.struct(i.alias("i"), w.alias("w"), l.alias("l"), kind.alias("k"))

    return F.transform(words, token)


def parsed(sentences: DataFrame) -> DataFrame:
    """sentences (doc_id, idx, text, ...) with ``t``, their tokens, and ``quoted``, whether each token is inside quotation marks."""
    return sentences.withColumn("t", tokens(F.col("text")))


#: The relations of one sentence with tokens t, as array<struct<subj, pred, obj, rule, negated>>. t[i] counts from 0, try_element_at from 1.
_ACTIVE = f"""flatten(transform(filter(t, v -> v.k = 'V' and not (v.i > 0 and t[v.i - 1].k = 'Q')), v -> flatten(transform(
  array(struct(
    coalesce(array_max(transform(filter(t, s -> s.i < v.i and s.k in ('E', 'P')), s -> s.i)), -1) as s,
    coalesce(array_min(transform(filter(t, s -> s.i > v.i and s.k = 'V'), s -> s.i)), size(t)) as upto,
    v.i > 0 and t[v.i - 1].l in ('is', 'was', 'are', 'were', 'been') and coalesce(try_element_at(t, v.i + 2).l = 'by', false) as passive)),
  c -> if(c.s < 0, array(), if(c.passive,
    if(coalesce(try_element_at(t, v.i + 3).k in ('E', 'P'), false), array(struct(try_element_at(t, v.i + 3).w as subj, {_map(VERBS)}[v.l] as pred, t[c.s].w as obj, 'passive' as rule, exists(t, n -> n.k = 'N' and n.i between c.s and v.i) as negated)), array()),
    flatten(transform(
      concat(array(struct(t[c.s].w as w, 'first' as how)), if(c.s >= 2 and t[c.s - 1].k = 'A' and t[c.s - 2].k = 'E', array(struct(t[c.s - 2].w as w, 'conj' as how)), array())),
      s -> concat(
        transform(filter(t, o -> o.k = 'E' and (o.i = v.i + 1 or (o.i = v.i + 2 and t[v.i + 1].k in ('D', 'T')))),
          o -> struct(s.w as subj, {_map(VERBS)}[v.l] as pred, o.w as obj, if(s.how = 'conj', 'conj', 'svo') as rule, exists(t, n -> n.k = 'N' and n.i between c.s and v.i) as negated)),
        transform(filter(t, r -> r.k = 'R' and r.i > v.i and r.i < c.upto and coalesce(try_element_at(t, r.i + 2).k = 'E', false)),
          r -> struct(s.w as subj, concat({_map(VERBS)}[v.l], '_', r.l) as pred, try_element_at(t, r.i + 2).w as obj, if(s.how = 'conj', 'conj', 'prep') as rule, exists(t, n -> n.k = 'N' and n.i between c.s and v.i) as negated)))))))))))"""
_ROLE = f"""transform(filter(t, x -> x.l in ('is', 'was') and x.i > 0 and t[x.i - 1].k in ('E', 'P') and coalesce(try_element_at(t, x.i + 2).k = 'D', false)
    and coalesce({_map(ROLES)}[try_element_at(t, x.i + 3).l] is not null, false) and coalesce(try_element_at(t, x.i + 4).l = 'of', false) and coalesce(try_element_at(t, x.i + 5).k = 'E', false)),
  x -> struct(t[x.i - 1].w as subj, {_map(ROLES)}[try_element_at(t, x.i + 3).l] as pred, try_element_at(t, x.i + 5).w as obj, 'role' as rule, false as negated))"""
_STATE = """transform(filter(t, x -> x.l in ('is', 'was') and x.i > 0 and t[x.i - 1].k in ('E', 'P') and coalesce(try_element_at(t, x.i + 2).k = 'O' and try_element_at(t, x.i + 2).w rlike '^[a-z]', false)),
  x -> struct(t[x.i - 1].w as subj, 'is' as pred, try_element_at(t, x.i + 2).w as obj, 'state' as rule, false as negated))"""


def relations(sentences: DataFrame) -> DataFrame:
    """doc_id, sent, subj, pred, obj, rule, negated, confidence of the relations and states that the rules find.

    svo: the name before a verb, and the one right after it; conj: the other of two joined subjects; prep: verb and
    preposition before a name; passive: "was done by"; role: "is the father of"; state: "was tired". A pronoun as subject
    stays as it is (``resolved`` replaces it) and costs 0.15.
    """
    t = parsed(sentences)
    found = t.select("doc_id", F.col("idx").alias("sent"), F.explode(F.concat(F.expr(_ACTIVE), F.expr(_ROLE), F.expr(_STATE))).alias("r"))
    pronoun = F.lower("r.subj").isin(*PRONOUNS)
    base = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("r.rule")]
    return found.select("doc_id", "sent", "r.subj", "r.pred", "r.obj", "r.rule", "r.negated", F.round(base - F.when(pronoun, 0.15).otherwise(0.0), 2).alias("confidence"))


def resolved(found: DataFrame) -> DataFrame:
    """The relations with every pronoun subject replaced by the last name that was a subject in an earlier sentence of the
    document; ``method`` is name, pronoun or unresolved."""
    pronoun = F.lower("subj").isin(*PRONOUNS)
    w = Window.partitionBy("doc_id").orderBy("sent").rangeBetween(Window.unboundedPreceding, -1)
    # Of several subjects of one sentence the last in alphabetical order, so that the answer does not depend on row order.
    last = F.max(F.when(~pronoun, F.struct("sent", "subj"))).over(w)["subj"]
    rows = found.withColumn("_last", last)
    return rows.withColumn("method", F.when(~pronoun, "name").when(F.col("_last").isNotNull(), "pronoun").otherwise("unresolved")).withColumn("subj", F.when(pronoun, F.coalesce("_last", "subj")).otherwise(F.col("subj"))).drop("_last")


def voice(sentences: DataFrame) -> DataFrame:
    """doc_id, idx, voice: passive where an auxiliary stands before a verb and "by" after it, active where a verb stands, else none."""
    t = parsed(sentences)
    passive = F.expr("exists(t, v -> v.k = 'V' and v.i > 0 and t[v.i - 1].k = 'X' and t[v.i - 1].l in ('is', 'was', 'are', 'were', 'been'))")
    return t.select("doc_id", "idx", F.when(passive, "passive").when(F.expr("exists(t, v -> v.k = 'V')"), "active").otherwise("none").alias("voice"))


def clauses(sentences: DataFrame) -> DataFrame:
    """doc_id, idx, n_clauses, pattern: verbs of a sentence, and its shape in the letters S, V, O, C and A."""
    t = parsed(sentences)
    verbs = F.expr("size(filter(t, v -> v.k = 'V' or (v.k = 'X' and not exists(t, u -> u.k = 'V' and u.i between v.i + 1 and v.i + 2))))")
    svo, sv, svc = F.expr("exists(t, v -> v.k = 'V' and coalesce(try_element_at(t, v.i + 2).k = 'E', false))"), F.expr("exists(t, v -> v.k = 'V')"), F.expr("exists(t, v -> v.k = 'X')")
    return t.select("doc_id", "idx", verbs.alias("n_clauses"), F.when(svo, "SVO").when(sv, "SV").when(svc, "SVC").otherwise("-").alias("pattern"))
