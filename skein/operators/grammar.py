"""Relations of ordinary sentences: an automaton with a stack over the tokens of a sentence.

A verb must get its own subject: what stands between the two, a relative clause or an appositive, is a clause of its own.
The automaton reads tokens from left to right and keeps the open clause; a relative pronoun or an appositive puts it on the
stack, and the comma that closes it, or a second verb, brings it back. Time is in proportion to the tokens. A sentence is a
row and stays where it is: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import text as T
from .parse import AUXILIARIES, DETERMINERS, PREPOSITIONS, PRONOUNS, ROLES, VERBS

#: Verb form -> lemma; the lemma itself follows an auxiliary ("did not love").
FORMS = VERBS | {lemma: lemma for lemma in VERBS.values()} | {"seen": "see", "given": "give", "taken": "take"}
BE = ("is", "was", "are", "were", "be", "been")
RELATIVE = ("who", "which", "that", "whom")
NEGATION = ("not", "never", "n't", "neither")
#: What costs confidence (fixed values): a negated relation, a pronoun as subject, an inherited or coordinated subject.
CONFIDENCE, NEGATED, PRONOUN, INHERITED = 0.7, 0.1, 0.15, 0.05
_token = re.compile(r"[A-Z][\w'’-]*(?: (?!(?:" + "|".join(w.capitalize() for w in T.BLOCKED) + r")\b)[A-Z][\w'’-]*)*|[^\W\d_][\w'’-]*|\d+|[^\w\s]")


def kinds(text: str) -> Iterator[tuple[str, str]]:
    """(word, kind) of each token: E name, P pronoun, V verb, X auxiliary, N negation, R preposition, W relative pronoun, A and,
    C comma, Q quotation mark, D determiner, T title, L role noun, O other. A name is a run of capitalised words; function
    words, verbs and titles that a sentence begins with are taken off it."""
    for m in _token.finditer(text):
        for w in _names(m.group()):
            low = w.lower()
            if w[0].isupper() and " " in w:
                yield w, "E"
            else:
                yield (
                    w,
                    "P" if low in PRONOUNS else "X" if low in AUXILIARIES else "N" if low in NEGATION or low.endswith("n't") else "W" if low in RELATIVE else "D" if low in DETERMINERS
                    else "R" if low in PREPOSITIONS else "A" if low in ("and", "or", "but") else "C" if w == "," else "Q" if w in '"“”' else "L" if low in ROLES and w.islower() else "T" if low in T.TITLES or low in ("mr", "mrs", "ms", "dr")
                    else "V" if low in FORMS and w.islower() else "E" if w[0].isupper() and low not in T.BLOCKED else "O",
                )


def _names(run: str) -> list[str]:
    first, _, rest = run.partition(" ")
    if rest and (first.lower() in T.BLOCKED or first.lower() in (*PREPOSITIONS, *DETERMINERS, *PRONOUNS, *T.TITLES, "mr", "mrs", "ms", "dr")):
        return [first, *_names(rest)]
    return [run]


@dataclass
class Clause:
    subjects: tuple[str, ...] = ()
    noun: tuple[str, ...] = ()  # the names of the last noun phrase before the verb
    verb: str = ""
    preposition: str = ""
    negated: bool = False
    be: bool = False
    passive: bool = False
    inherited: bool = False
    role: str = ""
    comma: bool = False  # opened by a comma, so that a comma closes it
    plain: bool = False  # the last noun phrase is no name


@dataclass
class Found:
    rows: list[tuple] = field(default_factory=list)

    def add(self, subjects, predicate: str, obj: str, rule: str, clause: Clause) -> None:
        for k, s in enumerate(subjects):
            if s != obj:
                cost = NEGATED * clause.negated + PRONOUN * (s.lower() in PRONOUNS) + INHERITED * (k > 0 or clause.inherited)
                self.rows.append((s, predicate, obj, rule, clause.negated, round(CONFIDENCE - cost, 2)))


def relations_of(text: str) -> list[tuple]:
    """(subj, pred, obj, rule, negated, confidence) of the relations of one sentence, in the order of their objects.

    Rules: svo, prep (verb and preposition), passive (by), role ("son of", as an appositive or after "is"), state ("was tired").
    """
    found, stack, c = Found(), [], Clause()
    joined, late, before = False, 0, ""  # after "and"; relations of an object that may be the next clause's subject; last kind
    opened = False  # a comma after a noun phrase that has no verb yet
    speech = False
    tokens = list(kinds(text))
    for at, (word, kind) in enumerate(tokens):
        low = word.lower()
        if kind == "Q":
            stack, c, joined, opened = [], Clause(), False, False
        elif kind in "EP":
            if speech:
                speech = False
            elif c.role and c.preposition == "of":
                found.add(c.subjects, ROLES[c.role], word, "role", c)
                c = replace(c, role="", preposition="")
            elif not c.verb:
                if c.preposition:
                    c = replace(c, preposition="")
                else:
                    c = replace(c, noun=(*c.noun, word) if joined or opened else (word,), plain=False)
            else:
                n = len(found.rows)
                if c.passive and c.preposition == "by":
                    for s in c.subjects:
                        found.add((word,), c.verb, s, "passive", c)
                elif c.preposition:
                    found.add(c.subjects, f"{c.verb}_{c.preposition}", word, "prep", c)
                elif not c.passive:
                    found.add(c.subjects, c.verb, word, "svo", c)
                late = len(found.rows) - n if joined else 0
                c = replace(c, noun=(word,), plain=False)
            joined = opened = False
        elif kind == "W" and c.noun and before in "ECO":
            stack.append(replace(c, noun=c.noun))
            c = Clause(noun=() if before == "O" else c.noun, comma=before == "C")
            opened = False
        elif kind == "L" and (before == "C" or (before == "D" and tokens[at - 2][1] == "C" if at > 1 else False)) and c.noun and not c.verb:
            stack.append(c)
            c = Clause(subjects=c.noun, noun=c.noun, verb="", role=low, comma=True)
            opened = False
        elif kind == "L" and c.be and not c.verb:
            c = replace(c, subjects=c.noun, role=low)
        elif kind == "C":
            if stack and c.comma and (c.verb or c.subjects):
                c, opened = stack.pop(), False
            else:
                opened = bool(c.noun) and not c.verb
                c = replace(c, preposition="") if not c.verb else c
        elif kind == "A":
            joined = True
        elif kind == "R":
            c = replace(c, preposition=low)
        elif kind == "X":
            while stack and c.verb and not stack[-1].verb:
                c = stack.pop()
            c = replace(c, be=low in BE or (c.be and not c.verb))
        elif kind == "N":
            c = replace(c, negated=True)
        elif kind == "V":
            if before == "Q" or (before == "C" and at > 1 and tokens[at - 2][1] == "Q"):
                speech = True
            else:
                while stack and (c.verb or c.role == "" and c.subjects) and not joined and not (c.noun and not c.verb and not c.subjects):
                    c = stack.pop()  # a restrictive clause ends before the verb of the clause around it
                passive = c.be and not low.endswith("ing")
                if c.verb and (before == "E" or c.plain) and (late or c.plain):
                    # What looked like one more object begins a clause: "and Sam met ..."
                    if late:
                        del found.rows[-late:]
                    c = Clause(subjects=() if c.plain else c.noun, noun=c.noun, verb=FORMS[low])
                elif c.verb:
                    c = replace(c, verb=FORMS[low], preposition="", passive=passive, be=False, inherited=True, negated=c.negated and not joined)
                else:
                    c = replace(c, subjects=() if c.plain else c.noun, verb=FORMS[low], preposition="", passive=passive)
                late = 0
            joined = opened = False
        elif kind == "O" and low[0].isalpha():
            if before in ("X", "N") and c.be and not c.verb and not c.preposition:
                found.add(c.noun, "is", low, "state", c)
            elif before == "D" and (joined or not c.verb) and not c.preposition and not c.role:
                c = replace(c, plain=True, **({} if c.verb else {"noun": ()}))
        elif kind == "O" and low.isdigit():
            c = replace(c, preposition="")
        before = kind if kind not in "T" else before
    return found.rows


RELATION = "subj string, pred string, obj string, rule string, negated boolean, confidence double"


def clause_relations(sentences: DataFrame) -> DataFrame:
    """doc_id, idx and RELATION for each relation of the sentences (doc_id, idx, text). A null text has none."""

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for row in relations_of(text or ""):
                    at.append(i)
                    rows.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string()] * 4 + [pa.bool_(), pa.float64()]
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(index), batch.column("idx").take(index), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "idx", "subj", "pred", "obj", "rule", "negated", "confidence"],
            )

    key = ", ".join(f"{c} {sentences.schema[c].dataType.simpleString()}" for c in ("doc_id", "idx"))
    return sentences.select("doc_id", "idx", "text").mapInArrow(run, f"{key}, {RELATION}")
