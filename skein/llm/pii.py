"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, scheme marks, plus signs, digits and cue
words. At each anchor a deterministic local parser expands to both sides and validates what it finds. A text is never
searched by a pattern as a whole, and nothing is shuffled.

Kinds: email, ip, card and phone as the base patterns define them; and url (scheme://...), iban (after its cue, checked
modulo 97), account (digits and letters after a cue such as "account no.") and secret (a value after "token =", "api key:").
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")
#: Cue words and the kind of value that may follow them (fixed values).
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "passport": "account",
    "ssn": "account",
    "token": "secret",
    "secret": "secret",
    "password": "secret",
    "api key": "secret",
    "api_key": "secret",
    "apikey": "secret",
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
# Local parsers, matched at one place only.
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_quad = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
_digits = re.compile(r"[0-9]+").match
_digit_run = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_rest_of_url = re.compile(r"[^\s<>\"'`]+").match
# ASCII alone: without re.A, capitals aside, A-Z would also match the Kelvin sign and the dotted capital I.
# Blanks are stepped over for good (*+), so that a long run of them is passed once by each part and not tried at every length.
_value = re.compile(r"(?:[ \t]*+(?:no\.?|number|nr\.?|id|#))?[ \t]*+(?:[:=]|is\b)?[ \t]*+[\"']?([A-Za-z0-9][A-Za-z0-9_/+.-]*[A-Za-z0-9])", re.I | re.A).match
_iban = re.compile(r"[ \t]*+[:=]?[ \t]*+([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})", re.I | re.A).match


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *"0123456789"):
        found.add_word(mark, (mark, len(mark)))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
            found.add_word(form, (cue, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as KINDS has them, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    after = dict.fromkeys((*KINDS, "digits"), 0)  # where each kind's last match ends, kept or dropped
    for end, (mark, n) in automaton().iter(text):
        at = end - n + 1
        if mark == "@":
            if m := _domain(text, at + 1):
                first, least = at, after["email"]
                while first > least and text[first - 1] in _LOCAL:
                    first -= 1
                if first < at:
                    found["email"].append((first, m.end()))
                    after["email"] = m.end()
        elif mark in "0123456789":
            if at >= after["digits"]:  # a run of digits begins here
                after["digits"] = _digits(text, at).end()
                if at >= after["ip"] and (m := _quad(text, at)):
                    after["ip"] = m.end()
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split(".")):
                        found["ip"].append(m.span())
                if at >= after["card"] and (m := _digit_run(text, at)):
                    after["card"] = m.end()
                    plain = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(plain) <= 19 and luhn(plain):
                        found["card"].append(m.span())
        elif mark == "+":
            if at >= after["phone"] and (m := _phone(text, at)):
                after["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif mark == "://":
            first = at
            while first > after["url"] and text[first - 1] in _SCHEME:
                first -= 1
            while first < at and not text[first].isalpha():
                first += 1
            if first < at and (m := _rest_of_url(text, at + 3)):
                last = m.end()
                while text[last - 1] in ".,;:!?)]}":
                    last -= 1
                if last > at + 3:
                    found["url"].append((first, last))
                    after["url"] = last
        elif (at == 0 or not text[at - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            kind = CUES[mark]
            m = (_iban if kind == "iban" else _value)(text, end + 1)
            if m and m.start(1) >= after[kind] and m.start(1) > end + 1:
                value, last = m.group(1), m.end(1)
                if kind == "iban":  # letters that follow may look like more of it: the longest valid one counts
                    ends = [e for e in range(len(value), 14, -1) if value[e - 1] != " " and _iban_ok(value[:e])]
                    good, last = bool(ends), m.start(1) + (ends or [0])[0]
                else:
                    good = len(value) >= 8 and sum("0" <= c <= "9" for c in value) >= (5 if kind == "account" else 2)
                if good:
                    found[kind].append((m.start(1), last))
                    after[kind] = last
    return [(kind, *s) for kind in KINDS for s in sorted(found[kind])]


def _listed(some: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in some)


def redact(text: str) -> str:
    """Every span becomes its kind in brackets, spans that overlap become one; again until nothing is found."""
    while some := sorted((a, b, k) for k, a, b in spans(text)):
        out, at = [], 0
        joined: list[list] = []
        for a, b, k in some:
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b, k])
        for a, b, k in joined:
            out += [text[at:a], f"[{k.upper()}]"]
            at = b
        text = "".join([*out, text[at:]])
    return text


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for each row of docs (doc_id, text).

    A null text counts as empty. Whole texts are searched, in time that grows with their length. Repeated rows are judged
    one by one; an empty table gives an empty result. Only doc_id and text are read, so other columns cannot clash. Offsets
    count code points, the end is exclusive.
    """

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column("text"):
                some = spans(text.as_py() or "")
                base = [s for s in some if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(some)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with the spans of text masked. A null text stays null, an empty one empty. n_chars, where
    there is one of a number type, follows the new text.

    Whole texts are masked, very long ones alone, in time that grows with their length. Repeated rows are masked one by one;
    an empty table gives an empty result. Columns of any other name pass through untouched.
    """

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            new = [t if t is None else redact(t) for t in batch.column("text").to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast(kind)))
    return out
