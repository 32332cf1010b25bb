"""Scalar text functions as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A name: capitalised words in a row.
NAME = r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"
#: Words that begin sentences and are no names on their own (fixed values).
BLOCKED = (
    "a an and are as at be but by da das de del der des die du ein eine el elle en es est et for from he her his in is it la las le les los mit of on or que se she so than that the their then there they this to un una une und was we were with y you zu"
).split()
#: Cue words of the modalities, in order of priority (fixed values).
MODALITY_CUES = {
    "BELIEF": ("believed", "thought", "suspected", "assumed", "felt"),
    "NEGATED": ("not", "never", "no"),
    "RUMOR": ("rumor", "rumored", "reportedly", "allegedly"),
    "PLAN": ("planned", "intended", "decided", "promised", "will"),
}
#: Honorifics that a name may begin with (fixed values).
TITLES = (
    "mr mrs ms miss dr doctor prof professor sir madam madame lord lady king queen prince princess captain commander general colonel major sergeant lieutenant "
    "father mother brother sister coach detective officer nurse principal judge justice senator governor mayor president headmaster headmistress master mistress"
).split()


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks and tabs become one space; none is left at the end of a line."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), " (\n|$)", "$1")


def normalize_evidence(text: Column, longest: int = 200) -> Column:
    """Control characters out, white space collapsed, cut to ``longest`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"[ \t\r\n]+", " "))
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest - 3), F.lit("..."))).otherwise(t)


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def strip_title(name: Column) -> Column:
    return F.regexp_replace(name, f"^(?i:{'|'.join(TITLES)})\\.? +", "")


def surface_key(name: Column) -> Column:
    """The form under which mentions are grouped: lower case, inner white space collapsed, no non-word ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "), r"^\W+|\W+$", "")


def cluster_keys(name: Column) -> Column:
    """Blocking keys: the whole form, the form without a title, and the last word of several."""
    full, bare = surface_key(name), surface_key(strip_title(name))
    last = F.when(F.instr(bare, " ") > 0, F.concat(F.lit("lastname:"), F.substring_index(bare, " ", -1)))
    return F.array_distinct(F.array_compact(F.array(full, bare, last)))


def names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME), F.lit(1))


def is_blocked(name: Column) -> Column:
    return F.lower(name).isin(BLOCKED)


def modality(text: Column, is_speech: Column) -> Column:
    """CLAIM for speech, else the first modality of which a cue occurs as a word, else FACT."""
    out = F.when(is_speech, "CLAIM")
    for name, cues in MODALITY_CUES.items():
        out = out.when(F.lower(text).rlike(rf"(^|[^a-z])({'|'.join(cues)})([^a-z]|$)"), name)
    return out.otherwise("FACT")


def relation_id(subj: Column, pred: Column, obj: Column) -> Column:
    return F.sha1(F.concat_ws("|", subj, pred, obj))


def document_id(uri: Column, content_hash: Column, version: int = 1) -> Column:
    """The first eight bytes of sha256(uri::hash::version) as a little-endian unsigned number: decimal(20,0)."""
    hexed = F.sha2(F.concat_ws("::", uri, content_hash, F.lit(str(version))), 256)
    little = F.concat(*[F.substring(hexed, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(little, 16, 10).cast("decimal(20,0)")


def snippet(text: Column, query: Column, before: int = 30, after: int = 50, longest: int = 100) -> Column:
    """A window around the first hit of the query, with ellipses where it is cut; the beginning where there is no hit."""
    at = F.position(F.lower(query), F.lower(text))
    first = F.greatest(at - before, F.lit(1))
    last = F.least(at + F.length(query) - 1 + after, F.length(text))
    window = F.concat(F.when(first > 1, "...").otherwise(""), F.substring(text, first, last - first + 1), F.when(last < F.length(text), "...").otherwise(""))
    head = F.concat(F.substring(text, 1, longest), F.when(F.length(text) > longest, "...").otherwise(""))
    return F.when(at > 0, window).otherwise(head)


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(text, F.lit(""))


def escape_cypher(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.coalesce(text, F.lit(""))
