"""Forms of names: cleaning, suffixes, schools, kinds, and accents. Column expressions; nothing leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes, cues and kinds of schools (fixed values).
SUFFIXES = ("Jr", "Jr.", "Sr", "Sr.", "II", "III", "IV", "V")
ORG_CUES = ("inc", "llc", "ltd", "corp", "co.", "company", "university", "college", "ministry", "church", "department", "committee", "foundation", "studio", "records")
PLACE_CUES = ("street", "st.", "ave", "avenue", "road", "rd.", "boulevard", "blvd", "lane", "ln.", "parish", "county", "city", "state", "province", "park", "river", "lake")
SCHOOLS = ("junior high school", "high school", "junior high", "jr high", "jr", "school", "academy", "university", "college", "institute")


def _accents() -> tuple[str, str]:
    """Letters of Latin script with an accent and the letter below it, by the Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    return F.translate(text, *_accents())


def alias_form(name: Column) -> Column:
    """Lower case, no accents, white space collapsed, no other than word characters at the ends."""
    return F.regexp_replace(F.regexp_replace(without_accents(F.lower(F.trim(name))), r"\s+", " "), r"^\W+|\W+$", "")


def normalized(text: Column) -> Column:
    """Straight quotation marks, a dash as two hyphens, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(text, "[‘’‛]", "'"), "[“”]", '"')
    return F.trim(F.regexp_replace(F.regexp_replace(t, "—", "--"), r"\s+", " "))


def preprocessed(text: Column) -> Column:
    """``normalized``, with initials drawn together, no comma before a suffix, and hyphens without blanks inside names."""
    t = F.regexp_replace(normalized(text), r"\b([A-Z])\.\s(?=[A-Z]\.)", "$1.")
    t = F.regexp_replace(t, r",\s+(Jr\.|Sr\.|II|III|IV|V)", " $1")
    return F.regexp_replace(t, r"\b([A-Z][a-z]+)\s*-\s*([A-Z][a-z]+)\b", "$1-$2")


def guessed_type(surface: Column) -> Column:
    """ORG and LOC by a cue word, PERSON by the look of a name, else UNKNOWN."""
    s = F.trim(surface)
    low = F.lower(s)

    def cued(cues) -> Column:
        words = "|".join(c.replace(".", r"\.") for c in cues)
        return low.rlike(f" ({words})( |$)")

    words = F.split(s, " ")
    title = (F.size(words) <= 5) & F.forall(words, lambda w: w.rlike(r"^[A-Z][a-z'\-]*(-[A-Z][a-z'\-]*)*$") | w.rlike(r"^[A-Z]\.$") | w.rlike(r"^(Jr\.|Sr\.)$"))
    person = title & (s.rlike(r"(Jr\.|Sr\.|II|III|IV|V)$") | (F.contains(s, F.lit("-")) & (F.size(words) >= 2)) | F.size(words).between(2, 3))
    return F.when(cued(ORG_CUES), "ORG").when(cued(PLACE_CUES), "LOC").when(person, "PERSON").when(s.rlike(r"\b[A-Z]{2,}\b(\s+\b[A-Z]{2,}\b)+"), "ORG").otherwise("UNKNOWN")


def entity_name(name: Column) -> Column:
    """White space collapsed; marks at the ends, a possessive, an article before and "family" or "house" after cut off."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    n = F.regexp_replace(F.regexp_replace(n, "^[\"'`]+|[\"'`]+$", ""), "^[-–—]+|[-–—]+$", "")
    n = F.regexp_replace(F.regexp_replace(n, "[,;:!?]+$", ""), "(?i)'s$", "")
    n = F.regexp_replace(n, r"\.([A-Z])", ". $1")
    last = F.substring_index(n, " ", -1)
    n = F.when(~last.isin(*SUFFIXES) & last.rlike(r"^..+\.$"), F.regexp_replace(n, r"\.$", "")).otherwise(n)
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"(?i)^(the|a|an)\s+", ""), r"(?i)\s+(family|house)$", ""))


def suffix_parts(name: Column) -> Column:
    """struct<base, suffix>: the generational suffix of a name of two words or more."""
    last = F.substring_index(name, " ", -1)
    has = F.contains(name, F.lit(" ")) & last.isin(*SUFFIXES)
    return F.struct(F.when(has, F.regexp_replace(name, r"\s+\S+$", "")).otherwise(name).alias("base"), F.when(has, last).alias("suffix"))


def school_parts(name: Column) -> Column:
    """struct<root, suffix> of a school's name, lower case: the longest kind of school that it ends with."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[.,]", ""), r"\s+", " ")
    kind = F.lit(None).cast("string")
    for s in sorted(SCHOOLS, key=lambda s: (len(s.split()), s)):
        kind = F.when((n == s) | n.endswith(" " + s), s).otherwise(kind)
    root = F.when(kind.isNull(), n).otherwise(F.trim(F.substring(n, F.lit(1), F.length(n) - F.length(kind))))
    return F.struct(root.alias("root"), F.coalesce(kind, F.lit("")).alias("suffix"))


def junior_type(name: Column, near_school: Column, known_place: Column) -> Column:
    """"X Jr": a school where X is a place and school words are near, a person where three capitalised words are not."""
    junior = name.rlike(r"(?i)\s(jr\.?|junior)$")
    person = name.rlike(r"^[A-Z]\S*\s+[A-Z]\S*(\s+[A-Z]\S*)*\s+\S+$")
    return F.when(junior & known_place & near_school, "ORG").when(junior & person & ~near_school, "PERSON").otherwise("UNKNOWN")


def ir_type(kind: Column) -> Column:
    """The kinds of the compiled graph for the kinds of extraction; CONCEPT for any other."""
    same = ("PERSON", "ORG", "PLACE", "ITEM", "EVENT", "CREATURE", "WORK")
    groups = {"ITEM": ("OBJECT", "ARTIFACT", "TECHNOLOGY", "DRUG"), "GROUP": ("HOUSE", "TRIBE", "RACE"), "TIME_PERIOD": ("DATE", "TIME"), "PERSON": ("DEITY",), "WORK": ("SPELL",), "CREATURE": ("SPECIES",)}
    out = F.when(kind.isin(*same), kind)
    for to, kinds in groups.items():
        out = out.when(kind.isin(*kinds), to)
    return out.otherwise("CONCEPT")


def api_type(kind: Column) -> Column:
    """Upper case and trimmed; synonyms of PLACE and ORG as those; MISC for none."""
    k = F.upper(F.trim(kind))
    return F.when(k.isin("LOCATION", "LOC", "GPE"), "PLACE").when(k.isin("ORGANIZATION", "ORGANISATION"), "ORG").when(F.coalesce(k, F.lit("")) == "", "MISC").otherwise(k)
