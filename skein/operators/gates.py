"""Which names may become entities: closed classes, the gate, validity, aliases, confidence and quality. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed classes and word lists (fixed values).
PERSONAL = "i you he she it we they me him us them my mine your yours his her hers its our ours their theirs".split()
DEMONSTRATIVE = "this that these those".split()
REFLEXIVE = "myself yourself himself herself itself ourselves yourselves themselves".split()
INDEFINITE = "anyone everyone someone nobody anybody everybody somebody anything everything something nothing one ones another other others each either neither both all some any none".split() + ["no one"]
RELATIVE = "who whom whose which that".split()
INTERROGATIVE = "who whom whose which what".split()
DEICTIC = "here there now then today yesterday tomorrow".split()
PRONOUNS = sorted({*PERSONAL, *DEMONSTRATIVE, *REFLEXIVE, *INDEFINITE, *RELATIVE, *INTERROGATIVE})
WH = "who whom whose which what where when why how whoever whomever whatever whichever wherever whenever".split()
PREPOSITIONS = (
    "in on at by with from to of for about through during before after above below between among under over into onto upon within without against along around behind "
    "beneath beside besides beyond despite except inside outside toward towards underneath unlike until via near across past like off out up down since per"
).split()
DETERMINERS = "the a an this that these those my your his her its our their some any no every each all both few many much several most other another such what which".split()
MODALS = "can could may might must shall should will would ought need dare".split()
COORDINATING = "and or but nor yet so for".split()
SUBORDINATING = "because since unless until while although though if when where whereas whenever wherever whether after before as once than that lest".split()
DISCOURSE = (
    "however therefore moreover furthermore nevertheless thus hence consequently accordingly indeed certainly surely obviously clearly perhaps possibly probably likely "
    "meanwhile otherwise instead besides well now anyway actually basically honestly frankly seriously literally apparently"
).split()
INTERJECTIONS = (
    "oh ah uh um er erm hmm hm mm wow oops ouch hey hi hello bye goodbye yes no yeah yep nope nah okay ok please thanks sorry pardon huh eh "
    "alas bravo cheers damn darn geez gosh hooray hurrah phew psst shh ugh whew yikes"
).split()
ROLES = (
    "detective coach nurse doctor professor teacher principal officer soldier guard captain general manager director president chairman secretary lawyer judge politician "
    "minister bishop priest king queen prince princess lord lady man woman boy girl child person people stranger visitor traveler messenger servant friend enemy neighbor colleague partner"
).split()
COMMON = (
    "said came went moved told asked replied welcome excuse sorry thank thanks please yes no maybe okay ok sure fine first second third last next very really always never often sometimes just only "
    "better worse good bad small big large part partly back even almost definitely probably sounds seeing tell remember thought killing happier scared easier different bring says am are is was were been "
    "being have has had do does did will would should could might must can dinner tomorrow yesterday today life people children recovery medicine perhaps hidden forgive finally inside bodies whoever "
    "three fifty entire fields livestock chose oh join release long run brilliant rebuild located looking wisdoms gather take if before after during while whenever"
).split()
VALID_SHORT = "nyc usa uk eu un fbi cia nsa nasa mit ucla nyu usc uva ibm hp ge gm at&t dr mr mrs ms prof id pm am".split()
GENERIC = (
    "professor doctor captain commander leader strategist explorer warrior wizard king queen prince princess student teacher mentor friend enemy ally "
    "couple trio pair friends family group man woman boy girl person child house order council guild academy"
).split()
GARBAGE = "if mr ms dr or an at by to of in on is it be as so no we us my me he do".split()
VERBS = "said says asked told came went moved replied bought gave married lived lives visited died fought ruled made took saw was is were are had has have did does".split()

CLOSED = sorted({*PREPOSITIONS, *DETERMINERS, *MODALS, *PRONOUNS, *COORDINATING, *SUBORDINATING})


def is_pronoun(name: Column) -> Column:
    """A pronoun, unless it is written in capitals alone like an acronym."""
    n = F.trim(name)
    return ~n.rlike("^[A-Z]{2,}$") & F.lower(n).isin(PRONOUNS)


def is_context_dependent(name: Column) -> Column:
    n = F.trim(name)
    return ~n.rlike("^[A-Z]{2,}$") & F.lower(n).isin([*PRONOUNS, *DEICTIC])


def pronoun_category(name: Column) -> Column:
    n = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for kind, words in reversed((("personal", PERSONAL), ("demonstrative", DEMONSTRATIVE), ("reflexive", REFLEXIVE), ("indefinite", INDEFINITE), ("relative", RELATIVE), ("interrogative", INTERROGATIVE))):
        out = F.when(n.isin(words), kind).otherwise(out)
    return out


def is_garbage_alias(name: Column) -> Column:
    """Aliases that name nobody: too short, function words, "the" and a common noun, more than four words, a verb at the end."""
    n = F.trim(name)
    low, words = F.lower(n), F.split(n, r"\s+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    verb_end = F.size(words).between(2, 99) & low.rlike("(ing| ed|ied|ang|ung)$") & last.rlike("^[a-z]")
    return (
        F.coalesce(n, F.lit("")).isin("") | ((F.length(n) < 3) & ~F.contains(n, F.lit("."))) | low.isin(GARBAGE) | (low.startswith("the ") & (F.length(n) < 20) & n.rlike("^.{4}[a-z]"))
        | ((F.size(words) >= 2) & (F.length(first) <= 2) & first.rlike("^[a-z]+$")) | F.contains(n, F.lit("�")) | verb_end | (F.size(words) > 4)
    )


def gate(surface: Column, initial: Column, attached: Column) -> Column:
    """struct<verdict, reason> of a candidate: NON_ENTITY, CONTEXT_ONLY or DURABLE_CANDIDATE, by the first rule that fits.

    initial: it begins its sentence; attached: its word occurs only inside longer names (``tokens``). Word classes come from
    closed lists; adverbs end in -ly, a nominal head is a capitalised word or one of no closed class.
    """
    n = F.trim(F.coalesce(surface, F.lit("")))
    words = F.split(F.lower(n), r"\s+")
    first, single = F.element_at(words, 1), F.size(words) == 1
    shapes = F.split(n, r"\s+")
    nominal = F.exists(shapes, lambda w: ~F.lower(w).isin([*CLOSED, *VERBS]) & ~F.lower(w).rlike("ly$"))
    rest = F.exists(F.slice(shapes, 2, 99), lambda w: ~F.lower(w).isin([*CLOSED, *VERBS]))
    capital = F.exists(shapes, lambda w: w.rlike("^[A-Z]"))
    rules = (
        (n == "", "NON_ENTITY", "empty_span"),
        (F.length(n) < 2, "NON_ENTITY", "too_short"),
        (n.rlike(r"^\d+$"), "NON_ENTITY", "numeric_only"),
        (single & first.isin(PRONOUNS), "NON_ENTITY", "pronoun_only"),
        (single & first.isin(WH), "NON_ENTITY", "wh_word"),
        (single & first.isin(DISCOURSE), "NON_ENTITY", "discourse_marker"),
        (single & first.isin(INTERJECTIONS), "NON_ENTITY", "interjection"),
        (F.forall(words, lambda w: w.isin(VERBS)) & ~single, "NON_ENTITY", "verb_phrase"),
        (first.isin(VERBS) & ~rest, "NON_ENTITY", "verb_lead"),
        (first.isin(MODALS), "NON_ENTITY", "modal_lead"),
        (first.rlike("ly$") & ~nominal, "NON_ENTITY", "adverb_lead"),
        (first.isin(COORDINATING), "NON_ENTITY", "conjunction_lead"),
        (first.isin(SUBORDINATING), "NON_ENTITY", "subordinator_lead"),
        (first.isin(PREPOSITIONS), "NON_ENTITY", "pp_lead_no_object"),
        (single & first.isin(DETERMINERS), "NON_ENTITY", "determiner_only"),
        (F.forall(words, lambda w: w.isin(CLOSED)), "NON_ENTITY", "closed_class_only"),
        (attached, "NON_ENTITY", "compound_fragment"),
        (~nominal & ~capital, "NON_ENTITY", "incomplete_constituent"),
        (~capital, "NON_ENTITY", "lowercase_non_noun"),
        (single & first.isin(ROLES) & (initial | (n == F.lower(n))), "CONTEXT_ONLY", "role_without_identity"),
        (single & initial, "CONTEXT_ONLY", "single_token_sentence_initial_unverified"),
        (n.rlike("^[A-Z ]{8,}$"), "CONTEXT_ONLY", "theme_slogan"),
    )
    out = F.struct(F.lit("DURABLE_CANDIDATE").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    for when, verdict, reason in reversed(rules):
        out = F.when(when, F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def tokens(docs: DataFrame) -> DataFrame:
    """token, total, lowercase, capitalized, standalone (capitalised, beside no capitalised word) and attached_only."""
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z]+)"), F.lit(1))
    big = lambda w: F.coalesce(w.rlike("^[A-Z]"), F.lit(False))
    near = F.transform("w", lambda w, i: F.struct(w.alias("w"), (big(w) & ~F.when(i > 0, big(F.get("w", i - 1))).otherwise(F.lit(False)) & ~big(F.get("w", i + 1))).alias("alone")))
    rows = docs.select(words.alias("w")).select(F.explode(near).alias("x")).select("x.*")
    seen = rows.groupBy(F.lower("w").alias("token")).agg(
        F.count("*").alias("total"), F.count_if(~big(F.col("w"))).alias("lowercase"), F.count_if(big(F.col("w"))).alias("capitalized"), F.count_if(F.col("alone")).alias("standalone")
    )
    return seen.withColumn("attached_only", (F.col("capitalized") > 0) & (F.col("standalone") == 0) & (F.col("lowercase") == 0))


def invalid_reason(name: Column, kind: Column) -> Column:
    """Why a name of a type is no entity, or null: pronouns, common_words, bad_pattern, too_short, no_letter, section."""
    low = F.lower(F.trim(name))
    bad = (
        name.rlike("(?i)^(and|or|but|the|a|an|when|where|seeing|meeting|before|after|if|take|gather|located)\\s+") | name.rlike("(?i)\\s+(said|asked|replied|moved|came|went|told)$")
        | name.rlike("(?i)\\s+(there|here)$") | ((kind != "DATE") & name.rlike("(?i)^[^a-z]+$")) | name.rlike("(?i)^[a-z]$") | name.rlike("(?i)chapter|section|part\\s+\\d+|epilogue|prologue")
        | name.rlike("^[A-Z\\s]{4,}$") | name.rlike("(?i)^(you|i|they|we)\\s+(dared|use|my|your|their|our)")
    )
    return (
        F.when(F.coalesce(low, F.lit("")) == "", "empty").when(low.isin([*PRONOUNS, *REFLEXIVE]), "pronouns").when(low.isin(COMMON), "common_words").when(bad, "bad_pattern")
        .when((F.length(low) < 2) | ((F.length(low) == 2) & ~low.isin(VALID_SHORT) & (kind != "PERSON")), "too_short").when((kind != "DATE") & ~name.rlike("(?i)[a-z]"), "no_letter")
        .when((kind == "PERSON") & name.rlike("(?i)^(chapter|section|part|volume|book)\\s+\\d+"), "section")
    )


def valid(entities: DataFrame) -> DataFrame:
    return entities.where(invalid_reason(F.col("canonical"), F.col("type")).isNull())


def filter_stats(entities: DataFrame) -> DataFrame:
    """reason, n: how many entities each reason removes; kept for the rest."""
    return entities.groupBy(F.coalesce(invalid_reason(F.col("canonical"), F.col("type")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def quality(name: Column, kind: Column, mentions: Column) -> Column:
    """1, less for common words and pronouns and long names, more for mentions, capitals and two to four words; from 0 to 1."""
    low, words = F.lower(F.trim(name)), F.size(F.split(F.lower(F.trim(name)), r"\s+"))
    capital = F.substring(name, 1, 1) == F.upper(F.substring(name, 1, 1))
    score = F.lit(1.0) - F.when(low.isin(COMMON), 0.8).otherwise(0.0) - F.when(low.isin(PRONOUNS), 0.9).otherwise(0.0)
    score = score + F.when(mentions > 1, F.least(mentions - 1, F.lit(5)) * 0.1).otherwise(0.0) + F.when(capital & (kind == "PERSON"), 0.1).otherwise(0.0)
    score = score + F.when(words.between(2, 4), 0.1).otherwise(0.0) - F.when(words > 5, 0.2).otherwise(0.0) - F.when((kind == "PERSON") & (words == 1) & ~capital, 0.3).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def confidence(name: Column, mentions: Column, source: Column, kind: Column, weights: dict[str, float]) -> Column:
    """The best source's weight times a bonus for mentions (0.05 each, 1.5 at most), 0.3 for a generic single word, and up to 1.5
    for names of several words that only a fallback found; from 0 to 1."""
    words = F.size(F.split(F.trim(name), r"\s+"))
    base = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[source]
    bonus = F.least(F.lit(1.5), F.lit(1.0) + mentions * 0.05)
    generic = F.when((words == 1) & F.lower(name).isin(GENERIC), 0.3).otherwise(1.0)
    boost = F.when(words >= 3, 1.4).when(words == 2, 1.3).otherwise(1.0) + F.when(mentions >= 2, 0.1).otherwise(0.0) + F.when(kind.isin("ORG", "HOUSE", "PLACE"), 0.05).otherwise(0.0)
    score = base * bonus * generic * F.when(source == "FALLBACK", F.least(boost, F.lit(1.5))).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def global_drop(name: Column, kind: Column, of_org: Column) -> Column:
    """Names that the merged graph drops: without a capital, or a one-word person that is a word of an organisation."""
    return (name == F.lower(name)) | ((kind == "PERSON") & ~F.contains(name, F.lit(" ")) & of_org)


def filter_global(entities: DataFrame) -> DataFrame:
    """entities (id, type, canonical) without those: one-word people are looked up among the words of organisations."""
    words = entities.where("type = 'ORG'").select(F.explode(F.split("canonical", " ")).alias("canonical")).distinct().withColumn("of_org", F.lit(True))
    rows = entities.join(words, "canonical", "left")
    return rows.where(~global_drop(F.col("canonical"), F.col("type"), F.coalesce("of_org", F.lit(False)))).select(entities.columns)


def stage_filter(entities: DataFrame, least: float = 0.7, letters: int = 3) -> DataFrame:
    """Entities with ``removed``, why the filter stage takes them out: low_confidence, too_short, not_capitalized; else null."""
    name = F.col("canonical")
    return entities.withColumn("removed", F.when(F.col("confidence") < least, "low_confidence").when(F.length(name) < letters, "too_short").when(~name.rlike("^[A-Z]"), "not_capitalized"))


def confidence_stats(scored: DataFrame, least: float = 0.5) -> DataFrame:
    return scored.agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= least).alias("kept"), F.round(F.avg("confidence"), 6).alias("average"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"))


def uncertainty(confidence_: Column, mentions: Column, name: Column) -> Column:
    """0.4 below a confidence of 0.5 (0.2 below 0.7), 0.3 for a single mention, 0.2 for a single word; 1 at most."""
    score = F.when(confidence_ < 0.5, 0.4).when(confidence_ < 0.7, 0.2).otherwise(0.0) + F.when(mentions <= 1, 0.3).otherwise(0.0) + F.when(~F.contains(name, F.lit(" ")), 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score), 6)


def by_uncertainty(scored: DataFrame, limit: int = 10, least: float = 0.3) -> DataFrame:
    """The ``limit`` most uncertain rows (uncertainty, name), from ``least`` on: what a reviewer is asked first."""
    return scored.where(F.col("uncertainty") >= least).orderBy(F.desc("uncertainty"), "name").limit(limit)


def promotion(score: Column) -> Column:
    """Level of accumulated evidence: from 0.4 tentative, from 0.7 likely, from 0.9 confirmed; else rejected."""
    return F.when(score >= 0.9, "confirmed").when(score >= 0.7, "likely").when(score >= 0.4, "tentative").otherwise("rejected")


def accumulated(evidence: DataFrame) -> DataFrame:
    """name, n, score, level of evidence (name, weight): 1 - product of (1 - weight), so that more evidence never overshoots."""
    doubt = F.sum(F.log(F.greatest(1 - F.col("weight"), F.lit(1e-12))))
    rows = evidence.groupBy("name").agg(F.count("*").alias("n"), F.round(1 - F.exp(doubt), 6).alias("score"))
    return rows.withColumn("level", promotion(F.col("score")))
