"""Documents -> mentions -> entities: extraction, grouping, salience, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, ord, surface: the capitalised names of a text in order, without blocked words."""
    rows = docs.select("doc_id", F.posexplode(T.names(F.col("text"))).alias("ord", "surface"))
    return rows.where(~T.is_blocked(F.col("surface")))


def mention_spans(docs: DataFrame, pattern: str = T.NAME, keep: tuple[str, ...] = (), gaps: bool = False) -> DataFrame:
    """doc_id, ord, surface, start, end in code points of the matches of a pattern (one group, the whole match), and the
    columns of ``keep``; with ``gaps`` also the text between a match and the one before it (gap). The gaps between matches give the offsets: a running sum over the pieces of each row of docs."""
    pieces = docs.select("doc_id", *keep, F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("m"), F.split("text", pattern).alias("gap"))
    rows = pieces.select("doc_id", *keep, "_row", F.posexplode(F.transform(F.arrays_zip("gap", "m"), lambda x: F.struct(x["m"].alias("surface"), F.length(x["gap"]).alias("g"), *([x["gap"].alias("gap")] if gaps else [])))).alias("ord", "s"))
    between = ["s.gap"] if gaps else []
    rows = rows.where("s.surface is not null").select("doc_id", *keep, "_row", "ord", *between, "s.surface", (F.col("s.g") + F.length("s.surface")).alias("n"))
    end = F.sum("n").over(Window.partitionBy("_row").orderBy("ord")).cast("int")
    return rows.withColumn("end", end).select("doc_id", *keep, "ord", *(["gap"] if gaps else []), "surface", (F.col("end") - F.length("surface")).alias("start"), "end")


def registry(found: DataFrame) -> DataFrame:
    """One entity for each normal form: longest surface (ties: smallest), number of aliases, first place, counts. One
    aggregation, so the texts are read and searched once."""
    keyed = found.withColumn("key", T.surface_key(F.col("surface"))).where(F.length("key") >= 2)
    # Struct minima instead of a window: the aggregation is partial on the map side.
    grouped = keyed.groupBy("key").agg(
        F.min(F.struct((-F.length("surface")).alias("l"), F.col("surface"))).getField("surface").alias("canonical"),
        F.countDistinct("surface").alias("n_aliases"), F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"), F.min(F.struct("doc_id", "ord")).alias("first"),
    )
    return grouped.select("key", "canonical", "n_aliases", "n_mentions", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.ord").alias("first_ord"))


def top_entities(docs: DataFrame, n: int = 20) -> DataFrame:
    """The minimum slice end to end: documents, names, blocked words out, grouped, most mentioned first."""
    return registry(mentions(docs)).select("key", "canonical", "n_mentions", "n_docs").orderBy(F.desc("n_mentions"), "key").limit(n)


def salience(docs: DataFrame) -> DataFrame:
    """Per document and name: ln(n+1)*10 + (1 - first/len)*20 + 10, 7 or 3 for the name + 2 for each tenth of the text with a
    mention (none below two mentions), and the percentile among the names of the document."""
    spans = mention_spans(docs.withColumn("len", F.length("text")), keep=("len",))
    rows = spans.withColumn("key", T.surface_key(F.col("surface"))).where(F.length("key") >= 2)
    each = rows.groupBy("doc_id", "key").agg(
        F.count("*").alias("n"), F.min("start").alias("first"), F.max("len").alias("len"),
        F.countDistinct(F.floor(F.col("start") * 10 / F.col("len"))).alias("tenths"),
    )
    name = F.when(F.instr("key", " ") > 0, 10.0).when(F.length("key") > 8, 7.0).otherwise(3.0)
    total = F.log(F.col("n") + 1) * 10 + (1 - F.col("first") / F.col("len")) * 20 + name + F.when(F.col("n") >= 2, F.col("tenths") * 2).otherwise(0)
    scored = each.select("doc_id", "key", "n", F.round(total, 6).alias("total"))
    w = Window.partitionBy("doc_id")
    rank = F.row_number().over(w.orderBy("total", "key")) - 1
    size = F.count("*").over(w)
    return scored.select("doc_id", "key", "n", "total", F.when(size > 1, F.round(100.0 * rank / (size - 1))).otherwise(0.0).cast("int").alias("percentile"))


def resolve_pronouns(docs: DataFrame, pattern: str = r"(\bhe\b)", reach: int = 500) -> DataFrame:
    """doc_id, start, antecedent: each match of the pattern with the last name that begins before it, not more than
    ``reach`` characters away; null where there is none."""
    from .spans import asof_previous

    names = mention_spans(docs).where(~T.is_blocked(F.col("surface"))).select("doc_id", "start", F.struct("start", "surface").alias("name"))
    pronouns = mention_spans(docs, pattern).select("doc_id", "start")
    found = asof_previous(pronouns, names, ["doc_id"], "start", "name")
    near = F.when(F.col("start") - F.col("previous_name.start") <= reach, F.col("previous_name.surface"))
    return found.select("doc_id", "start", near.alias("antecedent"))


def cooccurrence(found: DataFrame, min_count: int = 2) -> DataFrame:
    """Pairs of names that share at least ``min_count`` documents. Only names of fewer documents are left out before pairing:
    no pair of theirs can reach the count. The names of a document are one sorted array and pairs come from it row by row,
    so nothing is dealt by name, and the count aggregates before its shuffle."""
    keys = found.select("doc_id", T.surface_key(F.col("surface")).alias("key")).where(F.length("key") >= 2).distinct()
    enough = keys.groupBy("key").agg(F.count("*").alias("df")).where(F.col("df") >= min_count).select("key")
    sets = keys.join(enough, "key", "left_semi").where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    firsts = sets.select("keys", F.posexplode("keys").alias("at", "a"))
    pairs = firsts.select("a", F.explode(F.expr("slice(keys, at + 2, size(keys))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_count)


def token_stats(docs: DataFrame) -> DataFrame:
    """For each word, case aside: how often in all, in lower case, capitalised."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z]+)"), F.lit(1))).alias("w"))
    capital = F.col("w").rlike("^[A-Z]")
    return words.groupBy(F.lower("w").alias("token")).agg(
        F.count("*").alias("total"), F.sum((~capital).cast("long")).alias("lowercase"), F.sum(capital.cast("long")).alias("capitalized")
    )


def gate(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """Verdict and reason for each name: blocked, short, known in lower case, or durable; and how many of each."""
    keyed = found.select(T.surface_key(F.col("surface")).alias("token"), "surface")
    low = tokens.where("lowercase > 0").select("token", F.lit(True).alias("echo"))
    rows = keyed.join(low, "token", "left")
    reason = (
        F.when(F.length("token") < 2, "too_short").when(F.length("token") > 40, "too_long").when(F.col("echo") & (F.instr("token", " ") == 0), "lowercase_echo")
    )
    verdict = F.when(reason.isin("too_short", "too_long"), "NON_ENTITY").when(reason.isNotNull(), "CONTEXT_ONLY").otherwise("DURABLE_CANDIDATE")
    return rows.groupBy(verdict.alias("verdict"), F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, idx, start, text of the lines that are not blank; starts follow from the lengths of the lines before."""
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text")
    lines = numbered.select("doc_id", "_row", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("_row").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return lines.select("doc_id", "idx", F.coalesce(before, F.lit(0)).cast("int").alias("start"), "text").where(F.trim("text") != "")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, idx, text: pieces that end with . ! or ? and white space, or with the line."""
    pieces = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"([^.!?\n]+[.!?]*)"), F.lit(1)), lambda s: F.trim(s)), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(pieces).alias("idx", "text"))


def segments(paragraph_rows: DataFrame, least: int = 450, most: int = 600) -> DataFrame:
    """Greedy segments of ``least`` to ``most`` words: a segment is closed when it has enough, or when the next paragraph
    would make it too long. Order-dependent, so a fold over the word counts of a document's paragraphs: it keeps the open
    segment and appends only closed ones, which are at least ``least`` words or as long as one paragraph."""
    counts = paragraph_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.size(F.split(F.trim("text"), r"\s+")).alias("n")))).alias("p"))
    closed = "array<struct<n_paragraphs:bigint,n_words:bigint>>"
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("words"), F.array().cast(closed).alias("out"))
    done = lambda acc: F.struct(acc["n"].alias("n_paragraphs"), acc["words"].alias("n_words"))

    def step(acc, x):
        close = (acc["words"] >= least) | ((acc["words"] > 0) & (acc["words"] + x["n"] > most))
        return F.struct(
            (F.when(close, zero).otherwise(acc["n"]) + 1).alias("n"), (F.when(close, zero).otherwise(acc["words"]) + x["n"]).alias("words"), F.when(close, F.concat(acc["out"], F.array(done(acc)))).otherwise(acc["out"]).alias("out")
        )

    folded = counts.select("doc_id", F.aggregate("p", start, step).alias("f")).select("doc_id", F.concat("f.out", F.array(done(F.col("f")))).alias("out"))
    return folded.select("doc_id", F.posexplode("out").alias("seg", "s")).select("doc_id", "seg", "s.n_paragraphs", "s.n_words")
