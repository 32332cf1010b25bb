"""Quotations, who says them, and the assertions that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Verbs of speech (fixed values).
SPEECH = "said|says|asked|replied|answered|whispered|shouted|cried|told|muttered|called|exclaimed"
#: A quotation in straight or curved marks.
QUOTE = "(\"[^\"]*\"|“[^”]*”)"
REACH = 100


def quotes(docs: DataFrame) -> DataFrame:
    """doc_id, ord, start, end, text, before, after: each quotation without its marks, its place with them, and up to REACH
    characters of the text between it and its neighbours on both sides."""
    pieces = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1)).alias("m"), F.split("text", QUOTE).alias("g"))
    near = F.transform("m", lambda m, i: F.struct(m.alias("q"), F.length(F.get("g", i)).alias("gap"), F.substring(F.get("g", i), -REACH, REACH).alias("before"), F.substring(F.coalesce(F.get("g", i + 1), F.lit("")), 1, REACH).alias("after")))
    rows = pieces.select("doc_id", "row", F.posexplode(near).alias("ord", "x")).select("doc_id", "row", "ord", "x.*")
    end = F.sum(F.col("gap") + F.length("q")).over(Window.partitionBy("row").orderBy("ord"))
    return rows.withColumn("end", end.cast("int")).select("doc_id", "row", "ord", (F.col("end") - F.length("q")).alias("start"), "end", F.expr("substring(q, 2, length(q) - 2)").alias("text"), "before", "after").where("text <> ''")


def attributed(found: DataFrame) -> DataFrame:
    """The quotations with speaker, method and confidence.

    A verb of speech beside a name within REACH (0.9); else, beside a pronoun, the last speaker before (0.6); else turn-taking:
    where the four quotations before have just two speakers, the one who did not speak last (0.5); else null.
    """
    name = T.NAME
    after = F.coalesce(_group("after", rf"^[,.!?]?\s*(?:{SPEECH})\s+{name}"), _group("after", rf"^[,.!?]?\s*{name}\s+(?:{SPEECH})\b"))
    before = _group("before", rf"{name}\s+(?:{SPEECH})[,:]?\s*$")
    explicit = F.coalesce(after, before)
    pronoun = F.col("after").rlike(rf"^[,.!?]?\s*((?:{SPEECH})\s+(?:he|she|they)|(?:he|she|they)\s+(?:{SPEECH}))\b")
    w = Window.partitionBy("row").orderBy("ord")
    rows = found.withColumn("explicit", explicit).withColumn("last", F.last("explicit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    recent = F.array_distinct(F.collect_list("explicit").over(w.rowsBetween(-4, -1)))
    other = F.when((F.size(recent) == 2) & F.col("last").isNotNull(), F.element_at(F.array_remove(recent, F.col("last")), 1))
    rows = rows.withColumn("turn", other)
    said_by_pronoun = pronoun & F.col("last").isNotNull()
    speaker = F.coalesce("explicit", F.when(said_by_pronoun, F.col("last")), F.col("turn"))
    method = F.when(F.col("explicit").isNotNull(), "explicit").when(said_by_pronoun, "pronoun").when(F.col("turn").isNotNull(), "turn").otherwise("none")
    sure = F.when(method == "explicit", 0.9).when(method == "pronoun", 0.6).when(method == "turn", 0.5).otherwise(0.3)
    return rows.select("doc_id", "ord", "start", "end", "text", speaker.alias("speaker"), method.alias("method"), sure.alias("confidence"))


def _group(column: str, pattern: str) -> Column:
    found = F.regexp_extract(column, pattern, 1)
    return F.when(found != "", found)


def tells(said: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, ord, subj, pred, obj, modality, confidence: a TELL for each quotation with a speaker that is sure enough."""
    sure = said.where(F.col("speaker").isNotNull() & (F.col("confidence") >= least))
    return sure.select("doc_id", "ord", F.col("speaker").alias("subj"), F.lit("tell").alias("pred"), F.col("text").alias("obj"), F.lit("CLAIM").alias("modality"), "confidence")


def of_nodes(said: DataFrame, nodes: DataFrame) -> DataFrame:
    """Quotations whose speaker is among nodes (id), and those without one."""
    return said.where("speaker is null").unionByName(said.join(nodes.select(F.col("id").alias("speaker")), "speaker", "left_semi").select(said.columns))


def merged_tells(by_verb: DataFrame, by_quote: DataFrame) -> DataFrame:
    """TELLs from verbs and from quotations; a verb's gives way to a quotation's of the same document, sentence and speaker,
    which then has the higher of the two confidences."""
    keys = ["doc_id", "sent", "subj"]
    rows = by_quote.withColumn("kind", F.lit("quote")).unionByName(by_verb.withColumn("kind", F.lit("verb")), allowMissingColumns=True)
    return rows.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.min_by("obj", "kind").alias("obj"), F.min("kind").alias("kind"))
