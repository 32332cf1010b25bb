"""Tables that are kept: documents, jobs, snapshots, patterns, temporal events; and contracts of outside parsers as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as D

#: The nested contract of an outside parser, as far as it becomes tables.
CONTRACT = (
    "document_id string, characters array<struct<id:string,canonical_name:string,mention_count:int>>, "
    "mentions array<struct<id:string,character_id:string,text:string,start_char:int,end_char:int,sentence_idx:int,mention_type:string>>, "
    "quotes array<struct<id:string,text:string,start_char:int,end_char:int,speaker_id:string>>"
)


def new_document(rows: DataFrame) -> DataFrame:
    """id, title, text, updated_at of new documents: the id from the text, "Untitled" where there is no title."""
    return rows.select(F.substring(F.sha2("text", 256), 1, 32).alias("id"), F.coalesce("title", F.lit("Untitled")).alias("title"), "text", "updated_at")


def upserted(table: DataFrame, new: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The table with new rows in the place of those that have their key, and the others added; of several new rows of a key the
    latest counts."""
    columns = [c for c in table.columns if c != key]
    last = new.groupBy(key).agg(F.max(F.struct(order, *[c for c in columns if c != order])).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in columns])
    return table.join(new.select(key), key, "left_anti").unionByName(last)


def newest_first(table: DataFrame, order: str = "updated_at", limit: int | None = None) -> DataFrame:
    rows = table.orderBy(F.desc(order), "id")
    return rows.limit(limit) if limit else rows


def queued_jobs(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The oldest queued jobs (id, status, created_at); ties to the smaller id."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(limit)


def worked(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs after one round of the worker: those with a result (id, ok, message) are done or failed, others stay."""
    rows = jobs.join(results, "id", "left")
    return rows.withColumn("status", F.when(F.col("ok"), "done").when(~F.col("ok"), "failed").otherwise(F.col("status"))).select(*jobs.columns, F.when(~F.col("ok"), F.col("message")).alias("error"))


def snapshot(table: DataFrame, folder: str, at: str) -> None:
    """Writes the table as the snapshot ``at`` (a sortable name) below the folder, gzip-compressed."""
    table.write.mode("errorifexists").option("compression", "gzip").parquet(f"{folder}/snapshot={at}")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """snapshot, n: the names of the snapshots and their numbers of rows, newest first."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/snapshot=*").groupBy(F.col("snapshot").cast("string").alias("snapshot")).agg(F.count("*").alias("n")).orderBy(F.desc("snapshot"))


def restored(spark: SparkSession, folder: str, at: str, required: tuple[str, ...]) -> DataFrame:
    """The rows of a snapshot; it must have the required columns."""
    rows = spark.read.parquet(f"{folder}/snapshot={at}")
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"the snapshot lacks {', '.join(missing)}")
    return rows


def contract(rows: DataFrame) -> DataFrame:
    """Contracts as JSON text (json) in columns; rows that are no valid JSON have null columns."""
    return rows.select(F.from_json("json", CONTRACT).alias("c")).select("c.*")


def contract_mentions(parsed: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, character, name, text, start, end, sent, kind: mentions with the name of their character, those of characters with
    ``least`` mentions or more."""
    m = parsed.select("document_id", "characters", F.explode("mentions").alias("m"))
    who = F.element_at(F.filter("characters", lambda c: c["id"] == F.col("m.character_id")), 1)
    rows = m.select(F.col("document_id").alias("doc_id"), F.col("m.character_id").alias("character"), who.alias("who"), "m.text", F.col("m.start_char").alias("start"), F.col("m.end_char").alias("end"), F.col("m.sentence_idx").alias("sent"), F.col("m.mention_type").alias("kind"))
    return rows.where(F.coalesce(F.col("who.mention_count"), F.lit(0)) >= least).select("doc_id", "character", F.col("who.canonical_name").alias("name"), "text", "start", "end", "sent", "kind")


def contract_quotes(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("document_id").alias("doc_id"), F.explode("quotes").alias("q")).select("doc_id", F.col("q.id").alias("quote"), "q.text", F.col("q.speaker_id").alias("speaker"))


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def temporal_events(docs: DataFrame) -> DataFrame:
    """doc_id, family, precision, expression, starts: an event for each time expression of each text."""
    found = docs.select("doc_id", F.explode(D.time_expressions(F.col("text"))).alias("e")).select("doc_id", "e.*")
    return found.select("doc_id", "family", "precision", "expression", D.normalized(F.col("expression"), F.col("family")).alias("starts"))


def between(events: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Events whose date, as text, lies between the two."""
    rows = events.where("starts is not null")
    if first is not None:
        rows = rows.where(F.col("starts") >= first)
    return rows if last is None else rows.where(F.col("starts") <= last)
