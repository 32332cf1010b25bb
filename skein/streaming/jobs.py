"""Structured Streaming jobs: file ingest, windowed counts, debounced bursts, a keyed token bucket, the decaying salience of names.

Each ``run_*`` drives its stream with the availableNow trigger until the input is used up, writes to a folder and reads it
back; a service would start the same stream with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.lineage import shared_path


def parquet_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the files of a table, which may be a folder or one file: the source takes one file only as a pattern."""
    parent, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{parent}/[{name[0]}]{name[1:]}")


def finish(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if each:
        writer.foreachBatch(each).start().awaitTermination()
    else:
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their sum of values by type and tumbling window. ``late`` lets a sink that appends or
    updates drop windows; in complete mode every window is kept and no event is too late."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_window_counts(spark: SparkSession, path: str) -> DataFrame:
    folder = shared_path(spark)
    counted = window_counts(parquet_stream(spark, path))
    # Complete mode: the last batch holds every window, also those that the watermark has not closed.
    finish(counted, folder, "complete", lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    return spark.read.parquet(f"{folder}/out").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def debounced(events: DataFrame, by: list[str], quiet: str, late: str) -> DataFrame:
    """by, first, last, n of a stream of events (ts, the columns of ``by``): one row for a burst, once no event of its key has come
    for the time ``quiet``. A burst is a session window in the state store, which keeps a row a key and burst, merges bursts that a
    late event joins, and lets one go when the watermark (``late`` behind the newest event) passes its end. So micro-batches
    in another order, within ``late``, give the same bursts; events behind the watermark are left out. Keys may be hot: the
    events of a batch are merged into bursts before the shuffle, if the session says so (see ``run_debounce``)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bursts = timed.groupBy(F.session_window("ts", quiet).alias("w"), *by).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return bursts.select(*by, "first", "last", "n")


def run_debounce(spark: SparkSession, path: str, by: list[str], quiet: str, late: str, files_per_batch: int = 8) -> DataFrame:
    """The bursts of a table that are over when its events are used up; those that may still go on stay in the state."""
    folder = shared_path(spark)
    key = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        finish(debounced(parquet_stream(spark, path, files_per_batch), by, quiet, late), folder)
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{folder}/out")


def token_bucket(events: DataFrame, capacity: float, refill_seconds: float) -> DataFrame:
    """event_id, user_id, allowed: each user has ``capacity`` tokens, one comes back every ``refill_seconds``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            if at is not None:
                tokens = min(capacity, tokens + max(0.0, now - at) / refill_seconds)
            at = now if at is None else max(at, now)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), float(at)))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    timed = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "event_id long, user_id long, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout
    )


def run_token_bucket(spark: SparkSession, path: str, capacity: float = 3, refill_seconds: float = 21_600) -> DataFrame:
    folder = shared_path(spark)
    finish(token_bucket(parquet_stream(spark, path), capacity, refill_seconds), folder)
    return spark.read.parquet(f"{folder}/out")


#: What is left of a name's salience after each sentence, and below what it is forgotten.
DECAY, FORGOTTEN = 0.8, 0.3


def salience_stack(mentions: DataFrame) -> DataFrame:
    """doc_id, name, sent, salience of a stream of mentions (doc_id, name, sent, weight), in the state after each micro-batch.

    A name's salience grows by the weight of each mention and falls to DECAY of itself with every sentence; below FORGOTTEN it
    is zero again. The state of a (document, name) is two numbers. Of one micro-batch the mentions of a key are summed by
    sentence first, so a frequent name costs a row a sentence; mentions of earlier sentences that come later count where the
    state is, without decay.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        salience, at = state.get if state.exists else (0.0, None)
        by_sentence: dict[int, float] = {}
        for rows in batches:
            for sent, weight in rows.groupby("sent")["weight"].sum().items():
                by_sentence[sent] = by_sentence.get(sent, 0.0) + weight
        for sent in sorted(by_sentence):
            if at is not None:
                salience *= DECAY ** max(0, sent - at)
                salience = 0.0 if salience < FORGOTTEN else salience
            at = sent if at is None else max(at, sent)
            salience += by_sentence[sent]
        state.update((float(salience), int(at)))
        yield pd.DataFrame({"doc_id": [key[0]], "name": [key[1]], "sent": [at], "salience": [salience]})

    return mentions.groupBy("doc_id", "name").applyInPandasWithState(
        step, "doc_id long, name string, sent long, salience double", "salience double, at long", "update", GroupStateTimeout.NoTimeout
    )


def run_salience(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each user's event types, a day being a sentence: the weight of a purchase is 3, of a click 2, else 1."""
    folder = shared_path(spark)
    events = parquet_stream(spark, path)
    weight = F.when(F.col("event_type") == "purchase", 3.0).when(F.col("event_type") == "click", 2.0).otherwise(1.0)
    day = F.unix_date(F.col("ts").cast("timestamp").cast("date")).cast("long")
    rows = events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("name"), day.alias("sent"), weight.alias("weight"))
    finish(salience_stack(rows), folder, "update", lambda batch, k: batch.withColumn("k", F.lit(k)).write.mode("append").parquet(f"{folder}/out"))
    states = spark.read.parquet(f"{folder}/out")
    return states.groupBy("doc_id", "name").agg(F.max_by(F.struct("sent", "salience"), "k").alias("s")).select("doc_id", "name", "s.sent", F.round("s.salience", 6).alias("salience"))


def ingest(spark: SparkSession, inbox: str, table_path: str, extract: Callable[[DataFrame], DataFrame]) -> None:
    """New .txt and .md files of ``inbox`` go through ``extract`` and are appended to ``table_path``.

    Rows are keyed by the hash of the content: a file that was taken before, under any name, adds nothing, so a batch that
    is repeated after a failure leaves the table as it was.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").load(inbox)
    files = files.select(F.sha2("value", 256).alias("content_hash"), F.col("value").alias("text"))

    def each(batch: DataFrame, k: int) -> None:
        new = batch.dropDuplicates(["content_hash"])
        try:
            new = new.join(spark.read.parquet(table_path).select("content_hash").distinct(), "content_hash", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        extract(new).write.mode("append").parquet(table_path)

    files.writeStream.foreachBatch(each).option("checkpointLocation", f"{table_path}_state").trigger(availableNow=True).start().awaitTermination()
