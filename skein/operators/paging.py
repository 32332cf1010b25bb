"""Keyset paging, search and facets."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode_cursor(key: str) -> str:
    return base64.b64encode(json.dumps({"k": key}, separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> str:
    try:
        return json.loads(base64.b64decode(cursor, validate=True))["k"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("invalid cursor") from e


def page(rows: DataFrame, key: str, after: str | None = None, limit: int = 50) -> DataFrame:
    """The next rows in key order; the filter reaches the scan and the sort keeps only ``limit`` rows in each task."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    if after is not None:
        rows = rows.where(F.col(key) > decode_cursor(after))
    return rows.orderBy(key).limit(limit)


def page_before(rows: DataFrame, key: str, before: str, limit: int = 50) -> DataFrame:
    return rows.where(F.col(key) < decode_cursor(before)).orderBy(F.desc(key)).limit(limit)


def search(docs: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """Documents by the sum of the terms' frequencies over the square root of the length; ties to the smaller doc_id."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]+)"), F.lit(1))
    hits = F.size(F.filter("w", lambda w: w.isin([t.lower() for t in terms])))
    scored = docs.select("doc_id", words.alias("w")).select("doc_id", hits.alias("hits"), F.size("w").alias("n")).where("hits > 0")
    return scored.select("doc_id", "hits", F.round(F.col("hits") / F.sqrt("n"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of the columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns]))
    return rows.select(pairs.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
