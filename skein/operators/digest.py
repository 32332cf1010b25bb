"""A digest of the whole graph that renaming ids, reordering and repeating a run do not change."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import with_names


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_lines(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, line: the graph as JSON with sorted keys, names in place of ids.

    entities (id, type, canonical, aliases) say type, name and sorted aliases; relations (subj, pred, obj, confidence, extractor,
    qualifiers as array of struct(type, value)) the names of both ends, an unknown id itself, and sorted qualifiers. A null
    array is an empty one. Ids are unique; equal lines stay apart."""
    none = F.array().cast("array<string>")
    own = entities.select(F.lit("entity").alias("kind"), _json(type=F.col("type"), canonical=F.col("canonical"), aliases=F.array_sort(F.coalesce("aliases", none))).alias("line"))
    rows = with_names(relations, entities)
    told = _json(
        subj=F.col("subj_name"), pred=F.col("pred"), obj=F.col("obj_name"), confidence=F.col("confidence"), extractor=F.col("extractor"),
        qualifiers=F.array_sort(F.coalesce("qualifiers", F.array().cast(relations.schema["qualifiers"].dataType))),
    )
    return own.unionByName(rows.select(F.lit("relation").alias("kind"), told.alias("line")))


def digest(lines: DataFrame) -> DataFrame:
    """kind, n, hash of the bag of lines (kind, line), a row for each kind: SHA-256 of each different line and how often it is
    there, of those in order that begin with the same four hex digits, and of these 65,536 digests at most. Equal lines of an
    Arrow batch are counted before the shuffle, the only one of all lines: it deals bytes, not hex digits, by the digest's
    beginning, where equal lines meet as well. No task holds the whole graph."""

    def counted(batches):
        for batch in batches:
            yield from pa.Table.from_batches([batch]).group_by(["kind", "h"]).aggregate([([], "count_all")]).rename_columns(["kind", "h", "n"]).to_batches()

    some = lines.select("kind", F.unhex(F.sha2("line", 256)).alias("h")).mapInArrow(counted, "kind string, h binary, n long")
    dealt = some.withColumn("b", F.substring("h", 1, 2)).repartition("kind", "b")
    each = dealt.groupBy("kind", "b", "h").agg(F.sum("n").alias("n"))
    leaf = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "n"))), lambda x: F.concat_ws(":", F.lower(F.hex(x["h"])), x["n"])), ",")
    parts = each.groupBy("kind", "b").agg(F.sum("n").alias("n"), F.sha2(leaf, 256).alias("p"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat(F.lower(F.hex("b")), "p"))), ",")
    return parts.groupBy("kind").agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("hash"))
