"""Ordered and interval operators: as-of joins, band joins, islands, coverage, adjacency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_previous(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``value`` of the last right row strictly before each left row: one union and one window, no inequality join."""
    l = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*by, at, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    both = l.unionByName(r)
    # Left rows go before right rows of the same time, so equal times are not seen.
    w = Window.partitionBy(*by).orderBy(at, F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_v").alias(f"previous_{value}"))


def band_pairs(rows: DataFrame, by: list[str], at: Column, width: int, key: str) -> DataFrame:
    """Pairs of rows (a.key < b.key) with the same ``by`` and at most ``width`` apart. Every row is in its own bucket of
    that width and the left side also asks the next, so the join is on equal keys and no pair is found twice."""
    base = rows.select(*by, at.alias("_at"), F.col(key).alias("_key")).withColumn("_b", F.floor(F.col("_at") / width))
    left = base.select(*by, F.col("_at").alias("at_a"), F.col("_key").alias("a"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    right = base.select(*by, F.col("_at").alias("at_b"), F.col("_key").alias("b"), "_b")
    return left.join(right, [*by, "_b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= width)).drop("_b")


def islands(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal ``value`` in order: by, island, value, n, first, last of the first order column."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(*by, "island", value).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def sessions(rows: DataFrame, by: list[str], at: str, order: list[str], gap_seconds: int) -> DataFrame:
    """Islands by time: a gap of more than ``gap_seconds`` begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    gap = (seconds - F.lag(seconds).over(w)) > gap_seconds * 1_000_000
    marked = rows.withColumn("_new", F.when(gap | gap.isNull(), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w))
    return marked.groupBy(*by, "session").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def uncovered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Spans (start, end) that no earlier or longer span covers."""
    w = Window.partitionBy(*by).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max("end").over(w)).where(F.col("_m").isNull() | (F.col("end") > F.col("_m"))).drop("_m")


def adjacent(rows: DataFrame, by: list[str], order: list[str], who: str) -> DataFrame:
    """Neighbouring rows of different ``who``: distinct unordered pairs with the number of changes."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(who).over(w)
    pairs = rows.withColumn("_b", before).where(F.col("_b") != F.col(who))
    return pairs.groupBy(*by, F.least("_b", who).alias("a"), F.greatest("_b", who).alias("b")).agg(F.count("*").alias("n"))


def point_in_interval(points: DataFrame, intervals: DataFrame, by: list[str], at: str, longest: int) -> DataFrame:
    """Points with the interval (start <= at < end) that holds them. Intervals enter every bucket of ``longest`` that they
    touch; an interval longer than that is simply in more buckets."""
    p = points.withColumn("_b", F.floor(F.col(at) / longest))
    spread = F.sequence(F.floor(F.col("start") / longest), F.floor((F.greatest("end", F.col("start") + 1) - 1) / longest))
    i = intervals.withColumn("_b", F.explode(spread))
    return p.join(i, [*by, "_b"]).where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("_b")


def first_interval(points: DataFrame, intervals: DataFrame, by: list[str], at: str, reach: int, longest: int) -> DataFrame:
    """Points (unique in ``by`` and ``at``) with the one interval (start, end, id) that they belong to, and ``inside``: of those
    that hold the point the first, else the first of those at most ``reach`` away (start - reach <= at < end + reach). First is
    the smallest start, then end, then id. Points that no interval reaches are left out; intervals may be nested, repeated
    and, where end = start, empty. One join in buckets (see ``point_in_interval``) and a minimum that aggregates before the
    shuffle, so a point in many intervals costs their rows, but no list of them."""
    wide = intervals.select(*by, (F.col("start") - reach).alias("start"), (F.col("end") + reach).alias("end"), "id")
    met = point_in_interval(points.withColumn("_at", F.col(at)), wide, by, at, longest)
    start, end = F.col("start") + reach, F.col("end") - reach
    outside = (F.col("_at") < start) | (F.col("_at") >= end)
    best = met.groupBy(*by, "_at").agg(F.min(F.struct(outside.alias("o"), start.alias("start"), end.alias("end"), F.col("id"))).alias("m"))
    return points.join(best.select(*by, F.col("_at").alias(at), (~F.col("m.o")).alias("inside"), "m.start", "m.end", "m.id"), [*by, at])


def trailing_speakers(rows: DataFrame, by: list[str], order: list[str], who: str, n: int = 4) -> DataFrame:
    """The distinct ``who`` of the ``n`` rows before each row; two of them make an exchange."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.array_sort(F.array_distinct(F.collect_list(who).over(w.rowsBetween(-n, -1))))
    return rows.withColumn("active", F.array_join(before, ",")).withColumn("exchange", F.size(before) == 2)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
