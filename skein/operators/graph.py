"""Graph queries over an edge table (subj, pred, obj)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import written


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int = 3) -> DataFrame:
    """Directed simple paths of at most ``depth`` edges from starts(id) to ends(id): from_id, to_id, length, path.

    The depth bounds the number of joins, so the plan is finite; each join is on the frontier's node. A path ends at the
    first target that it meets. Backward reachability prunes: step d takes only edges into nodes from which a target is
    at most depth - d edges away, so a hub without a way to a target costs nothing. Its node sets and each frontier are
    written once, as both branches of every step read them.
    """
    out = written(edges.select(F.col("subj").alias("_s"), F.col("obj").alias("_o")).distinct())
    targets = ends.select("id").distinct()
    reach = [targets]  # nodes with a target at most k edges on
    for _ in range(depth - 1):
        before = reach[-1]
        reach.append(written(before.unionByName(out.join(before, F.col("_o") == F.col("id"), "left_semi").select(F.col("_s").alias("id"))).distinct()))
    frontier = starts.select(F.col("id").alias("from_id"), F.col("id").alias("at"), F.array("id").alias("nodes"))
    found = []
    for d in range(1, depth + 1):
        useful = out.join(reach[depth - d], F.col("_o") == F.col("id"), "left_semi")
        step = (
            frontier.join(useful, F.col("at") == F.col("_s")).where(~F.array_contains("nodes", F.col("_o")))
            .select("from_id", F.col("_o").alias("at"), F.concat("nodes", F.array("_o")).alias("nodes"))
        )
        step = written(step) if d < depth else step
        found.append(step.join(targets, F.col("at") == F.col("id"), "left_semi"))
        frontier = step.join(targets, F.col("at") == F.col("id"), "left_anti")
    done = reduce(DataFrame.unionByName, found)
    return done.select("from_id", F.col("at").alias("to_id"), (F.size("nodes") - 1).alias("length"), F.array_join("nodes", ">").alias("path"))


def neighborhood(edges: DataFrame, center: str, depth: int = 2, limit: int = 200) -> DataFrame:
    """Nodes within ``depth`` undirected steps of a node: id and the least number of steps, nearest first up to ``limit``.

    Each step reads the edges that touch the frontier, in both directions, and makes only what it reaches distinct. The
    frontier holds new nodes alone and is written once.
    """
    ends = edges.select("subj", "obj")
    seen = edges.sparkSession.createDataFrame([(center, 0)], "id string, depth int")
    frontier = seen.select("id")
    for d in range(1, depth + 1):
        out = ends.join(frontier, F.col("subj") == F.col("id"), "left_semi").select(F.col("obj").alias("id"))
        back = ends.join(frontier, F.col("obj") == F.col("id"), "left_semi").select(F.col("subj").alias("id"))
        new = out.unionByName(back).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = written(new) if d < depth else new
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    return seen.orderBy("depth", "id").limit(limit)


def predicate_subgraph(edges: DataFrame, pred: str, limit: int) -> DataFrame:
    """The first edges of a predicate (by subj, obj, doc_id, sent) and the distinct nodes that they induce."""
    first = edges.where(F.col("pred") == pred).orderBy("subj", "obj", "doc_id", "sent").limit(limit)
    return first.select(F.explode(F.array("subj", "obj")).alias("id")).distinct()


def two_cycles(edges: DataFrame, pred: str, inverse: str | None = None) -> DataFrame:
    """Pairs that hold a relation both ways; edges of the inverse predicate count backwards."""
    forward = edges.where(F.col("pred") == pred).select("subj", "obj")
    if inverse:
        forward = forward.unionByName(edges.where(F.col("pred") == inverse).select(F.col("obj").alias("subj"), F.col("subj").alias("obj")))
    forward = forward.distinct()
    back = forward.select(F.col("obj").alias("subj"), F.col("subj").alias("obj"))
    return forward.join(back, ["subj", "obj"], "left_semi").where("subj < obj")


def cycles(edges: DataFrame, depth: int = 4) -> DataFrame:
    """Simple cycles of at most ``depth`` edges, each once, from its smallest node: length and path."""
    out = edges.select(F.col("subj").alias("_s"), F.col("obj").alias("_o")).distinct()
    frontier = out.select(F.col("_s").alias("root"), F.col("_o").alias("at"), F.array("_s", "_o").alias("nodes")).where("at >= root")
    found = [frontier.where("at = root")]
    for _ in range(depth - 1):
        frontier = frontier.where("at <> root")
        step = frontier.join(out, F.col("at") == F.col("_s")).where((F.col("_o") >= F.col("root")) & ((F.col("_o") == F.col("root")) | ~F.array_contains("nodes", F.col("_o"))))
        frontier = step.select("root", F.col("_o").alias("at"), F.concat("nodes", F.array("_o")).alias("nodes"))
        found.append(frontier.where("at = root"))
    return reduce(DataFrame.unionByName, found).select((F.size("nodes") - 1).alias("length"), F.array_join("nodes", ">").alias("path"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("subj").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("obj").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.count("*").alias("degree"))
