"""Exact top-k inner products with a vector-approximation file.

``build`` writes, next to each integer vector, the cell of every component: ``bits`` bits, equal widths between bounds
that one aggregation finds for each dimension. A search scans the cells of all vectors. The middle and half width of a
component's cell bound its product with the query from both sides, so the cells give a lower and an upper bound of each
score; vectors that cannot reach the k-th best lower bound are passed over, and the exact vectors of the rest are read
in the order of their bounds until the k-th result is certain.

Equal vectors are one entry of the file, with the k + 1 smallest of their vec_ids: of equal scores the smaller vec_ids
win, so no other can be among the k best, and a vector that fills a third of the table is scanned once.

File and queries meet in a grid. The file is dealt into parts and the queries into blocks, both of bounded size, and the
task of a square searches one part for one block; each returns at most k rows a query to the final top-k. Nothing is
broadcast or collected but two numbers for each dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Shared

SCALE, TOP, BITS = 256, 5, 6
#: Bytes of a part of the file and of a block of queries that one task holds, at most; a part has LEAST vectors or more.
PART_BYTES, BLOCK_BYTES, LEAST = 32 << 20, 16 << 20, 2048
#: Queries and vectors in one step of a scan, which bounds its matrices.
QUERIES, STEP = 256, 2048


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and v = floor(SCALE * x) of each usable vector: not null, not empty, every component finite."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    return embeddings.where("vec_id is not null and embedding is not null").select("vec_id", x.alias("x")).where(
        (F.size("x") > 0) & F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    ).select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


def build(vectors: DataFrame, bits: int = BITS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The approximation file (vec_id, dims, cells, exact) and, for each number of dimensions, the lower bounds and cell widths."""
    ends = vectors.select(F.size("v").alias("dims"), F.posexplode("v").alias("at", "e")).groupBy("dims", "at").agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    bounds: dict[int, np.ndarray] = {}
    for r in sorted(ends.collect()):  # a row for each dimension
        bounds.setdefault(r["dims"], np.zeros((2, r["dims"]), np.int64))[:, r["at"]] = r["lo"], max(1, -(-(r["hi"] - r["lo"] + 1) // (1 << bits)))

    def run(batches):
        for batch in batches:
            cells, exact, dims = [], [], []
            for v in batch.column("v"):
                x = np.asarray(v.as_py(), np.int64)
                lo, width = bounds[len(x)]
                dims.append(len(x))
                cells.append(((x - lo) // width).astype(np.uint8).tobytes())
                exact.append(x.tobytes() if abs(x).max() > 32000 else x.astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(cells, pa.binary()), pa.array(exact, pa.binary())], ["vec_id", "dims", "cells", "exact"])

    return vectors.mapInArrow(run, "vec_id long, dims int, cells binary, exact binary"), bounds


def entries(file: DataFrame, k: int) -> DataFrame:
    """dims, cells, exact, owners: one row for each different vector, with the k + 1 smallest vec_ids that have it and how
    often each does (k at most). Rows of one vec_id are counted before the shuffle, and the ranks cut there too."""
    rows = file.groupBy("dims", "cells", "exact", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    rank = F.row_number().over(Window.partitionBy("dims", "exact").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("dims", "exact").agg(F.first("cells").alias("cells"), F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("owners"))


def _read(exact: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(exact, np.int64 if len(exact) == 8 * dims else np.int16).astype(np.int64)


class Best:
    """The k best (score, first vec_id) entries of each query so far; ties go to the smaller vec_id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.score = np.full((len(ids), k), -(1 << 62))
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.at = np.full((len(ids), k), -1)

    def scan(self, first: np.ndarray, second: np.ndarray, alone: np.ndarray, cells: np.ndarray, exact: list[bytes], lo: np.ndarray, width: np.ndarray, base: int = 0) -> int:
        """One step over a part of the file; the number of exact scores that were needed.

        first, second: the two smallest vec_ids of each entry; alone: it has no second. An entry that the query's own
        vec_id has alone takes no part; base: the number of the step's first entry.
        """
        q = self.queries.astype(np.float64)
        middle, half = lo + width * cells + (width - 1) / 2, (width - 1) / 2
        mid = q @ middle.T
        slack = (np.abs(q) @ half)[:, None] + 1e-6 * (1 + np.abs(mid))  # rounding errors included
        own = (self.ids[:, None] == first[None, :]) & alone[None, :]
        upper = np.where(own, -np.inf, mid + slack)
        kth = self.score[:, -1].astype(np.float64)
        if upper.shape[1] >= self.k:
            lower = np.where(own, -np.inf, mid - slack)
            kth = np.maximum(kth, np.partition(lower, -self.k, axis=1)[:, -self.k])
        reads = 0
        some, which = np.nonzero((upper >= kth[:, None]) & ~own)
        vectors: dict[int, np.ndarray] = {}
        for i, mine in zip(*_runs(some, which), strict=True):
            order = mine[np.argsort(-upper[i, mine], kind="stable")]
            at = 0
            while at < len(order):
                if upper[i, order[at]] < self.score[i, -1]:
                    break  # no later vector can reach the k-th result
                part = order[at : at + 4 * self.k]
                at += len(part)
                for j in part:
                    if j not in vectors:
                        vectors[j] = _read(exact[j], cells.shape[1])
                s = np.stack([vectors[j] for j in part]) @ self.queries[i]
                reads += len(part)
                of = np.where(first[part] == self.ids[i], second[part], first[part])
                score, number, place = (np.concatenate(x) for x in ((self.score[i], s), (self.id[i], of), (self.at[i], base + part)))
                keep = np.lexsort((number, -score))[: self.k]
                self.score[i], self.id[i], self.at[i] = score[keep], number[keep], place[keep]
        return reads


def _runs(some: np.ndarray, which: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(some):
        return [], []
    cuts = np.flatnonzero(np.diff(some)) + 1
    return some[np.r_[0, cuts]].tolist(), np.split(which, cuts)


def searched(part: pa.Table, block: pa.Table, bounds: dict[int, np.ndarray], k: int) -> pa.Table:
    """query_id, vec_id, score: the k best rows of a part of the file for each query of a block."""
    out: list[list[np.ndarray]] = [[], [], []]
    for dims in np.intersect1d(part["dims"].to_numpy(), block["dims"].to_numpy()).tolist():
        mine, asked = (t.take(pa.array(np.flatnonzero(t["dims"].to_numpy() == dims))) for t in (part, block))
        owners, exact = mine["owners"].to_pylist(), mine["exact"].to_pylist()
        cells = np.frombuffer(b"".join(mine["cells"].to_pylist()), np.uint8).reshape(-1, dims)
        first = np.array([o[0]["vec_id"] for o in owners], np.int64)
        alone = np.array([len(o) == 1 for o in owners])
        second = np.array([o[min(1, len(o) - 1)]["vec_id"] for o in owners], np.int64)
        for b in range(0, asked.num_rows, QUERIES):
            some = asked.slice(b, QUERIES)
            ids = some["vec_id"].to_numpy()
            best = Best(ids, np.stack([_read(e, dims) for e in some["exact"].to_pylist()]), k)
            for at in range(0, len(exact), STEP):
                step = slice(at, at + STEP)
                best.scan(first[step], second[step], alone[step], cells[step], exact[step], *bounds[dims], base=at)
            for i, times in enumerate(some["times"].to_pylist()):
                rows = sorted((-int(s), o["vec_id"]) for s, j in zip(best.score[i], best.at[i], strict=True) if j >= 0 for o in owners[j] if o["vec_id"] != ids[i] for _ in range(o["times"]))
                rows = np.repeat(np.array(rows[:k], np.int64).reshape(-1, 2), times, axis=0)
                for column, values in zip(out, (np.full(len(rows), ids[i]), rows[:, 1], -rows[:, 0]), strict=True):
                    column.append(values)
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in out], ["query_id", "vec_id", "score"])


def search(file: DataFrame, queries: DataFrame, bounds: dict[int, np.ndarray], parts: int, blocks: int, k: int = TOP) -> DataFrame:
    """The k best rows of each part of the file (dims, cells, exact, owners) for each of the queries (vec_id, dims, exact,
    times). Row (part, block) of the grid goes to one task: parts x blocks squares, the file is dealt ``blocks`` times and
    the queries ``parts`` times."""

    def dealt(df: DataFrame, n: int, others: int, square) -> DataFrame:
        mine = df.withColumn("mine", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
        return mine.withColumn("square", F.explode(square(F.col("mine"), F.sequence(F.lit(0), F.lit(others - 1))))).drop("mine")

    left = dealt(file, parts, blocks, lambda p, all_blocks: F.transform(all_blocks, lambda b: p * blocks + b))
    right = dealt(queries, blocks, parts, lambda b, all_parts: F.transform(all_parts, lambda p: p * blocks + b))
    return left.groupBy("square").cogroup(right.groupBy("square")).applyInArrow(lambda f, q: searched(f, q, bounds, k), "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, queries: Column, k: int = TOP, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that ``queries`` (a condition on vec_id) selects, the k best others.

    Vectors that are null, empty, or hold a null or non-finite component take no part. Only vectors of equal length are
    compared. Every row counts: a vec_id that occurs more than once takes a place for each of its rows, and the rows of a
    repeated query each bring their answers to the k places of their vec_id; rows never answer a query of their own id.
    Equal rows of a query are asked once and their answers repeated. Ties go to the smaller vec_id. Scores are exact
    64-bit integers while they fit. An empty table, or no query, gives no rows. Only vec_id and embedding are read, so other
    columns cannot clash.
    """
    shared = Shared(embeddings.sparkSession)
    built, bounds = build(quantised(embeddings), bits)
    file = shared.write(built)
    asked = shared.write(file.where(queries).groupBy("vec_id", "dims", "exact").agg(F.least(F.count("*"), F.lit(k)).alias("times")))
    once = shared.write(entries(file, k))
    size = once.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("cells") + F.length("exact") + 64), F.lit(0)).alias("bytes")).first()
    wide = asked.agg(F.coalesce(F.sum(F.length("exact") * 4 + 64), F.lit(0))).first()[0]
    tasks = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-size["bytes"] // PART_BYTES), min(tasks, size["n"] // LEAST))
    found = search(once, asked, bounds, parts, max(1, -(-wide // BLOCK_BYTES)), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
