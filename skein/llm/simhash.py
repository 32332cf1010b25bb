"""SimHash near-duplicates with the generalised pigeonhole principle.

Bits that correlate are grouped into partitions of the 64-bit fingerprint. If two fingerprints differ in at most T bits,
then for any thresholds t_i with sum(t_i) = T - m + 1 some partition i differs in at most t_i bits (t_i = -1: partition i
need not be probed). Dynamic programming picks the t_i from estimated candidate counts. Every fingerprint is indexed by
its bits in each probed partition and probes all keys within t_i bits; the pairs that meet are verified by bit_count.

Equal texts share a fingerprint and are collapsed before any search, so a group of copies costs one row. Components need
not all links, so a dense group is not searched pair by pair: fingerprints in buckets of more than HOT are first tied to
their neighbours at one bit, which an equality join finds, and in those buckets, split again by the other bits, only
fingerprints of different such groups are compared, those of a bucket's largest group with the rest. Links become
components by alternating large and small stars, each round written to the shared folder.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fresh, slices

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints used to estimate candidate counts (a bound on the sample, not on the search).
SAMPLE = 2048
#: What verifying one candidate costs, counted in index rows.
CANDIDATE_COST = 10.0
HOT = 256


def fingerprint(text: str | None) -> int:
    """64 bits, signed; no words: 0."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z are lower-cased, only ASCII white space splits
    if not w:
        return 0
    n = max(1, len(w) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(w, w[1:], w[2:], strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    counts = np.zeros(64, np.int64)
    while len(h := np.fromiter((digest(s, SEED) for s in itertools.islice(shingles, 100_000)), np.uint64)) > 0:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if isinstance(shingles, list):
            break
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), h (hash of the text, null for null) of every row."""

    def run(batches):
        for batch in slices(batches):
            fp = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp, pa.int64())], ["doc_id", "h", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, how many have both set: 64 x 64 sums, whatever the input."""

    def run(batches):
        n, both = 0, np.zeros((64, 64), np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(v), both + (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.ravel().tolist()], pa.list_(pa.int64()))], ["n", "both"])

    parts = fps.select("fp").mapInArrow(run, "n long, both array<long>").where("n > 0")
    sums = parts.select("n", F.posexplode("both").alias("at", "v")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    both = np.zeros(64 * 64, np.int64)
    for r in sums:
        both[r["at"]] = r["v"]
    return (sums[0]["n"] if sums else 0), both.reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width: each grows by the bit that correlates most with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for i in range(m):
        width = (64 - sum(map(len, groups))) // (m - i)
        first = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group = [first]
        left.discard(first)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def estimates(sample: np.ndarray, n: int, p: np.ndarray, groups: list[list[int]], distance: int) -> list[list[float]]:
    """For each group and t = -1..distance: index rows and CANDIDATE_COST times the expected candidates among n fingerprints.

    Candidates come from the sample's pairs where those are frequent, else from independent bits with their frequencies.
    """
    out = []
    for group in groups:
        mask = np.int64(sum(1 << b for b in group) - (1 << 64 if 63 in group else 0))
        seen = np.zeros(distance + 1)
        v = sample & mask
        for i in range(0, len(v), 256):
            d = np.bitwise_count(v[i : i + 256, None] ^ v[None, :])
            seen += [(d <= t).sum() for t in range(distance + 1)]
        pairs = max(1, len(v) * (len(v) - 1))
        differ = np.zeros(distance + 2)
        differ[0] = 1.0
        for b in group:  # chance of t differing bits
            q = 2 * p[b] * (1 - p[b])
            differ[1:], differ[0] = differ[1:] * (1 - q) + differ[:-1] * q, differ[0] * (1 - q)
        costs = [0.0]
        for t in range(distance + 1):
            rate = max((seen[t] - len(v)) / pairs if len(v) > 1 else 0.0, differ[: t + 1].sum())
            costs.append(n * (1 + sum(math.comb(len(group), k) for k in range(t + 1))) + CANDIDATE_COST * n * n / 2 * rate)
        out.append(costs)
    return out


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum distance - m + 1 and the least total cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, distance + 1):
                new = (cost + c[t + 1], [*ts, t])
                if used + t not in step or new < step[used + t]:
                    step[used + t] = new
        best = step
    return best[distance - len(costs) + 1]


def plan(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of the partitions to probe, for two or three partitions, whichever costs less."""
    n, both = bit_counts(fps)
    n = max(n, 1)  # of an empty table too, an index of few rows is the better one
    sample = np.array([r["fp"] for r in fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64)
    options = []
    for m in (2, 3):
        groups = group_bits(n, both, m)
        cost, ts = allocate(estimates(sample, n, np.diag(both) / max(n, 1), groups, distance), distance)
        options.append((cost, [(_signed(sum(1 << b for b in g)), g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _variants(fp, part: int, mask: int, bits: list[int], t: int) -> list:
    flips = [sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(bits, k)]
    return [F.struct(F.lit(part).alias("part"), fp.bitwiseXOR(F.lit(_signed(f))).bitwiseAND(F.lit(mask)).alias("key")) for f in flips]


def links(fps: DataFrame, distance: int = DISTANCE, shared: Shared | None = None) -> DataFrame:
    """Pairs a, b of fingerprints (fp, distinct) whose components are those of all pairs within ``distance`` bits.

    In buckets of at most HOT fingerprints these are all the pairs that meet there. In others: ties at one bit, and ties
    between the groups that these make, each named by its smallest fingerprint.
    """
    shared = shared or Shared(fps.sparkSession)
    parts = plan(fps, distance)
    fp = F.col("fp")
    index = fps.select("fp", F.explode(F.array(*[v for i, (mask, bits, _) in enumerate(parts) for v in _variants(fp, i, mask, bits, 0)])).alias("k")).select("fp", "k.*")
    probe = fps.select("fp", F.explode(F.array(*[v for i, (mask, bits, t) in enumerate(parts) for v in _variants(fp, i, mask, bits, t)])).alias("k")).select("fp", "k.*")
    # Written once, as the counts, the cold and the hot buckets read them.
    index, probe = shared.write(index), shared.write(probe)
    hot = shared.write(index.groupBy("part", "key").count().where(F.col("count") > HOT).select("part", "key"))
    on = ["part", "key"]
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    if not hot.limit(1).count():
        return _named(index, "a").join(_named(probe, "b"), on).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    cold = _named(index.join(hot, on, "left_anti"), "a").join(_named(probe, "b"), on).where((F.col("a") != F.col("b")) & near).select("a", "b").distinct()
    members = shared.write(index.join(hot, on, "left_semi").select("fp").distinct())
    flips = F.explode(F.array(*[fp.bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])).alias("b")
    hops = shared.write(members.select(F.col("fp").alias("a"), flips).where("a < b").join(members.withColumnRenamed("fp", "b"), "b", "left_semi").select("a", "b"))
    roots = shared.write(components(hops, shared).withColumnsRenamed({"node": "fp"}))

    def rooted(rows: DataFrame) -> DataFrame:
        inside = rows.join(hot, on, "left_semi").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        again = F.lit(None).cast("array<struct<sub:int,more:bigint>>")
        for i, (_, bits, _) in enumerate(parts):
            again = F.when(F.col("part") == i, F.array(*_equal_groups([b for b in range(64) if b not in bits], distance + 1, distance))).otherwise(again)
        return inside.withColumn("s", F.explode(again)).select("fp", "root", F.struct("part", "key", "s.sub", "s.more").alias("bucket"))

    left, right = shared.write(rooted(index)), shared.write(rooted(probe))
    crowded = shared.write(_groups(left).where(f"n > {HOT} and roots > 1").select("bucket"))
    ties = [_between(left.join(crowded, "bucket", "left_anti"), right, near)]
    if crowded.limit(1).count():  # those once more, by any five of eight groups of all bits
        finer = F.explode(F.array(*_equal_groups(list(range(64)), distance + 5, distance))).alias("s")
        left, right = (r.join(crowded, "bucket", "left_semi").select("fp", "root", "bucket", finer).select("fp", "root", F.struct("bucket", "s.sub", "s.more").alias("bucket")) for r in (left, right))
        ties.append(_between(left, right, near))
    out = cold.unionByName(hops)
    for t in ties:
        out = out.unionByName(t)
    return out


def _named(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumnRenamed("fp", name)


def _equal_groups(bits: list[int], n: int, distance: int) -> list:
    """Keys of fp, one for each choice of n - distance of n groups of the bits: of two fingerprints that differ in at most
    ``distance`` bits one is equal."""
    groups = [bits[j::n] for j in range(n)]
    masks = [_signed(sum(1 << b for g in some for b in groups[g])) for some in itertools.combinations(range(n), n - distance)]
    return [F.struct(F.lit(i).alias("sub"), F.col("fp").bitwiseAND(F.lit(m)).alias("more")) for i, m in enumerate(masks)]


def _groups(index: DataFrame) -> DataFrame:
    """bucket, n (fingerprints), roots (different ones) and main (the most frequent root)."""
    each = index.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    return each.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).getField("root").alias("main"))


def _between(index: DataFrame, probe: DataFrame, near) -> DataFrame:
    """Pairs of different roots that have fingerprints within the distance in one bucket. Those of the bucket's main root
    are not compared with each other."""
    main = _groups(index).select("bucket", "main")
    a = index.join(main, "bucket").select("bucket", F.col("fp").alias("a"), F.col("root").alias("ra"), (F.col("root") == F.col("main")).alias("of_main"))
    b = probe.join(main, "bucket").select("bucket", F.col("fp").alias("b"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("b_of_main"))
    met = a.where("not of_main").join(b, "bucket").unionByName(a.where("of_main").join(b.where("not b_of_main"), "bucket"))
    return met.where((F.col("ra") != F.col("rb")) & near).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def components(edges: DataFrame, shared: Shared) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (a, b) reaches. Nodes without an edge are absent.

    Large star: every neighbour above u is tied to the smallest neighbour of u. Small star: those below u likewise.
    Minima are aggregated before the shuffle; no list of neighbours is ever built. Rounds grow with log(longest path).
    """
    edges = shared.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = shared.write(small.where("a <> b").distinct())
        shared.drop(edges)
        edges, after = new, mark(new)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, h, fp, root, component_id for each row of docs (doc_id, text).

    component_id: the smallest doc_id of the component; rows with a null doc_id never give it, and it is null where all
    are null. root names the component by its smallest fingerprint. Null, empty and blank texts share fingerprint zero.
    Whole texts are read, very long ones too. Repeated rows keep their own line. An empty table gives an empty result. Only
    doc_id and text are read, so other columns cannot clash.
    """
    shared = Shared(docs.sparkSession)
    rows = shared.write(fingerprints(docs))
    fps = shared.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps, distance, shared), shared)
    known = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = shared.write(known.select("fp", "root").join(least, "root"))
    return rows.join(named, "fp").select("doc_id", "h", "fp", "root", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, all columns: that with the smallest doc_id (null last), then the smallest text hash.

    Of rows with equal doc_id and text one stays, whichever; columns of any name besides doc_id and text pass through
    untouched. An empty table gives an empty result.
    """
    h, id_, of = fresh(docs.columns, "h", "id", "of")
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    kept = near_duplicates(docs, distance).groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias(id_), F.col("k.h").alias(of)).distinct()
    rows = docs.withColumn(h, F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(of)), "left_semi")
    return rows.dropDuplicates(["doc_id", h]).select(docs.columns)
