"""A trie of the prefixes that conversations share, with members, leaves and saved tokens of every node.

Turns are dictionary-encoded: a different (role, text) is one id. Conversations are sequences of ids; equal sequences become
one row, whose members' ids are hashed from chunks of ranges of ids. The sequences are sorted into range shards, cut into
blocks of BLOCK turns, and each block is a ternary search tree, filled by median insertion so that it is balanced. One
iterative traversal gives members, leaves and savings of the nodes that lie inside the block. The nodes on the way to the
block's first and last sequence may go on in other blocks: these are few, are brought together by path, and add up their
parts; children of theirs learn their parent's name by block and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared

#: Turns of one block, and conversation ids of one chunk.
BLOCK, CHUNK = 200_000, 4096
WORD = r"[^\x20\x09-\x0D]+"
NODE = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text, null ones empty) and n_words of each turn that has a conv_id."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
    )


def encoded(turns: DataFrame, shared: Shared) -> DataFrame:
    """conv_id, own: array of (turn, digest, id, n_words) in order; ids number the different digests and are written once."""
    # A turn that a third of all conversations have is one row before the shuffle; the join splits its rows where it is skewed.
    known = shared.write(turns.groupBy("digest").agg(F.first("n_words").alias("n_words")).withColumn("id", F.monotonically_increasing_id()))
    rows = turns.select("conv_id", "turn", "digest").join(known, "digest")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "digest", "id", "n_words"))).alias("own"))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id, seq (ids), words: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most."""
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left").withColumn("h", h)
    none = F.array().cast(own.schema["own"].dataType)
    kept = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return rows.withColumn("all", kept).select("conv_id", F.transform("all", lambda t: t["id"]).alias("seq"), F.transform("all", lambda t: t["n_words"]).alias("words"))


def plain(own: DataFrame) -> DataFrame:
    """conv_id, seq, words of the conversations as they are."""
    return own.select("conv_id", F.transform("own", lambda t: t["id"]).alias("seq"), F.transform("own", lambda t: t["n_words"]).alias("words"))


def grouped(seqs: DataFrame, parts: int) -> DataFrame:
    """seq, words, conv_id (smallest), n, ends_sha256: one row for each different sequence.

    The ids of one sequence are joined to chunks where ranges of ids lie together, so that a sequence which a third of the
    conversations have is a row for each range and chunk; the task that hashes them holds one batch of chunks at a time.
    """

    def chunked(batches):
        found: dict[tuple, tuple[list, list]] = {}
        held = 0

        def rows():
            columns = ([], [], [], [], [])
            for seq, (words, ids) in found.items():
                for at in range(0, len(ids), CHUNK):
                    some = ids[at : at + CHUNK]
                    for c, v in zip(columns, (list(seq), words, some[0], len(some), ",".join(map(str, some))), strict=True):
                        c.append(v)
            found.clear()
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (longs, longs, pa.int64(), pa.int64(), pa.string()), strict=True)], ["seq", "words", "first", "n", "ids"])

        for batch in batches:
            for conv, seq, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(tuple(seq), (words, []))[1].append(conv)
                held += len(seq) + 4
                if held > 4 * BLOCK:
                    yield rows()
                    held = 0
        yield rows()

    def hashed(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for seq, words, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seq != last:
                    if last is not None:
                        out.append(state[:4] + (state[4].hexdigest(),))
                    last, state = seq, (seq, words, first, 0, hashlib.sha256())
                elif state[3]:
                    state[4].update(b",")
                state[4].update(ids.encode())
                state = (*state[:3], state[3] + n, state[4])
            yield batch_of(out)
        yield batch_of([state[:4] + (state[4].hexdigest(),)] if last is not None else [])

    def batch_of(rows):
        longs = pa.list_(pa.int64())
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (longs, longs, pa.int64(), pa.int64(), pa.string()), strict=True)], ["seq", "words", "conv_id", "n", "ends_sha256"])

    chunks = seqs.select("conv_id", "seq", "words").repartitionByRange(parts, "conv_id").sortWithinPartitions("conv_id").mapInArrow(chunked, "seq array<long>, words array<long>, first long, n long, ids string")
    together = chunks.repartition(parts, "seq").sortWithinPartitions("seq", "first")
    return together.mapInArrow(hashed, "seq array<long>, words array<long>, conv_id long, n long, ends_sha256 string")


class Tree:
    """A ternary search tree over ids. Node 0 is the textless root; ``lo`` and ``hi`` lead to siblings, ``eq`` to children."""

    def __init__(self):
        self.key, self.lo, self.hi, self.eq = [-1], [0], [0], [0]
        self.depth, self.up, self.words = [0], [0], [0]
        self.group: dict[int, int] = {}  # node -> the sequence that ends there

    def _child(self, node: int, key: int, words: int) -> int:
        key_, lo, hi = self.key, self.lo, self.hi
        side, at = self.eq, node
        while nxt := side[at]:
            if key == key_[nxt]:
                return nxt
            side, at = (lo if key < key_[nxt] else hi), nxt
        new = len(key_)
        side[at] = new
        key_.append(key)
        for links in (lo, hi, self.eq):
            links.append(0)
        self.depth.append(self.depth[node] + 1)
        self.up.append(node)
        self.words.append(words)
        return new

    def fill(self, seqs: list[list[int]], words: list[list[int]]) -> None:
        """Inserts sorted sequences, the median first, then either half, so that siblings are balanced."""
        todo = [(0, len(seqs))]
        while todo:
            a, b = todo.pop()
            if a < b:
                m = (a + b) // 2
                node = 0
                for key, n in zip(seqs[m], words[m], strict=True):
                    node = self._child(node, key, n)
                self.group[node] = m
                todo += [(a, m), (m + 1, b)]

    def path(self, seq: list[int]) -> list[int]:
        """The nodes from the root along a sequence that is in the tree."""
        nodes = [0]
        for key in seq:
            nodes.append(self._child(nodes[-1], key, 0))
        return nodes


EMPTY = hashlib.sha256(b"").hexdigest()
PART = f"block long, place long, parent_place long, parent_conv_id long, own_tokens long, path array<long>, {NODE}"
_LONGS = pa.list_(pa.int64())
PART_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("block", "place", "parent_place", "parent_conv_id", "own_tokens")] + [("path", _LONGS)]
    + [(c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string())]
)


def nodes_of(block: int, seqs: list[list[int]], words: list[list[int]], first: list[int], n: list[int], ends: list[str]) -> Iterator[tuple]:
    """Rows of PART for a block of sorted, different sequences.

    Nodes on the way to the first or last sequence have a place and a path; their children, leaves and savings count what
    lies inside the block only, nodes with a place left out. Others are whole; ``parent_place`` names a parent with a place.
    """
    tree = Tree()
    tree.fill(seqs, words)
    size = len(tree.key)
    place = {}
    for nodes in (tree.path(seqs[0]), tree.path(seqs[-1])):
        for node in nodes:
            place.setdefault(node, len(place))
    conv, members, children, leaves, saved = [None] * size, [0] * size, [0] * size, [0] * size, [0] * size
    for node, m in tree.group.items():
        conv[node], members[node] = first[m], n[m]
    # A child has a larger number than its parent, so that going down the numbers visits children first.
    for node in range(size - 1, -1, -1):
        if node not in place:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.words[node]
        if node:
            up = tree.up[node]
            members[up] += members[node]
            conv[up] = conv[node] if conv[up] is None else min(conv[up], conv[node])
            if node not in place:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    for node in range(size):
        up = tree.up[node]
        m = tree.group.get(node)
        here, held = place.get(node), node and place.get(up)
        path = None
        if here is not None:
            path, at = [], node
            while at:
                path.append(tree.key[at])
                at = tree.up[at]
            path.reverse()
        yield (
            block, here, held if node and here is None else None, conv[up] if node and held is None else None, tree.words[node], path, tree.depth[node], conv[node],
            members[node], children[node], leaves[node], saved[node], EMPTY if m is None else ends[m],
        )


def blocks(groups: Iterable[pa.RecordBatch], block: int = BLOCK) -> Iterator[tuple[list, ...]]:
    """The rows of sorted groups (seq, words, conv_id, n, ends_sha256) as columns, about ``block`` turns at a time."""
    held: tuple[list, ...] = ([], [], [], [], [])
    size = 0
    for batch in groups:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for column, x in zip(held, row, strict=True):
                column.append(x)
            size += len(row[0]) + 1
            if size >= block:
                yield held
                held, size = ([], [], [], [], []), 0
    if held[0]:
        yield held


def trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """NODE with parent_conv_id for each different prefix of the sequences seqs (conv_id, seq, words); see ``prefix_trie``."""
    spark = seqs.sparkSession
    shared = Shared(spark)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = shared.write(grouped(seqs, parts))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for held in blocks(batches, block):
            rows = list(nodes_of(number, *held))
            number += 1
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows[at : at + 20_000], strict=True), PART_ARROW, strict=True)], schema=PART_ARROW)

    # The numbers of blocks are fixed by writing them.
    sorted_ = groups.repartitionByRange(parts, "seq").sortWithinPartitions("seq").select("seq", "words", "conv_id", "n", "ends_sha256")
    made = shared.write(sorted_.mapInArrow(run, PART))
    shared.drop(groups)
    edge = made.where("place is not null")
    joined = shared.write(
        edge.groupBy("path").agg(
            F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inside"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved"), F.max("own_tokens").alias("own_tokens"), F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))).alias("ends"),
        )
    )
    up = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    below = joined.where("depth > 0").groupBy(up.alias("path")).agg(F.count("*").alias("more"))
    named = joined.select(F.col("path").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    own = joined.join(below, "path", "left").withColumn("n_children", F.col("inside") + F.coalesce("more", F.lit(0)))
    own = own.withColumn("leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("own_tokens"))
    # Each adds what it has to all nodes above it: as many rows as it is deep.
    adds = own.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda d: F.slice("path", F.lit(1), d))).alias("path"), "leaves", "saved")
    sums = adds.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shape = own.select("path", up.alias("up"), "depth", "conv_id", "n_convs", "n_children", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")).join(sums, "path")
    spanning = shape.where("depth > 0").join(named, "up").select(columns).unionByName(shape.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    whole = made.where("place is null")
    of = edge.select("block", F.col("place").alias("parent_place"), F.col("path").alias("up")).join(named, "up").drop("up")
    inner = whole.where("parent_place is null").select(columns).unionByName(whole.where("parent_place is not null").drop("parent_conv_id").join(of, ["block", "parent_place"]).select(columns))
    return inner.unionByName(spanning)


def prefix_trie(conversations: DataFrame, rebuild: bool = True, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of the trie of
    conversations (conv_id, turn, role, text); with ``rebuild``, of the conversations that the query makes from them.

    A node is a sequence of first turns; its members are the conversations that begin with it, and saved_tokens are the words
    that its subtree would not repeat. Turns go by number, null first; of equal numbers by the digest of role and text (see
    ``turns_of``), so that repeated rows are turns of their own and their order does not matter. Null roles and texts are
    empty; rows without conv_id belong to no conversation. An empty table has no nodes. Other columns are not read. Very long
    texts are digested where they lie. The ids of one conversation's turns are one row (16 bytes a turn).
    """
    shared = Shared(conversations.sparkSession)
    own = encoded(turns_of(conversations), shared)
    return trie(shared.write(rebuilt(own) if rebuild else plain(own)), block)
