"""Best-two-fit packing of token sequences.

A bin is filled greedily (each time the longest piece that still fits); then, while it pays, its smallest piece gives way
to two unpacked pieces that fit the widened gap more tightly.

Which pieces share a bin depends on their lengths alone, and there are at most ``capacity`` of those. So the plan is made
for the counts of lengths: a bin's pattern is repeated for as long as the counts allow, which makes the plan's size and
time depend on the capacity, not on the number of documents, and the packing is one global packing. Spark then numbers
the pieces of each length, and a piece's number says which bin of the plan is its own.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, byte_characters, slices

CAPACITY = 1024
#: Pieces of one length are numbered in parts of about so many documents, in order of the parts.
PART_ROWS = 50_000
#: Tokenized runs of text remembered in a worker, and the longest of them: long ones rarely come back.
MAX_RUNS, LONGEST_RUN = 300_000, 12


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    A text is cut at single spaces between other characters. A pre-token never reaches over such a place, so the ids of
    the parts make up the ids of the whole, and a part that was seen before need not be tokenized again. New parts of
    Latin letters go through tiktoken with the same vocabulary, which gives the same ids in a quarter of the time; others,
    and those with a special token, through the library that the file belongs to.
    """

    _at = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, name: str):
        import json

        import public_tokenizers

        self.path = public_tokenizers.path(name)
        self.known: dict[str, bytes | None] = {}
        with open(self.path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.quick = None
        if model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not model["normalizer"]:
            import tiktoken

            byte_of = {c: b for b, c in byte_characters().items()}
            ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.special}
            self.quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MAX_RUNS:
            self.known = {}
        parts = [t.split(" ") for t in texts]
        for p in parts:
            p[0] = " " + p[0]  # marks the first, which has no space before it; no other holds one
        new = set().union(*parts).difference(self.known)
        self._learn(new)
        out = []
        for t, p in zip(texts, parts, strict=True):
            ids = list(map(self.known.__getitem__, p))
            if None in ids:  # white space beside a space: cut only where there is none
                first, *rest = self._at.split(t)
                p = [" " + first, *rest]
                more = set(p).difference(self.known)
                self._learn(more)
                new |= more
                ids = [self.known[x] if self.known[x] is not None else self._library(self._text(x)) for x in p]
            out.append(b"".join(ids))
        for x in new:
            if len(x) > LONGEST_RUN:
                del self.known[x]
        return out

    @staticmethod
    def _text(part: str) -> str:
        return part[1:] if part[:1] == " " else " " + part

    def _library(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, new: set[str]) -> None:
        """Ids of parts; None for a part that begins or ends with white space, as the place it was cut at may not be one."""
        slow = []
        for x in new:
            text = self._text(x)
            if text[-1:].isspace() or x[:1] != " " and text[1:2].isspace():
                self.known[x] = None
            elif self.quick and (text.isascii() or max(text) < "\u0250") and not any(s in text for s in self.special):
                ids = self.quick(text)
                self.known[x] = array("I", ids).tobytes()
            else:
                slow.append(x)
        for x in slow:
            self.known[x] = self._library(self._text(x))


@lru_cache(4)
def encoder(name: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    return Encoder(name)


def tokenized(docs: DataFrame, name: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, n (ids with the end id), crcs (of each piece) for each row of docs; the text is left behind."""

    def run(batches):
        for batch in slices(batches):
            n, crcs = [], []
            tail = int(end_id).to_bytes(4, "little")
            for ids in encoder(name).encode([t or "" for t in batch.column("text").to_pylist()]):
                ids += tail
                k = len(ids) // 4
                first = (k - 1) % capacity + 1
                cuts = [0, *range(first, k + 1, capacity)]
                n.append(k)
                crcs.append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n", "crcs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, crcs array<long>")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths of the pieces, longest first; how many such bins), for so many pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[list[int], int]] = []
    while left.any():
        here = left.copy()
        pieces, gap = [], capacity
        while True:
            fits = np.flatnonzero(here[1 : gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1]) + 1
            pieces.append(longest)
            here[longest] -= 1
            gap -= longest
        while gap and len(pieces) > 1 and (two := _two(here, pieces[-1], pieces[-1] + gap)):
            here[pieces.pop()] += 1
            pieces = sorted([*pieces, *two], reverse=True)
            here[list(two)] -= 1 if two[0] != two[1] else 0
            if two[0] == two[1]:
                here[two[0]] -= 2
            gap = capacity - sum(pieces)
        used = np.bincount(pieces, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        plan.append((pieces, times))
    return plan


def _two(here: np.ndarray, smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked pieces that together take more of ``room`` than ``smallest`` does, as much as any two."""
    have = np.flatnonzero(here[1:room]) + 1
    if not len(have):
        return None
    partner = np.searchsorted(have, room - have, side="right") - 1  # the longest that fits beside each
    partner = np.where((partner >= 0) & (have[partner] == have) & (here[have] < 2), partner - 1, partner)
    total = np.where(partner >= 0, have + have[np.maximum(partner, 0)], 0)
    best = int(np.argmax(total))
    if total[best] <= smallest:
        return None
    return int(have[best]), int(have[partner[best]])


def lookup(plan: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which number on its pieces go to which first bin, at which offset. One row for a place of a pattern."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(capacity + 1, np.int64)
    bins = 0
    for pieces, times in plan:
        offset = 0
        for length in pieces:
            rows.setdefault(length, []).append((int(taken[length]), bins, offset))
            taken[length] += times
            offset += length
        bins += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of docs (doc_id, text).

    A null text counts as empty and still gives its end id. Rows that repeat, and rows without a doc_id, are packed one by
    one. Whole texts are tokenized, very long ones too. Only documents longer than ``capacity`` are cut, and only their first piece is shorter than that. Only doc_id
    and text are read, so other columns of docs cannot clash. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    shared = Shared(spark)
    # Dealt by row and not by content, as rows may repeat; the written table fixes it.
    rows = shared.write(tokenized(docs, name, end_id, capacity).withColumn("dealt", F.xxhash64(F.monotonically_increasing_id())))
    parts = max(16, rows.count() // PART_ROWS)
    rows = rows.withColumn("part", F.pmod("dealt", F.lit(parts)).cast("int")).drop("dealt")
    # Pieces of full length fill a bin each; one shorter piece a document may be left, the first.
    short = F.when(F.col("n") % capacity > 0, (F.col("n") % capacity).cast("int"))
    counted = rows.groupBy("part", short.alias("short")).agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("n") / capacity)).alias("full"))
    counted = shared.write(counted)
    totals = counted.groupBy("short").agg(F.sum("rows").alias("rows")).where("short is not null").collect()  # a row for each length
    plan = best_two_fit({r["short"]: r["rows"] for r in totals}, capacity)
    held, bins = spark.sparkContext.broadcast(lookup(plan, capacity)), sum(t for _, t in plan)

    # How many pieces of a length lie in the parts before: sums over a row for each part and length.
    before = "sum({0}) over (partition by short order by part rows between unbounded preceding and 1 preceding)"
    lengths = counted.where("short is not null").select("part", "short", F.expr(f"coalesce({before.format('rows')}, 0)").alias("before"))
    step = counted.groupBy("part").agg(F.sum("full").alias("full")).select("*", F.lit(None).cast("int").alias("short")).selectExpr("part", f"coalesce({before.format('full')}, 0) as full_before")
    # Numbers inside a part: by length for the short pieces, over all documents for the full ones. The shuffle deals by part.
    inside = rows.withColumn("short", short).repartition(parts, "part").selectExpr(
        "*",
        "row_number() over (partition by part, short order by doc_id, n, crcs) - 1 as nth",
        f"coalesce(sum(floor(n / {capacity})) over (partition by part order by short, doc_id, n, crcs rows between unbounded preceding and 1 preceding), 0) as full_nth",
    )
    placed = inside.join(step, "part", "left").join(lengths, ["part", "short"], "left").selectExpr(
        "doc_id", "n", "crcs", "short", "nth + before as nth", f"{bins} + full_nth + full_before as full_id"
    )

    def assign(batches):
        by_length = held.value
        for batch in batches:
            n, crcs, shorts, nths, fulls = (batch.column(k).to_pylist() for k in ("n", "crcs", "short", "nth", "full_id"))
            row, piece, start, length, crc, sequence, offset = [], [], [], [], [], [], []
            for i, k in enumerate(n):
                at = 0
                for p, c in enumerate(crcs[i]):
                    m = shorts[i] if p == 0 and shorts[i] is not None else capacity
                    if m < capacity:
                        first, bin0, place = by_length[m]
                        j = int(np.searchsorted(first, nths[i], side="right")) - 1
                        s, o = int(bin0[j]) + nths[i] - int(first[j]), int(place[j])
                    else:
                        s, o = fulls[i] + p - (shorts[i] is not None), 0
                    for out, v in zip((row, piece, start, length, crc, sequence, offset), (i, p, at, m, c, s, o), strict=True):
                        out.append(v)
                    at += m
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, sequence, offset))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(assign, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
