"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark items, the alphabet is words. Windows of one length share a machine:
a shift table over blocks of two words says how far the search may jump, the block that ends a window selects a bucket,
the block that begins it selects the candidates inside, and a direct comparison confirms an occurrence.

Documents are never shuffled: every task scans its own texts against the compiled windows. Equal items are searched for
once, and long ones cut into overlapping pieces, so that the benchmark can be handed out in blocks of about BLOCK_WORDS
words, whatever it holds: one block, one scan of the documents. The driver holds one block at a time: the findings of each
are written before the next is read. With several blocks only the documents that were hit are brought together, by the
hash of their text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fresh, slices

WINDOW = 13
#: Words of benchmark text in one broadcast block (about 130 MB of compiled tables), and of an item in one piece.
BLOCK_WORDS, PIECE_WORDS = 400_000, 20_000
#: A-Z become a-z; every other ASCII byte that is neither a digit nor a letter becomes a space; bytes of 128 or more stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WuManber:
    """Search for the windows of one length in ``items``, lists of words: all of them, not copied."""

    def __init__(self, items: list[list[bytes]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        #: Last and first block of a window -> where such windows begin in ``words``.
        self.buckets: dict[bytes, list[int]] = {}
        self.words: list[bytes] = []
        self.first: list[int] = []  # of each item
        known: dict[bytes, bytes] = {}
        for item in items:
            base = len(self.words)
            self.first.append(base)
            self.words += [known.setdefault(w, w) for w in item]
            keys = [b" ".join(item[e - self.block : e]) for e in range(self.block, len(item) + 1)]
            for e, key in enumerate(keys, self.block):  # the block that ends here: words to the end of the nearest window
                self.shift[key] = min(self.shift.get(key, self.default), max(0, length - e))
            for start in range(len(item) - length + 1):
                self.buckets.setdefault(keys[start + length - self.block] + b"\n" + keys[start], []).append(base + start)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """The start of each occurrence, ascending, with the numbers of the items that have the window there."""
        m, default, shift, pair, words = self.length, self.default, self.shift.get, self.block == 2, self.words
        at, n = m - 1, len(text)
        while at < n:
            key = text[at - 1] + b" " + text[at] if pair else text[at]
            jump = shift(key, default)
            if jump:
                at += jump
                continue
            start = at - m + 1
            head = text[start] + b" " + text[start + 1] if pair else text[start]
            places = self.buckets.get(key + b"\n" + head)
            if places:
                here = text[start : at + 1]
                hit = [bisect_right(self.first, p) - 1 for p in places if words[p : p + m] == here]
                if hit:
                    yield start, hit
            at += 1


class Windows:
    """The windows of some items, compiled; ``find`` gives the hit intervals and the items seen in one text."""

    def __init__(self, items: Iterable[tuple[list[str], str]], window: int = WINDOW):
        by_length: dict[int, list[tuple[list[bytes], list[str]]]] = {}
        for ids, text in items:
            w = words(text)
            if w:
                by_length.setdefault(min(len(w), window), []).append((w, ids))
        self.machines = [(WuManber([w for w, _ in some], n), [ids for _, ids in some]) for n, some in sorted(by_length.items())]

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        spans, seen = [], set()
        for machine, ids in self.machines:
            which: set[int] = set()
            for start, items in machine.search(text):
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], start + machine.length))
                else:
                    spans.append((start, start + machine.length))
                which.update(items)
            for i in which:
                seen.update(ids[i])
        return merged(spans), seen


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching intervals become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, hits array<struct<first:long,after:long>>, items array<string>"


def handed_out(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[int, Iterator[list[tuple[list[str], str]]]]:
    """The number of blocks of about ``block_words`` words, and the blocks, each read when it is asked for, of items as (item_ids,
    text): equal texts are one, a text of more than PIECE_WORDS words is cut into pieces that overlap by all but one word of a
    window, so that they have its windows."""

    def cut(batches):
        for batch in slices(batches):
            ids, texts, n = [], [], []
            for i, text in zip(batch.column("ids").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words(text)
                size = max(PIECE_WORDS, window)
                for at in range(0, max(1, len(w) - window + 1) if w else 0, size - window + 1):
                    part = w[at : at + size]
                    ids.append(i)
                    texts.append(b" ".join(part).decode("utf-8", "surrogatepass"))
                    n.append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["ids", "text", "n"])

    items = benchmark.where("text is not null").groupBy("text").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("null"))).alias("ids"))
    parts = Shared(benchmark.sparkSession).write(items.mapInArrow(cut, "ids array<string>, text string, n long"))
    blocks = max(1, -(-parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // block_words))
    return blocks, ([(r["ids"], r["text"]) for r in parts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()] for k in range(blocks))


def _scan(docs: DataFrame, held: Broadcast, window: int) -> DataFrame:
    """Replaces the text of docs by FOUND, for the items of a block."""
    ahead = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in ahead] + [FOUND])

    def scan(batches):
        compiled = Windows(held.value, window)
        for batch in slices(batches):
            found = []
            for text in batch.column("text"):
                w = words(text.as_py())
                spans, seen = compiled.find(w)
                found.append((len(w), [{"first": a, "after": b} for a, b in spans], sorted(seen)))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
            n, hits, items = (list(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ahead] + [pa.array(n, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))],
                [*ahead, "n_words", "hits", "items"],
            )

    return docs.mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, hits (merged intervals of word positions) and items.

    Whole texts are searched, very long ones too. Null or empty text: no words, no hits. Items with null text have no
    windows; a null item_id reads "null"; items that repeat count once for each item_id. Rows that repeat a doc_id are
    judged one by one. Empty tables of either kind give no rows or no hits. Only doc_id and text are read, so other columns
    of docs cannot clash.
    """
    n_blocks, blocks = handed_out(benchmark, window, block_words)
    rows, broadcast = docs.select("doc_id", "text"), docs.sparkSession.sparkContext.broadcast
    if n_blocks == 1:
        return _scan(rows, broadcast(next(blocks)), window)
    # What a text holds does not depend on its row, so the blocks' findings meet by the text's hash and length.
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("size", F.octet_length("text"))
    shared = Shared(docs.sparkSession)
    found = others = None
    for block in blocks:
        held = broadcast(block)
        if found is None:
            found = shared.write(_scan(rows, held, window))
        else:
            part = shared.write(_scan(rows.where("size > 0").select("h", "size", "text"), held, window).where(F.size("items") > 0).select("h", "size", "hits", "items"))
            others = part if others is None else others.unionByName(part)
        held.destroy()
    none = F.array().cast("array<struct<first:long,after:long>>"), F.array().cast("array<string>")
    others = others.groupBy("h", "size").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("more_hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("more_items"))
    both = found.join(others, ["h", "size"], "left").select(
        "doc_id", "n_words", F.concat("hits", F.coalesce("more_hits", none[0])).alias("hits"), F.array_sort(F.array_union("items", F.coalesce("more_items", none[1]))).alias("items")
    )

    def joined(batches):
        for batch in batches:
            at = batch.schema.get_field_index("hits")
            kind = batch.schema.field(at).type
            spans = [[{"first": a, "after": b} for a, b in merged((x["first"], x["after"]) for x in some)] for some in batch.column(at).to_pylist()]
            yield batch.set_column(at, "hits", pa.array(spans, kind))

    return both.mapInArrow(joined, both.schema)


def judged(found: DataFrame) -> DataFrame:
    """The digest: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hits in a twentieth of the words or more)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["after"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; decided where the row lies, without a shuffle.

    Null and empty texts, and rows met with an empty benchmark, stay. Rows that repeat are judged one by one, and whole
    texts, very long ones too. Columns of any name besides text pass through untouched. An empty table gives an empty
    result. If the benchmark takes several blocks, the hashes of contaminated texts decide in a join.
    """
    n_blocks, blocks = handed_out(benchmark, window, block_words)
    if n_blocks > 1:
        h, size = fresh(docs.columns, "h", "size")
        key = F.xxhash64("text"), F.octet_length("text")
        texts = docs.select(F.struct(key[0].alias("h"), key[1].alias("size")).alias("doc_id"), "text")
        bad = judged(contamination(texts, benchmark, window, block_words)).where("contaminated").select(F.col("doc_id.h").alias(h), F.col("doc_id.size").alias(size)).distinct()
        return docs.withColumn(h, key[0]).withColumn(size, key[1]).join(bad, [h, size], "left_anti").select(docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(next(blocks))

    def keep(batches):
        compiled = Windows(held.value, window)
        for batch in slices(batches):
            clean = []
            for text in batch.column("text"):
                w = words(text.as_py())
                n = sum(b - a for a, b in compiled.find(w)[0])
                clean.append(not (n > 0 and 20 * n >= len(w)))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
