"""Aliases in texts, the longest first: a trie of alias words as hashes, what it finds joined by its words, conflicts by islands.

No task and no broadcast holds the aliases. The trie's nodes, the beginnings of all aliases, are PLACES bits of hashes, of
fixed size whatever the number of aliases: a walk from every word of a text ends at the first beginning that no alias has.
What the walks of a chunk of texts take for aliases is joined to the aliases by its words, once for each chunk, so that equal
hashes do no harm; the chunk's texts are then walked along a trie of the aliases that are in them. The bits are many
enough for millions of aliases: once most are set, walks find almost every place.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import written

#: Hashes of beginnings, and of whole aliases, are kept in so many bits each.
PLACES = 1 << 27
#: A word (digits, letters, underscores, all that is not ASCII), or one mark; blanks part them and do not count.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E]"
_tokens, _words = re.compile(TOKEN).finditer, re.compile(TOKEN).findall
#: Bytes of text that meet their aliases at once; keys that a task holds before it asks for them.
CHUNK, MOST = 1 << 20, 400_000


def _key(text: str | None) -> str:
    return " ".join(m.group().lower() for m in _tokens(text or ""))


def keyed(aliases: DataFrame) -> DataFrame:
    """key (the words of an alias in lower case, blank between), id (the smallest that has it) and length of aliases (alias, id);
    those without a word are left out. Written, as it is read three times."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("alias")
            yield batch.set_column(at, "alias", pa.array([_key(a) for a in batch.column(at).to_pylist()], pa.string()))

    rows = aliases.select(F.col("alias").cast("string").alias("alias"), "id")
    return written(rows.mapInArrow(run, rows.schema).where("alias <> ''").groupBy(F.col("alias").alias("key")).agg(F.min("id").alias("id")).withColumn("length", F.length("key")))


def _bits(keys: DataFrame) -> bytes:
    """PLACES bits, set at the CRC-32 of each key; at most PLACES / 8 rows come to the driver, whatever the number of keys."""
    h = keys.select(F.pmod(F.crc32("key"), F.lit(PLACES)).alias("h"))
    rows = h.groupBy(F.expr("cast(h >> 6 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(PLACES // 64, "<i8")
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return bits.tobytes()


def _asked(docs: DataFrame, index: DataFrame) -> DataFrame:
    """chunk, key of docs (chunk, doc_id, text): what a walk takes for an alias, about once for each chunk."""
    words = F.split("key", " ")
    heads = index.select(F.explode(F.transform(words, lambda w, i: F.array_join(F.slice(words, F.lit(1), i + 1), " "))).alias("key"))
    held = docs.sparkSession.sparkContext.broadcast((_bits(heads), _bits(index)))

    def rows(seen):
        for chunk, keys in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(keys), pa.int32()), pa.array(list(keys), pa.string())], ["chunk", "key"])

    def run(batches):
        begun, whole = held.value
        crc, last = zlib.crc32, PLACES - 1
        seen = {}
        for batch in batches:
            known = {}  # a word, as it is written: its lower case as bytes and text, and its hash if an alias begins with it
            for chunk, text in zip(batch.column("chunk").to_pylist(), batch.column("text"), strict=True):
                keys = seen.setdefault(chunk, set())
                words = _words(text.as_py() or "")
                for word in set(words).difference(known):
                    text_ = word.lower()
                    low = text_.encode("utf-8", "surrogatepass")
                    h = crc(low)
                    known[word] = low, text_, h if begun[(h & last) >> 3] >> (h & 7) & 1 else None
                low = [known[w] for w in words]
                for at, (_, word, h) in enumerate(low):
                    if h is None:
                        continue
                    end = at + 1
                    if whole[(h & last) >> 3] >> (h & 7) & 1:
                        keys.add(word)
                    if end == len(low):
                        break
                    h, end = crc(low[end][0], crc(b" ", h)), end + 1
                    while begun[(h & last) >> 3] >> (h & 7) & 1:
                        if whole[(h & last) >> 3] >> (h & 7) & 1:
                            keys.add(" ".join([w for _, w, _ in low[at:end]]))
                        if end == len(low):
                            break
                        h, end = crc(low[end][0], crc(b" ", h)), end + 1
            if sum(map(len, seen.values())) > MOST:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    return docs.mapInArrow(run, "chunk int, key string")


def _trie(keys: list[str]) -> dict:
    """Of each word its node: the number of the key that ends there, or -1, and the words that follow."""
    tree: dict = {}
    for j, key in enumerate(keys):
        level = tree
        for word in key.split(" "):
            node = level.setdefault(word, [-1, {}])
            level = node[1]
        node[0] = j
    return tree


def _places(text: str, tree: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """(at, n, start, end, number of the key) of the keys of a trie in a text, in order of at and n."""
    found = list(_tokens(text))
    low = [m.group().lower() for m in found]
    for at, word in enumerate(low):
        node, end = tree.get(word), at + 1
        while node is not None:
            if node[0] >= 0:
                yield at, end - at, found[at].start(), found[end - 1].end(), node[0]
            node, end = node[1].get(low[end]) if end < len(low) else None, end + 1


def _longest_first(doc: np.ndarray, at: np.ndarray, n: np.ndarray, keys: pa.Array) -> np.ndarray:
    """The numbers of the places that stay, of places in order of doc, at and n: candidates that overlap, directly or through
    others, are an island; in each the longest key is taken first (ties: the first place, then the smaller key)."""
    at = at + (doc << 32)  # documents one behind the other
    start = np.r_[0, 1 + np.flatnonzero(at[1:] >= np.maximum.accumulate(at + n)[:-1])]
    size = np.diff(np.r_[start, len(at)])
    stay = [start[size == 1]]
    many = np.flatnonzero(np.repeat(size > 1, size))
    if len(many):
        words = keys.take(pa.array(many)).to_pylist()
        each = list(zip([-len(k) for k in words], at[many].tolist(), words, n[many].tolist(), many.tolist(), strict=True))
        ends = np.cumsum(size[size > 1]).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            taken, out = [], []  # taken: the places that are gone, as (first, behind the last) in order
            for _, first, _, m, i in sorted(each[a:b]):
                k = bisect(taken, (first, first + m))
                if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= first + m):
                    insort(taken, (first, first + m))
                    out.append(i)
            stay.append(np.array(out, np.int64))
    return np.sort(np.concatenate(stay))


def candidates(docs: DataFrame, index: DataFrame, longest: bool = False) -> DataFrame:
    """doc_id, at, n, start, end, key, id: every place where the words of an alias of index (see ``keyed``) stand; at and n count
    words and marks, start and end code points. With ``longest``, the places that stay when the longest key is taken first (ties:
    the first place, then the smaller key) and whatever overlaps it goes, and so on.

    Texts are dealt to chunks of about CHUNK bytes by their doc_id, once. Of a chunk, each key that may be an alias is asked for
    once, and its texts meet the answers: places, of which there are more than words, are not moved at all."""
    kind, of = docs.schema["doc_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n_bytes // CHUNK + 1)).cast("int")
    dealt = docs.select(chunk.alias("chunk"), "doc_id", "text").repartition(parts, "chunk")
    # Neither side is broadcast: both grow with the texts.
    known = _asked(dealt, index).join(index.select("key", "id").hint("shuffle_hash"), "key").select("chunk", "key", "id").distinct()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, docs_ = (t.column(c).combine_chunks() for t, c in ((right, "key"), (right, "id"), (left, "doc_id")))
        tree = _trie(keys.to_pylist())
        rows_of: dict = {}
        for i, doc in enumerate(docs_.to_pylist()):
            rows_of.setdefault(doc, []).append(i)
        texts, tables, rows = left.column("text"), [], []

        def batch():
            doc, at, n, start, end, j = np.array(rows, np.int64).reshape(-1, 6).T
            j, stay = pa.array(j), _longest_first(doc, at, n, keys.take(pa.array(j))) if longest and rows else slice(None)
            columns = [docs_.take(pa.array(doc[stay])), *(pa.array(c[stay].astype(np.int32)) for c in (at, n, start, end)), *(c.take(pa.array(j.to_numpy()[stay])) for c in (keys, ids))]
            tables.append(pa.Table.from_arrays(columns, ["doc_id", "at", "n", "start", "end", "key", "id"]))
            rows.clear()

        for some in rows_of.values():  # rows that repeat a doc_id are one document
            found = [(some[0], *x) for i in some for x in _places(texts[i].as_py() or "", tree)]
            rows += found if len(some) == 1 else sorted(found, key=lambda x: x[:3])
            if len(rows) > 50_000:
                batch()
        batch()
        return pa.concat_tables(tables)

    return dealt.groupBy("chunk").cogroup(known.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, at int, n int, start int, end int, key string, id {of}")


def alias_mentions(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, at, n, start, end, key, id of the aliases (alias, id) in docs (doc_id, text), longest first, without overlaps.

    Capitals aside, and whatever blanks are between words. A null text has none, a null or wordless alias is nowhere; of
    several ids of one alias the smallest counts. doc_id names a document: rows that repeat it are read as one.
    """
    return candidates(docs, keyed(aliases), longest=True)
