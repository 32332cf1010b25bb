"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is a sequence of words, each spelled byte by byte and ended by a blank, and an end, which is a word of no bytes. A
byte is eight binary decisions. Each decision has a tree of contexts: the bytes before, back to the beginning of the word or
DEPTH of them, and below the deepest of these the class (the language) of the document learnt from. Every node holds
Krichevsky-Trofimov counts, and the weighted probability of a node is the mean of its own estimate and the product of its
children's, so that all depths are mixed. A text's class is not known: its probability is that of a mixture of the classes.

The code length of a word does not depend on its neighbours, so each different word is coded once, whatever the corpus:

1. words are counted by class over all documents, added up in the tasks before they are shuffled;
2. the different words give the counts of (context, byte), which give those of the nodes, level by level from the deepest
   contexts to the root, and mixtures from the root back to the deepest: one sum, then one join a level, none of them skewed,
   as a node has 256 children at most. All are merged: files of a few MB hold millions of nodes, and eight decisions a row;
3. words are coded by the table of (context, byte), and documents by the table of words. Of either table at most TOP rows, the
   most frequent ones, are broadcast; what those do not hold is joined, so nothing is left out and no table must fit a task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, held_out, slices

#: Bytes of context (six at most, as a context and a byte are one long); languages that are classes of their own.
DEPTH, CLASSES = 4, 15
#: Rows of a broadcast table at most, and bytes of a word in it.
TOP_GRAMS, TOP_WORDS, WORD_BYTES = 400_000, 200_000, 64
#: Different words that a task counts before it hands them on; bytes of text that are cut into words at once.
MAX_WORDS, PIECE = 400_000, 1 << 22
BLANK = 32
_blank = re.compile(rb"[\x20\x09-\x0D]")


def words(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in order, A-Z lower-cased, in lists; a null text has none."""
    at = 0
    while text is not None:
        m = _blank.search(text, at + PIECE)
        yield text[at : m.start() if m else len(text)].lower().split()
        if not m:
            return
        at = m.start()


def counts_of(text: bytes | None) -> Counter:
    """How often each word occurs, and the end (an empty word) once."""
    found: Counter = Counter()
    for some in words(text):
        found.update(some)
    found[b""] = 1
    return found


def grams(some: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every byte of every word and of the blank that ends it, and the number of the word it is in.

    The context's bytes, the nearest lowest, stand above the byte; a context that reaches the word's beginning has a blank there
    and zeros above. No word holds a blank, so contexts of different lengths differ.
    """
    length = np.fromiter(map(len, some), np.int64, len(some)) + 2
    text = np.frombuffer(b"".join(b" %b " % w for w in some), np.uint8).astype(np.int64)
    start = np.cumsum(length) - length
    of = np.repeat(np.arange(len(some)), length)
    inside = np.arange(len(text)) - start[of]
    key = text.copy()
    for r in range(1, depth + 1):
        key[r:] |= np.where(inside[r:] >= r, text[:-r], 0) << (8 * r)
    real = inside > 0
    return key[real], of[real]


def counted(docs: DataFrame, names: list[str], k: int) -> DataFrame:
    """word, c0, c1, ...: the count of each word of docs by class; only what docs not held out have is counted, but every word
    is there."""

    def rows(held: list[Counter]) -> pa.RecordBatch:
        cols = [np.concatenate([np.fromiter(c.values(), np.int64, len(c)) if j == i else np.zeros(len(c), np.int64) for i, c in enumerate(held)]) for j in range(k)]
        return pa.RecordBatch.from_arrays([pa.array([w for c in held for w in c], pa.binary()), *map(pa.array, cols)], ["word", *(f"c{j}" for j in range(k))])

    def run(batches):
        held: list[Counter] = [Counter() for _ in range(k + 1)]  # the last: words of documents held out
        for batch in slices(batches):
            for text, at in zip(batch.column("text").cast(pa.binary()), batch.column("cls").to_pylist(), strict=True):
                for some in words(text.as_py()):
                    if at < k:
                        held[at].update(some)
                    else:
                        held[at].update(dict.fromkeys(some, 1))
                held[at][b""] += 1
            if sum(map(len, held)) > MAX_WORDS:
                yield rows(held)
                held = [Counter() for _ in range(k + 1)]
        yield rows(held)

    given = F.lit(len(names))
    for i, name in enumerate(names):
        given = F.when(F.col("lang") == name, i).otherwise(given)
    cls = F.when(held_out(F.col("doc_id"), 5, 1), k).otherwise(given)
    source = docs.select("text", cls.cast("int").alias("cls"))
    return source.mapInArrow(run, "word binary, " + ", ".join(f"c{j} long" for j in range(k))).groupBy("word").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(k)))


def gram_counts(vocabulary: DataFrame, k: int, depth: int = DEPTH) -> DataFrame:
    """key, c0, c1, ... of each (context, byte) of the words."""
    columns = ["key", *(f"c{j}" for j in range(k))]

    def run(batches):
        for batch in slices(batches, "word"):
            key, of = grams(batch.column("word").to_pylist(), depth)
            some, at = np.unique(key, return_inverse=True)
            sums = [np.bincount(at, weights=batch.column(f"c{j}").to_numpy()[of], minlength=len(some)).astype(np.int64) for j in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, sums)], columns)

    out = vocabulary.mapInArrow(run, ", ".join(f"{c} long" for c in columns))
    return out.groupBy("key").agg(*(F.sum(c).alias(c) for c in columns[1:]))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps up."""
    y = x + 8
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.ln(steps)


def log_kt(a: Column, b: Column) -> Column:
    """The logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = a.cast("double"), b.cast("double")
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)


def gram_scores(counts: DataFrame, k: int, shared: Shared, depth: int = DEPTH) -> DataFrame:
    """key, n, lp: for each (context, byte) its count and the log10 of its probability by class, mixed over all depths."""
    decision = F.explode(F.sequence(F.lit(0), F.lit(7)))
    bits = counts.withColumn("j", decision).withColumn("x", F.col("key").bitwiseAND(255).bitwiseOR(256))
    bits = bits.withColumn("ctx", F.shiftright("key", 8)).withColumn("q", F.expr("shiftright(x, 8 - j)")).withColumn("bit", F.expr("shiftright(x, 7 - j) & 1"))
    zero, one = F.col("bit") == 0, F.col("bit") == 1
    sums = [F.sum(F.when(w, F.col(f"c{j}")).otherwise(0)).alias(f"{n}{j}") for n, w in (("a", zero), ("b", one)) for j in range(k)]
    leaves = shared.write(bits.groupBy("ctx", "q").agg(*sums))
    # The bytes of a context: up to the blank at the word's beginning.
    size = F.lit(depth)
    for r in range(depth - 1, 0, -1):
        size = F.when(F.shiftright("ctx", 8 * (r - 1)).bitwiseAND(255) == BLANK, r).otherwise(size)
    both = [sum((F.col(f"{n}{j}") for j in range(1, k)), F.col(f"{n}0")) for n in "ab"]
    kids = sum((log_kt(F.col(f"a{j}"), F.col(f"b{j}")) for j in range(1, k)), log_kt(F.col("a0"), F.col("b0")))
    deepest = leaves.select("ctx", "q", size.alias("size"), both[0].alias("a"), both[1].alias("b"), kids.alias("kids"), F.lit(True).alias("deepest"))
    levels: dict[int, DataFrame] = {}
    above = None
    for d in range(depth, -1, -1):
        rows = deepest.where(F.col("size") == d).drop("size")
        if above is not None:
            part = above.groupBy(F.col("ctx").bitwiseAND((1 << 8 * d) - 1).alias("ctx"), "q").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("kids"))
            rows = rows.unionByName(part.withColumn("deepest", F.lit(False)))
        e = log_kt(F.col("a"), F.col("b"))
        rows = rows.withColumn("e", e).withColumn("w", 1 / (1 + F.exp(F.least(F.col("kids") - F.col("e"), F.lit(700.0)))))
        top = F.greatest("e", "kids")
        rows = rows.withColumn("lw", top + F.ln(F.exp(F.col("e") - top) + F.exp(F.col("kids") - top)) - math.log(2))
        above = levels[d] = shared.write(rows.select("ctx", "q", "a", "b", "w", "lw", "deepest"))
    mixed = None  # m: what the depths down to here add to the probability of a one; rest: the weight of all that lie deeper
    ends = []
    own = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    for d in range(depth + 1):
        rows = levels[d]
        if mixed is None:
            rows = rows.withColumn("m", F.lit(0.0)).withColumn("rest", F.lit(1.0))
        else:
            rows = rows.withColumn("up", F.col("ctx").bitwiseAND((1 << 8 * (d - 1)) - 1)).join(mixed.select(F.col("ctx").alias("up"), "q", "m", "rest").hint("merge"), ["up", "q"])
        mixed = rows.select("ctx", "q", (F.col("m") + F.col("rest") * F.col("w") * own).alias("m"), (F.col("rest") * (1 - F.col("w"))).alias("rest"), "deepest")
        if d < depth:
            mixed = shared.write(mixed)
        ends.append(mixed.where("deepest").drop("deepest"))
    end = ends[0]
    for some in ends[1:]:
        end = end.unionByName(some)
    p = leaves.join(end.hint("merge"), ["ctx", "q"]).select("ctx", "q", *((F.col("m") + F.col("rest") * (F.col(f"b{j}") + 0.5) / (F.col(f"a{j}") + F.col(f"b{j}") + 1.0)).alias(f"p{j}") for j in range(k)))
    total = sum((F.col(f"c{j}") for j in range(1, k)), F.col("c0"))
    each = bits.select("key", "ctx", "q", "bit", total.alias("n")).join(p.hint("merge"), ["ctx", "q"])
    lp = F.array(*(F.sum(F.log10(F.when(one, F.col(f"p{j}")).otherwise(1 - F.col(f"p{j}")))) for j in range(k)))
    return each.groupBy("key").agg(F.max("n").alias("n"), lp.alias("lp"))


def most_frequent(rows: DataFrame, n: str, most: int) -> DataFrame:
    """Rows whose count ``n`` is at least such a bound that there are at most ``most`` of them: the bound is found on a histogram
    of counts with eight steps for each power of two."""
    step = F.floor(8 * F.log2(F.col(n) + 1.0))
    held, bound = 0, None
    for r in sorted(rows.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > most:
            break
        bound = r["s"]
    return rows.limit(0) if bound is None else rows.where(step >= bound)


class Coder:
    """A broadcast table of log10 probabilities by class; keys are looked up where a task needs them."""

    def __init__(self, keys, lp: np.ndarray):
        self.keys, self.lp, self.at = keys, lp, None

    def __getstate__(self):
        return self.keys, self.lp

    def __setstate__(self, state):
        self.keys, self.lp = state
        self.at = None


def matrix(column: pa.ChunkedArray, k: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) if len(flat) else np.zeros((0, k))


def coded_words(vocabulary: DataFrame, scores: DataFrame, k: int, shared: Shared, depth: int = DEPTH, top: int = TOP_GRAMS) -> DataFrame:
    """word, n (its count) and lp (log10 of its probability by class) of each word."""
    table = most_frequent(scores, "n", top).select("key", "lp").toArrow()
    key = table.column("key").to_numpy()
    order = np.argsort(key)
    held = vocabulary.sparkSession.sparkContext.broadcast(Coder(key[order], matrix(table.column("lp"), k)[order]))
    total = sum((F.col(f"c{j}") for j in range(1, k)), F.col("c0"))

    def run(batches):
        keys, lp = held.value.keys, held.value.lp
        for batch in slices(batches, "word"):
            some = batch.column("word")
            key, of = grams(some.to_pylist(), depth)
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            sums = np.stack([np.bincount(of[known], weights=lp[at[known], j], minlength=len(some)) for j in range(k)], axis=1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[~known], minlength=len(some)))])
            yield pa.RecordBatch.from_arrays(
                [some, batch.column("n"), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), k).cast(pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[~known]))],
                ["word", "n", "lp", "missing"],
            )

    first = shared.write(vocabulary.select("word", total.alias("n")).mapInArrow(run, "word binary, n long, lp array<double>, missing array<long>"))
    # Words with pieces that the broadcast table lacks: these are added up by the word's place in a table of such words.
    short = shared.write(first.where(F.size("missing") > 0).withColumn("place", F.monotonically_increasing_id()))
    asked = short.select("place", F.explode("missing").alias("key")).groupBy("place", "key").count()
    more = asked.join(scores.select("key", F.col("lp").alias("more")).hint("merge"), "key").groupBy("place").agg(*(F.sum(F.col("count") * F.col("more")[j]).alias(f"m{j}") for j in range(k)))
    whole = short.join(more.hint("merge"), "place").select("word", "n", F.array(*(F.col("lp")[j] + F.col(f"m{j}") for j in range(k))).alias("lp"))
    return shared.write(first.where(F.size("missing") == 0).drop("missing").unionByName(whole))


@dataclass
class Model:
    table: DataFrame  # word, n, lp
    prior: list[float]  # log10 of the share of each class
    tokens: int  # N
    distinct: int  # V
    classes: list[str] = field(default_factory=list)


def train(docs: DataFrame, depth: int = DEPTH, classes: int = CLASSES, top_grams: int = TOP_GRAMS) -> Model:
    """Learns from the rows of docs (doc_id, text, and lang if there is one) whose crc32(doc_id) % 5 is not 1, all of them.

    The most frequent ``classes`` languages are classes; all others, and rows without one, are a class together. The words of
    rows held out are coded with the rest, but not counted.
    """
    shared = Shared(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang" if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    learnt = docs.where(~held_out(F.col("doc_id"), 5, 1))
    frequent = learnt.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(classes).collect()
    names, sizes = [r["lang"] for r in frequent], [r["count"] for r in frequent]
    rest = learnt.count() - sum(sizes)
    if rest or not names:
        sizes.append(rest)
    k = len(sizes)
    vocabulary = shared.write(counted(docs, names, k))
    total = sum((F.col(f"c{j}") for j in range(1, k)), F.col("c0"))
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum(total), F.lit(0)), F.count_if(total > 0)).first()
    scores = shared.write(gram_scores(shared.write(gram_counts(vocabulary, k, depth)), k, shared, depth))
    table = coded_words(vocabulary, scores, k, shared, depth, top_grams)
    shared.drop(vocabulary)
    prior = [math.log10((n + 0.5) / (sum(sizes) + 0.5 * k)) for n in sizes]
    return Model(table, prior, tokens, distinct, names)


PARTIAL = "doc_id {0}, n_tokens long, n_bytes long, n_known long, base double, lp array<double>, rare array<struct<word:binary,n:long>>"


def scored(docs: DataFrame, model: Model, top: int = TOP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs (doc_id, text).

    n_tokens counts words and the end; score is the log10 of the text's probability, base_score that of counted words alone,
    bits_per_byte the code length over the bytes of the words, their blanks and the end. A null or empty text is an end.
    Whole texts are read, very long ones in pieces. A null doc_id is not held out. Repeated rows are scored one by one, their
    words once. docs are rows that ``train`` has seen, so every word is in its table. With nothing to learn from every bit is
    even. An empty table gives an empty result. Only doc_id and text are read, so other columns cannot clash.
    """
    shared = Shared(docs.sparkSession)
    k = len(model.prior)
    some = most_frequent(model.table.where(F.octet_length("word") <= WORD_BYTES), "n", top).select("word", "n", "lp").toArrow()
    keys = some.column("word").combine_chunks()
    count = some.column("n").to_numpy().astype(np.float64)
    # Every broadcast word's own numbers in one row: known or not, base, then the classes.
    weights = np.column_stack([count > 0, np.log10((count + 0.5) / (model.tokens + 0.5 * (model.distinct + 1))), matrix(some.column("lp"), k)])
    held = docs.sparkSession.sparkContext.broadcast(Coder(keys, weights))

    def run(batches):
        coder = held.value
        if coder.at is None:
            coder.at = {w: i for i, w in enumerate(coder.keys.to_pylist())}
        place, weights = coder.at.get, coder.lp
        for batch in slices(batches):
            rows, rare = [], []
            for text in batch.column("text").cast(pa.binary()):
                found = counts_of(text.as_py())
                at = [place(w, -1) for w in found]
                index, n = np.array(at), np.fromiter(found.values(), np.int64, len(found))
                inside = index >= 0
                sums = n[inside] @ weights[index[inside]]
                rows.append((int(n.sum()), sum((len(w) + 1) * m for w, m in found.items()), int(sums[0]), float(sums[1]), sums[2:]))
                rare.append([{"word": w, "n": m} for (w, m), i in zip(found.items(), at, strict=True) if i < 0])
            n_tokens, n_bytes, known, base, lp = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_tokens, n_bytes, known)), pa.array(base, pa.float64()), pa.array([x.tolist() for x in lp], pa.list_(pa.float64())), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                ["doc_id", "n_tokens", "n_bytes", "n_known", "base", "lp", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Rows are numbered where they are written, so that the numbers stay whatever is computed again.
    partial = shared.write(docs.select("doc_id", "text").mapInArrow(run, PARTIAL.format(kind)).withColumn("row", F.monotonically_increasing_id()))
    asked = partial.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("m"))
    m = F.col("m")
    base = F.log10((F.col("n") + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
    more = asked.join(model.table.hint("merge"), "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, m).otherwise(0)).alias("known"), F.sum(m * base).alias("more"), *(F.sum(m * F.col("lp")[j]).alias(f"m{j}") for j in range(k))
    )
    none = F.lit(0.0)
    rows = partial.drop("rare").join(more.hint("merge"), "row", "left").withColumn("by_class", F.array(*(F.col("lp")[j] + F.coalesce(f"m{j}", none) + model.prior[j] for j in range(k))))
    best = F.array_max("by_class")
    score = best + F.log10(F.aggregate(F.transform("by_class", lambda x: F.pow(F.lit(10.0), x - best)), none, lambda a, x: a + x))
    out = rows.select(
        "doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", none)).alias("base_score"), score.alias("score"), "n_bytes",
    )
    return out.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / F.col("n_bytes")).drop("n_bytes")
