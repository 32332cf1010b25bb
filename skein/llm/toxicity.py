"""Toxicity by a linear-chain conditional random field.

Two tags, toxic and other, over the words of a sequence. Words score by hashed features (the word, its prefixes and
suffixes), neighbours by a 2 x 2 table; forward-backward gives each word its marginal. A logistic curve over the
marginals of a document gives its score; runs of words with a marginal of a half or more are its offending offsets.

The labels are of documents, so the words of the training sample are labelled first: features (word families) whose
document frequency in toxic documents far exceeds that in others are chosen greedily until the toxic documents are
explained, and the words of toxic documents that have one are tagged toxic. The sample is bounded (TRAIN documents and
TRAIN_BYTES of text for each label, smallest hash of doc_id first); scoring reads every whole text where it lies, without
a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, held_out, slices

#: Labelled documents of each class that the model is fitted on, and bytes of their texts, at most.
TRAIN, TRAIN_BYTES = 1500, 12 << 20
BUCKETS = 1 << 16
#: A sequence ends with a sentence or after this many words.
LONGEST = 128
MAX_WORDS = 300_000
_sentence_end = re.compile(r"[.!?]\W*$").search
_edges = re.compile(r"^[\W_]+|[\W_]+$")
_chunk = re.compile(r"\S+").finditer


def families(word: str) -> list[str]:
    """The features of a word: itself, and its prefixes of three to six and suffixes of three to four letters."""
    w = _edges.sub("", word)
    if not w or w.isdigit():
        return []
    return ["=" + w, *("<" + w[:k] for k in range(3, 7) if len(w) > k), *(">" + w[-k:] for k in (3, 4) if len(w) > k)]


def hashed(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in features]


@dataclass
class Model:
    weight: np.ndarray  # of toxic against other, by hashed feature
    bias: float
    pair: np.ndarray  # 2 x 2: other, toxic
    curve: np.ndarray  # of the document score: constant, then for each of document_features


def _through(r: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-odds of the next tag, for log-odds r of this one."""
    return np.logaddexp(table[0, 1], table[1, 1] + r) - np.logaddexp(table[0, 0], table[1, 0] + r)


def messages(score: np.ndarray, first: np.ndarray, length: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward (own score included) and backward messages of the sequences [first, first + length) as log-odds of toxic.

    All sequences move one word a step, the longest come first, so that step t touches a prefix of them.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    fwd, bwd = score.copy(), np.zeros_like(score)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps + 1), side="left")  # sequences longer than t
    for t in range(1, steps):
        at = first[: active[t]] + t
        fwd[at] += _through(fwd[at - 1], pair)
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        bwd[at] = _through(bwd[at + 1] + score[at + 1], pair.T)
    return fwd, bwd


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def expected_pairs(score, fwd, bwd, inner, pair) -> np.ndarray:
    """Expected counts of the 2 x 2 neighbouring tags; inner: words that have a successor in their sequence."""
    a, b = fwd[inner], (bwd + score)[inner + 1]
    logs = np.stack([pair[0, 0] + 0 * a, pair[0, 1] + b, pair[1, 0] + a, pair[1, 1] + a + b])
    probs = np.exp(logs - logs.max(axis=0))
    return (probs / probs.sum(axis=0)).sum(axis=1).reshape(2, 2)


def tag_families(docs: list[list[str]], toxic: list[bool]) -> set[str]:
    """The features whose words are tagged in toxic documents; docs: the chunks of each, in lower case.

    Each step takes the feature with the most weight of toxic documents, less three times its rate in the others; words
    that have a chosen feature leave the count, and a document's weight halves each time it is explained.
    """
    holders: dict[str, dict[int, int]] = defaultdict(dict)  # feature -> toxic document -> words that have it
    has: dict[str, list[str]] = {}
    owners: dict[str, list[int]] = defaultdict(list)
    for i in np.flatnonzero(toxic).tolist():
        for w in sorted({_edges.sub("", c) for c in docs[i]}):
            fs = has.get(w)
            if fs is None:
                fs = has[w] = [f for f in families(w) if f[0] != ">"]
            owners[w].append(i)
            for f in fs:
                holders[f][i] = holders[f].get(i, 0) + 1
    n_toxic, n_clean = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    least = max(3.0, 0.01 * n_toxic)
    ratio = n_toxic / n_clean
    holders = {f: h for f, h in holders.items() if len(h) >= least}
    # Of the other documents only the features that are still in question are counted, and no word is kept.
    clean_df: Counter[str] = Counter()
    for i in np.flatnonzero(~np.array(toxic, bool)).tolist():
        clean_df.update({f for w in {_edges.sub("", c) for c in docs[i]} for f in families(w) if f in holders})
    weight = np.ones(len(docs))
    holders = {f: h for f, h in holders.items() if len(h) - 3 * ratio * clean_df[f] >= least and len(h) >= 0.8 * (len(h) + ratio * clean_df[f])}
    has = {w: [f for f in fs if f in holders] for w, fs in has.items() if w in owners}
    by_family = defaultdict(list)
    for w in owners:
        for f in has[w]:
            by_family[f].append(w)
    chosen: set[str] = set()
    while holders:
        gain = {f: sum(weight[i] for i in h) - 3 * ratio * clean_df[f] for f, h in holders.items()}
        best = max(gain, key=lambda f: (gain[f], len(f), f))
        if gain[best] < least:
            break
        chosen.add(best)
        weight[list(holders[best])] /= 2
        for w in by_family[best]:
            for i in owners.pop(w, ()):
                for f in has[w]:
                    if f in holders and i in holders[f]:
                        holders[f][i] -= 1
                        if not holders[f][i]:
                            del holders[f][i]
        holders = {f: h for f, h in holders.items() if h and f != best}
    return chosen


class Lexicon:
    """Scores of white-space separated chunks, remembered up to MAX_WORDS."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.score, self.ends = np.zeros(1024), np.zeros(1024, bool)

    def of(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk in ``score`` and ``ends``."""
        if len(self.at) > MAX_WORDS:
            self.clear()
        at = self.at
        for c in set(chunks).difference(at):
            k = at[c] = len(at)
            if k == len(self.score):
                self.score, self.ends = np.concatenate([self.score, self.score]), np.concatenate([self.ends, self.ends])
            self.score[k] = self.model.bias + self.model.weight[hashed(families(c))].sum()
            self.ends[k] = _sentence_end(c) is not None
        return np.fromiter(map(at.__getitem__, chunks), np.int64, len(chunks))


def sequences(ends: np.ndarray, doc_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each sequence; ends: where a sentence ends, doc_first: where documents begin."""
    n = len(ends)
    begin = np.zeros(n + 1, bool)
    begin[1:] |= ends
    begin[doc_first[doc_first < n]] = True
    begin[0] = True
    first = np.flatnonzero(begin[:n])
    length = np.diff(np.append(first, n))
    pieces = -(-length // LONGEST)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * LONGEST
        length = np.diff(np.append(first, n))
    return first, length


def document_features(p: np.ndarray, n_words: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
    """Of each document: constant, log of 1 + expected toxic words, share of them, and the largest marginal."""
    total, most = np.zeros(len(n_words)), np.zeros(len(n_words))
    some = n_words > 0
    if some.any():
        total[some] = np.add.reduceat(p, doc_first[some])
        most[some] = np.maximum.reduceat(p, doc_first[some])
    return np.stack([np.ones(len(n_words)), np.log1p(total), np.sqrt(total / np.maximum(n_words, 1)), most], axis=1)


def tagged(texts: list[str | None], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the words of all texts, the number of words and the first word of each text."""
    chunks = [(t or "").lower().split() for t in texts]
    n_words = np.fromiter(map(len, chunks), np.int64, len(chunks))
    doc_first = np.cumsum(n_words) - n_words
    at = lexicon.of([c for d in chunks for c in d])
    if not len(at):
        return np.zeros(0), n_words, doc_first
    score = lexicon.score[at]
    fwd, bwd = messages(score, *sequences(lexicon.ends[at], doc_first), lexicon.model.pair)
    return sigmoid(fwd + bwd), n_words, doc_first


def fit(docs: list[tuple[str, int]], rounds: int = 60, seed: int = 0) -> Model:
    """A model for (text, label) pairs; without both labels its score is the share of label 1, a quarter without any."""
    model = Model(np.zeros(BUCKETS), -4.0, np.zeros((2, 2)), np.zeros(4))
    labels = np.array([y for _, y in docs], float)
    if not len(docs) or labels.min() == labels.max():
        share = (labels.sum() + 0.25) / (len(labels) + 1)
        model.curve[0] = np.log(share / (1 - share))
        return model
    chunks = [(t or "").lower().split() for t, _ in docs]
    chosen = tag_families(chunks, [y == 1 for y in labels])
    # Training sequences: those that hold a word of a chosen family, and as many others of either label.
    vocabulary: dict[str, int] = {}
    marked: list[bool] = []
    ids, first, with_family, tags = [], [], [], []
    for d, y in zip(chunks, labels, strict=True):
        ends = np.array([_sentence_end(c) is not None for c in d], bool)
        if not d:
            continue
        a, n = sequences(ends, np.zeros(1, np.int64))
        numbers = []
        for c in d:
            k = vocabulary.setdefault(c, len(vocabulary))
            if k == len(marked):
                marked.append(not chosen.isdisjoint(families(c)))
            numbers.append(k)
        for s, m in zip(a.tolist(), n.tolist(), strict=True):
            part = numbers[s : s + m]
            first.append(len(ids))
            with_family.append(any(marked[k] for k in part))
            ids += part
            tags += [bool(y) and marked[k] for k in part]
    first, word, tag, with_family = np.array(first), np.array(ids), np.array(tags, float), np.array(with_family)
    length = np.diff(np.append(first, len(word)))
    others = np.flatnonzero(~with_family)
    pick = np.concatenate([np.flatnonzero(with_family), np.random.default_rng(seed).permutation(others)[: max(2000, 2 * with_family.sum())]])
    keep = np.concatenate([np.arange(first[i], first[i] + length[i]) for i in pick])
    word, tag, length = word[keep], tag[keep], length[pick]
    first = np.cumsum(length) - length
    inner = np.setdiff1d(np.arange(len(word)), first + length - 1, assume_unique=True)

    used, word = np.unique(word, return_inverse=True)
    spelled = list(vocabulary)
    features = [hashed(families(spelled[k])) for k in used]
    del vocabulary, spelled, ids, tags, marked
    of_word = np.repeat(np.arange(len(features)), [len(f) for f in features])
    feature = np.array([f for fs in features for f in fs], np.int64)
    counts = np.zeros((2, 2))
    np.add.at(counts, (tag[inner].astype(int), tag[inner + 1].astype(int)), 1)
    theta, memory = np.zeros(BUCKETS + 5), np.full(BUCKETS + 5, 1e-8)
    theta[BUCKETS] = model.bias
    for _ in range(rounds):
        pair = theta[BUCKETS + 1 :].reshape(2, 2)
        scores = theta[BUCKETS] + np.bincount(of_word, theta[feature], len(features))
        score = scores[word]
        fwd, bwd = messages(score, first, length, pair)
        p = sigmoid(fwd + bwd)
        slack = np.bincount(word, p - tag, len(features))
        step = np.zeros_like(theta)
        step[:BUCKETS] = np.bincount(feature, slack[of_word], BUCKETS) + 0.05 * theta[:BUCKETS]
        step[BUCKETS] = slack.sum()
        step[BUCKETS + 1 :] = (expected_pairs(score, fwd, bwd, inner, pair) - counts).ravel() + 0.1 * theta[BUCKETS + 1 :]
        memory += step * step
        theta -= 0.5 * step / np.sqrt(memory)
    model = Model(theta[:BUCKETS].copy(), float(theta[BUCKETS]), theta[BUCKETS + 1 :].reshape(2, 2).copy(), np.zeros(4))

    lexicon, rows = Lexicon(model), []
    for i in range(0, len(docs), 200):
        rows.append(document_features(*tagged([t for t, _ in docs[i : i + 200]], lexicon)))
    model.curve[:] = logistic(np.concatenate(rows), labels)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Ridge logistic regression by Newton steps; both labels weigh the same."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * len(y) * 0.01 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge * len(y) * 0.01 + 1e-6) * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    return w


def train(docs: DataFrame, labels: DataFrame, size: int = TRAIN) -> Model:
    """A model from the labelled documents that are not held out, at most ``size`` of each label.

    labels(doc_id, toxic): null labels are left out; a document with several labels has the largest. Of a doc_id with
    several rows the text with the smallest hash counts. A text that does not fit into what is left of TRAIN_BYTES is passed
    over. Null and empty texts teach nothing; without both labels the score is the share of label 1, a quarter without any.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label"))
    order = F.xxhash64("doc_id"), "doc_id"
    sample = usable.where("label = 1").orderBy(*order).limit(size).unionByName(usable.where("label = 0").orderBy(*order).limit(size))
    texts = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    shared = Shared(docs.sparkSession)
    held = shared.write(texts.withColumn("size", F.octet_length("text")))
    left, chosen = [TRAIN_BYTES, TRAIN_BYTES], []
    for r in held.select("doc_id", "label", "size").orderBy(*order).collect():  # 2 * size rows of three numbers
        if r["size"] <= left[r["label"]]:
            left[r["label"]] -= r["size"]
            chosen.append((r["doc_id"],))
    ids = docs.sparkSession.createDataFrame(chosen, docs.select("doc_id").schema)
    seen = {r["doc_id"]: (r["text"], r["label"]) for r in held.join(F.broadcast(ids), "doc_id").toLocalIterator()}
    shared.drop(held)
    return fit([seen[k] for k in sorted(seen)])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_words and offsets (start, end in code points) for each row of docs.

    Null, empty and blank texts have no words; their score is that of a document without toxic words. Whole texts are
    scored, very long ones too. Repeated rows are scored one by one; an empty table gives an empty result. Only doc_id and
    text are read, so other columns cannot clash.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(held.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            p, n_words, doc_first = tagged(texts, lexicon)
            score = sigmoid(document_features(p, n_words, doc_first) @ lexicon.model.curve)
            spans: list[list[dict]] = [[] for _ in texts]
            hits = np.flatnonzero(p >= 0.5)
            hit_doc = np.searchsorted(doc_first, hits, side="right") - 1 if len(hits) else hits
            for i in np.unique(hit_doc):
                # The last of documents that begin at one place is the one with words.
                mine = set((hits[hit_doc == i] - doc_first[i]).tolist())
                for k, m in enumerate(_chunk(texts[i])):
                    if k in mine:
                        if spans[i] and k - 1 in mine:
                            spans[i][-1]["end"] = m.end()
                        else:
                            spans[i].append({"start": m.start(), "end": m.end()})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "score", "offsets"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, offsets array<struct<start:long,end:long>>")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offsets")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that score below a half; decided where the row lies.

    Null, empty and blank texts are judged as documents without toxic words. Repeated rows are judged one by one and keep
    their order of columns and values; columns of any name besides text pass through untouched. An empty table gives an
    empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(held.value)
        for batch in slices(batches):
            score = sigmoid(document_features(*tagged(batch.column("text").to_pylist(), lexicon)) @ lexicon.model.curve)
            yield batch.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, docs.schema)
