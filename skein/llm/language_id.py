"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its words' character n-grams, hashed into BUCKETS rows; a softmax over it is
trained by stochastic gradient descent in numpy. As embedding and softmax are linear, a word's share of the scores is
computed once and remembered. A temperature and a rejection threshold are fitted on a part of the sample that training
does not see: ``rejected`` marks texts whose calibrated probability is lower than all but REJECT of those.

The fit uses a bounded sample of distinct rows: PER_LANGUAGE documents of each language, fewer where there are so many
languages that these would be more than SAMPLE, but LEAST at least: no language is left out. Of a document of the sample
only its counts of at most BUCKETS n-grams reach the driver, whatever its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, sampled, slices

PER_LANGUAGE, SAMPLE, LEAST, BUCKETS, DIM = 800, 20_000, 20, 1 << 14, 16
#: Sums that a worker remembers: so many chunks, and so many numbers.
MAX_WORDS, MAX_SUMS = 300_000, 8 << 20
REJECT = 0.01
_word = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode category L is in the text (number forms such as one half are none)."""
    return any(c.isalpha() for m in _word.finditer(text) for c in m.group())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of each n-gram of two to five letters of the words between marks, hashed all at once."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(marked)), np.fromiter(map(len, marked), np.int64, len(marked)))
    owners, buckets = [], []
    h = code * np.uint64(0x9E3779B97F4A7C15)
    for n in range(2, 6):
        if len(code) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :]
        inside = of[: len(h)] == of[n - 1 :]
        owners.append(of[: len(h)][inside])
        buckets.append(((h[inside] * np.uint64(0x94D049BB133111EB)) >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return (np.concatenate(owners), np.concatenate(buckets)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and the share of each. A word of more than 262,144 letters counts as several."""
    counts = np.zeros(BUCKETS, np.int64)
    for piece in pieces(text.lower()):
        counts += np.bincount(subwords(_word.findall(piece))[1], minlength=BUCKETS)
    f = np.flatnonzero(counts)
    return f.astype(np.int32), (counts[f] / max(1, counts.sum())).astype(np.float32)


def fit(docs: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 0) -> Model:
    """A model for (text, lang) pairs."""
    return fit_bags([(*bag(text), y) for text, y in docs], epochs, rate, seed)


def fit_bags(some: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 6, rate: float = 0.5, seed: int = 0) -> Model:
    """A model for (buckets, shares, lang); every fifth is kept for calibration."""
    langs = sorted({y for *_, y in some})
    k = len(langs)
    model = Model(langs, np.zeros((BUCKETS, k)), np.zeros(k), 1.0, 0.0)
    bags = [(f, n, langs.index(y)) for f, n, y in some if len(f)]
    if k < 2 or not bags:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    aside, used = [bags[i] for i in order[::5]], [bags[i] for i in np.delete(order, np.s_[::5])]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    weight, bias = np.zeros((DIM, k)), np.zeros(k)
    total, done = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            f, n, y = used[i]
            step = rate * (1 - done / total)
            done += 1
            hidden = n @ embed[f]
            p = _softmax(hidden @ weight + bias)
            p[y] -= 1
            back = weight @ p
            weight -= step * np.outer(hidden, p)
            bias -= step * p
            embed[f] -= (step * len(f)) ** 0.5 * 10 * n[:, None] * back  # the average is thin; its rows learn faster
    model.table, model.bias = embed @ weight, bias
    z = np.array([n @ model.table[f] + bias for f, n, _ in aside or used])
    y = np.array([y for *_, y in aside or used])
    losses = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    model.temperature = float(min(losses, key=losses.get))
    model.threshold = float(np.quantile(_softmax(z / model.temperature).max(axis=1), REJECT))
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Predictor:
    """Sums of the model's table over the subwords of chunks, remembered up to MAX_WORDS of them."""

    def __init__(self, model: Model):
        self.model = model
        self.most = min(MAX_WORDS, MAX_SUMS // (len(model.langs) + 1))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.langs) + 1))

    def totals(self, texts: list[str]) -> np.ndarray:
        """For each text the table's sums over its n-grams, by language, and the number of n-grams."""
        if len(self.at) > self.most:
            self.clear()
        chunks = [t.split() for t in texts]
        at, model = self.at, self.model
        new = list(set().union(*chunks).difference(at))
        if new:
            k = len(at)
            at.update(zip(new, range(k, k + len(new)), strict=True))
            while len(self.sums) < len(at):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            inner = [_word.findall(c.lower()) for c in new]
            chunk_of = np.repeat(np.arange(k, k + len(new)), np.fromiter(map(len, inner), np.int64, len(inner)))
            owner, bucket = subwords([w for ws in inner for w in ws])
            for lang in range(len(model.langs)):
                self.sums[: len(at), lang] += np.bincount(chunk_of[owner], model.table[bucket, lang], len(at))
            self.sums[: len(at), -1] += np.bincount(chunk_of[owner], minlength=len(at))
        n = np.fromiter(map(len, chunks), np.int64, len(chunks))
        rows = np.fromiter((at[c] for d in chunks for c in d), np.int64, int(n.sum()))
        total = np.zeros((len(texts), self.sums.shape[1]))
        if len(rows):
            total[n > 0] = np.add.reduceat(self.sums[rows], (np.cumsum(n) - n)[n > 0], axis=0)
        return total

    def probabilities(self, texts: list[str]) -> np.ndarray:
        parts = [list(pieces(t)) for t in texts]
        if all(len(p) == 1 for p in parts):
            total = self.totals(texts)
        else:  # a long text in pieces, so that no step holds all its words
            total = np.stack([sum(self.totals([p])[0] for p in ps) for ps in parts])
        return _softmax((total[:, :-1] / np.maximum(total[:, -1:], 1) + self.model.bias) / self.model.temperature)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """A model from the documents with a lang that are not held out; a null doc_id counts as not held out.

    Repeated rows (equal doc_id, lang and text) count once. An empty table gives a model without languages.
    """
    usable = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "lang", "text")
    languages = usable.agg(F.countDistinct("lang")).first()[0]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    size = min(per_language, max(LEAST, sample // languages))

    def bags(batches):
        for batch in slices(batches):
            found = [bag(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.float32()))], ["lang", "f", "n"]
            )

    rows = sampled(usable, size, "lang").select("lang", "text").mapInArrow(bags, "lang string, f array<int>, n array<float>").toLocalIterator()
    return fit_bags(sorted(((np.array(r["f"], np.int32), np.array(r["n"], np.float32), r["lang"]) for r in rows), key=lambda x: (x[2], len(x[0]), x[0].tobytes(), x[1].tobytes())))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs (doc_id, text).

    lang_pred is "und" with score 0 where the text is null or has no letter, or no language could be learned. Of languages
    with equal probability the first in alphabetical order is chosen. Whole texts are read, long ones piece by piece. Only
    doc_id and text are read, so other columns cannot clash. Repeated rows are predicted one by one; an empty table gives
    an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predictor = Predictor(held.value)
        langs = np.array([*held.value.langs, "und"], object)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            lettered = np.array([t is not None and len(langs) > 1 and has_letter(t) for t in texts], bool)
            if len(langs) > 1:
                p = predictor.probabilities([t or "" for t in texts])
                best, score = p.argmax(axis=1), np.where(lettered, p.max(axis=1), 0.0)
            else:
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            chosen = langs[np.where(lettered, best, len(langs) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(chosen.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(score < held.value.threshold)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")
