"""Text quality by positive-unlabelled learning.

A linear model over the shapes of the words and a few figures of the document minimises the non-negative unbiased risk:
trusted positives (label 1) and unlabelled web text stand for the two classes, the class prior is estimated from the
labelled share, and where the estimated risk of the negative class turns negative its gradient is reversed.

The fit uses a bounded sample (TRAIN positives and twice as many unlabelled documents, smallest hash first); of each only
its features reach the driver, BUCKETS + N_FIGURES numbers whatever its length. Scoring reads every whole text where it
lies, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled, slices

TRAIN, BUCKETS, MAX_WORDS, PIECE = 1500, 1024, 300_000, 64
THRESHOLD = 0.3
_runs = re.compile(r"[^\W\d_]+|\d+|(.)\1*", re.S)


def shapes(piece: str) -> list[str]:
    """Letters by case, digits as 9, other characters as they are, runs of one character cut to two: a shape for every six runs."""
    out = []
    for m in _runs.finditer(piece):
        s = m.group()
        if m.group(1):
            out.append(s[:2])
        elif s[0].isdigit():
            out.append("9")
        else:
            out.append("A" if s.isupper() and len(s) > 1 else "a" if s.islower() else "Aa" if s[1:].islower() or len(s) == 1 else "aA")
    end = "~" if len(piece) > 24 else ""
    return ["".join(out[i : i + 6]) + end for i in range(0, len(out), 6)]


def buckets(piece: str) -> list[int]:
    return [zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS for s in shapes(piece)]


class Shapes:
    """Buckets of pieces, remembered up to MAX_WORDS."""

    def __init__(self):
        self.at: dict[str, list[int]] = {}

    def of(self, chunks: list[str]) -> np.ndarray:
        """The buckets of all shapes of the chunks; a chunk of more than PIECE characters is cut into pieces."""
        if len(self.at) > MAX_WORDS:
            self.at = {}
        at = self.at
        if max(map(len, chunks)) > PIECE:
            chunks = [c[i : i + PIECE] for c in chunks for i in range(0, len(c), PIECE)]
        for c in set(chunks).difference(at):
            at[c] = buckets(c)
        return np.fromiter(chain.from_iterable(map(at.__getitem__, chunks)), np.int64)


def figures(text: str, chunks: list[str]) -> list[float]:
    """Length, share of distinct words, of words equal to one of the two before, of repeated lines, and the mean word length."""
    n = max(1, len(chunks))
    lines = [x for x in text.split("\n") if x]
    again = sum(map(str.__eq__, chunks, chunks[1:])) + sum(map(str.__eq__, chunks, chunks[2:]))
    return [
        float(np.log1p(len(chunks))),
        len(set(chunks)) / n,
        float(np.log(len(set(chunks)) + 1) / np.log(n + 2)),
        again / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(lines)) - np.log1p(len(chunks))),
        len(text) / n / 10,
    ]


N_FIGURES = 7


@dataclass
class Model:
    shapes: np.ndarray
    figures: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float


def _features(texts: list[str], known: Shapes) -> tuple[np.ndarray, np.ndarray]:
    x, f = np.zeros((len(texts), BUCKETS), np.float32), np.zeros((len(texts), N_FIGURES))
    for i, t in enumerate(texts):
        chunks = t.split()
        if chunks:
            at = known.of(chunks)
            x[i] = np.sqrt(np.bincount(at, minlength=BUCKETS) / len(at))
        f[i] = figures(t, chunks)
    return x, f


def fit(positive: list[str], unlabelled: list[str], prior: float) -> Model:
    known = Shapes()
    return fit_features(*_features(positive, known), *_features(unlabelled, known), prior)


def fit_features(xp: np.ndarray, fp: np.ndarray, xu: np.ndarray, fu: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05) -> Model:
    """A model from the shares of shapes (x) and the figures (f) of positives and of unlabelled documents."""
    both = np.concatenate([fp, fu]) if len(fp) + len(fu) else np.zeros((1, N_FIGURES))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    model = Model(np.zeros(BUCKETS), np.zeros(N_FIGURES), float(np.log(prior / (1 - prior))), mean, scale, prior)
    if not len(xp) or not len(xu):
        return model
    p = np.hstack([xp, ((fp - mean) / scale).clip(-5, 5), np.ones((len(xp), 1))])
    u = np.hstack([xu, ((fu - mean) / scale).clip(-5, 5), np.ones((len(xu), 1))])
    w, m1, m2 = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    w[-1] = model.bias
    for step in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp.clip(-30, 30))), 1 / (1 + np.exp(-zu.clip(-30, 30)))
        as_positive = prior * (p.T @ (sp - 1)) / len(p)  # gradient of the positives' loss as positives
        negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)  # and of the negatives' estimated loss
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gradient = (as_positive + negative if risk >= 0 else -negative) + 1e-3 * np.r_[w[:-1], 0]
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model(w[:BUCKETS], w[BUCKETS:-1], float(w[-1]), mean, scale, prior)


def score(texts: list[str | None], model: Model, known: Shapes) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        t = t or ""
        chunks = t.split()
        z = model.bias + model.figures @ ((figures(t, chunks) - model.mean) / model.scale).clip(-5, 5)
        if chunks:
            at = known.of(chunks)
            z += model.shapes @ np.sqrt(np.bincount(at, minlength=BUCKETS) / len(at))
        out[i] = z
    return 1 / (1 + np.exp(-out.clip(-40, 40)))


def train(docs: DataFrame, labels: DataFrame, size: int = TRAIN) -> Model:
    """A model from documents that are not held out: ``size`` positives and twice as many unlabelled, at most.

    labels(doc_id, quality): null labels are left out; a document with several labels has the smallest. Repeated rows count
    once: of a doc_id with several texts, a positive is the one with the smallest hash, and the unlabelled are distinct rows.
    The class prior is the share of label 1 among all labels that are not held out (one half where there are none). Without
    positives or without documents the score is the prior.
    """
    usable = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("label"))
    counts = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    prior = (counts["ones"] + 0.5) / (counts["n"] + 1)
    ids = usable.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).select("doc_id")
    rows = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trusted = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(F.lit(1).alias("label"), "text")
    web = sampled(rows, 2 * size).select(F.lit(0).alias("label"), "text")

    def features(batches):
        known = Shapes()
        for batch in slices(batches):
            x, f = _features(batch.column("text").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(np.hstack([x, f])), pa.list_(pa.float64()))], ["label", "x"])

    found: list[list[np.ndarray]] = [[], []]
    for r in trusted.unionByName(web).mapInArrow(features, "label int, x array<double>").toLocalIterator():
        found[r["label"]].append(np.array(r["x"]))
    u, p = (np.array(sorted(rows, key=lambda x: x.tobytes())).reshape(-1, BUCKETS + N_FIGURES) for rows in found)
    return fit_features(p[:, :BUCKETS], p[:, BUCKETS:], u[:, :BUCKETS], u[:, BUCKETS:], min(max(prior, 0.01), 0.99))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts have a score too, that of a text without words. Whole texts are scored, very long ones too. Repeated
    rows are scored one by one; an empty table gives an empty result. Only doc_id and text are read, so other columns cannot
    clash.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = Shapes()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text").to_pylist(), held.value, known), pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
