"""Periodic runs of words, by Kruskal's algorithm on longest common prefixes.

The suffixes of a text's words are sorted by prefix doubling, and neighbours in that order have the longest common prefixes
(LCP). Taken from the longest down, each unites two classes of suffixes that agree on so many words, with union-find over
ordered sets of positions. Where a union makes positions x < y neighbours in their set and y - x <= LCP, the words from x to
y + LCP have smallest period y - x: a run, which the seeds of one period and one end share, the first of them its start.

A run has six words at least and four periods, so an LCP under five matters to none: texts without a repeated sequence of
five words are done after one sort, and no shorter LCP is united. The arrays hold all texts of a slice together, words of
different texts being different. Everything happens where a row lies; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Words of a run at least, and its periods; the LCP below which no run begins.
LEAST_WORDS, LEAST_PERIODS, LEAST_LCP = 6, 4, 5
#: Positions in one bucket of an ordered set.
BUCKET = 512


class Positions:
    """An ordered set of positions in buckets; ``add`` tells the neighbours of what it puts in."""

    __slots__ = ("buckets", "last", "size")

    def __init__(self, first: int):
        self.buckets, self.last, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        buckets, last = self.buckets, self.last
        k = bisect_left(last, x)
        self.size += 1
        if k == len(last):
            k -= 1
            bucket = buckets[k]
            below, above = bucket[-1], None
            bucket.append(x)
            last[k] = x
        else:
            bucket = buckets[k]
            at = bisect_left(bucket, x)
            above = bucket[at]
            below = bucket[at - 1] if at else last[k - 1] if k else None
            bucket.insert(at, x)
        if len(bucket) > 2 * BUCKET:
            buckets[k : k + 1] = [bucket[:BUCKET], bucket[BUCKET:]]
            last.insert(k, bucket[BUCKET - 1])
        return below, above

    def __iter__(self) -> Iterator[int]:
        for bucket in self.buckets:
            yield from bucket


def rebuilt(words: list, doc_id: int | None) -> list:
    """The words, of every tenth document (by crc32 of its id) with a period from some place on; a null id changes nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def suffix_edges(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the order of suffixes, and their LCP where it is LEAST_LCP or more, from the longest down.

    The last code must be unique and stands for no word, so that no two suffixes are equal.
    """
    n = len(code)
    rank = np.unique(code, return_inverse=True)[1].astype(np.int32)
    levels, step = [rank], 1
    while True:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(new, dtype=np.int32)])
        if new.all():
            break
        levels.append(rank)
        step *= 2
    x, y, lcp = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = x + lcp, y + lcp
        inside = np.maximum(i, j) < n
        same = np.zeros(n - 1, bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        lcp += same << k
    far = np.flatnonzero(lcp >= LEAST_LCP)
    far = far[np.argsort(-lcp[far], kind="stable")]
    return x[far], y[far], lcp[far]


def seeded(edges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[tuple[int, int], int]:
    """(period, end) -> start of each run with LEAST_WORDS words and LEAST_PERIODS periods, from such edges."""
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    found: dict[tuple[int, int], int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = parent.get(p, p)
            i = p
        return i

    for x, y, lcp in zip(*(e.tolist() for e in edges), strict=True):
        a, b = root(x), root(y)
        large, small = sets.pop(a, None) or Positions(a), sets.pop(b, None) or Positions(b)
        if large.size < small.size:
            large, small, a, b = small, large, b, a
        parent[b] = a
        sets[a] = large
        # Positions that the union makes neighbours: one of either set, with no other between them.
        pairs, last, open_ = [], None, None
        for p in small:
            below, above = large.add(p)
            if open_ is not None and open_[1] is not None and open_[1] < p:
                pairs.append(open_)
            if below is not None and below != last:
                pairs.append((below, p))
            last, open_ = p, (p, above)
        if open_ is not None and open_[1] is not None:
            pairs.append(open_)
        for i, j in pairs:
            if j - i <= lcp and lcp + j - i >= max(LEAST_WORDS, LEAST_PERIODS * (j - i)):
                key = (j - i, j + lcp)
                if i < found.get(key, i + 1):
                    found[key] = i
    return found


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs in each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids: dict = {}
    length = np.array([len(w) for w in texts], np.int64)
    word = np.fromiter((ids.setdefault(w, len(ids)) for words in texts for w in words), np.int64, int(length.sum()))
    if len(word) < LEAST_WORDS:
        return out
    # Texts with a sequence of LEAST_LCP words twice, judged by a hash: what is equal by chance is only looked at in vain.
    of = np.repeat(np.arange(len(texts)), length)
    mixed = (word + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(word) - LEAST_LCP + 1
    h = np.zeros(n, np.uint64)
    for k in range(LEAST_LCP):
        h = h * np.uint64(0xD1B54A32D192ED03) + mixed[k : k + n]
    h += of[:n].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(h)
    again = np.flatnonzero(h[order][1:] == h[order][:-1])
    asked = np.unique(of[order[again]])
    if not len(asked):
        return out
    first = np.concatenate([[0], np.cumsum(length)])
    parts, starts, at = [], [], 0
    for k, d in enumerate(asked):
        part = np.concatenate([word[first[d] : first[d + 1]] + np.int64(k) * (len(ids) + 1), [np.int64(k) * (len(ids) + 1) + len(ids)]])
        parts.append(part)
        starts.append(at)
        at += len(part)
    begin = np.array(starts)
    for (period, end), x in seeded(suffix_edges(np.concatenate(parts))).items():
        k = int(np.searchsorted(begin, x, "right")) - 1
        out[asked[k]].append((x - starts[k], end - x, period))
    for some in out:
        some.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside of all repetitions: of each run only what its first period holds stays."""
    out, at = [], 0
    for begin, end in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at:begin]
        at = max(at, end)
    return out + words[at:] if at else words


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def periodic_runs(docs: DataFrame, rebuild: bool = True, texts: bool = False) -> DataFrame:
    """doc_id and the digest of its runs (SCHEMA) for each row of docs (doc_id, text).

    ``rebuild`` gives every tenth document a period first, as the query wants it; ``texts`` adds the runs themselves
    (array of start, length, period) and the text without repetitions.

    Words are what lies between blanks, compared as they are. A null or empty text has no words and no runs: null start,
    length, period and exponent. Of runs of equal length the one with the smallest start, then period is told. Whole texts
    are searched, very long ones alone, with about 100 bytes of memory a word and twenty more for each doubling of the
    longest repetition. Repeated rows are judged one by one; an empty table gives an empty result. Only doc_id and text are
    read, so other columns cannot clash.
    """
    extra = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if texts else ""

    def run(batches):
        for batch in slices(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            ids = batch.column("doc_id").to_pylist()
            words = [(t or b"").split() for t in raw]
            if rebuild:
                words = [rebuilt(w, i) for w, i in zip(words, ids, strict=True)]
            found = runs_of(words)
            columns = list(zip(*map(_digest, words, found), strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if texts:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                arrays.append(pa.array([[{"start": s, "length": n, "period": q} for s, n, q in some] for some in found], kind))
                arrays.append(pa.array([b" ".join(collapsed(w, some)).decode("utf-8", "surrogatepass") for w, some in zip(words, found, strict=True)], pa.string()))
                names += ["runs", "collapsed"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}{extra}")
