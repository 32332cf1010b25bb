"""Sentences with offsets by rules: abbreviations, initials, decimals, quotes and orphans; and the spans that lie in them.

A text is cut after every mark that may end a sentence; whether it does is decided from the two sides of the cut. A text is
read once, in its own Arrow batch and in time proportional to its length: no shuffle brings its pieces together again.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Abbreviations whose full stop ends no sentence (fixed values).
ABBREVIATIONS = (
    "Mr. Mrs. Ms. Dr. Prof. Sr. Jr. St. Mt. vs. etc. e.g. i.e. U.S. U.K. U.N. E.U. Inc. Ltd. Co. Corp. "
    "Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec. Mon. Tue. Wed. Thu. Fri. Sat. Sun. "
    "a.m. p.m. A.M. P.M. vol. pp. ed. al. Ph.D. M.D. B.A. M.A. D.D.S."
).split()
#: Words in lower case that may begin a sentence after a full stop (fixed values).
STARTERS = ("the", "a", "an", "and", "but", "or", "so", "yet")
#: Sentences shorter than this join a neighbour.
ORPHAN = 10
_QUOTES = "\"'“”‘’«»"
_MARK = "[.!?…]"
_LETTERS, _BLANKS = string.ascii_letters, " \t\n\x0b\f\r"


def ends_with_abbreviation(before: str) -> bool:
    """Whether the letters and full stops at the end of a piece are one of ABBREVIATIONS."""
    return before[len(before.rstrip(_LETTERS + ".")) :] in ABBREVIATIONS


def ends_with_initial(before: str) -> bool:
    """A single capital before the full stop."""
    return before[-1:] == "." and "A" <= before[-2:-1] <= "Z" and (len(before) == 2 or before[-3] in _BLANKS)


def is_decimal(before: str, after: str) -> bool:
    """A full stop between digits."""
    return before[-1:] == "." and "0" <= before[-2:-1] <= "9" and "0" <= after[:1] <= "9"


def is_boundary(before: str, after: str) -> bool:
    """Whether a sentence ends between a piece that ends with a mark (and quotes) and what follows (its blanks included)."""
    bare, then = before.rstrip(_QUOTES), after.lstrip(_BLANKS)
    first = then[:1]
    lower = first == first.lower() and first != first.upper()
    if bare[-1:] in ("!", "?"):
        return not lower
    if ends_with_abbreviation(bare) or ends_with_initial(bare) or is_decimal(bare, after):
        return False
    return not lower or then[: len(then) - len(then.lstrip(_LETTERS))].lower() in STARTERS


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, idx, start, end, text of the sentences of each row of docs; the text is that of [start, end) without blanks at
    its ends. A sentence of fewer than ORPHAN characters joins the next, the last one the one before."""

    def run(batches):
        for batch in batches:
            docs_of, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                rows = _joined(_cut(text)) if text is not None else ()
                docs_of += [k] * len(rows)
                found += rows
                if len(found) >= 50_000:
                    yield made(batch, docs_of, found)
                    docs_of, found = [], []
            if found:
                yield made(batch, docs_of, found)

    def made(batch, docs_of, found):
        idx, start, end, text = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs_of)), pa.array(idx, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string())], ["doc_id", "idx", "start", "end", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, idx int, start int, end int, text string")


_cuts = re.compile(rf"(?<={_MARK})(?!{_MARK}|[{_QUOTES}])|(?<={_MARK}[{_QUOTES}])(?![{_QUOTES}])").split
_ends = re.compile(r"\s+(?=[\x85\u2028\u2029]?\Z)", re.ASCII).sub  # as Java's $, which also stands before a last line's end


def _cut(text: str) -> list[tuple[int, str]]:
    """Start and text of the sentences, orphans still apart."""
    out, at, first, before = [], 0, 0, ""
    raw: list[str] = []
    for piece in [*_cuts(text), None]:
        if raw and (piece is None or is_boundary(before, piece)):
            whole = "".join(raw)
            bare = whole.lstrip(_BLANKS)
            if trimmed := _ends("", bare):
                out.append((first + len(whole) - len(bare), trimmed))
            raw, first = [], at
        if piece is not None:
            raw.append(piece)
            before, at = piece, at + len(piece)
    return out


def _joined(cut: list[tuple[int, str]]) -> list[tuple[int, int, int, str]]:
    """idx, start, end, text. Orphans take the next sentence along, so every second of a run of them opens a new one; a last
    orphan looks back."""
    out, nth = [], 0
    for k, (start, text) in enumerate(cut):
        nth += 1
        short, last = len(text) < ORPHAN, k == len(cut) - 1
        if not out or (nth % 2 == 1 and not (short and last)):
            out.append([len(out), start, start + len(text), [text]])
        else:
            out[-1][2] = start + len(text)
            out[-1][3].append(text)
        if not short:
            nth = 0
    return [(idx, start, end, " ".join(texts)) for idx, start, end, texts in out]


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, idx, start, text of the paragraphs: what blank lines part."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").where("text is not null")
    parts = rows.select("doc_id", "row", F.posexplode(F.split("text", r"(?<=\n)(?=[^\n])(?<=\n\n)")).alias("at", "piece"))
    w = Window.partitionBy("row").orderBy("at")
    parts = parts.withColumn("start", (F.sum(F.length("piece")).over(w) - F.length("piece")).cast("int")).withColumn("text", F.regexp_replace("piece", r"\n+$", ""))
    return parts.where(F.trim("text") != "").select("doc_id", (F.row_number().over(Window.partitionBy("row").orderBy("at")) - 1).alias("idx"), "start", "text")


def in_sentence(spans: DataFrame, found: DataFrame) -> DataFrame:
    """spans (doc_id, start, end, ...) with ``sent``, the sentence in which each begins, else the first that it overlaps,
    else 0: the last sentence that begins at or before the span's end, found by one union and one window."""
    columns = spans.columns
    left = spans.select("doc_id", (F.col("end") - 1).alias("p"), F.lit(1).alias("side"), F.struct(*columns).alias("r"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("int").alias("s"))
    starts = spans.select("doc_id", F.col("start").alias("p"), F.lit(2).alias("side"), F.struct(*columns).alias("r"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("int").alias("s"))
    right = found.select("doc_id", F.col("start").alias("p"), F.lit(0).alias("side"), F.lit(None).cast(left.schema["r"].dataType).alias("r"), "idx", F.col("end").alias("s"))
    w = Window.partitionBy("doc_id").orderBy("p", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = right.unionByName(left).unionByName(starts).withColumn("last", F.last(F.when(F.col("side") == 0, F.struct("idx", F.col("p").alias("start"), F.col("s").alias("end"))), ignorenulls=True).over(w)).where("side > 0")
    inside = F.when((F.col("side") == 2) & (F.col("p") < F.col("last.end")), F.col("last.idx"))
    overlap = F.when((F.col("side") == 1) & (F.col("last.end") > F.col("r.start")), F.col("last.idx"))
    each = seen.groupBy("doc_id", "r").agg(F.coalesce(F.min(inside), F.min(overlap), F.lit(0)).alias("sent"))
    return each.select("r.*", "sent")


def around(spans: DataFrame, segments: DataFrame, reach: int = 1000) -> DataFrame:
    """seg_doc, seg_idx and the spans that overlap [start - reach, end + reach) of each segment (doc_id, idx, start, end)."""
    width = F.lit(2 * reach)
    s = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest("end", F.col("start") + 1) - 1) / width))))
    g = segments.select(F.col("doc_id").alias("seg_doc"), F.col("idx").alias("seg_idx"), (F.col("start") - reach).alias("lo"), (F.col("end") + reach).alias("hi"))
    g = g.withColumn("b", F.explode(F.sequence(F.floor(F.greatest("lo", F.lit(0)) / width), F.floor(F.col("hi") / width))))
    met = s.join(g, (F.col("doc_id") == F.col("seg_doc")) & (s["b"] == g["b"]))
    # Of the buckets in which a pair meets, the first that both have counts.
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.greatest("lo", F.lit(0)) / width))
    return met.where((F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")) & (s["b"] == first)).select("seg_doc", "seg_idx", *spans.columns)
