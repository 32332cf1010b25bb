"""URL filtering: allow and block rules, and a naive Bayes verdict over segmented names for the rest.

Host and path are split off and the rules applied with built-in functions. A url that no rule fits is scored by its
tokens: the runs of letters of its host and path are cut into words by a unigram Viterbi search, and multinomial naive
Bayes weighs them. It learns from the urls that rules decide, and from further labelled urls where the caller has any.

Word frequencies are counted over the visible text of all pages and stay a table. A name is cut with the counts of the
words that it contains, which a join on its substrings finds: of at most PREFIX letters, which is the whole of a shorter
word and the beginning of a longer one, so that a name costs PREFIX rows a letter and no word is too long to be found.
Each different name is cut once, whatever the number of urls that have it. The token counts come from a bounded sample
of the decided urls (TRAIN), smallest hash first.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, slices

#: Different urls of either verdict to learn from; letters of a word that the join goes by; words that a task counts before it hands them on.
TRAIN, PREFIX, MAX_WORDS = 20_000, 24, 200_000
#: Letters of a name whose substrings are made at once (24 for each letter).
LETTERS = 8192
#: Places in the table of which hashes of words' beginnings there are (a byte each where it is used, a bit where it is sent).
PLACES = 1 << 23
#: Names that very many urls have are dealt to so many tasks when the odds of names are joined to urls.
SALT = 16
#: (verdict, host and path); the longest rule that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_letters = re.compile(r"[^\W\d_]+")
_tags = re.compile(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without "://"."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, begin = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segment(name: str, words: dict[str, float], unknown: float) -> list[str]:
    """The most probable split of a name into words with these log probabilities; ``unknown`` is that of any one other
    character, and runs of those stay together. Of equally probable splits the one with the latest cut wins."""
    lengths = sorted(set(map(len, words)))
    best, cut = [0.0] * (len(name) + 1), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        top, at = best[end - 1] + unknown, end - 1
        for n in lengths:
            if n > end:
                break
            p = words.get(name[end - n : end])
            if p is not None and (q := (best[end - n] + p, end - n)) > (top, at):
                top, at = q
        best[end], cut[end] = top, at
    out, end, strange = [], len(name), 0  # strange: where a run of unknown characters ends
    while end:
        begin = cut[end]
        known = end - begin > 1 or name[begin:end] in words
        if known and strange:
            out.append(name[end:strange])
        if known:
            out.append(name[begin:end])
        strange = 0 if known else strange or end
        end = begin
    if strange:
        out.append(name[:strange])
    return out[::-1]


def logs(counts: dict[str, int], total: int) -> tuple[dict[str, float], float]:
    """Log probabilities of words, and of one unknown character, when ``total`` words were counted."""
    total = max(total, 1)
    return {w: math.log(n / total) for w, n in counts.items()}, math.log(0.1 / total) / 2


def _words(html: str) -> list[str]:
    return [w for w in _letters.findall(_tags.sub(" ", html).lower()) if len(w) > 1]


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: how often each word of two letters or more occurs in the visible text of all pages, whole texts."""
    if "html" not in pages.columns:
        return pages.sparkSession.createDataFrame([], "word string, n long")

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in slices(batches, "html"):
            for html in batch.column("html").to_pylist():
                if html:
                    counts.update(_words(html))
            if len(counts) > MAX_WORDS:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    return pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def names(urls: DataFrame) -> DataFrame:
    """host, path, side, name: the runs of letters of each url, lower-cased; side h for the host, p for the path."""

    def of(side: str, column: str) -> Column:
        runs = F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1))
        return F.transform(runs, lambda name: F.struct(F.lit(side).alias("side"), name.alias("name")))

    both = F.concat(of("h", "host"), of("p", "path"))
    return urls.select("host", "path", F.explode(both).alias("w")).select("host", "path", "w.*")


def begun(keyed: DataFrame) -> np.ndarray:
    """Which of PLACES hashes the words' beginnings have, in bits: of fixed size, whatever the number of words."""
    h = keyed.select(F.pmod(F.crc32("begin"), F.lit(PLACES)).alias("h"))
    rows = h.groupBy(F.expr("cast(h >> 3 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(h & 7 as int)))").alias("bits")).toArrow()
    bits = np.zeros(PLACES // 8, np.uint8)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def cut(some: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """name, words: each name of ``some`` (name, distinct) in words.

    Names are numbered in a written table, and the number stands beside their substrings. A long name's substrings are handed
    on piece by piece, so that a task holds LETTERS of them whatever its length; most that no word begins with stay behind, as
    a table of hashes tells. Words that are longer than PREFIX letters are
    compared with the name where the found ones come together.
    """
    shared = Shared(some.sparkSession)
    numbered = shared.write(some.withColumn("id", F.monotonically_increasing_id()))
    keyed = counts.withColumn("begin", F.substring("word", 1, PREFIX))
    held = some.sparkSession.sparkContext.broadcast(begun(keyed))

    def candidates(batches):
        there, crc = np.unpackbits(held.value, bitorder="little").tobytes(), zlib.crc32
        for batch in slices(batches, "name"):
            for at, name in zip(batch.column("id").to_pylist(), batch.column("name").to_pylist(), strict=True):
                for first in range(0, len(name), LETTERS):
                    inside = {name[i : i + k] for i in range(first, min(len(name), first + LETTERS)) for k in range(2, min(PREFIX, len(name) - i) + 1)}
                    inside = [w for w in inside if there[crc(w.encode("utf-8", "surrogatepass")) % PLACES]]
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(inside), pa.int64()), pa.array(inside, pa.string())], ["id", "begin"])

    def gathered(batches):  # one batch of substrings for many short names
        held, n = [], 0
        for batch in candidates(batches):
            held.append(batch)
            n += batch.num_rows
            if n > 24 * LETTERS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def split(batches):
        for batch in slices(batches, "name"):
            out = []
            for name, found in zip(batch.column("name").to_pylist(), batch.column("found").to_pylist(), strict=True):
                out.append(segment(name, *logs({x["word"]: x["n"] for x in found or () if len(x["word"]) <= PREFIX or x["word"] in name}, total)))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    hits = numbered.mapInArrow(gathered, "id long, begin string").join(keyed, "begin")
    found = hits.groupBy("id").agg(F.collect_set(F.struct("word", "n")).alias("found"))
    return numbered.join(found, "id", "left").select("name", "found").mapInArrow(split, "name string, words array<string>")


@dataclass
class Model:
    tokens: dict[str, float] = field(default_factory=dict)  # log odds of block
    prior: float = 0.0
    total: int = 0  # of all counted words

    def odds(self, side: str, words: list[str]) -> float:
        """The evidence of a name's words; one that no learnt url had says nothing."""
        return float(sum(self.tokens.get(f"{side}:{w}", 0.0) for w in words))


def fit(seen: dict[str, Counter], urls: Counter, total: int = 0) -> Model:
    """Naive Bayes with one added to each count: of the tokens of the urls of either verdict, and of these urls."""
    vocabulary = seen["block"].keys() | seen["allow"].keys()
    size = {v: sum(c.values()) + len(vocabulary) + 1 for v, c in seen.items()}
    odds = {t: math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"]) for t in vocabulary}
    return Model(odds, math.log((urls["block"] + 1) / (urls["allow"] + 1)), total)


def train(pages: DataFrame, rules=RULES, size: int = TRAIN, labelled: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """The model, and the table of word counts that names are cut with.

    It learns from different (host, path) whose verdict a rule gives, and from ``labelled`` (url, verdict): ``size`` of each
    verdict at most, smallest hash first. Without any, as with an empty table, every url that no rule fits has even odds.
    """
    shared = Shared(pages.sparkSession)
    counts = shared.write(word_counts(pages))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    host, path = parts(F.col("url"))
    judged = pages.select(host.alias("host"), path.alias("path")).withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)[1])
    if labelled is not None:
        judged = judged.unionByName(labelled.select(host.alias("host"), path.alias("path"), "verdict"))
    each = [judged.where(F.col("verdict") == v).distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(size) for v in ("block", "allow")]
    urls = shared.write(each[0].unionByName(each[1]))
    found = names(urls).join(urls, ["host", "path"])
    words = cut(found.select("name").distinct(), counts, total)
    tokens = found.join(words, "name").select("verdict", "side", F.explode("words").alias("w")).groupBy("verdict", "side", "w").count()
    seen = {v: Counter() for v in ("block", "allow")}
    for r in tokens.toLocalIterator():  # of 2 * size urls at most
        seen[r["verdict"]][f"{r['side']}:{r['w']}"] = r["count"]
    return fit(seen, Counter({r["verdict"]: r["count"] for r in urls.groupBy("verdict").count().collect()}), total), counts


def url_odds(urls: DataFrame, learnt: tuple[Model, DataFrame]) -> DataFrame:
    """host, path, block_odds: the log odds of block for each row of urls (host, path, distinct).

    The odds of names are joined to urls by name and a part of the url's hash, as a third of all urls may share a name.
    """
    model, counts = learnt
    held = urls.sparkSession.sparkContext.broadcast(model)
    shared = Shared(urls.sparkSession)
    found = shared.write(names(urls))

    def odds(batches):
        for batch in batches:
            words = batch.column("words").to_pylist()
            values = [pa.array([held.value.odds(side, w) for w in words], pa.float64()) for side in "hp"]
            yield pa.RecordBatch.from_arrays([batch.column("name"), *values], ["name", "h", "p"])

    of_name = cut(found.select("name").distinct(), counts, model.total).mapInArrow(odds, "name string, h double, p double")
    salted = of_name.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = found.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALT)).cast("int"))
    # The terms of a url are added in one order, so that rounding does not depend on the shuffle.
    terms = rows.join(salted, ["name", "salt"]).select("host", "path", F.struct("side", "name", F.when(F.col("side") == "h", F.col("h")).otherwise(F.col("p")).alias("x")).alias("t"))
    summed = terms.groupBy("host", "path").agg(F.aggregate(F.array_sort(F.collect_list("t")), F.lit(0.0), lambda acc, t: acc + t["x"]).alias("evidence"))
    return urls.join(summed, ["host", "path"], "left").select("host", "path", (F.lit(model.prior) + F.coalesce("evidence", F.lit(0.0))).alias("block_odds"))


def judged(pages: DataFrame, learnt: tuple[Model, DataFrame], rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, block_odds for each row of pages (page_id, url).

    block_odds is the method's log odds where no rule fits, else null; even odds allow. Null urls, and urls without "://",
    have an empty host and path, no rule and the verdict of the prior. Only page_id and url (and html, in training) are
    read, so other columns cannot clash. Repeated rows are judged one by one, their url once. Very long urls and pages are
    read whole. An empty table gives an empty result.
    """
    host, path = parts(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("verdict", verdict)
    asked = rows.where("rule is null").select("host", "path").distinct()
    odds = url_odds(asked, learnt).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    open_rows = rows.where("rule is null").withColumn("salt", (F.rand(7) * SALT).cast("int"))
    by_method = open_rows.join(odds, ["host", "path", "salt"]).drop("salt").withColumn("verdict", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    by_rule = rows.where("rule is not null").withColumn("block_odds", F.lit(None).cast("double"))
    return by_rule.unionByName(by_method).select("page_id", "host", "path", "rule", "verdict", "block_odds")
