"""Queries whose work grew with the square of a group: the same results, on groups that the square would not finish."""

import hashlib
import itertools
import random
import re
import time

from pyspark.sql import functions as F

from skein.operators import aliases, digest, entities, learning, registry, relations, sentences
from skein.sources import exports
from skein.sources import postings as index


def test_matching_sense_equals_brute_force(spark):
    rng = random.Random(5)
    words = lambda: rng.choice([None, [], [None, "a"]]) if rng.random() < 0.1 else [rng.choice("abcdef") for _ in range(rng.randint(1, 6))]
    asked = [(i, rng.choice(["n", "m", None]), "t", words()) for i in range(120)]
    senses = [(rng.choice(["n", "m", None]), "t", rng.randint(1, 9), words()) for _ in range(80)]
    want = {}
    for key, name, kind, w in asked:
        found = [(len(set(w) & set(x)) / len(set(w) | set(x)), -s) for n, k, s, x in senses if name and (n, k) == (name, kind) and w and x]
        best = max([f for f in found if f[0] > 0.7], default=None)
        want[key] = (-best[1], round(best[0], 6)) if best else (None, None)
    a = spark.createDataFrame(asked, "key int, name string, type string, words array<string>")
    got = registry.matching_sense(a, spark.createDataFrame(senses, "name string, type string, sense int, words array<string>"))
    assert {r.key: (r.sense, r.similarity) for r in got.collect()} == want


def test_matching_sense_of_one_name(spark):
    rows = spark.range(60_000).select(F.col("id").alias("key"), F.lit("n").alias("name"), F.lit("t").alias("type"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 3)).alias("words"))
    began = time.monotonic()
    got = registry.matching_sense(rows, rows.withColumnRenamed("key", "sense")).groupBy("sense", "similarity").count().collect()
    assert {tuple(r) for r in got} == {(k, 1.0, 20_000) for k in range(3)}
    assert time.monotonic() - began < 120  # 3.6e9 pairs of rows are not met


def test_jaccard_equals_brute_force_on_long_and_short_texts(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.choice([3, 5, 9, 12, 39, 60]))]
        for _ in range(4):
            texts.append(base + ["more"] * rng.randint(0, 1) if rng.random() < 0.5 else base[: len(base) - rng.randint(0, 3)])
    docs = [(i, " ".join(w)) for i, w in enumerate(texts) if w] + [(1000 + i, " ".join(f"w{i}x{j % 5000}" for j in range(12_000))) for i in (0, 0, 1, 2, 3, 4)]
    sets = {}
    for i, t in docs:
        w = t.split()
        sets.setdefault(i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))))
    links = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a != b and len(x & y) >= 0.8 * len(x | y)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    began = time.monotonic()
    got = {tuple(r) for r in entities.jaccard_classes(frame).collect()}
    first = {i: min(j for j, y in sets.items() if y == x) for i, x in sets.items()}
    assert got == {(i, first[i], sum(1 for j in sets if j != i and sets[j] == sets[i]), sum(1 for x in links if x[0] == i)) for i in sets}
    pairs = sorted(tuple(r) for r in entities.jaccard_pairs(frame).collect())
    assert pairs == sorted((a, b, round(v, 6)) for (a, b), v in links.items() if a < b and first[a] == a and first[b] == b)
    assert time.monotonic() - began < 120  # words of a text are not split anew for each of its shingles


def test_sentences_are_cut_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "Dr. Ann met Bob in 3.5 hours. Hm. Then she left for good! no way"), (2, None), (1, "One sentence here. One sentence there."), (3, "z." * 30_000)], "doc_id long, text string")
    found = sentences.sentences(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.idx, r.start, r.end, r.text) for r in found.where("doc_id < 3").collect())
    assert got == [(1, 0, 0, 18, "One sentence here."), (1, 0, 0, 29, "Dr. Ann met Bob in 3.5 hours."), (1, 1, 19, 38, "One sentence there."), (1, 1, 30, 64, "Hm. Then she left for good! no way")]
    assert found.where("doc_id = 3").select(F.sum(F.length("text"))).first()[0] == 60_000


def test_known_ids_are_not_broadcast(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "b"), (None, "a"), ("c", "a"), ("a", "b")], "subj string, obj string")
    kept = relations.drop_dangling(edges, spark.createDataFrame([("a", "A"), ("b", "B"), ("c", " ")], "id string, canonical string"))
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.subj, r.obj) for r in kept.collect()) == [("a", "b"), ("a", "b")]


def test_discriminated_pairs_are_made_after_the_last_shuffle(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["n", "m", None]), rng.choice(["t", "u"]), rng.choice([["a"], ["a", "b"], ["b", "c", "d"], []])) for i in range(300)]
    none = F.array().cast("array<string>")
    senses = spark.createDataFrame(rows, "key long, name string, type string, words array<string>").select("key", "name", "type", F.struct("words", none.alias("descriptors"), none.alias("titles")).alias("profile"))
    want = {}
    for a, n, t, w in rows:
        for b, m, u, x in rows:
            if a < b and n and n == m:
                share = len(set(w) & set(x)) / len(set(w) | set(x)) if w or x else 0.0
                want[a, b] = (True, 1.0) if t != u else (True, 0.9) if share < 0.3 else (True, 0.6) if share < 0.5 else (False, 0.8)
    for size in (7, 1024):
        got = registry.discriminated_pairs(senses, size, 3).collect()
        assert len(got) == len(want) and {(r.a, r.b): (r.different, r.confidence) for r in got} == want
    plan = registry.discriminated_pairs(senses)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("keys_a") < plan.index("Exchange")  # keys are shuffled as blocks
    one = senses.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"), (F.col("key") * 10 + F.col("i")).alias("key"), F.lit("n").alias("name"), F.lit("t").alias("type"), "profile")
    assert registry.discriminated_pairs(one).count() == 3000 * 2999 // 2


def test_pairs_of_senses_are_not_held_by_the_join(spark, tmp_path):
    none = F.array().cast("array<string>")
    senses = spark.range(600).select(F.col("id").alias("key"), F.lit("n").alias("name"), (F.col("id") % 3).cast("string").alias("type"), F.struct(F.array(F.lit("a")).alias("words"), none.alias("descriptors"), none.alias("titles")).alias("profile"))
    for most in (7, 64):
        found = registry.discriminated_pairs(senses, 50, 3, most)
        found.write.parquet(str(tmp_path / f"pairs{most}"))
        got = spark.read.parquet(str(tmp_path / f"pairs{most}"))
        assert got.distinct().count() == got.count() == 600 * 599 // 2 and got.where("a >= b or different = ((a - b) % 3 = 0)").count() == 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    code = {x: set(re.findall(rf"\*\((\d+)\) {x}", plan)) for x in ("SortMergeJoin", "Generate explode\\(keys_b")}
    # What is compiled with a join is held for all matches of a row: here, all pairs of a block and its name.
    assert all(code.values()) and not set.intersection(*code.values())


def test_aliases_are_resolved_in_batches_of_any_size(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    known = [(" ".join(rng.choice("abc") for _ in range(rng.randint(2, 4))), f"D{i}") for i in range(8)]
    ids = {}
    for alias, i in known:
        ids[alias] = min(i, ids.get(alias, i))
    want = set()
    for doc, text in docs:
        words, gone = text.split(), set()
        places = [(-len(a), at, a) for a in ids for at in range(len(words)) if words[at : at + a.count(" ") + 1] == a.split()]
        for _, at, a in sorted(places):
            span = set(range(at, at + a.count(" ") + 1))
            if not span & gone:
                gone |= span
                want.add((doc, at, len(span), ids[a]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    names = spark.createDataFrame(known, "alias string, id string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = aliases.alias_mentions(frame, names)
        assert sorted((r.doc_id, r.at, r.n, r.id) for r in found.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "Window" not in plan and "ObjectHashAggregate" not in plan


def test_places_of_aliases_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(aliases, "CHUNK", 40)
    monkeypatch.setattr(aliases, "MOST", 2)
    rng = random.Random(8)
    docs = [(rng.choice([None, *range(30)]), " ".join(rng.choice(["A", "a", "b", "c,", "\u0130x"]) for _ in range(rng.randint(0, 30)))) for _ in range(60)] + [(5, None)]
    known = [("a", 3), ("A  b", 2), ("a b", 1), ("b c", 4), ("c,a", 5), ("\u0130X a", 6), (None, 7), ("z", 8), ("", 9)]
    key = lambda t: [m.lower() for m in re.findall(aliases.TOKEN, t or "")]
    ids = {}
    for a, i in known:
        if key(a):
            ids[tuple(key(a))] = min(i, ids.get(tuple(key(a)), i))
    everywhere = sorted((str(d), at, len(a), i) for d, t in docs for a, i in ids.items() for at in range(len(key(t))) if tuple(key(t)[at : at + len(a)]) == a)
    want = set()
    for doc in {d for d, _ in docs}:
        gone = set()
        for _, at, a in sorted({(-len(" ".join(a)), at, a) for d, t in docs if d == doc for a in ids for at in range(len(key(t))) if tuple(key(t)[at : at + len(a)]) == a}):
            span = set(range(at, at + len(a)))
            if not span & gone:
                gone |= span
                want.add((str(doc), at, len(a), ids[a]))
    frame, names = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "alias string, id int")
    assert sorted((str(r.doc_id), r.at, r.n, r.id) for r in aliases.candidates(frame, aliases.keyed(names)).collect()) == everywhere
    found = aliases.alias_mentions(frame, names)
    got = found.collect()
    assert len(got) == len(want) and {(str(r.doc_id), r.at, r.n, r.id) for r in got} == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "Exchange" not in plan[: plan.index("FlatMapCoGroups")]  # texts are dealt once, places stay where they are found


NAMED = [("a", "PERSON", "Ann"), ("b", "PERSON", "Bob"), ("c", "ITEM", None)]
TOLD = [("a", "met", "b", 0.5), ("a", "met", "x", 0.5), ("a", "met", "b", 0.9), ("c", "is", "a", 0.7), ("y", "saw", "b", 0.1)]


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), "BroadcastHashJoin" in plan


def test_names_are_merged_and_pages_shuffle_relations_twice(spark):
    known = spark.createDataFrame(NAMED, "id string, type string, canonical string")
    told = spark.createDataFrame(TOLD, "subj string, pred string, obj string, confidence double")
    named = relations.with_names(told, known)
    assert shuffles(named) == (4, False)  # the relations and the names, by either end
    assert sorted((r.subj, r.subj_name, r.obj, r.obj_name) for r in named.collect()) == [("a", "Ann", "b", "Bob"), ("a", "Ann", "b", "Bob"), ("a", "Ann", "x", "x"), ("c", "c", "a", "Ann"), ("y", "y", "b", "Bob")]
    pages = exports.entity_pages(told, known)
    assert shuffles(pages) == (4, False)
    assert {r.id: r.page for r in pages.collect()} == {"a": "# Ann\n## met\n- Bob\n- x", "c": "# c\n## is\n- Ann", "y": "# y\n## saw\n- Bob"}


def test_digest_shuffles_lines_once(spark):
    lines = spark.range(3000).select(F.lit("k").alias("kind"), (F.col("id") % 1000).cast("string").alias("line"))
    found = digest.digest(lines)
    assert shuffles(found) == (2, False)  # the lines, and the digests of their beginnings
    each = [f"{h}:3" for h in sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(1000))]
    parts = sorted(b + hashlib.sha256(",".join(g).encode()).hexdigest() for b, g in ((b, list(g)) for b, g in itertools.groupby(each, lambda x: x[:4])))
    assert [tuple(r) for r in found.collect()] == [("k", 3000, hashlib.sha256(",".join(parts).encode()).hexdigest())]


def test_active_round_reads_the_texts_once_for_occurrences(spark):
    docs = spark.createDataFrame([(i, f"old {n} walked home. old {n} went out. the {n} walked") for i, n in enumerate(["Ann", "Bob", "Cyd", "Dan"])], "doc_id long, text string")
    seeds = spark.createDataFrame([("Ann",), ("Bob",)], "name string")
    asked = learning.active_round(docs, seeds)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # both kinds of templates in one reading; what the contexts gave is written
    assert sorted((r.name, r.n_templates, r.n) for r in asked.collect()) == []  # four templates each: certain
    assert sorted((r.name, r.n_templates, r.n) for r in learning.scored(learning.applied(docs, learning.generalized(learning.contexts(docs, seeds)), seeds), learning.generalized(learning.contexts(docs, seeds))).collect()) == [("Cyd", 4, 6), ("Dan", 4, 6)]


def test_a_learning_loop_reads_the_answers_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"N{chr(97 + i % 24)}{chr(97 + j)} w{chr(97 + (i + j) % 7)}x" for j in range(6))) for i in range(24)], "doc_id int, text string")
    names = [f"N{chr(97 + i)}{chr(97 + j)}" for i in range(24) for j in range(6)]
    read = spark.sparkContext.accumulator(0)
    told = F.udf(lambda name: read.add(1) or True, "boolean")
    answers = spark.createDataFrame([(n,) for n in names], "name string").select("name", told("name").alias("is_correct"))
    found = learning.learning_loop(docs, spark.createDataFrame([("Naa",), ("Nha",)], "name string"), answers, str(tmp_path / "loop"), rounds=3, ask=5)
    assert found.agg(F.max("round")).first()[0] == 3 and read.value == len(names)


def test_words_are_counted_within_a_document(spark, monkeypatch):
    monkeypatch.setattr(index, "ROWS", 3)
    rng = random.Random(11)
    make = lambda: rng.choice([None, "", "7 - 8", " ".join(rng.choice(["Elf", "orc", "the", "o'er", "\u212aing", "\u0130s", "x1y"]) for _ in range(rng.randint(1, 30)))])
    rows = [(f"d{i}", make(), make(), make()) for i in range(120)]
    boosts = {"label": 10.0, "text": 1.0, "type": 5.0}
    want = {}
    for i, *fields in rows:
        found = [re.findall("[a-z]+", (f or "").lower()) for f in fields]
        for t in {t for w in found for t in w}:
            want[t, i] = sum(w.count(t) * b / max(len(w), 1) ** 0.5 for w, b in zip(found, boosts.values(), strict=True))
    got = index.postings(spark.createDataFrame(rows, "id string, label string, text string, type string"), boosts)
    found = {(r.term, r.id): r.weight for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want) and got.count() == len(want)
    assert "Exchange" not in got._jdf.queryExecution().toString()  # no row of a word is moved before the index is dealt out


def test_a_long_document_beside_short_ones_is_indexed(spark, tmp_path):
    words = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(200_000))
    docs = spark.createDataFrame([(0, words), (1, "waa"), (2, None), (3, "...")], "id long, text string")
    index.build(docs, str(tmp_path / "index"), {"text": 1.0})
    once = -(-200_000 // 676) / 200_000**0.5
    assert [(r.id, r.score) for r in index.search(spark, str(tmp_path / "index"), "WAA waa", 5).collect()] == [(1, 1.0), (0, round(once, 6))]
    assert index.current(spark, str(tmp_path / "index")).count() == 677
