"""Sentences, relations, quotations, names, times, references and stores on small texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import names as N
from skein.functions import time as D
from skein.operators import entities, gates, graph, learning, narrative, parse, profiles, quotes, references, registry, rendering, sentences
from skein.sources import stores

DOC = "doc_id long, text string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def brute_sentences(text):
    """By plain Python: cut where a mark ends a sentence, then join what is too short."""
    marks, ends = ".!?…", "\"'“”‘’«»"
    cuts, i = [0], 0
    while i < len(text):
        if text[i] not in marks:
            i += 1
            continue
        j = i
        while j + 1 < len(text) and text[j + 1] in marks:
            j += 1
        mark, k = text[j], j + 1
        while k < len(text) and text[k] in ends:
            k += 1
        before, rest = text[: j + 1], text[k:].lstrip()
        first = rest[:1]
        lower = first == first.lower() and first != first.upper()
        if mark in "!?":
            stop = not lower
        else:
            word = re.search(r"[A-Za-z.]*$", before).group()
            known = word in sentences.ABBREVIATIONS or re.search(r"(^|\s)[A-Z]\.$", before) or (re.search(r"\d\.$", before) and text[k : k + 1].isdigit())
            stop = not known and ((first != "" and first in ends) or not lower or re.match(r"[A-Za-z]*", rest).group().lower() in sentences.STARTERS)
        if stop:
            cuts.append(k)
        i = k
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        piece = text[a:b].strip()
        if piece:
            at = a + len(text[a:b]) - len(text[a:b].lstrip())
            rows.append((at, at + len(piece), piece))
    out, i = [], 0
    while i < len(rows):
        if len(rows[i][2]) < 10 and i + 1 < len(rows):
            out.append((rows[i][0], rows[i + 1][1], rows[i][2] + " " + rows[i + 1][2]))
            i += 2
        elif len(rows[i][2]) < 10 and out:
            out[-1] = (out[-1][0], rows[i][1], out[-1][2] + " " + rows[i][2])
            i += 1
        else:
            out.append(rows[i])
            i += 1
    return out


TEXTS = [
    "Mr. Smith met Dr. J. Brown at 3.14 p.m. on Jan. 5. They talked! Did they? yes they did. It was fine.", 'He said "Go home now." Then he left. "Stop right there!" she cried. Nobody answered him.', "No end", "", "One. Two. Three. Four and more words here. Five.",
    "It cost 3.50 dollars... or so. the end of it. And a start of it.\n\nNew paragraph here. (e.g. this one). U.S. laws apply here. Ends with etc.", "Short. A much longer sentence follows it. X.", "  Leading blanks here.   Trailing too.  ", "Wait... What is this? I do not know",
]


def test_sentences_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], DOC)
    got = {}
    for r in sentences.sentences(docs).collect():
        got.setdefault(r.doc_id, []).append((r.idx, r.start, r.end, r.text))
    for i, t in enumerate(TEXTS):
        assert [x[1:] for x in sorted(got.get(i, []))] == brute_sentences(t), t


def test_paragraphs_by_blank_lines(spark):
    docs = spark.createDataFrame([(1, "a b\nc\n\n\nd\n\n \n\ne")], DOC)
    assert [(r.idx, r.start, r.text) for r in sentences.blocks(docs).orderBy("idx").collect()] == [(0, 0, "a b\nc"), (1, 8, "d"), (2, 14, "e")]


def test_relations_of_sentences(spark):
    rows = [(1, "Anna and Boris founded the Guild in Paris."), (2, "She never loved Mark."), (3, "The Tower was made by Hugo."), (4, "Maria is the queen of Spain."), (5, ""), (6, "nothing here at all")]
    found = parse.relations(spark.createDataFrame([(i, 0, t) for i, t in rows], "doc_id long, idx int, text string"))
    got = {(r.doc_id, r.subj, r.pred, r.obj, r.rule, r.negated, r.confidence) for r in found.collect()}
    assert got == {
        (1, "Boris", "found", "Guild", "svo", False, 0.65), (1, "Anna", "found", "Guild", "conj", False, 0.6), (1, "Boris", "found_in", "Paris", "prep", False, 0.6), (1, "Anna", "found_in", "Paris", "conj", False, 0.6),
        (2, "She", "love", "Mark", "svo", True, 0.5), (3, "Hugo", "make", "Tower", "passive", False, 0.6), (4, "Maria", "rules", "Spain", "role", False, 0.7),
    }


def test_quotations_and_speakers(spark):
    text = '"We go," said Anna. "No," Boris replied. “Why not?” she asked. "Because it rains."'
    got = [(r.text, r.speaker, r.method) for r in quotes.attributed(quotes.quotes(spark.createDataFrame([(1, text)], DOC))).orderBy("ord").collect()]
    assert got == [("We go,", "Anna", "explicit"), ("No,", "Boris", "explicit"), ("Why not?", "Boris", "pronoun"), ("Because it rains.", "Anna", "turn")]
    both = spark.createDataFrame([(1, 0, "Anna", "x", 0.6)], "doc_id long, sent int, subj string, obj string, confidence double")
    merged = quotes.merged_tells(both, both.withColumn("confidence", F.lit(0.9)).withColumn("obj", F.lit("quoted"))).collect()
    assert [(r.obj, r.confidence) for r in merged] == [("quoted", 0.9)]


def test_gate_and_validity(spark):
    gate = lambda s, initial=False, attached=False: tuple(one(spark, gates.gate(F.lit(s).cast("string"), F.lit(initial), F.lit(attached))))
    want = {
        "": "empty_span", "x": "too_short", "12": "numeric_only", "He": "pronoun_only", "Where": "wh_word", "However": "discourse_marker", "Hello": "interjection", "said went": "verb_phrase", "said": "verb_lead", "must Go": "modal_lead",
        "And Anna": "conjunction_lead", "If Anna": "subordinator_lead", "In Paris": "pp_lead_no_object", "Every": "determiner_only", "my own": "lowercase_non_noun",
    }
    for s, reason in want.items():
        assert gate(s) == ("NON_ENTITY", reason), s
    assert gate("Captain", True) == ("CONTEXT_ONLY", "role_without_identity") and gate("Paris", True)[0] == "CONTEXT_ONLY" and gate("Paris") == ("DURABLE_CANDIDATE", None)
    assert gate("Paris", False, True) == ("NON_ENTITY", "compound_fragment") and gate(None)[1] == "empty_span"
    reason = lambda s, kind="PERSON": one(spark, gates.invalid_reason(F.lit(s), F.lit(kind)))
    assert [reason("she"), reason("said"), reason("Chapter 3"), reason("1999", "DATE"), reason("UK", "ORG"), reason("zz", "ORG"), reason("Anna")] == ["pronouns", "common_words", "bad_pattern", None, None, "too_short", None]
    assert [one(spark, gates.is_garbage_alias(F.lit(s))) for s in ("the old man", "Anna Berg", "if Anna", "a b c d e", "US.", "Xy")] == [True, False, True, True, False, True]


def test_forms_of_names(spark):
    assert one(spark, N.entity_name(F.lit('"The  Baker family"'))) == "Baker" and one(spark, N.alias_form(F.lit(" Éva  Müller! "))) == "eva muller"
    assert tuple(one(spark, N.suffix_parts(F.lit("John Smith Jr.")))) == ("John Smith", "Jr.") and tuple(one(spark, N.school_parts(F.lit("Lincoln Jr. High")))) == ("lincoln", "jr high")
    assert [one(spark, N.guessed_type(F.lit(s))) for s in ("Acme Foundation", "Green River", "Ann Lee", "Ann", "AB CD")] == ["ORG", "LOC", "PERSON", "UNKNOWN", "ORG"]
    assert one(spark, N.preprocessed(F.lit("J. R. Smith, Jr. met  Ann - Lee — “hi”"))) == 'J.R. Smith Jr. met Ann-Lee -- "hi"'
    assert one(spark, N.junior_type(F.lit("Linden Jr"), F.lit(True), F.lit(True))) == "ORG" and one(spark, N.junior_type(F.lit("Ann Lee Jr"), F.lit(False), F.lit(False))) == "PERSON"


def test_times(spark):
    found = one(spark, D.time_expressions(F.lit("IN MARCH 1999, during 3019 T.A. and 12 fo.a")))
    got = {(r.family, one(spark, D.normalized(F.lit(r.expression), F.lit(r.family)))) for r in found}
    assert {("month_year", "1999-03-01"), ("age", "3019-TA"), ("age", "12-FO"), ("about_year", None)} <= got
    assert tuple(one(spark, D.without_preposition(F.lit("in  1999")))) == ("1999", 4) and one(spark, D.first_position(F.lit("so in 1999"), "about_year")) == 3
    assert one(spark, D.least_year(F.array(F.lit("x 1999"), F.lit("900")))) == 900
    rows = [("UNKNOWN", None, None), ("DISCOURSE", 2, None), ("DISCOURSE", 1, None), ("ABSOLUTE", None, "1999"), ("ABSOLUTE", None, "1998")]
    df = spark.createDataFrame(rows, "kind string, chapter int, date string")
    order = D.anchor_order(F.col("kind"), F.col("chapter"), F.lit(None), F.lit(None), F.col("date"))
    assert [(r.kind, r.chapter, r.date) for r in df.orderBy(order).collect()] == [rows[4], rows[3], rows[2], rows[1], rows[0]]


def test_reference_forms(spark):
    assert one(spark, F.hex(references.packed(F.lit(300), F.lit(258), F.lit(7), F.lit(1), F.lit(20_000), F.lit(5)))) == "AC02" + "00" + "0201000000000000" + "07" + "01" + "A09C01" + "05"

    def slow(*parts):
        h = 0
        for p in parts:
            h = (h * 31 + (p or 0) + 2**31) % 2**32 - 2**31
        return h & 0xFFFFF

    for parts in ((None, None, 1, 2, 3), (9, 8, 70_000, 60_000, 5), (1, 2, 3, 4, 2**31 - 1)):
        assert one(spark, references.location_hash(*[F.lit(p).cast("long") for p in parts])) == slow(*parts)
    assert [one(spark, references.confidence_bin(F.lit(x))) for x in (0.0, 0.5, 1.0, 2.0)] == [0, 3, 7, 7]


def test_merging_over_documents(spark):
    rows = [("d1_a", "PERSON", "Gandalf", ["Mithrandir"]), ("d2_b", "PERSON", "gandalf", []), ("d3_c", "PERSON", "Mithrandir", []), ("d4_d", "ORG", "Gandalf", []), ("d5_e", "PLACE", "Old Forest", None), ("d6_f", "GPE", "The Old Forest", [])]
    df = spark.createDataFrame(rows, "id string, type string, canonical string, aliases array<string>")
    pairs = {(r.a, r.b): (r.score, r.method) for r in registry.merge_candidates(df).collect()}
    assert pairs == {("d1_a", "d2_b"): (0.95, "canonical"), ("d1_a", "d3_c"): (0.93, "alias"), ("d5_e", "d6_f"): (0.85, "substring")}
    ids = registry.merged(df)
    assert {r.id: r.global_id for r in ids.collect()} == {"d1_a": "d1_a", "d2_b": "d1_a", "d3_c": "d1_a", "d4_d": "d4_d", "d5_e": "d5_e", "d6_f": "d6_f"}
    whole = {r.global_id: (r.canonical, r.aliases, r.n_local) for r in registry.global_entities(df, ids).collect()}
    assert whole["d1_a"] == ("Mithrandir", ["Gandalf", "gandalf"], 3)


def test_components_of_a_chain_and_a_star(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("z", f"y{i}") for i in range(5)], "a string, b string")
    got = {r.id: r.root for r in registry.components(edges).collect()}
    assert got == {f"n{i:02d}": "n00" for i in range(31)} | {f"y{i}": "y0" for i in range(5)} | {"z": "y0"}


def test_edit_distance_two(spark):
    words = ["anna", "hanna", "hannah", "ana", "zoe", "anan", "bob", "boob"]
    got = {(r.a, r.b): r.distance for r in entities.levenshtein_pairs(spark.createDataFrame([(w,) for w in words], "name string"), 2).collect()}

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    assert got == {(a, b): slow(a, b) for a in words for b in words if a < b and slow(a, b) <= 2}
    with pytest.raises(ValueError):
        entities.levenshtein_pairs(spark.createDataFrame([], "name string"), 3)


def test_profiles_keep_the_last_contexts(spark):
    rows = [("a", i, f"c{i:03d}", "tall" if i % 2 else "old") for i in range(45)] + [("b", 1, "c", None)]
    df = spark.createDataFrame(rows, "id string, at long, context string, descriptor string")
    whole = {r.id: r for r in profiles.profiles(df).collect()}
    folded = {r.id: r for r in profiles.updated(profiles.profiles(df.where("at < 30")), profiles.profiles(df.where("at >= 30"))).collect()}
    assert whole["a"].contexts == [f"c{i:03d}" for i in range(25, 45)] == folded["a"].contexts and folded["a"].n == 45 and folded["b"].n == 1 and whole["a"].confidence == 0.95
    who = spark.createDataFrame([("m1", "a", 3.0), ("m1", "b", 2.0), ("m2", "a", 3.0), ("m2", "b", 2.5), ("m3", "c", 0.1)], "key string, id string, score double")
    assert {r.key: r.id for r in profiles.dominant(who, "key", "score").collect()} == {"m1": "a", "m3": "c"}


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], "id string, text string, updated_at int")
    new = spark.createDataFrame([("2", "old", 2), ("2", "new", 3), ("3", "z", 2)], df.schema)
    assert sorted(map(tuple, stores.upserted(df, new).collect())) == [("1", "x", 1), ("2", "new", 3), ("3", "z", 2)]
    assert [r.id for r in stores.newest_first(stores.upserted(df, new), limit=2).collect()] == ["2", "3"]
    folder = str(tmp_path / "snaps")
    stores.snapshot(df, folder, "20240101T000000")
    stores.snapshot(new, folder, "20240201T000000")
    assert [(r.snapshot, r.n) for r in stores.snapshots(spark, folder).collect()] == [("20240201T000000", 3), ("20240101T000000", 2)]
    assert stores.restored(spark, folder, "20240101T000000", ("id", "text")).count() == 2
    with pytest.raises(ValueError):
        stores.restored(spark, folder, "20240101T000000", ("missing",))
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx y\n")
    assert tuple(stores.tab_separated(spark, str(tmp_path / "t.tsv"), "a int, b string").first()) == (1, "x y")
    assert stores.contract(spark.createDataFrame([("no json",)], "json string")).first().mentions is None


def test_rendered_lines(spark):
    line = lambda p, c, t=None: one(spark, rendering.sentence(F.lit(p), F.lit("A"), F.lit("B"), F.lit(t).cast("string"), F.lit(c)))
    assert [line("married_to", 0.9, "1999"), line("parent_of", 0.6, "1999"), line("knows", 0.9)] == ["A married B in 1999.", "A is said to be the parent of B.", 'A has relation "knows" with B.']
    assert len(rendering.TEMPLATES) == 43 == len(rendering.WEIGHTS)


def test_lemmas_and_tags(spark):
    assert [one(spark, learning.lemma(F.lit(w))) for w in ("Stories", "walking", "wanted", "boxes", "cats", "glass", "is")] == ["story", "walk", "want", "box", "cat", "glass", "is"]
    assert one(spark, learning.signature(F.lit("Walking cats"))) == one(spark, learning.signature(F.lit("cat, walk!")))
    notes = spark.createDataFrame([(1, "[[Entity: Ann]] and [[NewEntity: Bob|type=person]] [[Entity: ]]")], "note_id long, text string")
    assert {(r.kind, r.name, r.type) for r in learning.tags(notes).collect()} == {("known", "Ann", None), ("new", "Bob", "PERSON")}


def test_empty_texts_everywhere(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (None, "Ann met Bob.")], DOC)
    none = docs.limit(0)
    assert narrative.pipeline(docs).count() == 1 and narrative.pipeline(none).count() == 0
    assert quotes.quotes(docs).count() == 0 and stores.temporal_events(docs).count() == 0
    assert graph.neighborhood(spark.createDataFrame([], "subj string, pred string, obj string"), "x").count() == 1


def test_contained_names_merge(spark):
    rows = [("e1", "PERSON", "Gandalf", []), ("e2", "PERSON", "Gandalf the Grey", []), ("e3", "PERSON", "Saruman", []), ("e4", "ORG", "Gandalf the Great", []), ("e5", "PERSON", "John", []), ("e6", "PERSON", "John the Elder", []), ("e7", "PERSON", "John the Younger", [])]
    ids = registry.merged(spark.createDataFrame(rows, "id string, type string, canonical string, aliases array<string>"))
    assert {r.id: r.global_id for r in ids.collect()} == {"e1": "e1", "e2": "e1"} | {f"e{i}": f"e{i}" for i in range(3, 8)}


def test_similar_names_equal_brute_force(spark):
    rng = random.Random(6)
    names = [sorted({rng.choice("abcdefghijklmnopqrstuv") * rng.choice([1, 1, 2]) for _ in range(rng.randint(1, 12))}) for _ in range(500)]
    got = {(r.a, r.b): (round(r.score, 6), r.method) for r in registry.similar_names(spark.createDataFrame([("X", i, w) for i, w in enumerate(names)], "kind string, id int, w array<string>")).collect()}
    want = {}
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            b = names[j]
            common = len(set(a) & set(b))
            if common == min(len(a), len(b)):
                want[i, j] = (0.85, "substring")
            elif common / (len(a) + len(b) - common) > 0.7:
                want[i, j] = (round(common / (len(a) + len(b) - common), 6), "words")
    assert got == want and len(want) > 100


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{(i * 7919) % 3001:04d}", f"n{((i + 1) * 7919) % 3001:04d}") for i in range(3000)], "a string, b string")
    assert {r.root for r in registry.components(edges).collect()} == {"n0000"}
