"""Clauses, pronouns, aliases and cited texts against brute-force versions and the cases of the surveyed tests."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import aliases, coreference, dependency, grammar


def found(text):
    return [r[:3] + (("not",) if r[4] else ()) for r in grammar.relations_of(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Aragorn, who ruled Gondor, married Arwen.", [("Aragorn", "rule", "Gondor"), ("Aragorn", "marry", "Arwen")]),
        ("Frodo, son of Drogo, travelled to Mordor.", [("Frodo", "child_of", "Drogo"), ("Frodo", "travel_to", "Mordor")]),
        ("Ron and Hermione and Neville visited Hogwarts.", [(n, "visit", "Hogwarts") for n in ("Ron", "Hermione", "Neville")]),
        ("Boromir was killed by the Orc King.", [("Orc King", "kill", "Boromir")]),
        ("Harry did not love Ron.", [("Harry", "love", "Ron", "not")]),
        ("Frodo, the brother of Sam, did not visit Mordor.", [("Frodo", "sibling_of", "Sam"), ("Frodo", "visit", "Mordor", "not")]),
        ("Aragorn met the man who ruled Gondor.", []),
        ("The man who ruled Gondor married Arwen.", []),
        ("In 1980, Aragorn met Boromir and Frodo met Sam.", [("Aragorn", "meet", "Boromir"), ("Frodo", "meet", "Sam")]),
        ("Frodo met Sam and the man married Arwen.", [("Frodo", "meet", "Sam")]),
        ("Aragorn visited Gondor and married Arwen.", [("Aragorn", "visit", "Gondor"), ("Aragorn", "marry", "Arwen")]),
        ("Aragorn, who was not loved by Boromir, married Arwen, and Frodo visited Gondor.", [("Boromir", "love", "Aragorn", "not"), ("Aragorn", "marry", "Arwen"), ("Frodo", "visit", "Gondor")]),
        ("Frodo is the son of Drogo.", [("Frodo", "child_of", "Drogo")]),
        ("Frodo was tired.", [("Frodo", "is", "tired")]),
        ("Mr. Smith met Dr. Jones.", [("Smith", "meet", "Jones")]),
        ('"Pa is lost," said Cua.', [("Pa", "is", "lost")]),
        ("A quiet day.", []),
        ("", []),
    ],
)
def test_clauses(text, want):
    assert found(text) == want


def test_clauses_of_long_and_null_texts(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, "Frodo met Sam and " * 50_000 + "Frodo met Merry."), (2, 1, "")], "doc_id long, idx int, text string").withColumn("subj", F.lit("x"))
    got = grammar.clause_relations(df).groupBy("doc_id").count().collect()
    assert [(r.doc_id, r["count"]) for r in got] == [(2, 50_001)]
    assert grammar.clause_relations(df.limit(0)).count() == 0


# --- pronouns --------------------------------------------------------------------------------------------------------


def answers(spark, lines, types=None):
    sentences = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, idx int, text string")
    known = spark.createDataFrame(list((types or {}).items()) or [("-", "-")], "name string, type string")
    got = coreference.resolved(coreference.described(coreference.mentions(sentences), known)).orderBy("sent", "at").collect()
    return [(r.pronoun, r.antecedent) for r in got]


def test_pronouns(spark):
    places = {"Gondor": "PLACE", "Anduril": "ITEM", "Hogwarts School": "ORG"}
    assert answers(spark, ["Mr. Brown met Mrs. Green in Gondor.", "She liked him.", "He bought it."], places) == [("she", "Green"), ("him", "Brown"), ("he", "Brown"), ("it", "Gondor")]
    assert answers(spark, ["Gondor fell.", "He wept."], places) == [("he", None)]  # never a place
    assert answers(spark, ["Hogwarts School closed.", "She left.", "They moved."], places) == [("she", None), ("they", "Hogwarts School")]
    assert answers(spark, ["Frodo met Sam.", "They thanked him."]) == [("they", None), ("him", "Frodo")]
    assert answers(spark, ["Frodo and Sam met Merry.", "They thanked him."]) == [("they", "Frodo and Sam"), ("him", "Frodo")]
    assert answers(spark, ["Mr. Brown saw him."]) == [("him", None)]  # not its own subject
    assert answers(spark, ["Frodo slept.", *["The day went by."] * 5, "He woke."]) == [("he", None)]  # too far
    assert answers(spark, ["Frodo slept.", "Sam met Frodo.", "Sam cooked.", "He ate."]) == [("he", "Sam")]
    assert answers(spark, ["Frodo slept.", "Frodo ate.", "Sam met Merry.", "He ate."]) == [("he", "Sam")] and answers(spark, ["", "no names"]) == []


def test_scores_of_random_dialogues_equal_brute_force(spark):
    rng, people = random.Random(7), {"Mr. Aa": "m", "Mrs. Bb": "f", "Cc": None, "Dd": None, "Ee": "place"}
    talks = []
    for d in range(40):
        for i in range(rng.randint(1, 12)):
            words = [rng.choice([*people, "he", "she", "him", "it"]) for _ in range(rng.randint(1, 4))]
            talks.append((d, i, words))
    df = spark.createDataFrame([(d, i, " saw ".join(w) + ".") for d, i, w in talks], "doc_id long, idx int, text string")
    known = spark.createDataFrame([("Ee", "PLACE")], "name string, type string")
    got = {(r.doc_id, r.sent, r.at): (r.antecedent, r.score) for r in coreference.resolved(coreference.described(coreference.mentions(df), known)).collect()}
    want = {}
    for d, i, words in talks:
        titled = {w.split()[-1]: people[w] for e, _, some in talks if e == d for w in some if w[:2] in ("Mr",)}
        for at, p in enumerate(words):
            if p in people:
                continue
            gender = {"he": "m", "him": "m", "she": "f", "it": "n"}[p]
            scores, last, unknown = {}, {}, set()
            for e, j, some in talks:
                if e != d or not i - 5 <= j <= i:
                    continue
                for k, w in enumerate(some):
                    if w not in people or (j == i and k >= at) or (p == "him" and j == i and k == 0):
                        continue
                    name = w.split()[-1]
                    g = titled.get(name)
                    if (name != "Ee" or g) if gender == "n" else (name == "Ee" or (g or gender) != gender):
                        continue
                    scores[name] = scores.get(name, 0) + (1.0 if k == 0 else 0.6) * 0.5 ** (i - j)
                    last[name] = max(last.get(name, (-1, -1)), (j, k))
                    unknown |= {name} if g is None else set()
            final = {n: round(s * (0.8 if n in unknown and gender in "mf" else 1.0), 6) for n, s in scores.items()}
            best = min(final, key=lambda n: (-final[n], -last[n][0], -last[n][1], n), default=None)
            want[d, i, at] = (best, final.get(best))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and (got[k][1] is None or abs(got[k][1] - want[k][1]) < 2e-6) for k in want)


# --- aliases ---------------------------------------------------------------------------------------------------------


def greedy(text, known):
    tokens = [m.group().lower() for m in aliases._tokens(text)]
    index = {}
    for a, i in known:
        key = aliases._key(a)
        if key:
            index[key] = min(i, index.get(key, i))
    found = []
    for key in index:
        words = key.split(" ")
        found += [(at, len(words), key) for at in range(len(tokens) - len(words) + 1) if tokens[at : at + len(words)] == words]
    kept = []
    for at, n, key in sorted(found, key=lambda x: (-len(x[2]), x[0], x[2])):
        if not any(at < a + m and a < at + n for a, m, _ in kept):
            kept.append((at, n, key))
    return sorted((at, n, key, index[key]) for at, n, key in kept)


def test_aliases_equal_greedy_matching(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "Grey", "gandalf", "of", "St.", "Mary's", "É", "x"])
    known = [(" ".join(word() for _ in range(rng.randint(1, 5))), f"e{i}") for i in range(120)] + [(None, "n"), ("", "m"), ("  ", "o")]
    texts = [(i, " ".join(word() + rng.choice(["", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(98, None), (99, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("id", F.lit("x"))
    got = {}
    for r in aliases.alias_mentions(docs, spark.createDataFrame(known, "alias string, id string")).collect():
        text = dict(texts)[r.doc_id]
        assert aliases._key(text[r.start : r.end]) == r.key
        got.setdefault(r.doc_id, []).append((r["at"], r.n, r.key, r.id))
    for i, text in texts:
        assert sorted(got.get(i, [])) == greedy(text or "", known)
    assert aliases.alias_mentions(docs, spark.createDataFrame([], "alias string, id string")).count() == 0


def test_a_million_aliases(spark):
    known = spark.range(1_000_000).select(F.concat(F.lit("name "), F.col("id").cast("string"), F.lit(" the great")).alias("alias"), "id")
    docs = spark.createDataFrame([(1, "Name 77 the Great met name 999999 the great and name 5 the small."), (2, "no one")], "doc_id long, text string")
    assert sorted(r.id for r in aliases.alias_mentions(docs, known).collect()) == [77, 999_999]


# --- dependency paths ------------------------------------------------------------------------------------------------


def bfs(tokens, a, b):
    if a == b:
        return None
    near = {i: [] for i in range(len(tokens))}
    for i, (_, dep, head) in enumerate(tokens):
        if head is not None and 0 <= head < len(tokens) and head != i:
            near[i].append((head, f":↑{dep}:{tokens[head][0]}"))
            near[head].append((i, f":↓{dep}:{tokens[i][0]}"))
    seen, queue = {a: tokens[a][0]}, [a]
    for i in queue:
        for j, edge in near[i]:
            if j not in seen:
                seen[j] = seen[i] + edge
                queue.append(j)
    return seen.get(b)


def test_paths_of_random_trees_equal_breadth_first_search(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(300):
        n = rng.randint(1, 14)
        order = rng.sample(range(n), n)
        tokens = [None] * n
        for place, i in enumerate(order):
            root = place == 0 or rng.random() < 0.05  # several roots: no path between their trees
            tokens[i] = (f"l{i % 5}", rng.choice(["nsubj", "dobj", "prep"]), rng.choice([i, None, -1]) if root else order[rng.randrange(place)])
        a, b = rng.randrange(n), rng.randrange(n)
        rows.append((k, [(i, w, "VERB" if i % 3 else "ADP", dep, h) for i, (w, dep, h) in enumerate(tokens)], a, b))
        want[k] = bfs(tokens, a, b)
    rows += [(300, [(0, "x", "VERB", "d", 1), (1, "y", "ADP", "e", 0)], 0, 1), (301, [], 0, 1), (302, None, 0, 0), (303, [(0, "x", "VERB", "d", 0)], 0, 7)]
    want |= {300: "x:↓e:y", 301: None, 302: None, 303: None}
    df = spark.createDataFrame(rows, "k int, tokens array<struct<i:int,lemma:string,pos:string,dep:string,head:int>>, a int, b int")
    got = {r.k: (r.path, r.length, r.edges) for r in dependency.with_paths(df).collect()}
    assert {k: v[0] for k, v in got.items()} == want and sum(v is not None for v in want.values()) > 150
    assert all(v[1] is None or v[1] == len(v[2]) + 1 == v[0].count(":") // 2 + 1 for v in got.values())
