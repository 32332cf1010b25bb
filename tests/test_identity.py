"""Persons of one name, clusters under constraints, names in pieces, rewriting, the index and the digest, against plain Python."""

import datetime
import random
import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import digest as D
from skein.operators import homonyms as H
from skein.operators import linking as L
from skein.operators import stitching as S
from skein.operators.learning import learning_loop
from skein.operators.mentions import mention_spans
from skein.operators.rendering import biographies, index_lines
from skein.operators.resolution import without_siblings_as_parents
from skein.operators.spans import first_interval
from skein.sources import postings as I
from skein.streaming.jobs import run_debounce


def clash(a, b):
    if a == b:
        return False
    kin = any((x in a[1] and y in b[1]) or (y in a[1] and x in b[1]) for x, y in H.OPPOSITE)
    age = ("retired" in a[2] and "young" in b[2]) or ("young" in a[2] and "retired" in b[2])
    return bool(a[0] and b[0] and not set(a[0]) & set(b[0])) or kin or age or ("died" in a[2]) != ("died" in b[2])


def mixed(contexts):
    occ, kin, ages = (set().union(*(c[i] for c in contexts)) for i in range(3))
    both = kin & {"father", "mother"} and kin & {"son", "daughter"}
    return len(contexts) >= 3 and bool(both or len(occ) > 1 or (ages & {"died", "retired"} and "young" in ages))


def test_context_of(spark):
    texts = ["Cub, the WIZARD and king, father of Suc, died young.", "kings and wizardry", "", None, "his spouse " * 50_000]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", H.context_of(F.col("text")).alias("c")).orderBy("i").collect()]
    assert (got[0].occupations, got[0].relations, got[0].ages) == (["king", "wizard"], ["father"], ["died", "young"])
    assert all(not any(got[i]) for i in (1, 2, 3)) and got[4].relations == ["husband", "wife"]


def test_persons_equal_greedy_python_mention_by_mention(spark):
    rng = random.Random(5)
    pick = lambda words: tuple(sorted(rng.sample(words, rng.choice([0, 0, 0, 1, 1, 2]))))
    rows = []
    for at in range(1200):
        rows.append((f"n{int(rng.random() ** 3 * 60)}", at, (pick(["wizard", "farmer", "judge"]), pick(["father", "son", "uncle", "nephew"]), pick(["young", "retired", "died"]))))
    frame = spark.createDataFrame([(n, a, tuple(list(x) for x in c)) for n, a, c in rows], "name string, at long, context struct<occupations: array<string>, relations: array<string>, ages: array<string>>")
    got = {(r.name, r.at): r.person for r in H.split(frame.repartition(7)).collect()}
    want = {}
    for name in {n for n, _, _ in rows}:
        mine = [(a, c) for n, a, c in rows if n == name]
        groups = []
        for at, c in mine:
            fit = next((i for i, first in enumerate(groups) if not clash(first, c)), None)
            if fit is None:
                fit = len(groups)
                groups.append(c)
            want[name, at] = fit if mixed([c for _, c in mine]) else 0
    assert got == want and max(want.values()) > 3


def test_two_persons_split_and_three_agreeing_mentions_do_not(spark):
    texts = ["Tom, the farmer, left.", "Tom saw the wizard Tom.", "Tom came."] + ["Ann, the judge, left.", "Ann, judge of Rome.", "Ann came."] + ["Bob, the farmer.", "Bob, the wizard."]
    docs = spark.createDataFrame([(i, t[:3], t) for i, t in enumerate(texts)], "at int, name string, text string").withColumn("context", H.context_of(F.col("text")))
    got = {(r.name, r.person): (r.label, r.n, r.first) for r in H.described(H.persons(docs)).collect()}
    assert got == {("Tom", 0): ("Tom (farmer)", 2, 0), ("Tom", 1): ("Tom (wizard)", 1, 1), ("Ann", 0): ("Ann", 3, 3), ("Bob", 0): ("Bob", 2, 6)}
    assert H.split(docs.where("false")).count() == 0 and H.described(H.persons(docs.where("false"))).count() == 0


def groups(nodes, links):
    """The rounds of ``united`` in plain Python; nodes id -> (type, title, weight)."""
    root = {i: i for i in nodes}
    state = dict(nodes)

    def fit(a, b):
        return all(x is None or y is None or x == y for x, y in zip(state[a][:2], state[b][:2], strict=True))

    def contract(pairs):
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        new, seen = {}, set()
        for a in near:
            if a in seen:
                continue
            part, todo = {a}, [a]
            while todo:
                for b in near[todo.pop()] - part:
                    part.add(b)
                    todo.append(b)
            seen |= part
            new |= dict.fromkeys(part, min(part))
        for r in set(new.values()):
            part = [x for x in new if new[x] == r]
            pick = lambda k, part=part: max((state[x][k] for x in part if state[x][k]), default=None)
            state[r] = (pick(0), pick(1), sum(state[x][2] for x in part))
        for i in root:
            root[i] = new.get(root[i], root[i])

    edges = lambda: {(root[a], root[b]) for a, b in links if root[a] != root[b] and fit(root[a], root[b])}
    says = lambda x: sum(v is not None for v in state[x][:2])
    rounds = 0
    while edges():
        rounds += 1
        contract([(a, b) for a, b in edges() if says(a) == says(b)])
        both = [e for a, b in edges() for e in ((a, b), (b, a)) if says(e[0]) < says(e[1])]
        contract([(a, min((-state[y][2], y) for x, y in both if x == a)[1]) for a in {x for x, _ in both}])
    assert rounds <= 3
    return root, state, fit


NODE = "id string, type string, title string, weight long"


def test_united_equals_python_and_keeps_titles_apart(spark):
    rng = random.Random(11)
    nodes = {}
    for i in range(400):
        title = rng.choice([None, None, None, "dr", "lady"])
        nodes[f"n{i:03d}"] = ("PERSON" if title else rng.choice([None, "PERSON", "ORG", "PLACE"]), title, rng.randrange(5))
    links = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(420)]
    links = [(a, b) for a, b in links if a != b]
    frame = spark.createDataFrame([(i, *v) for i, v in nodes.items()] * 2, NODE)
    edges = spark.createDataFrame([*links, *links[:9], ("n000", "unknown"), ("n001", "n001"), (None, "n002")], "a string, b string")
    got = {r.id: (r.root, r.type, r.title) for r in L.united(frame, edges).collect()}
    root, state, fit = groups(nodes, links)
    assert got == {i: (r, *state[r][:2]) for i, r in root.items()}
    for r in set(root.values()):
        mine = [nodes[i] for i in nodes if root[i] == r]
        assert all(len({m[k] for m in mine} - {None}) <= 1 for k in (0, 1))
    assert not any(root[a] != root[b] and fit(root[a], root[b]) for a, b in links)


def test_a_chain_that_components_would_join(spark):
    nodes = spark.createDataFrame([("a", "PERSON", "dr", 3), ("b", None, None, 1), ("c", "PERSON", "lady", 5), ("d", "GPE", None, 1), ("e", "LOC", None, 2), ("f", "ORG", None, 1)], NODE)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "f")], "a string, b string")
    got = {r.id: r.root for r in L.united(nodes, links).collect()}
    assert got == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "d", "f": "f"}
    assert L.united(nodes.where("false"), links).count() == 0
    assert {r.id: r.root for r in L.united(nodes, links.where("false")).collect()} == {i: i for i in "abcdef"}


def test_one_key_for_all_nodes_makes_one_cluster_a_title(spark):
    rows = spark.range(600).select(F.format_string("n%03d", "id").alias("id"), F.lit("PERSON").alias("type"), F.when(F.col("id") % 3 == 1, "dr").when(F.col("id") % 3 == 2, "lady").alias("title"), (F.col("id") % 3).alias("weight"))
    nodes, links = L.key_links(rows, rows.select("id", F.lit("smith").alias("key")))
    assert nodes.count() == 604 and links.count() == 603
    got = {r.id: (r.root, r.title) for r in L.united(nodes, links).collect() if r.id[0] != "~"}
    want = {f"n{i:03d}": ("n001", "dr") if i % 3 == 1 else ("n000", "lady") for i in range(600)}
    assert got == want


def test_titles(spark):
    names = ["Dr. Smith", "Lady  Ann Grey", "Smith", "dr", "", None, "Drab Smith"]
    got = [tuple(r) for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(L.title_of(F.col("n")), L.stripped(F.col("n"))).collect()]
    assert got == [("dr", "smith"), ("lady", "ann grey"), (None, "smith"), (None, "dr"), (None, ""), (None, None), (None, "drab smith")]


def stitch(spans):
    """Runs of spans (gap, surface, type) in plain Python: (text, type, n)."""
    out = []
    ok = lambda w: w.lower() in S.CONNECTORS or w[:1].isupper()
    rank = lambda t: S.TYPES.index(t) if t in S.TYPES else 99
    for i, (gap, surface, kind) in enumerate(spans):
        words, before = gap.split(), spans[i - 1] if i else None
        near = i and gap[:1].isspace() and gap[-1:].isspace() and len(words) <= 1 and all(re.fullmatch("[A-Za-z.'’]+", w) and ok(w) for w in words)
        near = near and all(map(ok, surface.split())) and all(map(ok, before[1].split())) and not (words and words[0].lower() == "and" and before[2] == kind)
        if near:
            text, best, n = out[-1]
            out[-1] = (text + gap + surface, min(best, kind, key=rank), n + 1)
        else:
            out.append((surface, kind, 1))
    return out


def test_stitched_equals_python(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(150):
        spans = [(rng.choice([" ", " of ", " and ", " met ", ", ", " The ", "  de la ", " St. ", "\n"]), rng.choice(["Ann", "Ann Lee", "House of Lords", "ann"]), rng.choice(["PERSON", "PLACE", "ORG", "MISC"])) for _ in range(rng.randrange(9))]
        want[doc] = [] if not spans else stitch(spans)
        rows += [(doc, i, g, s, 0, 0, t) for i, (g, s, t) in enumerate(spans)]
    frame = spark.createDataFrame(rows, "doc_id long, ord int, gap string, surface string, start int, end int, type string")
    offsets = frame.withColumn("end", F.sum(F.length("gap") + F.length("surface")).over(Window.partitionBy("doc_id").orderBy("ord")).cast("int")).withColumn("start", F.col("end") - F.length("surface"))
    got = {}
    for r in S.stitched(offsets).orderBy("doc_id", "start").collect():
        assert r.end - r.start == len(r.text)
        got.setdefault(r.doc_id, []).append((r.text, r.type, r.n))
    assert got == {d: w for d, w in want.items() if w} and max(n for w in want.values() for _, _, n in w) > 3
    assert S.stitched(offsets.where("false")).count() == 0


def test_rewriting_there_and_back(spark):
    rng = random.Random(8)
    texts, edits = {}, []
    for doc in range(80):
        texts[doc] = "".join(rng.choice("abc é𝒳ß") for _ in range(rng.randrange(60)))
        at = 0
        while at < len(texts[doc]) and rng.random() < 0.8:
            a = rng.randrange(at, len(texts[doc]) + 1)
            b = min(len(texts[doc]), a + rng.randrange(4))
            edits.append((doc, a, b, rng.choice(["", "X", "long word", "𝒴"])))
            at = b + 1
    overlapping = [(d, a, b + 1, None) for d, a, b, _ in edits[::7] if b + 1 <= len(texts[d]) and b > a]
    frame = spark.createDataFrame([*edits, *edits[:5], *overlapping, (1, None, 2, "x"), (1, 4, 2, "x")], "doc_id int, start int, end int, replacement string")
    docs = spark.createDataFrame([*((d, t, d) for d, t in texts.items()), (900, None, 1), (901, "", 2)], "doc_id int, text string, end int")
    want, back, kept = {900: None, 901: ""}, {}, set()
    for doc, text in texts.items():
        mine = sorted({(a, -b, r or "") for d, a, b, r in [*edits, *overlapping] if d == doc})
        new, old, at, end = "", [], 0, -1
        for a, b, r in mine:
            if a >= end:
                new, old = new + text[at:a] + r, [*old, *range(at, a), *[a] * len(r)]
                kept.add((doc, a, -b, r))
                at = -b
            end = max(end, -b)
        want[doc], back[doc] = new + text[at:], [*old, *range(at, len(text))]
    got = S.rewritten(docs, frame)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == want
    placed = S.placed(frame)
    for r in placed.collect():
        assert want[r.doc_id][r.new_start : r.new_end] == r.replacement and (r.doc_id, r.start, r.end, r.replacement) in kept
    assert placed.count() == len(kept)
    points = spark.createDataFrame([(d, i) for d in back for i in range(len(back[d]))], "doc_id int, at int")
    assert {(r.doc_id, r.at): r.old for r in S.to_old(points, placed).collect()} == {(d, i): o for d in back for i, o in enumerate(back[d])}


def test_there_is_the_last_place_before_it(spark):
    docs = spark.createDataFrame([(1, "There Frodo studied at Rivendell. He lived there, then Bree. THERE he stayed; therefore."), (2, None), (3, "")], "doc_id int, text string")
    places = mention_spans(docs, r"(Rivendell|Bree)").select("doc_id", "start", F.col("surface").alias("name"))
    got = {r.doc_id: r.text for r in S.rewritten(docs, S.deictic_edits(docs, places)).collect()}
    assert got == {1: "There Frodo studied at Rivendell. He lived in Rivendell, then Bree. in Bree he stayed; therefore.", 2: None, 3: ""}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_index_equals_a_scan_after_updates_and_compaction(spark, tmp_path):
    rng = random.Random(2)
    words = ["ring", "sword", "elf", "orc", "gate", "the"]
    make = lambda: (" ".join(rng.choices(words, k=rng.randrange(3))), " ".join(rng.choices(words, k=rng.randrange(40))), rng.choice(["PERSON", "PLACE", None]))
    now = {f"d{i:03d}": make() for i in range(200)}
    frame = lambda rows: spark.createDataFrame([(i, *v) for i, v in rows.items()], "id string, label string, text string, type string")
    path = str(tmp_path / "index")
    I.build(frame(now), path)

    def scan(query):
        scores = {}
        for i, fields in now.items():
            score = 0
            for field, boost in zip(fields, I.BOOSTS.values(), strict=True):
                w = (field or "").lower().split()
                score += boost * sum(w.count(t) for t in set(query.lower().split())) / max(len(w), 1) ** 0.5
            if score:
                scores[i] = round(score, 6)
        return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]

    def found(query, path):
        return [(r.id, r.score) for r in I.search(spark, path, query, 10).collect()]

    assert found("Ring elf ring", path) == scan("Ring elf ring") and found("person", path) == scan("person")
    for gen in (1, 2):
        changed = {i: make() for i in rng.sample(sorted(now), 30)} | {f"new{gen}": ("ring", "ring", "ITEM")}
        gone = rng.sample(sorted(set(now) - set(changed)), 9)
        now = {i: v for i, v in (now | changed).items() if i not in gone}
        assert I.merge(frame(changed | dict.fromkeys(gone, (None, None, None))), path) == gen
        assert found("ring orc", path) == scan("ring orc")
    assert found("", path) == [] and found("zzz", path) == []
    I.compacted(spark, path, str(tmp_path / "compact"))
    assert found("ring orc", str(tmp_path / "compact")) == scan("ring orc")
    shown = plan(I.search(spark, path, "ring orc"))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET) ", shown) and re.search(r"PushedFilters: \[[^\]]*In\(term, \[orc,ring\]\)", shown)


def test_digest_does_not_see_ids_or_order(spark):
    entity = "id string, type string, canonical string, aliases array<string>"
    relation = "subj string, pred string, obj string, confidence double, extractor string, qualifiers array<struct<type: string, value: string>>"
    rows = [("1", "PERSON", "Tom", ["T", "A"]), ("2", "ITEM", "Ring", None)]
    edges = [("1", "has", "2", 0.9, None, [("t", "b"), ("t", "a")]), ("1", "has", "2", 0.9, None, [("t", "a"), ("t", "b")]), ("1", "met", "9", 0.5, "dep", None)]

    def digest(rows, edges):
        return {r.kind: (r.n, r.hash) for r in D.digest(D.canonical_lines(spark.createDataFrame(rows, entity), spark.createDataFrame(edges, relation))).collect()}

    new = {"1": "x", "2": "a"}
    renamed = digest([(new[i], k, n, a and a[::-1]) for i, k, n, a in rows[::-1]], [(new.get(s, s), p, new.get(o, o), *x) for s, p, o, *x in edges[::-1]])
    one = digest(rows, edges)
    assert one == renamed and one["relation"][0] == 3
    assert digest(rows, edges[:1] + edges[2:])["relation"] != one["relation"]
    assert digest([*rows[:1], ("2", "ITEM", "Rings", None)], edges) != one and digest([], []) == {}


def test_first_interval_equals_python(spark):
    rng = random.Random(6)
    intervals = [(rng.randrange(3), a, a + rng.choice([0, 1, 5, 40, 300]), i % 50) for i, a in enumerate(rng.choices(range(400), k=120))]
    points = [(k, at) for k in range(4) for at in range(-20, 760, 3)]
    want = {}
    for k, at in points:
        near = [(not a <= at < b, a, b, i) for key, a, b, i in intervals if key == k and a - 12 <= at < b + 12]
        if near:
            out, a, b, i = min(near)
            want[k, at] = (not out, a, b, i)
    frame = spark.createDataFrame(intervals, "k int, start int, end int, id int")
    for longest in (7, 1000):
        got = {(r.k, r.at): (r.inside, r.start, r.end, r.id) for r in first_interval(spark.createDataFrame(points, "k int, at int"), frame, ["k"], "at", 12, longest).collect()}
        assert got == want
    assert {w[0] for w in want.values()} == {True, False}


def test_a_learning_loop_that_was_stopped_goes_on(spark, tmp_path):
    rng = random.Random(4)
    names = [f"N{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(60)]
    texts = [" ".join(f"{rng.choice(names)} w{rng.choice('abcdefghijklmnop')}x" for _ in range(6)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    seeds = spark.createDataFrame([("Naa",), ("Nab",), ("Nab",)], "name string")
    said = {n: i % 4 != 3 for i, n in enumerate(names) if i % 11}
    answers = spark.createDataFrame([*said.items(), (names[2], False)], "name string, is_correct boolean")
    said[names[2]] = False

    def loop(name, **more):
        return sorted((r.round, r.name, r.status) for r in learning_loop(docs, seeds, answers, str(tmp_path / name), ask=5, **more).collect())

    whole = loop("whole")
    places = {}
    for t in texts:
        w = re.findall("[A-Za-z]+", t)
        for a, b in zip(w, w[1:], strict=False):
            for name, template in ((a, f"X {b}"), (b, f"{a} X")):
                if name[0].isupper() and template.replace("X ", "").replace(" X", "")[0].islower():
                    places.setdefault(template, []).append(name)
    known, refused, want = {"Naa", "Nab"}, set(), [(0, "Naa", "seed"), (0, "Nab", "seed")]
    for k in range(1, 6):
        good = [t for t, ns in places.items() if len(set(ns) & known) >= 2]
        score = {n: (round(1 - abs(0.5 - 0.5 ** sum(n in places[t] for t in good)) * 2, 6), sum(places[t].count(n) for t in good)) for t in good for n in places[t] if n not in known | refused}
        asked = sorted((n for n, s in score.items() if s[0] >= 0.3), key=lambda n: (-score[n][0], -score[n][1], n))[:5]
        want += [(k, n, {True: "confirmed", False: "rejected", None: "unanswered"}[said.get(n)]) for n in asked]
        yes = [n for n in asked if said.get(n)]
        known, refused = known | set(yes), refused | {n for n in asked if said.get(n) is False}
        if len(yes) < 2:
            break
    assert whole == sorted(want) and max(k for k, _, _ in want) >= 2
    first = loop("resumed", rounds=1)
    assert first == [r for r in whole if r[0] <= 1] and loop("resumed") == whole and loop("resumed") == whole


def test_bursts_do_not_depend_on_the_order_of_micro_batches(spark, tmp_path):
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=rng.randrange(4000)), i) for i, k in enumerate(rng.choices("aaab", k=160))]
    schema = "k string, ts timestamp, i int"
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=rng.randrange(60)))  # at most an hour late
    for name, order, size in (("whole", rows, 160), ("batches", late, 16)):
        for b in range(0, len(rows), size):
            spark.createDataFrame(order[b : b + size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    want = []
    for key in "ab":
        bursts = []
        for t in sorted(t for k, t, _ in rows if k == key):
            if bursts and t < bursts[-1][-1] + datetime.timedelta(minutes=45):
                bursts[-1].append(t)
            else:
                bursts.append([t])
        want += [(key, b[0], b[-1], len(b)) for b in bursts if b[-1] + datetime.timedelta(minutes=45) <= max(t for _, t, _ in rows) - datetime.timedelta(hours=1)]
    for name, files in (("whole", 8), ("batches", 1)):
        got = run_debounce(spark, str(tmp_path / name), ["k"], "45 minutes", "1 hour", files)
        assert sorted((r.k, r.first, r.last, r.n) for r in got.collect()) == sorted(want)
    assert len(want) > 20 and max(n for *_, n in want) > 3


def test_index_lines_number_each_type_over_ranges(spark):
    rows = [(None if i % 5 == 4 else f"T{i % 5}", f"Name {i * 7919 % 500:03d}", f"e{i:03d}") for i in range(600)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges also of a small table
    try:
        got = sorted((r.type or "", r.nth, r.line) for r in index_lines(spark.createDataFrame(rows, "type string, canonical string, id string")).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = []
    for kind in {t for t, _, _ in rows}:
        names = sorted((c, i) for t, c, i in rows if t == kind)
        want += [(kind or "", k, f"- [{c}](name-{c[5:]}.md)") for k, (c, _) in enumerate(names, 1)]
    assert got == sorted(want)


def test_biographies_limit_groups_before_the_shuffle(spark):
    told = spark.createDataFrame([("a", 1900 + i, 0.5, f"l{i}") for i in range(30)] + [("b", None, i / 10, f"u{i}") for i in range(9)] + [("a", None, 1.0, "x")], "id string, year int, weight double, line string")
    found = biographies(told)
    assert {r.id: r.text for r in found.collect()} == {"a": " ".join(f"l{i}" for i in range(10)), "b": "u8 u7 u6 u5 u4"}
    assert plan(found).count("WindowGroupLimit") >= 2


def test_siblings_are_no_parents(spark):
    docs = spark.createDataFrame([(1, "Then Tom Bell , the Eldest  son, met Ann, twin sister. Bob, a son, left."), (2, None), (3, "")], "doc_id int, text string")
    rows = [(1, "Tom Bell", "parent_of", "Bob"), (1, "Bob", "child_of", "ann"), (1, "Bob", "parent_of", "Ann"), (1, "Ann", "child_of", "Bob"), (1, "Tom Bell", "knows", "Ann"), (2, "Tom Bell", "parent_of", "Ann"), (3, None, "parent_of", "Ann"), (3, "Ann", None, "Bob")]
    got = without_siblings_as_parents(spark.createDataFrame([*rows, rows[2]], "doc_id int, subj string, pred string, obj string"), docs)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([*rows[2:], rows[2]], key=key)
