"""The operators against brute-force versions, and their edge cases: nulls, empty texts, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import decontaminate, language_id, packing, pii, quality, queries, simhash, token_counts, toxicity, url_filter, vector_search
from skein.llm.common import Shared

from ..conftest import SF, rows

DOC = "doc_id long, text string"
#: Columns whose names the operators use inside.
CLASHING = {"h": 1, "fp": 2, "score": 0.5, "n": 7, "part": 3, "items": "x", "root": 1, "label": 0, "_text": 4, "short": 1}
EDGES = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (4, "a"), (None, "no id here"), (5, "Ünïcode ß ٣ 日本語 😀"), (6, "word " * 30_000), (7, "x" * 200_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOC).withColumns({k: F.lit(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


# --- 1 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) and rows(got) == rows(want)


def brute_contamination(text, items, window=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, seen = fold(text), set(), set()
    for i, t in items:
        p = fold(t)
        for k in range(max(1, len(p) - window + 1)) if p else ():
            win = p[k : k + window]
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    seen.add(i)
    return len(w), len(hit), sorted(seen)


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(1)
    words = "a b c d é".split()
    items = [(str(i), " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 5, 5, 13, 14, 20])] + [("e", ""), ("null", "q r s")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + ("" if i % 3 else "! " + rng.choice(items)[1].upper())) for i in range(60)]
    bench = spark.createDataFrame([(None if i == "null" else i, t) for i, t in items], "item_id string, text string")
    for block in (decontaminate.BLOCK_WORDS, 5):  # one block, and several
        got = decontaminate.contamination(spark.createDataFrame(docs, DOC), bench, block_words=block).collect()
        for r in got:
            n, hit, seen = brute_contamination(dict(docs)[r.doc_id], items)
            assert (r.n_words, sum(h.after - h.first for h in r.hits), sorted(r["items"])) == (n, hit, seen)


def test_decontaminate_edges(spark, edges, nothing):
    bench = spark.createDataFrame([("1", "word word word"), ("2", None)], "item_id string, text string")
    got = decontaminate.judged(decontaminate.contamination(edges, bench)).collect()
    assert len(got) == len(EDGES) and {r.doc_id for r in got if r.contaminated} == {6}
    assert decontaminate.contamination(nothing, bench).count() == 0
    none = decontaminate.judged(decontaminate.contamination(edges, bench.limit(0)))
    assert {r.items_sha256 for r in none.collect()} == {hashlib.sha256(b"").hexdigest()}
    kept = decontaminate.drop_contaminated(edges, bench)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) - 1


# --- 2 ---------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    nodes = sorted(set(fps.values()))
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in sorted(fps.items()):
        least.setdefault(find(f), d)
    return {d: least[find(f)] for d, f in fps.items()}


def test_simhash_against_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op2_simhash"](spark, SF).collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == fps
    assert {d: r.component_id for d, r in got.items()} == brute_components(fps)


def test_links_find_every_pair(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b for b in base} | {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    signed = [simhash._signed(f) for f in fps]
    ball = rng.getrandbits(64)  # a dense group, tied at one bit, and another near it that is not
    fps |= {ball ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)} | {ball ^ (0x15 << 40) ^ (1 << a) ^ (1 << b) for a in range(0, 12, 2) for b in range(1, 12, 2)}
    signed = [simhash._signed(f) for f in fps]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components({f: f & (2**64 - 1) for f in signed})
    for hot in (simhash.HOT, 30, 2):  # without split buckets, with them, and with buckets split twice
        monkeypatch.setattr(simhash, "HOT", hot)
        shared = Shared(spark)
        found = simhash.links(df, shared=shared)
        pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()}
        if hot > 30:
            assert pairs == {(a, b) for a in signed for b in signed if a < b and near(a, b)}
        roots = {r.node: r.root for r in simhash.components(found, shared).collect()}
        assert {f: roots.get(f, f) for f in signed} == want


def test_allocation_obeys_the_generalised_pigeonhole():
    for m in (2, 3, 4):
        _, ts = simhash.allocate([[0, 1, 5, 50, 500]] * m, 3)
        assert sum(ts) == 3 - m + 1 and min(ts) >= -1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges, Shared(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_simhash_edges(spark, edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    assert {r.component_id for r in got if r.fp == 0} == {1}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7]


# --- 3, 6, 9 ---------------------------------------------------------------------------------------------------------


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    pair, score = rng.normal(size=(2, 2)), rng.normal(size=9)
    first, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    fwd, bwd = toxicity.messages(score, first, length, pair)
    got = toxicity.sigmoid(fwd + bwd)
    for a, n in zip(first, length):
        total, hit = 0.0, np.zeros(n)
        for mask in range(1 << n):
            tags = [mask >> k & 1 for k in range(n)]
            weight = np.exp(sum(score[a + k] * tags[k] for k in range(n)) + sum(pair[x, y] for x, y in zip(tags, tags[1:])))
            total += weight
            hit += weight * np.array(tags)
        assert np.allclose(got[a : a + n], hit / total)


def test_toxicity_learns_and_marks_offsets(spark):
    rng = random.Random(0)
    clean = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(50)]
    text = lambda bad: " ".join(rng.choice(clean) if rng.random() > 0.2 * bad else rng.choice(["Gloob!", "zarkin"]) for _ in range(40)) + "."
    docs = [(i, text(i % 2)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, DOC)
    model = toxicity.train(df, labels)
    got = toxicity.scored(df, model).collect()
    assert all(r.predicted == r.doc_id % 2 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    for r in got:
        for s in r.offsets:
            assert re.fullmatch(r"((Gloob!|zarkin)\.?\s?)+", dict(docs)[r.doc_id][s.start : s.end])
    assert toxicity.drop_toxic(df, model).count() == 150


@pytest.mark.parametrize("labelled", [True, False])
def test_scores_of_edges(spark, edges, nothing, labelled):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, 1, 0), (7, 0, 1)] if labelled else [], "doc_id long, quality int, toxic int")
    for found, empty in (
        (toxicity.scored(edges, toxicity.train(edges, labels)), toxicity.scored(nothing, toxicity.train(nothing, labels))),
        (quality.scored(edges, quality.train(edges, labels)), quality.scored(nothing, quality.train(nothing, labels))),
    ):
        got = found.collect()
        assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got) and empty.count() == 0


def test_quality_separates_held_out(spark, duck):
    got = {r.doc_id: r for r in queries.QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = duck.execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    right = [got[d].predicted == q for d, q in labels if got[d].held_out]
    assert len(right) > 40 and np.mean(right) >= 0.95


def test_shapes_reach_the_end_of_a_chunk():
    count = lambda text: np.bincount(quality.Shapes().of(text.split()), minlength=quality.BUCKETS).tolist()
    assert count("x" * 64 + "9" * 64) != count("x" * 128) and count("a1b2c3" + "d4") != count("a1b2c3" + "-+")
    assert sum(count("x" * 640)) == 10 and sum(count("plain words here")) == 3


def test_non_negative_risk_with_pure_unlabelled():
    model = quality.fit(["plain words here"] * 20, ["plain words here"] * 40, 0.9)
    assert np.isfinite(model.shapes).all() and quality.score(["plain words here"], model, quality.Shapes())[0] > 0.5


def test_language_id(spark, duck, edges, nothing):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, sf).collect()}
    right = [got[d].lang_pred == lang for d, lang in duck.execute(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall() if got[d].held_out]
    assert len(right) > 100 and np.mean(right) >= 0.95
    model = language_id.fit([("der die das und", "de"), ("the and of that", "en")] * 20)
    found = {(r.doc_id, r.lang_pred == "und", r.score > 0) for r in language_id.predicted(edges, model).collect()}
    assert {(1, True, False), (2, True, False), (3, True, False), (4, False, True)} <= found
    untrained = language_id.predicted(edges, language_id.train(edges.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in untrained.collect()} == {"und"}
    assert language_id.predicted(nothing, model).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_pii_against_patterns():
    rng = random.Random(3)
    parts = [*"@@@..++--  ()019aZ_%é\n", "1.2.3.4", "4111 1111 1111 1111", "a@b.c", "+1 (555) 123-4567", 'token = "abc123def456"', "http://x.y/z", "IBAN DE89 3704 0044 0532 0130 00", "account no. 12345678"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == brute_spans(t)
        assert not pii.spans(pii.redact(t))


def test_pii_query_and_edges(spark, texts, edges, nothing):
    got = {r.doc_id: r for r in queries.QUERIES["op4_pii"](spark, SF).collect()}
    for d, t in texts:
        base = brute_spans(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
    assert pii.personal_data(edges).count() == len(EDGES) and pii.personal_data(nothing).count() == 0
    masked = pii.redacted(edges.withColumn("n_chars", F.length("text").cast("long")))
    assert masked.columns[:2] == ["doc_id", "text"] and masked.where("n_chars is null").count() == 1


# --- 5, 10 -----------------------------------------------------------------------------------------------------------


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(got, docs):
    lib, bins, pieces = library(), {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = 0
    for d, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        mine = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == 1 if len(ids) <= 1024 else all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    return len(bins), -(-total // 1024)


def test_packing_query(spark, texts):
    used, least = check_packing(queries.QUERIES["op5_best_fit_packing"](spark, SF).collect(), texts)
    assert used <= 1.05 * least + 1


def test_packing_edges(spark, edges, nothing):
    docs = [(i, t) for i, t in EDGES if i not in (None, 4)]
    got = packing.pack(edges)
    check_packing(got.collect(), docs)
    assert got.where("doc_id is null").count() == 1 and got.where("doc_id = 4").count() == 2
    assert packing.pack(nothing).count() == 0


def test_best_two_fit_improves_on_greedy():
    # Greedy takes 6 and 3; two pieces of 2 fill the bin that 3 leaves open.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]
    plan = packing.best_two_fit({k: 7 for k in range(1, 1025)})
    counts = {}
    for pieces, times in plan:
        assert sum(pieces) <= 1024
        for p in pieces:
            counts[p] = counts.get(p, 0) + times
    assert counts == {k: 7 for k in range(1, 1025)}


def odd_texts():
    rng = random.Random(1)
    parts = ["'", "s", "'re", "'r", "'ll", "l", "e", "r", " ", "  ", "\n", "\t", "a", "Hello", "the", "12", "é", "ß", "!!", "--", "　", "日本", "😀", "<|endoftext|>", "x", "\0", " '", "\x1c", "\x85", "²", "½", "İ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]


def test_encoder_and_counter_equal_the_library():
    some = odd_texts()
    want = [e.ids for e in library().encode_batch(some, add_special_tokens=False)]
    assert packing.encoder("byte_bpe_50k.json").encode(some) == [np.array(i, "<u4").tobytes() for i in want]
    assert token_counts.counter("byte_bpe_50k.json").count(some).tolist() == [len(i) for i in want]


def test_counter_starts_again_with_empty_tables(monkeypatch):
    some = odd_texts()
    monkeypatch.setattr(token_counts, "MAX_WORDS", 50)
    machine = token_counts.counter("byte_bpe_50k.json")
    got = [n for i in range(0, len(some), 100) for n in machine.count(some[i : i + 100]).tolist()]
    assert got == [len(e.ids) for e in library().encode_batch(some, add_special_tokens=False)]


def test_prefix_scan_does_not_depend_on_chunks(monkeypatch):
    points = np.frombuffer("it's  a test\n\n of 'chunks'll 12x!".encode("utf-32-le"), np.uint32)
    points = np.append(np.tile(points, 40), 0x110000)
    want = token_counts.starts(points)
    for chunk in (1, 2, 7, 4096):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert (token_counts.starts(points) == want).all()


def test_token_counts_query_and_edges(spark, texts, edges, nothing):
    got = {r.doc_id: r for r in queries.QUERIES["op10_token_counts"](spark, SF).collect()}
    lib = library()
    for d, t in texts:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len(t.encode()), n > 1024)
    found = token_counts.token_counts(edges).collect()
    assert len(found) == len(EDGES) and sum(r.n_tokens == 0 for r in found) == 2
    assert token_counts.token_counts(nothing).count() == 0


# --- 7, 8 ------------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = [
        ("http://WWW.Example.ORG/es/1?x=/en", "www.example.org", "/es/1", "example.org/es/"), ("https://a.org/x#y?z", "a.org", "/x", "org/"), ("https://example.org", "example.org", "", None),
        ("x.com/fr/", "", "", None), (None, "", "", None), ("ftp://com/fr/a", "com", "/fr/a", "com/fr/"), ("http://notorg/x", "notorg", "/x", None), ("http://b.example.org/en/12", "b.example.org", "/en/12", "example.org/en/1"),
        ("http://q?://a.org/", "q", "", None), ("://c.com/de/", "c.com", "/de/", "com/de/"), ("http://", "", "", None),
    ]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judged(pages, url_filter.train(pages)).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (dict((b, a) for a, b in url_filter.RULES)[rule] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    empty = pages.limit(0)
    assert url_filter.judged(empty, url_filter.train(empty)).count() == 0


def brute_verdicts(pages, train_pages, rules=url_filter.RULES):
    """The verdicts of (page_id, url) by plain Python, trained on (page_id, url, html)."""
    counts = {}
    for _, _, html in train_pages:
        text = re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", html or "").lower()
        for w in re.findall(r"[^\W\d_]+", text):
            if len(w) > 1:
                counts[w] = counts.get(w, 0) + 1
    total = max(1, sum(counts.values()))

    def of(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fits)[1:] if fits else (None, None)

    def best(name):  # every split, by memory of the ends
        ways = {0: (0.0, [])}
        for end in range(1, len(name) + 1):
            options = []
            for begin in range(end):
                w = name[begin:end]
                if w in counts and len(w) > 1:
                    options.append((ways[begin][0] + np.log(counts[w] / total), [*ways[begin][1], w]))
            p, words = ways[end - 1]
            options.append((p + np.log(0.1 / total) / 2, [*words, "?" + name[end - 1]]))
            ways[end] = max(options, key=lambda x: x[0])
        out = []
        for w in ways[len(name)][1]:
            if w[0] == "?" and out and out[-1][0] == "?":
                out[-1] += w[1:]
            else:
                out.append(w)
        return [w.lstrip("?") for w in out]

    tokens = lambda host, path: [f"{s}:{w}" for s, t in (("h", host), ("p", path)) for name in re.findall(r"[^\W\d_]+", t.lower()) for w in best(name)]
    seen, n = {"block": {}, "allow": {}}, {"block": 0, "allow": 0}
    for host, path, verdict in {(h, p, v) for h, p, (_, v) in (of(u) for _, u, _ in train_pages) if v}:
        n[verdict] += 1
        for t in tokens(host, path):
            seen[verdict][t] = seen[verdict].get(t, 0) + 1
    vocabulary = seen["block"].keys() | seen["allow"].keys()
    size = {v: sum(c.values()) + len(vocabulary) + 1 for v, c in seen.items()}
    out = []
    for page_id, url in pages:
        host, path, (rule, verdict) = of(url)
        odds = np.log((n["block"] + 1) / (n["allow"] + 1)) + sum(np.log((seen["block"].get(t, 0) + 1) / size["block"]) - np.log((seen["allow"].get(t, 0) + 1) / size["allow"]) for t in tokens(host, path) if t in vocabulary)
        out.append((page_id, host, path, rule, verdict, odds))
    return out


def test_url_filter_against_brute_force(spark, duck):
    pages = duck.execute("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries.QUERIES["op7_url_filter"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for page_id, host, path, rule, verdict, odds in brute_verdicts([p[:2] for p in pages], pages):
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict and r.block_odds is None
        else:
            assert abs(r.block_odds - odds) < 1e-6 and (abs(odds) < 1e-9 or r.verdict == ("block" if odds > 0 else "allow"))


def test_segmentation():
    words, unknown = url_filter.logs({"casino": 5, "win": 5, "the": 9, "ring": 4, "x" * 40: 3}, 1_000)
    assert url_filter.segment("casinowin", words, unknown) == ["casino", "win"] and url_filter.segment("thering", words, unknown) == ["the", "ring"]
    assert url_filter.segment("qqqq", words, unknown) == ["qqqq"] and url_filter.segment("the" + "x" * 40, words, unknown) == ["the", "x" * 40]
    assert "xx" not in url_filter._words("<p>the ring</p><script>xx</script>")


def test_words_of_all_pages_are_counted(spark):
    filler, long = "<p>" + "lorem " * 4_000 + "</p>", "zorkmid" * 6
    pages = [(i, "http://x.example.net/a", f"<p>page{i}</p>") for i in range(1_200)] + [(5_000 + i, "http://x.example.net/a", f"{filler}zorkmid quuxly {long}") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    counts = {r.word: r.n for r in url_filter.word_counts(df).collect()}
    assert counts["zorkmid"] == counts["quuxly"] == counts[long] == 3 and counts["lorem"] == 12_000 and counts["page"] == 1_200
    some = spark.createDataFrame([(long + "quuxly",), ("quuxlyzzzzmid",), ("lorempage",)], "name string")
    got = {r.name: r.words for r in url_filter.cut(some, url_filter.word_counts(df), sum(counts.values())).collect()}
    assert got == {long + "quuxly": [long, "quuxly"], "quuxlyzzzzmid": ["quuxly", "zzzzmid"], "lorempage": ["lorem", "page"]}
    blocked = spark.createDataFrame([(9_000 + i, f"http://zorkmid{'abcdefghij'[i % 10]}.example.com/de/{i}", None) for i in range(400)], df.schema)
    model = url_filter.train(df.unionByName(blocked))
    asked = spark.createDataFrame([(1, "http://quuxlyzorkmid.example.net/b"), (2, "http://quuxlyzzzzmid.example.net/b"), (None, "http://quuxlyzorkmid.example.net/b"), (3, None), (4, "http://" + "ab1" * 3_000)], "page_id long, url string").withColumns({k: F.lit("x") for k in ("host", "salt", "name", "verdict", "words")})
    rows_ = url_filter.judged(asked.unionByName(asked), model).collect()
    odds = {r.page_id: r.block_odds for r in rows_}
    assert len(rows_) == 10 and odds[1] > odds[2] and odds[None] == odds[1]
    extra = spark.createDataFrame([(f"http://good{i}.example.net/a", "allow") for i in range(20)], "url string, verdict string")
    assert url_filter.train(df, labelled=extra)[0].tokens["h:good"] < 0


def test_top_k_against_brute_force(spark, nothing):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 12)))]
    vectors += [(300, vectors[0][1]), (301, vectors[0][1]), (302, None), (303, []), (304, [1.0, None]), (305, [float("nan")] * 12), (306, [float("inf")] * 12), (350, [1.0] * 5), (351, [2.0] * 5), (352, [1000.0] * 12)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("dims", F.lit(1))
    got = {}
    for r in vector_search.top_k(df, F.col("vec_id") % 50 == 0, 5, bits=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in exact if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q and len(v) == len(exact[q]))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_counts_every_repeated_row(spark, duck):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 6)))]
    near = [4 * x for x in vectors[50][1]]
    vectors += [(200 + i, near) for i in range(2)] + [(7, near)] * 7 + [(100, near)] * 2 + [(100, vectors[3][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = duck.cursor()
    want.execute("CREATE TEMP TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    want.executemany("INSERT INTO embeddings VALUES (?, ?)", vectors)
    want = rows(want.execute(queries.ORACLE_SQL["op8_exact_top_k"]).fetchdf())
    for parts in (1, 5):
        assert rows(vector_search.top_k(df.repartition(parts), F.col("vec_id") % 50 == 0, 5).toPandas()) == want


def test_bounds_hold_and_spare_reads():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(2000, 32)) * 30).astype(np.int64)
    lo, width = x.min(axis=0), np.maximum(1, -(-(x.max(axis=0) - x.min(axis=0) + 1) // 64))
    best = vector_search.Best(np.array([0]), x[:1], 5)
    ids = np.arange(2000)
    reads = best.scan(ids, ids, np.ones(2000, bool), ((x - lo) // width).astype(np.uint8), [v.astype(np.int16).tobytes() for v in x], lo, width)
    assert reads < 400 and best.score[0].tolist() == sorted((x[1:] @ x[0]).tolist(), reverse=True)[:5]


# --- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    stage = dict(P.STAGES)
    keep = lambda df: Shared(spark).write(df)
    before = keep(stage["toxicity"](spark, docs, SF))
    assert before.schema.names == docs.schema.names and 0 < before.count() < docs.count()
    after = keep(stage["simhash_near_dedup"](spark, before, SF))
    fps = {r.doc_id: brute_fingerprint(r.text) for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == set(brute_components(fps).values())
    clean = keep(stage["benchmark_decontamination"](spark, after, SF))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r.doc_id for r in after.collect() if (n := brute_contamination(r.text, items)) and not (n[1] > 0 and 20 * n[1] >= n[0])}
    assert {r.doc_id for r in clean.collect()} == good
    masked = keep(stage["pii"](spark, clean, SF))
    assert masked.count() == clean.count() and not any(brute_spans(r.text) for r in masked.collect())
    check_packing(stage["best_fit_packing"](spark, masked, SF).collect(), [(r.doc_id, r.text) for r in masked.collect()])
