"""Bounds, clashing columns, empty tables, very long texts, repeats and ties of the training-data operators."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, language_id, packing, pii, quality, simhash, token_counts, toxicity, url_filter, vector_search

from .test_llm import DOC, brute_contamination, library

#: Names that the stages and helpers use inside, in any case.
NAMES = ("_text", "_id", "_h", "_row", "h", "id", "of", "size", "H", "k", "root", "component_id", "n", "fp", "items", "hits", "label")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, None), (None, ""), (4, "q " * 40 + "w"), (5, "mail me at a@b.example now")]
    df = spark.createDataFrame(rows, DOC)
    seen = set()
    for n in NAMES:
        if n.lower() not in seen:
            seen.add(n.lower())
            df = df.withColumn(n, F.concat(F.lit(n + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return df


def values(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_stages_keep_the_values_of_every_column(spark, clashing, monkeypatch):
    bench = spark.createDataFrame([("1", "q q q"), ("2", "unseen words here"), ("3", "more of them")], "item_id string, text string")
    want = values(clashing.where("doc_id is null or doc_id <> 4"))
    for words in (decontaminate.BLOCK_WORDS, 3):  # one block, and several
        assert values(decontaminate.drop_contaminated(clashing, bench, block_words=words)) == want
    assert values(simhash.keep_one(clashing)) == values(clashing.where("doc_id in (1, 3, 4, 5)"))
    weight = np.zeros(toxicity.BUCKETS)
    weight[toxicity.hashed(["=zork"])] = 12.0
    model = toxicity.Model(weight, -6.0, np.zeros((2, 2)), np.array([-4.0, 10.0, 0.0, 0.0]))
    assert values(toxicity.drop_toxic(clashing, model)) == values(clashing)
    assert values(pii.redacted(clashing).where("doc_id <> 5")) == values(clashing.where("doc_id <> 5"))
    toxic = spark.createDataFrame([(1, "bad zork"), (2, None), (3, ""), (1, "bad zork")], DOC).withColumn("score", F.lit("kept"))
    assert values(toxicity.drop_toxic(toxic, model)) == values(toxic.where("doc_id <> 1"))


def test_stages_of_empty_tables(spark):
    import corpus_pipeline as P

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "one two three", "en", None, 13)], docs.schema)
    for d in (docs, some):
        n = d.count()
        assert toxicity.drop_toxic(d, toxicity.train(d, labels)).count() == n
        assert simhash.keep_one(d).count() == n and decontaminate.drop_contaminated(d, bench).count() == n
        assert pii.redacted(d).count() == n and packing.pack(d).count() == n
    assert toxicity.drop_toxic(docs, toxicity.train(docs, labels)).columns == docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


# --- samples ---------------------------------------------------------------------------------------------------------


def test_language_sample_is_bounded_and_distinct(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit_bags", lambda bags, *a: seen.append(bags) or language_id.Model([], np.zeros((1, 0)), np.zeros(0), 1.0, 0.0))
    rows = [(None, "same words again", "en")] * 2000 + [(None, f"word{'abcdefghij'[i % 10]} {i}", "en") for i in range(500)] + [(i, f"wort {i}", "de") for i in range(2000)] + [(9, "repeated", "fr")] * 500
    language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert zlib.crc32(b"9") % 4 != 2
    counts = {y: sum(b[2] == y for b in seen[0]) for y in ("en", "de", "fr")}
    assert counts == {"en": 50, "de": 50, "fr": 1}
    many = spark.createDataFrame([(i, "x y", f"l{i:04d}") for i in range(400)], "doc_id long, text string, lang string")
    language_id.train(many, per_language=50, sample=100)
    held = sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400))
    assert len({b[2] for b in seen[1]}) == 400 - held  # no language is left out


def test_quality_sample_counts_repeats_once(spark, monkeypatch):
    seen = []
    fit = quality.fit_features
    monkeypatch.setattr(quality, "fit_features", lambda xp, fp, xu, fu, prior: seen.append((len(xp), len(xu))) or fit(xp, fp, xu, fu, prior))
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(free[0], "a repeated row")] * 600 + [(free[0], f"other text {k}") for k in range(5)] + [(i, f"text number {i}") for i in free[1:300]]
    labels = spark.createDataFrame([(free[0], 1), (free[0], 1), (free[1], 1), (free[2], 0)], "doc_id long, quality int")
    quality.train(spark.createDataFrame(rows, DOC), labels, size=100)
    assert seen == [(2, 200)]


def test_toxicity_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda docs: seen.append(docs) or toxicity.Model(np.zeros(1), 0.0, np.zeros((2, 2)), np.zeros(4)))
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "word " * 20) for i in free[:300]] + [(free[0], "word " * 20)] * 500 + [(free[300], "long " * 100_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in free[:301]], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 2_000)
    toxicity.train(spark.createDataFrame(rows, DOC), labels, size=50)
    assert len(seen[0]) == 40 and all(len(t) <= 100 for t, _ in seen[0])  # twenty of each label fit
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 1 << 20)
    toxicity.train(spark.createDataFrame(rows, DOC), labels, size=50)
    assert 90 <= len(seen[1]) <= 100


# --- scores by plain Python -------------------------------------------------------------------------------------------


def test_quality_scores_against_brute_force():
    rng = random.Random(5)
    words = ["the", "Ring", "12", "a1b2", "%%%", "http://x.y/z?q=1", "ÉCOLE", "日本語", "x" * 200, "ab" * 90 + "7" * 30]
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3))
    model = quality.fit([text() for _ in range(30)], [text() for _ in range(60)], 0.3)
    for t in [text() for _ in range(20)] + ["", "one", None]:
        chunks, counts, total = (t or "").split(), {}, 0
        for c in chunks:
            for i in range(0, len(c), 64):
                for s in quality.shapes(c[i : i + 64]):
                    b = zlib.crc32(s.encode()) % quality.BUCKETS
                    counts[b], total = counts.get(b, 0) + 1, total + 1
        lines = [x for x in (t or "").split("\n") if x]
        n, d = max(1, len(chunks)), len(set(chunks))
        again = sum(chunks[i] == chunks[i - k] for k in (1, 2) for i in range(k, len(chunks)))
        figures = [np.log1p(len(chunks)), d / n, np.log(d + 1) / np.log(n + 2), again / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) - np.log1p(len(chunks)), len(t or "") / n / 10]
        z = model.bias + sum(w * min(5, max(-5, (f - m) / s)) for w, f, m, s in zip(model.figures, figures, model.mean, model.scale)) + sum(model.shapes[b] * (k / total) ** 0.5 for b, k in counts.items())
        assert abs(quality.score([t], model, quality.Shapes())[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_language_probabilities_against_brute_force():
    import re

    model = language_id.fit([("der die das und nicht", "de"), ("the and of that not", "en"), ("le la les et pas", "fr")] * 20)
    mask = (1 << 64) - 1

    def slow(text):
        sums, n = np.zeros(3), 0
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            w = [ord(c) for c in f"<{word}>"]
            for size in range(2, 6):
                for i in range(len(w) - size + 1):
                    h = w[i] * 0x9E3779B97F4A7C15 & mask
                    for c in w[i + 1 : i + size]:
                        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 + c) & mask
                    sums += model.table[(h * 0x94D049BB133111EB & mask) >> 40 & (language_id.BUCKETS - 1)]
                    n += 1
        z = (sums / max(n, 1) + model.bias) / model.temperature
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    predictor = language_id.Predictor(model)
    texts = ["the nicht", "", "les 12 and", "Straße über der Stadt", "x"]
    assert np.allclose(predictor.probabilities(texts), [slow(t) for t in texts])
    long = "der nicht und " * 30_000  # in pieces, with the same n-grams
    assert np.allclose(predictor.probabilities([long]), [slow("der nicht und")], atol=1e-6)


def test_letters_are_those_of_category_l():
    assert not any(language_id.has_letter(t) for t in ("", "½ ² Ⅷ 12 _ -", "٣ %", "😀"))
    assert all(language_id.has_letter(t) for t in ("a", "½é", "日", "ª"))


# --- long texts -------------------------------------------------------------------------------------------------------


def test_long_texts_take_time_in_proportion():
    began = time.perf_counter()
    pii.spans("token" + " " * 1_000_000 + "x iban" + "\t" * 1_000_000 + "account no" + " " * 1_000_000)
    text = "a" * 1_000_000 + "@" + "1" * 1_000_000 + "+" + "2 " * 500_000 + "://" * 100_000
    pii.spans(text)
    assert time.perf_counter() - began < 20


def test_counter_empties_its_tables_inside_a_word(monkeypatch):
    rng = random.Random(0)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=20_000))
    monkeypatch.setattr(token_counts, "MAX_STATES", 500)
    import public_tokenizers

    machine = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert machine.count([word, "x " + word]).tolist() == [len(library().encode(t, add_special_tokens=False).ids) for t in (word, "x " + word)]
    assert len(machine.states) <= 502 and not any(len(w) > token_counts.LONGEST for w in machine.words)


# --- grid of the exact search -----------------------------------------------------------------------------------------


def test_search_grid_with_hot_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))]
    hot = [2 * x for x in vectors[100][1]]
    vectors += [(1000 + i, hot) for i in range(300)] + [(50, hot)] * 40
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    exact = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in vectors]
    want = []
    for q in sorted({i for i, _ in exact if i % 50 == 0}):
        found = sorted((-int(a @ b), i) for j, a in exact if j == q for i, b in exact if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    for limit in (32 << 20, 4_000):
        monkeypatch.setattr(vector_search, "PART_BYTES", limit)
        monkeypatch.setattr(vector_search, "BLOCK_BYTES", limit // 8)
        got = vector_search.top_k(df.repartition(3), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect())) == want
    assert vector_search.entries(vector_search.build(vector_search.quantised(df))[0], 5).where(F.size("owners") > 6).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------------


def test_long_and_repeated_items_are_handed_out_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 30)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    long = " ".join(rng.choice(words) for _ in range(500))
    items = [(f"{i}", "same item of few words") for i in range(20)] + [("long", long), ("short", "w1 w2"), ("e", " ")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    blocks = list(decontaminate.handed_out(bench, block_words=200)[1])
    assert len(blocks) >= 3 and all(len(t.split()) <= 30 for b in blocks for _, t in b)
    docs = [(1, "intro " + " ".join(long.split()[100:160]) + " end"), (2, "the same item of few words, w1 w2"), (3, None), (4, " ".join(rng.choice(words) for _ in range(300)))]
    for block_words in (200, decontaminate.BLOCK_WORDS):
        for r in decontaminate.contamination(spark.createDataFrame(docs, DOC), bench, block_words=block_words).collect():
            n, hit, seen = brute_contamination(dict(docs)[r.doc_id], items)
            assert (r.n_words, sum(h.after - h.first for h in r.hits), sorted(r["items"])) == (n, hit, seen)


# --- long names, strange characters ----------------------------------------------------------------------------------


def test_urls_of_every_shape(spark):
    html = "<p>the ring casino win the win and " + "y" * 30 + "</p>"
    shapes = [None, "", "no scheme", "http://", "http://a", "https://x.example.com/" + "q" * 12_000, "https://thering.example/" + "casinowin" * 3000, "http://EİK.Com/ß?x#y"]
    rows = [(i, u, html) for i, u in enumerate(shapes)] + [(1, "", html), (None, "http://a", None), (50, "http://b.com/fr/x", html), (51, "http://b.com/de/x", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "name", "id", "begin", "word", "n", "salt", "side")})
    got = url_filter.judged(pages, url_filter.train(pages)).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    by = {r.page_id: r for r in got}
    assert by[5].path == "/" + "q" * 12_000 and by[0].host == by[2].host == "" and by[50].rule == "com/fr/" and by[51].verdict == "block"
    empty = pages.limit(0)
    assert url_filter.judged(empty, url_filter.train(empty)).count() == 0


def test_names_of_a_million_letters(spark):
    word = "abcdefghijklmnopqrstuvwxyz" * 2  # longer than what the join goes by
    df = spark.createDataFrame([("ring " * 9 + word,)], "html string")
    name = ("ring" + "\u00e9" + word) * 17_000
    began = time.perf_counter()
    got = url_filter.cut(spark.createDataFrame([(name,), ("ringring",)], "name string"), url_filter.word_counts(df), 10).collect()
    cut = {r.name: r.words for r in got}
    assert cut["ringring"] == ["ring", "ring"] and cut[name] == ["ring", "\u00e9", word] * 17_000
    assert time.perf_counter() - began < 60


def test_any_character_after_a_cue(spark):
    for cue in pii.CUES:
        for at in range(0, 0x110000, 64 if cue == "iban" else 1024):
            text = "".join(f"{cue} DE89{chr(c)}3704004405320130 " for c in range(at, at + 64, 7) if not 0xD800 <= c < 0xE000)
            for kind, a, b in pii.spans(text):
                assert text[a:b].isascii(), (cue, kind, text[a:b])
    some = [f"{cue} DE89{c}704004405320130" for cue in pii.CUES for c in "\u212a\u0130\u0131\u017f\u0660"]
    df = spark.createDataFrame(list(enumerate(some)), DOC)
    assert pii.personal_data(df).count() == pii.redacted(df).count() == len(some)
    assert ("iban", 5, 27) in pii.spans("iban DE89370400440532013000")


def test_blocks_with_many_hits_in_one_text(spark):
    random.seed(8)
    item = lambda: " ".join(f"w{random.randint(0, 40)}" for _ in range(random.randint(1, 30)))
    items = [(str(i), item()) for i in range(60)]
    docs = [(i, " ".join(random.choice(items)[1] if random.random() < 0.4 else item() for _ in range(60))) for i in range(4)] + [(9, None), (10, "")]
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id string, text string")
    one = {r.doc_id: r for r in decontaminate.contamination(df, bench).collect()}
    many = {r.doc_id: r for r in decontaminate.contamination(df, bench, block_words=100).collect()}
    assert decontaminate.handed_out(bench, block_words=100)[0] > 3 and one == many
    for i, text in docs:
        n, hit, seen = brute_contamination(text, items)
        assert (n, hit, seen) == (many[i].n_words, sum(x.after - x.first for x in many[i].hits), sorted(many[i]["items"]))
