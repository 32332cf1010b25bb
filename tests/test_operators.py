import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import time as D
from skein.operators import entities, graph, mentions, paging, relations, spans
from skein.sources import tables
from skein.streaming import jobs

REL = "subj string, pred string, obj string, confidence double, extractor string, doc_id long, sent int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize_evidence(spark):
    assert one(spark, T.normalize_evidence(F.lit("  a\x07\n\t b "))) == "a b"
    long = one(spark, T.normalize_evidence(F.lit("x" * 500)))
    assert len(long) == 200 and long.endswith("...")
    assert one(spark, T.normalize_evidence(F.lit(None).cast("string"))) is None


def test_names_titles_and_keys(spark):
    assert one(spark, T.strip_title(F.lit("Dr. Ada Byron"))) == "Ada Byron"
    assert sorted(one(spark, T.cluster_keys(F.lit("Dr. Ada Byron")))) == ["ada byron", "dr. ada byron", "lastname:byron"]
    assert one(spark, T.slug(F.lit("Émile's  House"))) == "mile-s-house"


def test_document_id_is_little_endian(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"u::h::1").digest()[:8], "little")
    assert int(one(spark, T.document_id(F.lit("u"), F.lit("h")))) == want


@pytest.mark.parametrize(
    "text, want",
    [("on March 21, 1999", [("month_day_year", "1999-03-21"), ("year", "1999-01-01")]), ("in 3019 T.A", [("about_year", None), ("age", "3019-TA"), ("year", "3019-01-01")]), ("2024-03-21", [("iso_day", "2024-03-21"), ("iso_month", "2024-03-01"), ("year", "2024-01-01")])],
)
def test_time_expressions(spark, text, want):
    found = spark.createDataFrame([(text,)], "t string").select(F.explode(D.time_expressions(F.col("t"))).alias("e"))
    got = found.select("e.family", D.normalized(F.col("e.expression"), F.col("e.family")).alias("n")).collect()
    assert sorted((r.family, r.n or "") for r in got) == sorted((a, b or "") for a, b in want)


def test_snippet(spark):
    assert one(spark, T.snippet(F.lit("a" * 60 + "needle" + "b" * 90), F.lit("NEEDLE"))) == "..." + "a" * 30 + "needle" + "b" * 50 + "..."
    assert one(spark, T.snippet(F.lit("short"), F.lit("none"))) == "short"


def test_deduplicate_merges_aliases_and_keeps_direction(spark):
    df = spark.createDataFrame(
        [("a", "heads", "b", 0.5, "regex", 1, 0), ("a", "leads", "b", 0.9, None, 2, 0), ("b", "leads", "a", 0.4, "dep", 1, 0), ("a", "leads", "b", 0.9, None, 2, 0)], REL
    )
    got = {(r.subj, r.obj): r for r in relations.deduplicate(df).collect()}
    assert len(got) == 2
    assert (got["a", "b"].confidence, got["a", "b"].extractor, got["a", "b"].n_evidence, got["a", "b"].n_merged) == (0.9, "regex", 2, 3)


def test_dedup_stats_of_nothing(spark):
    r = relations.deduplication_stats(spark.createDataFrame([], REL)).first()
    assert (r.original, r.deduplicated, r.removal_rate) == (None, 0, 0.0)


def test_suppress_near(spark):
    df = spark.createDataFrame([("a", "parent_of", "b", 0.9, "dep", 1, 4), ("b", "married_to", "a", 0.9, "dep", 1, 6), ("a", "parent_of", "b", 0.9, "dep", 1, 9), ("a", "parent_of", "b", 0.9, "dep", 2, 5)], REL)
    got = relations.suppress_near(df, "parent_of", "married_to", 2, 0.75)
    assert sorted((r.doc_id, r.sent, r.pred) for r in got.collect()) == [(1, 6, "married_to"), (1, 9, "parent_of"), (2, 5, "parent_of")]


def test_cycles_and_orientation(spark):
    e = spark.createDataFrame([("a", "parent_of", "b"), ("b", "child_of", "a"), ("b", "parent_of", "c"), ("c", "parent_of", "a")], "subj string, pred string, obj string")
    assert graph.two_cycles(e, "parent_of", "child_of").count() == 0  # an edge and its inverse are no cycle
    assert [r.path for r in graph.cycles(e.where("pred = 'parent_of'"), 4).collect()] == ["a>b>c>a"]


def test_paths_stop_at_targets(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("a", "p", "c"), ("c", "p", "d")], "subj string, pred string, obj string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r.path for r in graph.paths(e, ids("a"), ids("c"), 3).collect()) == ["a>b>c", "a>c"]


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, 10), (1, 20)], "k long, at long")
    right = spark.createDataFrame([(1, 10, "x"), (1, 5, "w"), (2, 1, "z")], "k long, at long, v string")
    assert sorted((r.at, r.previous_v) for r in spans.asof_previous(left, right, ["k"], "at", "v").collect()) == [(10, "w"), (20, "x")]


def test_band_pairs_once(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 4, 5, 9, 10, 15, 100])], "k long, id long, t long")
    got = spans.band_pairs(df, ["k"], F.col("t"), 5, "id").select("a", "b").collect()
    ts = [0, 4, 5, 9, 10, 15, 100]
    want = sorted((i, j) for i in range(7) for j in range(i + 1, 7) if abs(ts[i] - ts[j]) <= 5)
    assert sorted((r.a, r.b) for r in got) == want


def test_levenshtein_pairs_equal_brute_force(spark):
    names = ["ring", "rings", "king", "kin", "thing", "rung", "a", "", "gnir", "ringsx"]
    got = {(r.a, r.b) for r in entities.levenshtein_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return a == b
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    assert got == {(a, b) for a in names for b in names if a < b and near(a, b)}


def test_overrides_last_wins_and_rollback(spark):
    e = spark.createDataFrame([("1", "ORG", "Old"), ("2", "ORG", "Kept")], "id string, type string, canonical string")
    c = spark.createDataFrame(
        [(1, "rename", "1", "New", False), (2, "rename", "1", "Newer", False), (3, "retype", "1", "PLACE", True), (4, "alias", "1", "N", False), (5, "reject", "2", None, False)],
        "seq long, kind string, target string, value string, rolled_back boolean",
    )
    got = {r.id: r for r in entities.apply_overrides(e, c).collect()}
    assert (got["1"].type, got["1"].canonical, got["1"].aliases, got["1"].rejected) == ("ORG", "Newer", "N|Old", False)
    assert got["2"].rejected


def test_paging(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(9)], "k string")
    first = [r.k for r in paging.page(df, "k", None, 4).collect()]
    second = [r.k for r in paging.page(df, "k", paging.encode_cursor(first[-1]), 4).collect()]
    assert first + second == [f"k{i}" for i in range(8)]
    assert [r.k for r in paging.page_before(df, "k", paging.encode_cursor("k2"), 5).collect()] == ["k1", "k0"]
    with pytest.raises(ValueError):
        paging.decode_cursor("%%%")
    with pytest.raises(ValueError):
        paging.page(df, "k", None, 0)


def test_ingest_takes_a_content_once(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "table")
    inbox.mkdir()
    (inbox / "a.txt").write_text("The Ring")
    (inbox / "b.md").write_text("The Ring")
    (inbox / "c.pdf").write_text("no")
    jobs.ingest(spark, str(inbox), out, lambda df: df)
    (inbox / "d.txt").write_text("A Sword")
    (inbox / "e.txt").write_text("The Ring")
    jobs.ingest(spark, str(inbox), out, lambda df: df)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["A Sword", "The Ring"]
    assert tables.text_files(spark, str(inbox)).count() == 4


def test_predicate_filter_reaches_the_scan(spark, tmp_path):
    tables.table(spark, "/root/testdata/sf0.001", "lineitem")
    df = relations.query(tables.triples(spark, "/root/testdata/sf0.001"), tables.entities(spark, "/root/testdata/sf0.001"), pred="part_of")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and plan.count("Relation") == 1  # the other branches are pruned


def test_codec_round_trip():
    from hypothesis import given
    from hypothesis import strategies as st

    from skein.functions import codec

    @given(st.lists(st.integers(0, 2**63), max_size=8))
    def round_trip(values):
        data = b"".join(map(codec.varint, values))
        assert codec.read_varints(codec.from_base62(codec.base62(data))) == values

    round_trip()
    with pytest.raises(ValueError):
        codec.read_varints(b"\x80")


def test_approve_adds_both_ways_once(spark):
    from skein.operators import review

    items = spark.createDataFrame([("a", "ally_of", "b", 0.5, "approved"), ("b", "ally_of", "a", 0.6, "approved"), ("c", "p", "d", 1.0, "pending"), ("x", "p", "y", 1.0, "approved")], "subj string, pred string, obj string, confidence double, status string")
    known = spark.createDataFrame([("x", "p", "y")], "subj string, pred string, obj string")
    got = review.approve(items, known, ["ally_of"]).collect()
    assert sorted((r.subj, r.obj, r.confidence) for r in got) == [("a", "b", 0.6), ("b", "a", 0.6)]


def test_cooccurrence_keeps_frequent_names(spark):
    found = spark.createDataFrame([(i, 0, name) for i in range(60) for name in ("Ann", "Bob", "Ann")] + [(0, 1, "Carl"), (1, 1, "Carl"), (2, 1, "Dora")], "doc_id long, ord int, surface string")
    got = {(r.a, r.b): r.n_docs for r in mentions.cooccurrence(found).collect()}
    assert got == {("ann", "bob"): 60, ("ann", "carl"): 2, ("bob", "carl"): 2}


def test_jaccard_classes_name_every_copy(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    other = "a text that stands alone and is copied once"
    docs = [(i, text) for i in (7, 3, 9, 5)] + [(4, text + " more"), (20, other), (21, other.upper()), (30, "no copy of this"), (31, None), (32, "")]
    got = {r.doc_id: tuple(r)[1:] for r in entities.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    copies, none = {i: (3, 3, 4) for i in (3, 5, 7, 9)}, (None, 0, 0)
    assert got == copies | {4: (4, 0, 4), 20: (20, 1, 1), 21: (20, 1, 1), 30: (30, 0, 0), 31: none, 32: none}
