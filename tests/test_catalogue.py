"""Every registered query against its SQL, and the ones without SQL against a plain Python version."""

import pytest

from skein.plans import catalogue, further, identity, knowledge, language, more, narrative, rendering  # noqa: F401

from .conftest import SF, rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in EMPTY_AT_THIS_SIZE


#: Queries whose condition nothing meets in the smallest tables.
EMPTY_AT_THIS_SIZE = {"jaccard_pairs"}


def test_segments(spark, duck):
    got = {(r.doc_id, r.seg): (r.n_paragraphs, r.n_words) for r in catalogue.QUERIES["segments_450_600"](spark, SF).collect()}
    want = {}
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        seg = words = 0
        for line in text.split("\n"):
            if not line.strip(" "):
                continue
            n = len(line.strip(" ").split())
            if words >= 450 or words and words + n > 600:
                seg, words = seg + 1, 0
            words += n
            a, b = want.get((doc_id, seg), (0, 0))
            want[doc_id, seg] = a + 1, b + n
    assert got == want


def test_token_bucket(spark, duck):
    got = {r.event_id: r.allowed for r in catalogue.QUERIES["token_bucket"](spark, SF).collect()}
    state, want = {}, {}
    for event, user, at in duck.execute("SELECT event_id, user_id, epoch_us(ts) / 1e6 FROM events ORDER BY ts, event_id").fetchall():
        tokens, last = state.get(user, (3, at))
        tokens = min(3, tokens + (at - last) / 21_600)
        want[event] = tokens >= 1
        state[user] = tokens - want[event], at
    assert got == want


def test_graph_hash_ignores_order_and_repetition(spark):
    from skein.sources import exports

    a = spark.createDataFrame([("x", "p", "y"), ("y", "p", "z")], "subj string, pred string, obj string")
    b = spark.createDataFrame([("y", "p", "z"), ("x", "p", "y"), ("x", "p", "y")], "subj string, pred string, obj string")
    assert exports.graph_hash(a).collect() == exports.graph_hash(b).collect()


def test_entity_pages(spark):
    page = next(r for r in catalogue.QUERIES["entity_pages"](spark, SF).collect() if r.id == "N1")
    assert page.slug == "nation-1" and page.page.startswith("# NATION_1\n## part_of\n- ")


def test_queries_without_row_filters(spark, duck):
    edges = {(f"N{a}", f"N{b}") for a, b in duck.execute("""SELECT DISTINCT s_nationkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey""").fetchall()}
    got = {(r.subj, r.obj) for r in catalogue.QUERIES["cycle_pairs"](spark, SF).collect()}
    assert got == {(a, b) for a, b in edges if a < b and (b, a) in edges} and got
    three = {f"{a}>{b}>{c}>{a}" for a, b in edges for x, c in edges if x == b and (c, a) in edges and a < min(b, c)}
    assert {r.path for r in catalogue.QUERIES["cycles_k3"](spark, SF).collect()} == three | {f"{a}>{b}>{a}" for a, b in got}
    triples = catalogue.B.triples(spark, SF).select("subj", "pred", "obj").distinct()
    assert catalogue.QUERIES["render_relations"](spark, SF).count() == triples.count()
    assert sum(r.page.count("\n- ") for r in catalogue.QUERIES["entity_pages"](spark, SF).collect()) == triples.count()
    aliases = {a for r in catalogue.QUERIES["overrides_replay"](spark, SF).collect() for a in r.aliases.split("|")}
    n_org = {r.id for r in catalogue.B.entities(spark, SF).where("type = 'ORG'").collect()}
    want = {n for k, n, bal in duck.execute("SELECT c_custkey, c_name, c_acctbal FROM customer").fetchall() if k % 4 == 3 and bal >= 0 and f"S{k % 40}" in n_org}
    assert want and want <= aliases
