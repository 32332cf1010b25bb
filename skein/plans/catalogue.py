"""The registered queries of the knowledge-graph engine and, for each, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as D
from ..operators import entities as E
from ..operators import facts as K
from ..operators import graph as G
from ..operators import mentions as M
from ..operators import paging as P
from ..operators import relations as R
from ..operators import spans as S
from ..sources import exports as X
from ..sources import tables as B
from ..sources.tables import table
from ..streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ENT = """entities AS (
  SELECT 'C' || c_custkey AS id, 'PERSON' AS type, c_name AS canonical FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'ORG', s_name FROM supplier
  UNION ALL SELECT 'P' || p_partkey, 'ITEM', p_name FROM part
  UNION ALL SELECT 'N' || n_nationkey, 'PLACE', n_name FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'PLACE', r_name FROM region)"""
TRI = """triples AS (
  SELECT 'C' || o_custkey AS subj, 'bought' AS pred, 'P' || l_partkey AS obj, round(1 - l_discount, 2) AS confidence,
         CASE l_returnflag WHEN 'A' THEN 'dep' WHEN 'R' THEN 'regex' END AS extractor, l_orderkey AS doc_id, l_linenumber AS sent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'S' || l_suppkey, 'supplies', 'P' || l_partkey, round(1 - l_tax, 2),
         CASE l_returnflag WHEN 'A' THEN 'dep' WHEN 'R' THEN 'regex' END, l_orderkey, l_linenumber FROM lineitem
  UNION ALL SELECT 'C' || c_custkey, 'lives_in', 'N' || c_nationkey, 0.9, 'dep', c_custkey, 0 FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'located_in', 'N' || s_nationkey, 0.9, 'dep', s_suppkey, 0 FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'part_of', 'R' || n_regionkey, 0.9, 'dep', n_nationkey, 0 FROM nation)"""
BLOCKED = ", ".join(f"'{w}'" for w in T.BLOCKED)
MEN = rf"""raw AS (SELECT doc_id, regexp_extract_all(text, '{T.NAME}', 1) AS m FROM documents),
mentions AS (SELECT doc_id, i - 1 AS ord, m[i] AS surface FROM raw, LATERAL (SELECT unnest(generate_series(1, len(m))) AS i)
  WHERE lower(m[i]) NOT IN ({BLOCKED})),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(trim(surface)), '\s+', ' ', 'g'), '^\W+|\W+$', '', 'g') AS key FROM mentions)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- sources, filters and joins -------------------------------------------------------------------------------------


@query(f"""WITH {MEN}, each AS (SELECT key, surface, count(*) AS n FROM keyed WHERE length(key) >= 2 GROUP BY 1, 2),
d AS (SELECT key, count(DISTINCT doc_id) AS n_docs FROM keyed WHERE length(key) >= 2 GROUP BY 1)
SELECT key, first(surface ORDER BY length(surface) DESC, surface) AS canonical, CAST(sum(n) AS BIGINT) AS n_mentions, any_value(n_docs) AS n_docs
FROM each JOIN d USING (key) GROUP BY key ORDER BY n_mentions DESC, key LIMIT 20""")
def entry(spark, sf_dir):
    return M.top_entities(table(spark, sf_dir, "documents"))


@query(f"""WITH {ENT}, {TRI} SELECT subj, pred, obj, confidence, doc_id, sent FROM triples
WHERE pred = 'bought' AND confidence >= 0.97 AND obj IN (SELECT id FROM entities WHERE contains(lower(canonical), 'ring'))""")
def relation_filter(spark, sf_dir):
    found = R.query(B.triples(spark, sf_dir), B.entities(spark, sf_dir), pred="bought", obj_name="ring", min_confidence=0.97)
    return found.select("subj", "pred", "obj", "confidence", "doc_id", "sent")


@query(f"""WITH {TRI} SELECT subj, pred, obj, 'out' AS direction, confidence FROM triples WHERE subj = 'N3'
UNION ALL SELECT subj, pred, obj, 'in', confidence FROM triples WHERE obj = 'N3'""")
def entity_relations_in_out(spark, sf_dir):
    return R.in_and_out(B.triples(spark, sf_dir), "N3").select("subj", "pred", "obj", "direction", "confidence")


@query(f"""WITH {ENT}, {TRI} SELECT subj, coalesce(s.canonical, subj) AS subj_name, pred, obj, coalesce(o.canonical, obj) AS obj_name FROM triples
LEFT JOIN entities s ON s.id = subj LEFT JOIN entities o ON o.id = obj WHERE pred IN ('supplies', 'part_of')""")
def relations_with_names(spark, sf_dir):
    rows = B.triples(spark, sf_dir).where(F.col("pred").isin("supplies", "part_of"))
    return R.with_names(rows, B.entities(spark, sf_dir)).select("subj", "subj_name", "pred", "obj", "obj_name")


@query(f"""WITH {ENT}, {TRI}, good AS (SELECT id FROM entities WHERE coalesce(trim(canonical), '') <> '' AND type <> 'ORG')
SELECT pred, count(*) AS n FROM triples WHERE subj IN (SELECT id FROM good) AND obj IN (SELECT id FROM good) GROUP BY 1""")
def dangling_edges_dropped(spark, sf_dir):
    known = B.entities(spark, sf_dir).where("type <> 'ORG'")
    return R.drop_dangling(B.triples(spark, sf_dir), known).groupBy("pred").agg(F.count("*").alias("n"))


@query(f"""WITH {ENT} SELECT id, type, canonical, CASE WHEN contains(canonical, '#') THEN lower(substr(canonical, 1, instr(canonical, '#') - 1)) ELSE lower(canonical) END AS family FROM entities WHERE type IN ('PERSON', 'ORG')""")
def entity_type_filter(spark, sf_dir):
    rows = B.entities(spark, sf_dir).where(F.col("type").isin("PERSON", "ORG"))
    return rows.withColumn("family", F.lower(F.substring_index("canonical", "#", 1)))


# --- graph ----------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT DISTINCT * FROM (
  SELECT 'S' || l_suppkey AS s, 'P' || l_partkey AS o FROM lineitem UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer)),
p AS (SELECT 'C' || c_custkey AS root, 'C' || c_custkey AS cur, ['C' || c_custkey] AS nodes FROM customer
  UNION ALL SELECT root, o, list_append(nodes, o) FROM p JOIN e ON p.cur = e.s WHERE len(nodes) <= 3 AND NOT list_contains(nodes, o) AND cur <> 'R1')
SELECT root AS from_id, cur AS to_id, CAST(len(nodes) - 1 AS INTEGER) AS length, array_to_string(nodes, '>') AS path FROM p WHERE cur = 'R1' AND len(nodes) > 1""")
def paths_k3(spark, sf_dir):
    edges = B.triples(spark, sf_dir)
    starts = B.entities(spark, sf_dir).where("type = 'PERSON'").select("id")
    ends = B.entities(spark, sf_dir).where("id = 'R1'").select("id")
    return G.paths(edges, starts, ends, 3)


@query(f"""WITH {TRI}, b AS (SELECT DISTINCT subj AS a, obj AS b FROM triples UNION SELECT DISTINCT obj, subj FROM triples),
d1 AS (SELECT DISTINCT b AS id FROM b WHERE a = 'N2'), d2 AS (SELECT DISTINCT b.b AS id FROM b JOIN d1 ON b.a = d1.id),
u AS (SELECT 'N2' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM u GROUP BY id ORDER BY 2, 1 LIMIT 200""")
def neighborhood_d2(spark, sf_dir):
    return G.neighborhood(B.triples(spark, sf_dir), "N2", 2, 200)


@query(f"""WITH {TRI}, f AS (SELECT subj, obj FROM triples WHERE pred = 'supplies' ORDER BY subj, obj, doc_id, sent LIMIT 100)
SELECT subj AS id FROM f UNION SELECT obj FROM f""")
def predicate_subgraph(spark, sf_dir):
    return G.predicate_subgraph(B.triples(spark, sf_dir), "supplies", 100)


@query(f"""WITH {TRI} SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree
FROM (SELECT subj AS id, 1 AS o, 0 AS i FROM triples UNION ALL SELECT obj, 0, 1 FROM triples) GROUP BY id""")
def node_degrees(spark, sf_dir):
    return G.degrees(B.triples(spark, sf_dir))


TRADE = """trade AS (SELECT DISTINCT 'N' || s_nationkey AS subj, 'N' || c_nationkey AS obj FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey)"""


def _trade(spark, sf_dir):
    """The trade edges between nations, of every lineitem row."""
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey").distinct()
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    edges = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).where("s_nationkey <> c_nationkey")
    return edges.select(F.concat(F.lit("N"), "s_nationkey").alias("subj"), F.lit("trades").alias("pred"), F.concat(F.lit("N"), "c_nationkey").alias("obj")).distinct()


@query(f"""WITH {TRADE} SELECT a.subj, a.obj FROM trade a JOIN trade b ON a.subj = b.obj AND a.obj = b.subj WHERE a.subj < a.obj""")
def cycle_pairs(spark, sf_dir):
    return G.two_cycles(_trade(spark, sf_dir), "trades")


@query(f"""WITH {TRADE}, three AS (SELECT a.subj AS x, b.subj AS y, c.subj AS z FROM trade a JOIN trade b ON a.obj = b.subj JOIN trade c ON b.obj = c.subj AND c.obj = a.subj
  WHERE a.subj < b.subj AND a.subj < c.subj AND b.subj <> c.subj),
two AS (SELECT a.subj AS x, a.obj AS y FROM trade a JOIN trade b ON a.subj = b.obj AND a.obj = b.subj WHERE a.subj < a.obj)
SELECT 3 AS length, concat_ws('>', x, y, z, x) AS path FROM three UNION ALL SELECT 2, concat_ws('>', x, y, x) FROM two""")
def cycles_k3(spark, sf_dir):
    return G.cycles(_trade(spark, sf_dir), 3)


# --- relation hygiene -----------------------------------------------------------------------------------------------


@query(f"""WITH {TRI} SELECT 'predicate' AS kind, pred AS value, count(*) AS n, avg(confidence) AS avg_confidence FROM triples GROUP BY pred
UNION ALL SELECT 'extractor', coalesce(extractor, 'unknown'), count(*), avg(confidence) FROM triples GROUP BY 2
UNION ALL SELECT 'all', 'all', count(*), avg(confidence) FROM triples""")
def graph_stats(spark, sf_dir):
    return R.stats(B.triples(spark, sf_dir))


@query(f"""WITH {TRI}, up AS (SELECT subj, obj, 'made_by' AS pred FROM (SELECT obj AS subj, subj AS obj FROM triples WHERE pred = 'supplies'))
SELECT subj, pred, count(DISTINCT obj) AS n_objects, min(obj) AS first_object, max(obj) AS last_object, count(*) AS n_relations
FROM up GROUP BY 1, 2 HAVING count(DISTINCT obj) > 1""")
def single_valued_conflicts(spark, sf_dir):
    made = B.triples(spark, sf_dir).where("pred = 'supplies'").select(F.col("obj").alias("subj"), F.lit("made_by").alias("pred"), F.col("subj").alias("obj"))
    return R.single_valued_conflicts(made, ["made_by"])


@query(f"""WITH {TRI} SELECT subj, pred, obj, max(confidence) AS confidence,
  CASE min(CASE extractor WHEN 'dep' THEN 0 WHEN 'regex' THEN 1 ELSE 2 END) WHEN 0 THEN 'dep' WHEN 1 THEN 'regex' END AS extractor,
  count(DISTINCT (doc_id, sent)) AS n_evidence, count(*) AS n_merged, (min((doc_id, sent)))[1] AS first_doc, (min((doc_id, sent)))[2] AS first_sent
FROM triples GROUP BY subj, pred, obj""")
def dedup_survivor(spark, sf_dir):
    return R.deduplicate(B.triples(spark, sf_dir))


@query(f"""WITH {TRI}, g AS (SELECT count(*) AS c FROM triples GROUP BY subj, pred, obj)
SELECT CAST(sum(c) AS BIGINT) AS original, count(*) AS deduplicated, count(*) FILTER (c > 1) AS duplicate_groups, max(c) AS max_group,
  avg(c) FILTER (c > 1) AS avg_duplicate_group, (sum(c) - count(*)) / sum(c) AS removal_rate FROM g""")
def dedup_stats(spark, sf_dir):
    return R.deduplication_stats(B.triples(spark, sf_dir))


@query(f"""WITH {TRI} SELECT subj, pred, obj, confidence, doc_id, sent, false AS generated FROM triples
UNION ALL SELECT obj, CASE pred WHEN 'bought' THEN 'bought_by' WHEN 'supplies' THEN 'supplied_by' ELSE 'contains' END, subj, confidence, doc_id, sent, true
FROM triples WHERE pred IN ('bought', 'supplies', 'part_of')""")
def inverse_union(spark, sf_dir):
    return R.with_inverses(B.triples(spark, sf_dir)).select("subj", "pred", "obj", "confidence", "doc_id", "sent", "generated")


PAIRS = """rel AS (SELECT 'S' || l_suppkey AS subj, CASE WHEN l_returnflag = 'A' THEN 'married_to' ELSE 'parent_of' END AS pred, 'P' || (l_partkey % 20) AS obj,
  round(1 - l_discount, 2) AS confidence, l_orderkey % 50 AS doc_id, l_linenumber AS sent FROM lineitem)"""


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("subj"), F.when(F.col("l_returnflag") == "A", "married_to").otherwise("parent_of").alias("pred"),
        F.concat(F.lit("P"), F.col("l_partkey") % 20).alias("obj"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        (F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_linenumber").alias("sent"),
    )


@query(f"""WITH {PAIRS} SELECT subj, pred, obj, confidence, doc_id, sent FROM rel r WHERE pred <> 'parent_of' OR NOT EXISTS (
  SELECT 1 FROM rel m WHERE m.pred = 'married_to' AND m.confidence > 0.92 AND m.doc_id = r.doc_id AND least(m.subj, m.obj) = least(r.subj, r.obj)
  AND greatest(m.subj, m.obj) = greatest(r.subj, r.obj) AND m.sent BETWEEN r.sent - 2 AND r.sent + 2)""")
def suppress_proximity(spark, sf_dir):
    return R.suppress_near(_pairs(spark, sf_dir), "parent_of", "married_to", 2, 0.92)


FAMILY = """rel AS (SELECT 'N' || n_regionkey AS subj, 'parent_of' AS pred, 'N' || (n_nationkey + 100) AS obj, 0.9 AS confidence FROM nation
  UNION ALL SELECT 'N' || (s_nationkey + 100), CASE WHEN l_linenumber = 1 THEN 'friends_with' ELSE 'works_with' END, 'N' || (c_nationkey + 100), round(1 - l_discount, 2)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {FAMILY}, up AS (SELECT DISTINCT subj AS p, obj AS k FROM rel WHERE pred = 'parent_of'),
drop_ AS (SELECT a.k AS x, b.k AS y FROM up a JOIN up b USING (p) UNION SELECT p, k FROM up UNION SELECT k, p FROM up)
SELECT subj, pred, obj, confidence FROM rel WHERE pred <> 'friends_with' OR NOT EXISTS (SELECT 1 FROM drop_ WHERE x = subj AND y = obj)""")
def suppress_family_closure(spark, sf_dir):
    kin = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_regionkey").alias("subj"), F.lit("parent_of").alias("pred"), F.concat(F.lit("N"), F.col("n_nationkey") + 100).alias("obj"), F.lit(0.9).alias("confidence"))
    sold = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    social = sold.select(
        F.concat(F.lit("N"), F.col("s_nationkey") + 100).alias("subj"), F.when(F.col("l_linenumber") == 1, "friends_with").otherwise("works_with").alias("pred"),
        F.concat(F.lit("N"), F.col("c_nationkey") + 100).alias("obj"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )
    return R.suppress_family(kin.unionByName(social), "parent_of", ["friends_with"])


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT split_part(lower(p_name), ' ', 2) FROM part),
w AS (SELECT name AS long, unnest(list_distinct(string_split(name, ' '))) AS short FROM n WHERE contains(name, ' '))
SELECT short, long FROM w WHERE short IN (SELECT name FROM n)""")
def fragment_antijoin(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).unionByName(part.select(F.col("p_type").alias("name"))).unionByName(part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")))
    return E.containment_pairs(names)


# --- mentions and text ----------------------------------------------------------------------------------------------


@query(f"""WITH {MEN}, each AS (SELECT key, surface, count(*) AS n, min((doc_id, ord)) AS f FROM keyed WHERE length(key) >= 2 GROUP BY 1, 2),
d AS (SELECT key, count(DISTINCT doc_id) AS n_docs FROM keyed WHERE length(key) >= 2 GROUP BY 1)
SELECT key, first(surface ORDER BY length(surface) DESC, surface) AS canonical, count(*) AS n_aliases, CAST(sum(n) AS BIGINT) AS n_mentions,
  any_value(n_docs) AS n_docs, (min(f))[1] AS first_doc, CAST((min(f))[2] AS INTEGER) AS first_ord FROM each JOIN d USING (key) GROUP BY key""")
def alias_group(spark, sf_dir):
    return M.registry(M.mentions(table(spark, sf_dir, "documents")))


SPANS = rf"""parts AS (SELECT doc_id, regexp_extract_all(text, '{T.NAME}', 1) AS m, string_split_regex(text, '{T.NAME}') AS g FROM documents),
pos AS (SELECT doc_id, i - 1 AS ord, m[i] AS surface, sum(length(g[i]) + coalesce(length(m[i]), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS "end"
  FROM parts, LATERAL (SELECT unnest(generate_series(1, len(m))) AS i)),
spans AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, surface, CAST("end" - length(surface) AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM pos)"""


@query(f"WITH {SPANS} SELECT * FROM spans")
def mention_spans(spark, sf_dir):
    return M.mention_spans(table(spark, sf_dir, "documents"))


@query(rf"""WITH {SPANS}, k AS (SELECT s.*, regexp_replace(lower(trim(surface)), '^\W+|\W+$', '', 'g') AS key, length(text) AS len FROM spans s JOIN documents USING (doc_id)),
e AS (SELECT doc_id, key, count(*) AS n, min(start) AS f, max(len) AS len, count(DISTINCT floor(start * 10 / len)) AS t FROM k WHERE length(key) >= 2 GROUP BY 1, 2),
t AS (SELECT doc_id, key, n, round(ln(n + 1) * 10 + (1 - f / len) * 20 + CASE WHEN contains(key, ' ') THEN 10.0 WHEN length(key) > 8 THEN 7.0 ELSE 3.0 END
  + CASE WHEN n >= 2 THEN t * 2 ELSE 0 END, 6) AS total FROM e)
SELECT doc_id, key, n, total, CAST(CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN
  round(100.0 * (row_number() OVER (PARTITION BY doc_id ORDER BY total, key) - 1) / (count(*) OVER (PARTITION BY doc_id) - 1)) ELSE 0 END AS INTEGER) AS percentile FROM t""")
def salience(spark, sf_dir):
    return M.salience(table(spark, sf_dir, "documents"))


@query(f"""WITH {MEN}, k AS (SELECT DISTINCT doc_id, key FROM keyed WHERE length(key) >= 2),
r AS (SELECT key FROM k GROUP BY key HAVING count(*) >= 2), q AS (SELECT doc_id, key FROM k WHERE key IN (SELECT key FROM r))
SELECT a.key AS a, b.key AS b, count(*) AS n_docs FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.key < b.key GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence_doc(spark, sf_dir):
    return M.cooccurrence(M.mentions(table(spark, sf_dir, "documents")))


TOK = """tok AS (SELECT lower(w) AS token, count(*) AS total, count(*) FILTER (NOT regexp_matches(w, '^[A-Z]')) AS lowercase, count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS capitalized
  FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS w FROM documents) GROUP BY 1)"""


@query(f"WITH {TOK} SELECT * FROM tok")
def token_stats(spark, sf_dir):
    return M.token_stats(table(spark, sf_dir, "documents"))


@query(f"""WITH {MEN}, {TOK}, r AS (SELECT key, CASE WHEN length(key) < 2 THEN 'too_short' WHEN length(key) > 40 THEN 'too_long'
  WHEN lowercase > 0 AND NOT contains(key, ' ') THEN 'lowercase_echo' ELSE 'none' END AS reason FROM keyed LEFT JOIN tok ON token = key)
SELECT CASE WHEN reason IN ('too_short', 'too_long') THEN 'NON_ENTITY' WHEN reason = 'none' THEN 'DURABLE_CANDIDATE' ELSE 'CONTEXT_ONLY' END AS verdict, reason, count(*) AS n FROM r GROUP BY 1, 2""")
def gate_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return M.gate(M.mentions(docs), M.token_stats(docs))


LINES = r"""pl AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
pp AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, CAST(coalesce(sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, l[i] AS text
  FROM pl, LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)), para AS (SELECT * FROM pp WHERE trim(text) <> '')"""


@query(f"WITH {LINES} SELECT * FROM para")
def paragraphs(spark, sf_dir):
    return M.paragraphs(table(spark, sf_dir, "documents"))


@query(rf"""WITH RECURSIVE {LINES}, p AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS r, len(string_split_regex(trim(text), '\s+')) AS n FROM para),
w AS (SELECT doc_id, r, 0 AS seg, n, n AS words FROM p WHERE r = 1 UNION ALL SELECT p.doc_id, p.r, CASE WHEN words >= 450 OR words + p.n > 600 THEN seg + 1 ELSE seg END, p.n,
  CASE WHEN words >= 450 OR words + p.n > 600 THEN p.n ELSE words + p.n END FROM w JOIN p ON p.doc_id = w.doc_id AND p.r = w.r + 1)
SELECT doc_id, CAST(seg AS INTEGER) AS seg, count(*) AS n_paragraphs, CAST(sum(n) AS BIGINT) AS n_words FROM w GROUP BY doc_id, seg""")
def segments_450_600(spark, sf_dir):
    return M.segments(M.paragraphs(table(spark, sf_dir, "documents")))


@query(r"""WITH s AS (SELECT doc_id, list_filter([trim(x) FOR x IN regexp_extract_all(text, '([^.!?\n]+[.!?]*)', 1)], lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, l[i] AS text FROM s, LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)""")
def sentences(spark, sf_dir):
    return M.sentences(table(spark, sf_dir, "documents"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 197) || '...' ELSE t END AS evidence FROM t""")
def normalize_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_evidence(F.col("text")).alias("evidence"))


@query(r"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'CLAIM' WHEN regexp_matches(lower(text), '(^|[^a-z])(believed|thought|suspected|assumed|felt)([^a-z]|$)') THEN 'BELIEF'
  WHEN regexp_matches(lower(text), '(^|[^a-z])(not|never|no)([^a-z]|$)') THEN 'NEGATED' WHEN regexp_matches(lower(text), '(^|[^a-z])(rumor|rumored|reportedly|allegedly)([^a-z]|$)') THEN 'RUMOR'
  WHEN regexp_matches(lower(text), '(^|[^a-z])(planned|intended|decided|promised|will)([^a-z]|$)') THEN 'PLAN' ELSE 'FACT' END AS modality FROM conversations""")
def modality(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.modality(F.col("text"), F.col("role") == "user").alias("modality"))


@query(r"""SELECT page_id, count(*) AS n, CAST(sum(length(q)) AS BIGINT) AS n_chars FROM (SELECT page_id, unnest(regexp_extract_all(html, '"([^"]*)"', 1)) AS q FROM pages) WHERE q <> '' GROUP BY page_id""")
def quotes(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))).alias("q")).where("q <> ''")
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("q")).alias("n_chars"))


@query(rf"""WITH o AS (SELECT o_orderkey, 'Signed on ' || strftime(o_orderdate, '%Y-%m-%d') || ', due in ' || strftime(o_orderdate, '%B') || ' ' || year(o_orderdate) || '.' AS t FROM orders),
f AS (SELECT o_orderkey, 'iso_day' AS family, unnest(regexp_extract_all(t, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1)) AS x FROM o
  UNION ALL SELECT o_orderkey, 'iso_month', unnest(regexp_extract_all(t, '\b(\d{{4}}-\d{{2}})\b', 1)) FROM o
  UNION ALL SELECT o_orderkey, 'year', unnest(regexp_extract_all(t, '\b(\d{{4}})\b', 1)) FROM o
  UNION ALL SELECT o_orderkey, 'about_year', unnest(regexp_extract_all(t, '(?:on|in|at|during|by)\s+(\d{{4}})\b', 1)) FROM o
  UNION ALL SELECT o_orderkey, 'month_year', unnest(regexp_extract_all(t, '((?:{"|".join(D.MONTHS)})\s+\d{{4}})\b', 1)) FROM o)
SELECT o_orderkey, family, CASE family WHEN 'month_year' THEN 'month' WHEN 'iso_month' THEN 'month' WHEN 'year' THEN 'year' WHEN 'about_year' THEN 'approximate' ELSE 'day' END AS precision, x AS expression,
  CASE family WHEN 'iso_day' THEN x WHEN 'iso_month' THEN x || '-01' WHEN 'year' THEN x || '-01-01' WHEN 'about_year' THEN NULL ELSE strftime(try_strptime(x, '%B %Y'), '%Y-%m-01') END AS normalized FROM f""")
def time_expressions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Signed on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", due in "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(".")).alias("t"))
    found = rows.select("o_orderkey", F.explode(D.time_expressions(F.col("t"))).alias("e")).select("o_orderkey", "e.*")
    return found.select("o_orderkey", "family", "precision", "expression", D.normalized(F.col("expression"), F.col("family")).alias("normalized"))


# --- ordered operators ----------------------------------------------------------------------------------------------


@query("""SELECT conv_id, least(b, role) AS a, greatest(b, role) AS b, count(*) AS n FROM
  (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b <> role GROUP BY 1, 2, 3""")
def dialogue_adjacent(spark, sf_dir):
    return S.adjacent(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")


@query("""WITH t AS (SELECT conv_id, turn, role, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l FROM conversations)
SELECT conv_id, turn, role, coalesce(array_to_string(list_sort(list_distinct(l)), ','), '') AS active, coalesce(len(list_distinct(l)), 0) = 2 AS exchange FROM t""")
def turn_taking(spark, sf_dir):
    return S.trailing_speakers(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "role", "active", "exchange")


@query("""WITH p AS (SELECT conv_id, role, count(*) AS n, sum(length(text)) AS c FROM conversations GROUP BY 1, 2)
SELECT a.role AS a, b.role AS b, count(*) AS n_conversations, CAST(sum(a.n + b.n) AS BIGINT) AS n_turns FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.role < b.role GROUP BY 1, 2""")
def interactions(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    a, b = per.select("conv_id", F.col("role").alias("a"), F.col("n").alias("na")), per.select("conv_id", F.col("role").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "conv_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_conversations"), F.sum(F.col("na") + F.col("nb")).alias("n_turns"))


@query("""SELECT e.event_id, e.user_id, coalesce(p.event_id, -1) AS previous_event_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p
  ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.event_type = 'purchase'""")
def asof_previous(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return S.asof_previous(left, events.where("event_type = 'view'"), ["user_id"], "ts", "event_id").select("event_id", "user_id", F.coalesce("previous_event_id", F.lit(-1)).alias("previous_event_id"))


@query("""SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id
  AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000""")
def cooccurrence_band(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return S.band_pairs(events, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), 1_800_000_000, "event_id").select("user_id", "a", "b")


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM i GROUP BY 1, 2, 3""")
def event_islands(spark, sf_dir):
    return S.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM i GROUP BY 1, 2""")
def event_sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"], 21_600)


@query(f"""WITH {SPANS}, {LINES} SELECT s.doc_id, s.ord, p.idx FROM spans s JOIN para p ON s.doc_id = p.doc_id AND s.start >= p.start AND s.start < p.start + length(p.text)""")
def span_in_paragraph(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = M.paragraphs(docs).select("doc_id", "idx", "start", (F.col("start") + F.length("text")).alias("end"))
    points = M.mention_spans(docs).select("doc_id", "ord", F.col("start").alias("at"))
    return S.point_in_interval(points, lines, ["doc_id"], "at", 2000).select("doc_id", "ord", "idx")


COVER = """c AS (SELECT user_id, event_id, epoch(date_trunc('hour', ts))::BIGINT // 3600 AS start, epoch(date_trunc('hour', ts))::BIGINT // 3600 + 1 + CAST(floor(value) AS BIGINT) % 48 AS "end" FROM events)"""


@query(f"""WITH {COVER}, m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c)
SELECT user_id, start, "end" FROM m WHERE m IS NULL OR "end" > m""")
def uncovered_spans(spark, sf_dir):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    rows = table(spark, sf_dir, "events").select("user_id", hour.alias("start"), (hour + 1 + F.floor("value") % 48).alias("end"))
    return S.uncovered(rows, ["user_id"]).select("user_id", "start", "end")


# --- facts, timelines, review ---------------------------------------------------------------------------------------

TRANSFER = """tr AS (SELECT 'P' || (l_partkey % 200) AS item, 'S' || l_suppkey AS giver, 'C' || o_custkey AS taker, o_orderdate AS tm, round(1 - l_discount, 2) AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT item, tm, taker AS holder, 'gain' AS kind, confidence FROM tr UNION ALL SELECT item, tm, giver, 'loss', confidence * 0.9 FROM tr)"""


def _transfers(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.select(
        F.concat(F.lit("P"), F.col("l_partkey") % 200).alias("item"), F.concat(F.lit("S"), "l_suppkey").alias("giver"), F.concat(F.lit("C"), "o_custkey").alias("taker"),
        F.col("o_orderdate").alias("at"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )


@query(f"""WITH {TRANSFER}, p AS (SELECT holder, item, max(tm) FILTER (kind = 'gain') AS gained, max(tm) FILTER (kind = 'loss') AS lost FROM f GROUP BY 1, 2)
SELECT holder, item, gained FROM p WHERE gained IS NOT NULL AND (lost IS NULL OR gained > lost)""")
def possessions(spark, sf_dir):
    return K.possessions(K.transfer_facts(_transfers(spark, sf_dir)))


@query(f"""WITH {TRANSFER}, p AS (SELECT holder, item, max(tm) FILTER (kind = 'gain') AS gained, max(tm) FILTER (kind = 'loss') AS lost FROM f GROUP BY 1, 2)
SELECT item, count(*) AS n_holders, min(holder) AS holder, CASE WHEN count(*) > 1 THEN 'contested' ELSE 'held' END AS state
FROM p WHERE gained IS NOT NULL AND (lost IS NULL OR gained > lost) GROUP BY item""")
def current_holder(spark, sf_dir):
    return K.current_holder(K.transfer_facts(_transfers(spark, sf_dir)))


@query("""SELECT user_id, event_type, event_id AS last_event, ts AS last_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def facts_current_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("last_at"), F.col("event_id").alias("last_event"))
    return K.latest(rows, ["user_id", "event_type"], ["last_at", "last_event"])


@query("""WITH a AS (SELECT subj, pred, obj, confidence FROM (SELECT 'C' || o_custkey AS subj, CASE WHEN l_returnflag = 'R' THEN 'ally_of' ELSE 'bought' END AS pred, 'S' || l_suppkey AS obj,
  round(1 - l_discount, 2) - CASE WHEN l_returnflag = 'A' THEN 0.25 ELSE 0 END AS confidence, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE confidence >= 0.7),
b AS (SELECT * FROM a UNION ALL SELECT obj, pred, subj, confidence FROM a WHERE pred = 'ally_of')
SELECT subj, pred, obj, max(confidence) AS confidence, count(*) AS n_derived_from FROM b GROUP BY 1, 2, 3""")
def relation_facts(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = sold.select(
        F.concat(F.lit("C"), "o_custkey").alias("subj"), F.when(F.col("l_returnflag") == "R", "ally_of").otherwise("bought").alias("pred"), F.concat(F.lit("S"), "l_suppkey").alias("obj"),
        (F.round(1 - F.col("l_discount"), 2) - F.when(F.col("l_returnflag") == "A", 0.25).otherwise(0.0)).alias("confidence"), F.lit("FACT").alias("modality"),
    )
    return K.relation_facts(rows)


@query("""WITH e AS (SELECT user_id, event_id AS source, lead(event_id) OVER w AS target, ts AS a, lead(ts) OVER w AS b, least(value, lead(value) OVER w) AS confidence
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, source, target, confidence FROM e WHERE b > a""")
def temporal_edges(spark, sf_dir):
    return K.temporal_edges(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "value")


@query("""WITH o AS (SELECT o_custkey AS subject, o_orderkey AS key, year(o_orderdate) AS year, o_totalprice AS weight FROM orders),
h AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY subject ORDER BY weight DESC, year, key) <= 12)
SELECT subject, key, CAST(year AS INTEGER) AS year, weight, CAST(row_number() OVER (PARTITION BY subject ORDER BY year, weight DESC, key) AS INTEGER) AS rank FROM h""")
def timeline_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("weight"))
    return K.timeline(rows, "subject", "year", "weight", "key")


@query(f"""WITH {TRI}, c AS (SELECT pred, confidence - CASE WHEN extractor IS NULL THEN 0.5 ELSE 0.2 END AS c FROM triples)
SELECT pred, CASE WHEN c >= 0.7 THEN 'accepted' WHEN c >= 0.4 THEN 'review' ELSE 'rejected' END AS route, count(*) AS n FROM c GROUP BY 1, 2""")
def review_routing(spark, sf_dir):
    rows = B.triples(spark, sf_dir)
    sure = F.col("confidence") - F.when(F.col("extractor").isNull(), 0.5).otherwise(0.2)
    return K.routed(rows, sure).groupBy("pred", "route").agg(F.count("*").alias("n"))


FEAT = """feat AS (SELECT d.doc_id, l.quality AS label, length(text) / 5000.0 AS f_len, 1.0 * len(regexp_extract_all(text, '([%#$&*!|])', 1)) / (length(text) + 1) AS f_marks, contains(text, '%%%') AS negated
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sc AS (SELECT doc_id, label, round(CASE WHEN negated THEN least(s, 0.4) ELSE s END, 6) AS score FROM (SELECT *, 1 / (1 + exp(-(1.5 + 0.5 * f_len - 8.0 * f_marks))) AS s FROM feat))"""


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), (F.length("text") / 5000.0).alias("f_len"),
        (F.size(F.regexp_extract_all("text", F.lit("([%#$&*!|])"), F.lit(1))) * 1.0 / (F.length("text") + 1)).alias("f_marks"), F.contains("text", F.lit("%%%")).alias("negated"),
    )
    return K.rescored(rows, {"f_len": 0.5, "f_marks": -8.0}, 1.5, F.col("negated"))


@query(f"WITH {FEAT} SELECT doc_id, score, score >= 0.7 AS accepted FROM sc")
def rescorer(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "score", "accepted")


@query(f"""WITH {FEAT}, t AS (SELECT unnest(generate_series(30, 95, 5)) AS threshold),
c AS (SELECT threshold, count(*) FILTER (floor((score * 100 - 30) / 5) >= (threshold - 30) / 5) AS accepted, count(*) FILTER (floor((score * 100 - 30) / 5) >= (threshold - 30) / 5 AND label = 1) AS tp, count(*) FILTER (label = 1) AS pos FROM t, sc GROUP BY 1),
r AS (SELECT *, CASE WHEN accepted > 0 THEN tp / accepted ELSE 0 END AS p, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS r FROM c)
SELECT CAST(threshold AS INTEGER) AS threshold, accepted, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""")
def threshold_sweep(spark, sf_dir):
    return K.threshold_sweep(_scored(spark, sf_dir), "label")


@query(f"""WITH {FEAT} SELECT count(*) FILTER (score >= 0.7 AND label = 1) AS tp, count(*) FILTER (score >= 0.7 AND label = 0) AS fp, count(*) FILTER (score < 0.7 AND label = 1) AS fn,
  round(count(*) FILTER (score >= 0.7 AND label = 1) / count(*) FILTER (score >= 0.7), 6) AS precision, round(count(*) FILTER (score >= 0.7 AND label = 1) / count(*) FILTER (label = 1), 6) AS recall FROM sc""")
def gold_prf(spark, sf_dir):
    hit, real = F.col("accepted"), F.col("label") == 1
    n = _scored(spark, sf_dir).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"))
    return n.select("tp", "fp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6).alias("recall"))


# --- resolution and corrections -------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT lower(n_name) FROM nation UNION SELECT DISTINCT lower(p_brand) FROM part)
SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS distance FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 1 WHERE levenshtein(a.name, b.name) <= 1""")
def levenshtein_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = S.union_all([part.select(F.col(c).alias("name")) for c in ("p_name", "p_type", "p_brand")] + [table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))])
    return E.levenshtein_pairs(names)


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT min(doc_id) AS doc_id, s FROM (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0) GROUP BY s),
g AS (SELECT doc_id, unnest(s) AS g FROM s), r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1), h AS (SELECT g.* FROM g JOIN r USING (g)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(shared / (len(x.s) + len(y.s) - shared), 6) AS similarity FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE shared / (len(x.s) + len(y.s) - shared) >= 0.8""")
def jaccard_pairs(spark, sf_dir):
    return E.jaccard_pairs(table(spark, sf_dir, "documents"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
g AS (SELECT doc_id, unnest(s) AS g FROM s), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
n AS (SELECT a, count(*) AS n FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE shared / (len(x.s) + len(y.s) - shared) >= 0.8 GROUP BY 1),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS representative, count(*) OVER (PARTITION BY s) - 1 AS n_copies FROM s)
SELECT d.doc_id, representative, coalesce(n_copies, 0) AS n_copies, coalesce(n, 0) AS n_links FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN n ON n.a = d.doc_id""")
def jaccard_classes(spark, sf_dir):
    return E.jaccard_classes(table(spark, sf_dir, "documents"))


CORR = """corr AS (SELECT c_custkey AS seq, CASE c_custkey % 4 WHEN 0 THEN 'retype' WHEN 1 THEN 'rename' WHEN 2 THEN 'reject' ELSE 'alias' END AS kind,
  'S' || (c_custkey % 40) AS target, CASE c_custkey % 4 WHEN 0 THEN 'ITEM' WHEN 2 THEN NULL ELSE c_name END AS value, c_acctbal < 0 AS rolled_back FROM customer)"""


@query(f"""WITH {ENT}, {CORR}, live AS (SELECT * FROM corr WHERE NOT rolled_back),
p AS (SELECT target AS id, arg_max(value, seq) FILTER (kind = 'retype') AS retype, arg_max(value, seq) FILTER (kind = 'rename') AS rename, max(CASE WHEN kind = 'reject' THEN 1 ELSE 0 END) AS rejected,
  coalesce(list(DISTINCT value) FILTER (kind = 'alias'), []) AS added FROM live GROUP BY 1)
SELECT e.id, coalesce(retype, type) AS type, coalesce(rename, canonical) AS canonical,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(added, []), CASE WHEN rename IS NOT NULL AND rename <> canonical THEN [canonical] ELSE [] END))), '|') AS aliases,
  coalesce(rejected, 0) = 1 AS rejected FROM entities e LEFT JOIN p ON p.id = e.id""")
def overrides_replay(spark, sf_dir):
    k = F.col("c_custkey")
    corrections = table(spark, sf_dir, "customer").select(
        k.alias("seq"), F.when(k % 4 == 0, "retype").when(k % 4 == 1, "rename").when(k % 4 == 2, "reject").otherwise("alias").alias("kind"), F.concat(F.lit("S"), k % 40).alias("target"),
        F.when(k % 4 == 0, "ITEM").when(k % 4 != 2, F.col("c_name")).alias("value"), (F.col("c_acctbal") < 0).alias("rolled_back"),
    )
    return E.apply_overrides(B.entities(spark, sf_dir), corrections)


@query(f"""WITH {TRI}, m AS (SELECT 'P' || p_partkey AS source, 'P' || (p_partkey % 50) AS target FROM part WHERE p_partkey >= 50)
SELECT coalesce(a.target, subj) AS subj, pred, coalesce(b.target, obj) AS obj, count(*) AS n FROM triples LEFT JOIN m a ON a.source = subj LEFT JOIN m b ON b.source = obj
WHERE coalesce(a.target, subj) <> coalesce(b.target, obj) GROUP BY 1, 2, 3""")
def merge_rewire(spark, sf_dir):
    merges = table(spark, sf_dir, "part").where("p_partkey >= 50").select(F.concat(F.lit("P"), "p_partkey").alias("source"), F.concat(F.lit("P"), F.col("p_partkey") % 50).alias("target"))
    return E.merge_entities(B.triples(spark, sf_dir), merges).groupBy("subj", "pred", "obj").agg(F.count("*").alias("n"))


@query(r"""WITH o AS (SELECT lower(p_name) AS alias, 'P' || p_partkey AS id, p_retailprice AS confidence FROM part)
SELECT alias, first(id ORDER BY confidence DESC, id) AS id, max(confidence) AS confidence, count(*) AS n FROM o GROUP BY alias""")
def alias_upsert(spark, sf_dir):
    return E.alias_upsert(table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_retailprice").alias("confidence")))


@query("""SELECT p_name AS name, p_type AS type, max(p_size) + 1 AS next_sense, count(*) AS n FROM part GROUP BY 1, 2""")
def next_sense(spark, sf_dir):
    return E.next_sense(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("sense")))


@query("""WITH k AS (SELECT canonical, unnest(list_distinct(list_filter([f, b, CASE WHEN contains(b, ' ') THEN 'lastname:' || split_part(b, ' ', -1) END], lambda x: x IS NOT NULL))) AS key
  FROM (SELECT p_name AS canonical, lower(p_name) AS f, lower(p_name) AS b FROM (SELECT DISTINCT p_name FROM part))) SELECT key, count(*) AS n, min(canonical) AS first FROM k GROUP BY 1""")
def cluster_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("canonical")).distinct()
    keyed = rows.select("canonical", F.explode(T.cluster_keys(F.col("canonical"))).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("canonical").alias("first"))


# --- search, paging, learning, export -------------------------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z]+)', 1) AS w FROM documents), h AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('thtion', 'der', 'que'))) AS hits, len(w) AS n FROM w)
SELECT doc_id, CAST(hits AS INTEGER) AS hits, round(hits / sqrt(n), 6) AS score FROM h WHERE hits > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def search_topk(spark, sf_dir):
    return P.search(table(spark, sf_dir, "documents"), ["thtion", "der", "que"])


@query("""WITH j AS (SELECT lang, source, CAST(quality AS VARCHAR) AS quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'lang' AS facet, coalesce(lang, 'none') AS value, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'none'), count(*) FROM j GROUP BY 2
UNION ALL SELECT 'quality', coalesce(quality, 'none'), count(*) FROM j GROUP BY 2""")
def facets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return P.facets(rows, ["lang", "source", "quality"])


@query("SELECT c_name, c_custkey FROM customer WHERE c_name > 'Customer#000000100' ORDER BY c_name LIMIT 50")
def keyset_page(spark, sf_dir):
    return P.page(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", P.encode_cursor("Customer#000000100"), 50)


@query(r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+ (?:the|der|la|el) [a-z]+)', 1)) AS x FROM documents)
SELECT regexp_replace(x, '^[A-Z][a-z]+', 'X') AS pattern, count(*) AS n, count(DISTINCT split_part(x, ' ', 1)) AS n_examples FROM h GROUP BY 1 HAVING count(DISTINCT split_part(x, ' ', 1)) >= 2""")
def bootstrap_patterns(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+ (?:the|der|la|el) [a-z]+)"), F.lit(1))).alias("x"))
    found = hits.groupBy(F.regexp_replace("x", "^[A-Z][a-z]+", "X").alias("pattern")).agg(F.count("*").alias("n"), F.countDistinct(F.substring_index("x", " ", 1)).alias("n_examples"))
    return found.where("n_examples >= 2")


@query(f"""WITH {ENT}, {TRI} SELECT '"' || replace(coalesce(s.canonical, subj), '"', '""') || '","' || pred || '","' || replace(coalesce(o.canonical, obj), '"', '""') || '",' || printf('%.3f', confidence) || ',' || doc_id AS line
FROM triples LEFT JOIN entities s ON s.id = subj LEFT JOIN entities o ON o.id = obj""")
def export_csv(spark, sf_dir):
    return X.csv_lines(B.triples(spark, sf_dir), B.entities(spark, sf_dir))


@query(f"""WITH {ENT}, {TRI} SELECT '  "' || id || '" [label="' || replace(canonical, '"', '\\"') || '", fillcolor=' || CASE type WHEN 'PERSON' THEN 'lightblue' WHEN 'ORG' THEN 'lightgreen' WHEN 'PLACE' THEN 'lightyellow' ELSE 'lightpink' END || '];' AS line FROM entities
UNION ALL SELECT DISTINCT '  "' || subj || '" -> "' || obj || '" [label="' || pred || '"];' FROM triples""")
def export_dot(spark, sf_dir):
    return X.dot_nodes(B.entities(spark, sf_dir)).unionByName(X.dot_edges(B.triples(spark, sf_dir)))


@query(f"""WITH {ENT}, {TRI} SELECT '<node id="' || id || '"><data key="label">' || canonical || '</data><data key="type">' || type || '</data></node>' AS line FROM entities
UNION ALL SELECT DISTINCT '<edge source="' || subj || '" target="' || obj || '"><data key="pred">' || pred || '</data></edge>' FROM triples
WHERE subj IN (SELECT id FROM entities) AND obj IN (SELECT id FROM entities)""")
def export_graphml(spark, sf_dir):
    return X.graphml(B.triples(spark, sf_dir), B.entities(spark, sf_dir))


@query(f"""WITH {ENT}, {TRI}, t AS (SELECT DISTINCT subj, pred, obj FROM triples WHERE subj IN (SELECT id FROM entities) AND obj IN (SELECT id FROM entities)),
p AS (SELECT subj AS a, pred, obj AS b FROM t WHERE pred <> 'part_of' UNION SELECT subj, pred, obj FROM t WHERE pred = 'part_of' UNION SELECT obj, pred, subj FROM t WHERE pred = 'part_of')
SELECT 'MERGE (n:' || type || ' {{id: ''' || id || '''}}) SET n.name = ''' || canonical || ''';' AS line FROM entities
UNION ALL SELECT 'MATCH (a {{id: ''' || a || '''}}), (b {{id: ''' || b || '''}}) MERGE (a)-[:' || upper(pred) || ']->(b);' FROM p""")
def export_cypher(spark, sf_dir):
    return X.cypher(B.triples(spark, sf_dir), B.entities(spark, sf_dir), ("part_of",))


@query(f"""WITH {TRI}, d AS (SELECT DISTINCT sha256(concat_ws(chr(31), subj, pred, obj)) AS h FROM triples),
b AS (SELECT left(h, 4) AS b, count(*) AS n, left(h, 4) || sha256(string_agg(h, '' ORDER BY h)) AS p FROM d GROUP BY left(h, 4))
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p, '' ORDER BY p)) AS hash FROM b""")
def graph_hash(spark, sf_dir):
    return X.graph_hash(B.triples(spark, sf_dir))


@query(rf"""WITH {ENT}, {TRI}, d AS (SELECT subj, pred, obj, max(confidence) AS c FROM triples GROUP BY 1, 2, 3),
n AS (SELECT subj, coalesce(s.canonical, subj) AS name, pred, obj, coalesce(o.canonical, obj) AS obj_name, c FROM d LEFT JOIN entities s ON s.id = subj LEFT JOIN entities o ON o.id = obj),
l AS (SELECT subj, name, pred, string_agg('- ' || obj_name, chr(10) ORDER BY c DESC, obj, obj_name) AS lines FROM n GROUP BY 1, 2, 3)
SELECT subj AS id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, '# ' || name || chr(10) || string_agg('## ' || pred || chr(10) || lines, chr(10) ORDER BY pred) AS page FROM l GROUP BY subj, name""")
def entity_pages(spark, sf_dir):
    return X.entity_pages(B.triples(spark, sf_dir), B.entities(spark, sf_dir))


# --- streams --------------------------------------------------------------------------------------------------------


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    return J.run_window_counts(spark, f"{sf_dir}/events.parquet")


@query()
def token_bucket(spark, sf_dir):
    return J.run_token_bucket(spark, f"{sf_dir}/events.parquet")
