"""Registered queries over texts: sentences, quotations, relations, events, facts and timelines.

The stories are derived from the star schema, so the SQL states what must be found in them from the tables alone, without
reading a text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import narrative as N
from ..operators import parse as P
from ..operators import quotes as Q
from ..operators import relations as R
from ..operators import sentences as S
from ..sources import tables as B
from ..sources.tables import table
from .catalogue import TRI, query

_LETTERS = "'0123456789', 'abcdefghij'"
STORY = f"""story AS MATERIALIZED (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS t, 'Cu' || translate(CAST(o_custkey AS VARCHAR), {_LETTERS}) AS c, 'Su' || translate(CAST(s AS VARCHAR), {_LETTERS}) AS s,
  'Pa' || translate(CAST(p AS VARCHAR), {_LETTERS}) AS p, 'Na' || translate(CAST(c_nationkey AS VARCHAR), {_LETTERS}) AS n, CAST(year(o_orderdate) AS VARCHAR) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
TOLD = f"""{STORY}, told AS (SELECT doc_id, t, c, s, p, n, y, unnest(CASE t WHEN 0 THEN [c || ' married ' || s || ' in ' || n || '.', c || ' lives in ' || n || '.']
  WHEN 1 THEN [c || ' bought ' || p || ' from ' || s || '.', s || ' did not visit ' || n || '.'] WHEN 2 THEN ['"' || p || ' is lost," said ' || c || '.', s || ' travelled to ' || n || '.']
  WHEN 3 THEN ['Dr. ' || c || ' gave ' || p || ' to ' || s || ' in ' || y || '.', 'He lived in ' || n || '.']
  WHEN 4 THEN [c || ' is the father of ' || s || '.', s || ' was tired.', p || ' was destroyed by ' || c || '.']
  ELSE [c || ' and ' || s || ' fought ' || p || ' near ' || n || '.', s || ' died in ' || n || ' in ' || y || '.'] END) AS text,
  unnest(CASE t WHEN 4 THEN [0, 1, 2] ELSE [0, 1] END) AS idx FROM story)"""
#: What the rules must find: one struct for each relation of a story.
RELS = f"""{STORY}, rels AS (SELECT doc_id, unnest(CASE t
  WHEN 0 THEN [{{'sent': 0, 'subj': c, 'pred': 'marry', 'obj': s, 'rule': 'svo', 'negated': false, 'confidence': 0.65}}, {{'sent': 0, 'subj': c, 'pred': 'marry_in', 'obj': n, 'rule': 'prep', 'negated': false, 'confidence': 0.6}},
    {{'sent': 1, 'subj': c, 'pred': 'live_in', 'obj': n, 'rule': 'prep', 'negated': false, 'confidence': 0.6}}]
  WHEN 1 THEN [{{'sent': 0, 'subj': c, 'pred': 'buy', 'obj': p, 'rule': 'svo', 'negated': false, 'confidence': 0.65}}, {{'sent': 0, 'subj': c, 'pred': 'buy_from', 'obj': s, 'rule': 'prep', 'negated': false, 'confidence': 0.6}},
    {{'sent': 1, 'subj': s, 'pred': 'visit', 'obj': n, 'rule': 'svo', 'negated': true, 'confidence': 0.65}}]
  WHEN 2 THEN [{{'sent': 0, 'subj': p, 'pred': 'is', 'obj': 'lost', 'rule': 'state', 'negated': false, 'confidence': 0.7}}, {{'sent': 1, 'subj': s, 'pred': 'travel_to', 'obj': n, 'rule': 'prep', 'negated': false, 'confidence': 0.6}}]
  WHEN 3 THEN [{{'sent': 0, 'subj': c, 'pred': 'give', 'obj': p, 'rule': 'svo', 'negated': false, 'confidence': 0.65}}, {{'sent': 0, 'subj': c, 'pred': 'give_to', 'obj': s, 'rule': 'prep', 'negated': false, 'confidence': 0.6}},
    {{'sent': 1, 'subj': 'He', 'pred': 'live_in', 'obj': n, 'rule': 'prep', 'negated': false, 'confidence': 0.45}}]
  WHEN 4 THEN [{{'sent': 0, 'subj': c, 'pred': 'parent_of', 'obj': s, 'rule': 'role', 'negated': false, 'confidence': 0.7}}, {{'sent': 1, 'subj': s, 'pred': 'is', 'obj': 'tired', 'rule': 'state', 'negated': false, 'confidence': 0.7}},
    {{'sent': 2, 'subj': c, 'pred': 'destroy', 'obj': p, 'rule': 'passive', 'negated': false, 'confidence': 0.6}}]
  ELSE [{{'sent': 0, 'subj': s, 'pred': 'fight', 'obj': p, 'rule': 'svo', 'negated': false, 'confidence': 0.65}}, {{'sent': 0, 'subj': s, 'pred': 'fight_near', 'obj': n, 'rule': 'prep', 'negated': false, 'confidence': 0.6}},
    {{'sent': 0, 'subj': c, 'pred': 'fight', 'obj': p, 'rule': 'conj', 'negated': false, 'confidence': 0.6}}, {{'sent': 0, 'subj': c, 'pred': 'fight_near', 'obj': n, 'rule': 'conj', 'negated': false, 'confidence': 0.6}},
    {{'sent': 1, 'subj': s, 'pred': 'die_in', 'obj': n, 'rule': 'prep', 'negated': false, 'confidence': 0.6}}] END) AS r, c FROM story),
rel AS (SELECT doc_id, CAST(r.sent AS BIGINT) AS sent, r.subj AS subj, r.pred AS pred, r.obj AS obj, r.rule AS rule, r.negated AS negated, CAST(r.confidence AS DOUBLE) AS confidence, c FROM rels),
res AS (SELECT doc_id, sent, CASE WHEN subj = 'He' THEN c ELSE subj END AS subj, pred, obj, rule, negated, confidence, CASE WHEN subj = 'He' THEN 'pronoun' ELSE 'name' END AS method FROM rel)"""
#: Assertions, events and facts from those relations.
FACTS = f"""{RELS}, ass AS (SELECT left(sha256(concat_ws('|', doc_id, sent, subj, pred, obj)), 16) AS id, *, CASE WHEN rule = 'state' THEN 'STATE' ELSE 'RELATION' END AS kind, CASE WHEN negated THEN 'NEGATED' ELSE 'FACT' END AS modality,
  round(confidence * CASE WHEN rule = 'state' THEN 0.9 ELSE 0.8 END, 4) AS composite FROM res),
kinds(pred, type) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in N.EVENTS.items())}),
ev AS (SELECT 'e_' || id AS id, doc_id, sent, type, subj AS agent, obj AS target, pred, modality, composite AS confidence FROM ass JOIN kinds USING (pred)),
graph(pred, g) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in N.GRAPH_PREDICATES.items())}),
raw AS (SELECT id, doc_id, sent, agent AS subj, 'located_in' AS pred, target AS obj, false AS ended, confidence FROM ev WHERE type = 'MOVE' AND modality <> 'NEGATED'
  UNION ALL SELECT id, doc_id, sent, agent, 'alive', 'false', false, confidence FROM ev WHERE type = 'DEATH' UNION ALL SELECT id, doc_id, sent, agent, 'died_in', target, false, confidence FROM ev WHERE pred = 'die_in'
  UNION ALL SELECT id, doc_id, sent, agent, 'possesses', target, pred = 'give', confidence * CASE WHEN pred = 'give' THEN 0.9 ELSE 1.0 END FROM ev WHERE type = 'TRANSFER'
  UNION ALL SELECT id, doc_id, sent, subj, coalesce(g, ass.pred), obj, false, composite FROM ass LEFT JOIN graph USING (pred) WHERE modality <> 'NEGATED' AND kind = 'RELATION'
  UNION ALL SELECT id, doc_id, sent, obj, g, subj, false, composite FROM ass JOIN graph USING (pred) WHERE modality <> 'NEGATED' AND kind = 'RELATION' AND g = 'married_to'),
fact AS (SELECT doc_id, subj, pred, obj, ended, max(sent) AS from_sent, round(max(confidence), 4) AS confidence, list_sort(list(DISTINCT id)) AS derived_from FROM raw GROUP BY 1, 2, 3, 4, 5)"""


def _relations(spark, sf_dir):
    return P.relations(S.sentences(B.stories(spark, sf_dir)))


def _asserted(spark, sf_dir):
    return N.assertions(P.resolved(_relations(spark, sf_dir)))


def _facts(spark, sf_dir):
    asserted = _asserted(spark, sf_dir)
    return N.facts(N.events(asserted), asserted)


@query()
def sentences_full(spark, sf_dir):
    return S.sentences(table(spark, sf_dir, "documents"))


@query(f"""WITH {TOLD} SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, text FROM told""")
def story_sentences(spark, sf_dir):
    return S.sentences(B.stories(spark, sf_dir)).select("doc_id", "idx", "start", "text")


@query(f"""WITH {TOLD}, x AS (SELECT doc_id, idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, text, n FROM told)
SELECT doc_id, CAST(start + strpos(text, n) - 1 AS INTEGER) AS start, CAST(idx AS INTEGER) AS sent FROM x WHERE strpos(text, n) > 0""")
def span_in_sentence(spark, sf_dir):
    from ..operators import mentions as M

    docs = B.stories(spark, sf_dir)
    places = M.mention_spans(docs, r"(\bNa[a-z]+)").select("doc_id", "start", "end")
    return S.in_sentence(places, S.sentences(docs)).select("doc_id", "start", "sent")


@query(f"""WITH {TOLD}, x AS (SELECT doc_id, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, text, idx, n FROM told),
sp AS (SELECT doc_id, start + strpos(text, n) - 1 AS a, start + strpos(text, n) - 1 + length(n) AS b FROM x WHERE strpos(text, n) > 0)
SELECT x.doc_id, CAST(x.idx AS INTEGER) AS seg_idx, count(*) AS n FROM x JOIN sp ON x.doc_id = sp.doc_id AND sp.a < x.start + length(x.text) + 20 AND sp.b > x.start - 20 GROUP BY 1, 2""")
def spans_around_segments(spark, sf_dir):
    from ..operators import mentions as M

    docs = B.stories(spark, sf_dir)
    places = M.mention_spans(docs, r"(\bNa[a-z]+)").select("doc_id", "start", "end")
    met = S.around(places, S.sentences(docs), 20)
    return met.groupBy(F.col("seg_doc").alias("doc_id"), "seg_idx").agg(F.count("*").alias("n"))


@query(f"WITH {RELS} SELECT doc_id, sent, subj, pred, obj, rule, negated, confidence FROM rel")
def text_relations(spark, sf_dir):
    return _relations(spark, sf_dir).withColumn("sent", F.col("sent").cast("long"))


@query(f"WITH {RELS} SELECT doc_id, sent, subj, pred, obj, method FROM res")
def resolved_relations(spark, sf_dir):
    return P.resolved(_relations(spark, sf_dir)).select("doc_id", F.col("sent").cast("long").alias("sent"), "subj", "pred", "obj", "method")


@query(f"""WITH {TOLD} SELECT CASE WHEN t = 4 AND idx = 2 THEN 'passive' WHEN t = 4 THEN 'none' ELSE 'active' END AS voice, count(*) AS n FROM told GROUP BY 1""")
def sentence_voice(spark, sf_dir):
    return P.voice(S.sentences(B.stories(spark, sf_dir))).groupBy("voice").agg(F.count("*").alias("n"))


@query(f"""WITH {TOLD} SELECT CASE WHEN (t, idx) IN ((0, 0), (1, 0), (1, 1), (2, 0), (3, 0), (5, 0)) THEN 'SVO' WHEN t = 4 AND idx < 2 THEN 'SVC' ELSE 'SV' END AS pattern, count(*) AS n FROM told GROUP BY 1""")
def sentence_patterns(spark, sf_dir):
    return P.clauses(S.sentences(B.stories(spark, sf_dir))).groupBy("pattern").agg(F.count("*").alias("n"))


@query(f"""WITH {STORY} SELECT doc_id, 0 AS ord, p || ' is lost,' AS text, c AS speaker, 'explicit' AS method FROM story WHERE t = 2""")
def quote_speakers(spark, sf_dir):
    return Q.attributed(Q.quotes(B.stories(spark, sf_dir))).select("doc_id", "ord", "text", "speaker", "method")


@query(f"""WITH {STORY} SELECT doc_id, c AS subj, 'tell' AS pred, p || ' is lost,' AS obj, 'CLAIM' AS modality FROM story WHERE t = 2""")
def quote_tells(spark, sf_dir):
    return Q.tells(Q.attributed(Q.quotes(B.stories(spark, sf_dir)))).select("doc_id", "subj", "pred", "obj", "modality")


@query(f"WITH {FACTS} SELECT type, modality, count(*) AS n, count(DISTINCT agent) AS n_agents, round(avg(confidence), 6) AS confidence FROM ev GROUP BY 1, 2")
def story_events(spark, sf_dir):
    return N.events(_asserted(spark, sf_dir)).groupBy("type", "modality").agg(F.count("*").alias("n"), F.countDistinct("agent").alias("n_agents"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"""WITH {FACTS} SELECT 'fact_' || pred || '_' || left(sha256(concat_ws('|', subj, pred, obj, array_to_string(derived_from, '|'))), 16) AS id, doc_id, subj, pred, obj, ended, from_sent, confidence, CAST(len(derived_from) AS INTEGER) AS n_derived_from FROM fact""")
def story_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("id", "doc_id", "subj", "pred", "obj", "ended", F.col("from_sent").cast("long").alias("from_sent"), "confidence", F.size("derived_from").alias("n_derived_from"))


@query(f"WITH {FACTS} SELECT subj AS id, count(*) AS n_facts, NOT bool_or(pred = 'alive' AND obj = 'false') AS alive FROM fact WHERE subj LIKE 'Su%' GROUP BY 1")
def alive_entities(spark, sf_dir):
    known = _facts(spark, sf_dir).where("subj like 'Su%'")
    people = known.groupBy(F.col("subj").alias("id")).agg(F.count("*").alias("n_facts"))
    return people.join(N.alive(known, people.select("id")), "id").select("id", "n_facts", "alive")


@query(f"WITH {FACTS} SELECT doc_id, subj, pred, obj, confidence FROM fact WHERE pred = 'located_in' OR subj = 'Cub' OR obj = 'Cub'")
def facts_of_entity(spark, sf_dir):
    known = _facts(spark, sf_dir)
    found = N.by_predicate(known, "located_in").unionByName(N.of_entity(known, "Cub").where("pred <> 'located_in'"))
    return found.select("doc_id", "subj", "pred", "obj", "confidence")


@query(f"""WITH {FACTS} SELECT doc_id, sent, id, type, agent, target FROM ev WHERE type IN ('MOVE', 'DEATH', 'ATTACK') AND confidence >= 0.48 ORDER BY doc_id, sent, id LIMIT 200""")
def query_timeline(spark, sf_dir):
    rows = N.timeline(N.events(_asserted(spark, sf_dir)), types=("MOVE", "DEATH", "ATTACK"), unsure=False, least=0.48)
    return rows.select("doc_id", F.col("sent").cast("long").alias("sent"), "id", "type", "agent", "target")


@query(f"""WITH {FACTS} SELECT doc_id, '- **' || agent || '** ' || CASE type WHEN 'MOVE' THEN 'moved to' WHEN 'DEATH' THEN 'died in' WHEN 'TRANSFER' THEN 'got or gave' WHEN 'ATTACK' THEN 'attacked' ELSE 'met' END || ' **' || target || '**' AS line FROM ev""")
def event_lines(spark, sf_dir):
    return N.rendered(N.events(_asserted(spark, sf_dir))).select("doc_id", "line")


@query(f"""WITH {RELS}, graph(pred, g) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in N.GRAPH_PREDICATES.items())}),
x AS (SELECT doc_id, sent, subj, coalesce(g, res.pred) AS pred, obj, confidence, rule FROM res LEFT JOIN graph USING (pred) WHERE NOT negated AND rule <> 'state' AND confidence >= 0.4),
inv(pred, p) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in R.INVERSES.items())}),
w AS (SELECT * FROM x UNION ALL SELECT doc_id, sent, obj, p, subj, confidence, rule FROM x JOIN inv USING (pred))
SELECT subj, pred, obj, max(confidence) AS confidence, CASE WHEN bool_or(rule IN ('svo', 'passive', 'role')) THEN 'dep' ELSE 'regex' END AS extractor, count(DISTINCT (doc_id, sent)) AS n_evidence, count(*) AS n_merged FROM w GROUP BY 1, 2, 3""")
def extract_pipeline(spark, sf_dir):
    return N.pipeline(B.stories(spark, sf_dir)).select("subj", "pred", "obj", "confidence", "extractor", "n_evidence", "n_merged")


@query(f"""WITH {TRI}
SELECT modality, count(*) AS n, round(avg(c), 6) AS composite FROM (SELECT CASE WHEN extractor = 'regex' THEN 'BELIEF' ELSE 'FACT' END AS modality, round(confidence * 0.85, 6) AS c FROM triples) GROUP BY 1""")
def adapted_relations(spark, sf_dir):
    rows = N.adapted(B.triples(spark, sf_dir))
    return rows.groupBy("modality").agg(F.count("*").alias("n"), F.round(F.avg("composite"), 6).alias("composite"))
