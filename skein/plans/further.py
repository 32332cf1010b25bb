"""Registered queries: features, conflicts of spans, promotion, kinds, described entities, suppression, paging, references in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec
from ..operators import features as E
from ..operators import mentions as M
from ..operators import parse as P
from ..operators import resolution as Z
from ..operators import sentences as S
from ..sources import tables as B
from ..sources.tables import table
from .catalogue import MEN, SPANS, TRI, query
from .narrative import RELS, STORY

#: Distance in tokens, names between, tokens of the sentence, family by template and predicate: read off the stories by hand.
FEATURES = f"""{RELS}, ft AS (SELECT rel.*, story.t, CASE WHEN pred IN ('marry', 'buy', 'visit', 'give', 'fight', 'is') THEN 2 WHEN pred IN ('marry_in', 'buy_from', 'give_to') THEN 4 WHEN pred IN ('live_in', 'travel_to', 'die_in') THEN 3 WHEN pred = 'parent_of' THEN 5 WHEN pred = 'destroy' THEN 4 ELSE 4 END
  + CASE WHEN rule = 'conj' THEN 2 ELSE 0 END + CASE WHEN negated THEN 2 ELSE 0 END AS d FROM rel JOIN story USING (doc_id))"""


def _features(spark, sf_dir):
    return E.relation_features(S.sentences(B.stories(spark, sf_dir)))


@query(f"""WITH {FEATURES} SELECT doc_id, subj, pred, obj, d AS token_distance, negated, pred = 'destroy' AS passive, t = 2 AND pred = 'is' AS quoted, pred <> 'destroy' AS subject_first, false AS modal,
  CASE WHEN pred IN ('marry', 'parent_of') THEN 'kinship' WHEN pred IN ('live_in', 'travel_to', 'die_in', 'marry_in', 'fight_near') THEN 'location' WHEN pred IN ('buy', 'buy_from', 'give', 'give_to') THEN 'possession' WHEN pred IN ('fight', 'destroy') THEN 'conflict' WHEN pred = 'is' THEN 'state' ELSE 'other' END AS family FROM ft""")
def relation_features(spark, sf_dir):
    return _features(spark, sf_dir).select("doc_id", "subj", "pred", "obj", F.col("token_distance").cast("int").alias("token_distance"), "negated", "passive", "quoted", "subject_first", "modal", "family")


@query(f"""WITH {FEATURES} SELECT subj || ',' || pred || ',' || obj || ',' || d || ',' || CASE WHEN pred IN ('marry_in', 'buy_from', 'give_to', 'fight_near') THEN 1 ELSE 0 END + CASE WHEN rule = 'conj' THEN 1 ELSE 0 END || ',' || CASE WHEN pred = 'destroy' THEN 0 ELSE 1 END || ',' || CAST(negated AS INTEGER) || ',0,' || CASE WHEN pred = 'destroy' THEN 1 ELSE 0 END || ','
  || CASE WHEN t = 2 AND pred = 'is' THEN 1 ELSE 0 END || ',' || printf('%.4f', CASE WHEN subj = 'He' THEN 0.6 ELSE confidence END) AS line FROM ft""")
def features_csv(spark, sf_dir):
    return E.csv(_features(spark, sf_dir))


@query(f"WITH {RELS} SELECT subj AS name, count(*) AS as_subject, 0 AS as_speaker FROM rel GROUP BY 1")
def subject_counts(spark, sf_dir):
    return E.subject_counts(P.relations(S.sentences(B.stories(spark, sf_dir))))


CLAIMS = "cl AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 3 AS INTEGER) AS start, CAST(l_linenumber % 3 + 4 AS INTEGER) AS stop, 'P' || l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'PERSON' WHEN 'R' THEN 'PLACE' ELSE 'DATE' END AS type, round(1 - l_discount, 2) AS confidence FROM lineitem)"


def _claims(spark, sf_dir):
    start = (F.col("l_linenumber") % 3).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 4).alias("end"), F.concat(F.lit("P"), "l_partkey").alias("id"), F.when(F.col("l_returnflag") == "A", "PERSON").when(F.col("l_returnflag") == "R", "PLACE").otherwise("DATE").alias("type"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )


@query(f"""WITH {CLAIMS} SELECT doc_id, start, first(id ORDER BY confidence DESC, CASE type WHEN 'PERSON' THEN 0 WHEN 'PLACE' THEN 2 ELSE 4 END, id) AS id, first(type ORDER BY confidence DESC, CASE type WHEN 'PERSON' THEN 0 WHEN 'PLACE' THEN 2 ELSE 4 END, id) AS type, max(confidence) AS confidence, count(DISTINCT id) AS n_claims FROM cl GROUP BY doc_id, start, stop""")
def span_conflicts(spark, sf_dir):
    return Z.span_winners(_claims(spark, sf_dir)).select("doc_id", "start", "id", "type", "confidence", "n_claims")


@query(f"WITH {CLAIMS} SELECT doc_id, start, first(id ORDER BY confidence DESC, id) AS id, max(confidence) AS confidence FROM cl GROUP BY 1, 2")
def surest_mentions(spark, sf_dir):
    return Z.surest_by_start(_claims(spark, sf_dir))


@query(f"""WITH {MEN}, g AS (SELECT key AS name, count(*) AS n, bool_or(contains(surface, ' ')) AS strong, bool_or(ord = 0) AS introduced FROM keyed WHERE length(key) >= 2 GROUP BY 1)
SELECT coalesce(CASE WHEN n >= 2 THEN 'mentions' WHEN name IN ('le', 'the') THEN 'whitelist' WHEN strong THEN 'strong_ner' WHEN introduced THEN 'introduced' END, 'deferred') AS reason, count(*) AS n FROM g GROUP BY 1""")
def promotion_gate(spark, sf_dir):
    from ..functions import text as T

    found = M.mentions(table(spark, sf_dir, "documents")).withColumn("name", T.surface_key(F.col("surface"))).where(F.length("name") >= 2)
    # Ordinals count blocked words too, as they are counted before those are taken out.
    clusters = found.groupBy("name").agg(F.count("*").alias("n"), F.bool_or(F.contains("surface", F.lit(" "))).alias("strong"), F.bool_or(F.col("ord") == 0).alias("introduced"))
    return Z.promoted(clusters, ("Le", "The")).groupBy(F.coalesce("reason", F.lit("deferred")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT p_name AS name, CASE p_size % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PLACE' END AS vote FROM part), c AS (SELECT name, vote, count(*) AS n FROM v WHERE vote IS NOT NULL GROUP BY 1, 2), b AS (SELECT name, first(vote ORDER BY n DESC, vote) AS vote FROM c GROUP BY 1)
SELECT DISTINCT v.name, coalesce(b.vote, CASE split_part(v.name, ' ', -1) WHEN 'ring' THEN 'ARTIFACT' WHEN 'sword' THEN 'ARTIFACT' WHEN 'crown' THEN 'ARTIFACT' WHEN 'widget' THEN 'ITEM' WHEN 'gadget' THEN 'ITEM' WHEN 'bolt' THEN 'ITEM' WHEN 'anvil' THEN 'ITEM' WHEN 'rod' THEN 'ITEM' END, 'MISC') AS kind FROM v LEFT JOIN b USING (name)""")
def inferred_types(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "PERSON").when(F.col("p_size") % 3 == 1, "PLACE").alias("vote"))
    return rows.groupBy("name").agg(F.collect_list("vote").alias("votes")).select("name", Z.kind_of(F.col("name"), F.col("votes")).alias("kind"))


@query(f"""WITH {STORY} SELECT doc_id, 'the father' AS name, CASE WHEN doc_id % 4 = 0 THEN 'TIER_B' ELSE 'TIER_C' END AS tier FROM story WHERE t = 4""")
def described_entities(spark, sf_dir):
    docs = B.stories(spark, sf_dir)
    found = Z.described(docs)
    related = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("The Father").alias("subj"), F.lit("of").alias("pred"), F.lit("x").alias("obj"))
    return Z.raised(found, related).select("doc_id", "name", "tier")


SCHOOL = """rel AS (SELECT 'S' || l_suppkey AS subj, CASE WHEN l_linenumber = 1 THEN 'teaches_at' WHEN l_suppkey % 3 <> 0 THEN 'knows' WHEN l_linenumber = 2 THEN 'child_of' WHEN l_linenumber = 3 THEN 'parent_of' ELSE 'knows' END AS pred, 'S' || (l_partkey % 40) AS obj FROM lineitem)"""


@query(f"WITH {SCHOOL} SELECT subj, pred, obj FROM rel r WHERE pred <> 'teaches_at' OR NOT EXISTS (SELECT 1 FROM rel c WHERE (c.pred = 'child_of' AND c.subj = r.subj) OR (c.pred = 'parent_of' AND c.obj = r.subj))")
def suppress_young_teachers(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem")
    return Z.without_young_teachers(rows.select(F.concat(F.lit("S"), "l_suppkey").alias("subj"), F.when(n == 1, "teaches_at").when(F.col("l_suppkey") % 3 != 0, "knows").when(n == 2, "child_of").when(n == 3, "parent_of").otherwise("knows").alias("pred"), F.concat(F.lit("S"), F.col("l_partkey") % 40).alias("obj")))


@query("""WITH r AS (SELECT l_orderkey % 100 AS doc_id, 'knows' AS pred, 'P' || (l_partkey % 30) AS obj, 'L' || l_orderkey || ':' || l_linenumber AS subj, l_partkey + l_linenumber AS start FROM lineitem),
g AS (SELECT *, start - lag(start) OVER w AS gap, row_number() OVER w AS r FROM r WINDOW w AS (PARTITION BY doc_id, pred, obj ORDER BY start, subj)), m AS (SELECT *, coalesce(max(gap) OVER (PARTITION BY doc_id, pred, obj), 0) >= 100 AS far FROM g)
SELECT doc_id, pred, obj, subj, start FROM m WHERE NOT far OR r = 1""")
def appositive_filter(spark, sf_dir):
    name = F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("doc_id"), F.lit("knows").alias("pred"), F.concat(F.lit("P"), F.col("l_partkey") % 30).alias("obj"), name.alias("subj"), (F.col("l_partkey") + F.col("l_linenumber")).alias("start"))
    return Z.first_of_appositives(rows)


@query("""WITH e AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY 1, 2) SELECT c_nationkey, first(c_mktsegment ORDER BY n DESC, f) AS c_mktsegment FROM e GROUP BY 1""")
def group_modes(spark, sf_dir):
    return Z.mode(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


@query("""SELECT c_name, base64(encode('{"k":"' || c_name || '"}')) AS cursor, (SELECT count(*) FROM customer WHERE c_name > 'Customer#000000040') > 25 AS has_next, true AS has_previous FROM customer WHERE c_name > 'Customer#000000040' ORDER BY c_name LIMIT 25""")
def connection_page(spark, sf_dir):
    return Z.connection(table(spark, sf_dir, "customer").select("c_name"), "c_name", "Customer#000000040", 25)


@query(f"WITH {TRI}, i AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'known' END AS id FROM triples) SELECT coalesce(id, sha1(subj || '|' || pred || '|' || obj)) AS id, subj, obj FROM i")
def relation_ids(spark, sf_dir):
    rows = B.triples(spark, sf_dir).withColumn("id", F.when(F.col("doc_id") % 2 == 0, "known"))
    return Z.with_ids(rows).select("id", "subj", "obj")


@query("SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n FROM conversations WHERE turn % 3 <> 0 UNION ALL SELECT conv_id, turn, NULL, NULL FROM conversations WHERE turn % 3 = 0")
def lenient_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit('Sure, here it is:\n```json\n{"role": "'), "role", F.lit('", "n": '), F.length("text").cast("string"), F.lit(",}\n```\nDone."))
    told = rows.select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, body).otherwise("I cannot say.").alias("answer"))
    return told.select("conv_id", "turn", Z.lenient_json(F.col("answer"), "role string, n int").alias("j")).select("conv_id", "turn", "j.role", "j.n")


@query(f"""WITH {SPANS} SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(start AS BIGINT) AS start, CAST("end" - start AS BIGINT) AS n, true AS prefixed FROM spans""")
def reference_roundtrip(spark, sf_dir):
    s = M.mention_spans(table(spark, sf_dir, "documents"))
    word = F.concat(F.lit("refv1:"), codec.encode_reference(F.struct("doc_id", "ord", "start", (F.col("end") - F.col("start")).alias("n"))))
    back = s.select(word.alias("w")).select(codec.decode_reference(F.expr("substring(w, 7)")).alias("v"), F.col("w").startswith("refv1:").alias("prefixed"))
    return back.select(F.col("v")[0].alias("doc_id"), F.col("v")[1].alias("ord"), F.col("v")[2].alias("start"), F.col("v")[3].alias("n"), "prefixed")
