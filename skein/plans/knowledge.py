"""Registered queries: registries, references, merging over documents, gates, profiles, learning, corrections, the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates as A
from ..operators import learning as L
from ..operators import mentions as M
from ..operators import profiles as O
from ..operators import references as W
from ..operators import registry as Y
from ..sources import tables as B
from ..sources.lineage import shared_path, written
from ..sources.tables import table
from .catalogue import BLOCKED, ENT, MEN, PAIRS, SPANS, TRI, _pairs, query

# --- entities over many documents -----------------------------------------------------------------------------------

LOCAL = """ent AS (SELECT 'P' || p_partkey AS id, p_name AS canonical, lower(p_name) AS name, CASE WHEN p_partkey % 50 = 0 THEN lower(p_brand) END AS alias, p_size AS doc_id FROM part
  UNION ALL SELECT DISTINCT 'B' || p_brand, p_brand, lower(p_brand), NULL, 0 FROM part
  UNION ALL SELECT DISTINCT 'E' || p_brand || e, p_brand || ' the ' || e, lower(p_brand || ' the ' || e), NULL, 0 FROM part, LATERAL (SELECT unnest(CASE WHEN p_brand LIKE '%1' THEN ['Elder', 'Younger'] ELSE ['Elder'] END) AS e)),
ep AS (SELECT s.name AS a, min(l.name) AS b FROM (SELECT DISTINCT name FROM ent) s JOIN (SELECT DISTINCT name FROM ent WHERE contains(name, ' the ')) l ON starts_with(l.name, s.name || ' the ') GROUP BY 1 HAVING count(*) = 1),
ed AS (SELECT name AS a, alias AS b FROM ent WHERE alias IS NOT NULL UNION SELECT alias, name FROM ent WHERE alias IS NOT NULL UNION SELECT a, b FROM ep UNION SELECT b, a FROM ep),
reach AS (SELECT DISTINCT name AS a, name AS b FROM ent UNION SELECT r.a, e.b FROM reach r JOIN ed e ON r.b = e.a),
least_of AS (SELECT a AS name, min(f.id) AS global_id FROM reach JOIN ent f ON f.name = reach.b GROUP BY 1), gl AS (SELECT ent.*, global_id FROM ent JOIN least_of USING (name))"""


def _local(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    items = part.select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.lit("ITEM").alias("type"), F.col("p_name").alias("canonical"), F.when(F.col("p_partkey") % 50 == 0, F.array(F.lower("p_brand"))).otherwise(none).alias("aliases"), F.col("p_size").alias("doc_id"))
    brands = part.select("p_brand").distinct().select(F.concat(F.lit("B"), "p_brand").alias("id"), F.lit("ITEM").alias("type"), F.col("p_brand").alias("canonical"), none.alias("aliases"), F.lit(0).alias("doc_id"))
    told = table(spark, sf_dir, "part").select("p_brand", F.explode(F.when(F.col("p_brand").like("%1"), F.array(F.lit("Elder"), F.lit("Younger"))).otherwise(F.array(F.lit("Elder")))).alias("e")).distinct()
    told = told.select(F.concat(F.lit("E"), "p_brand", "e").alias("id"), F.lit("ITEM").alias("type"), F.concat("p_brand", F.lit(" the "), "e").alias("canonical"), none.alias("aliases"), F.lit(0).alias("doc_id"))
    return items.unionByName(brands).unionByName(told)


@query(f"WITH RECURSIVE {LOCAL} SELECT id, global_id FROM gl")
def merged_entities(spark, sf_dir):
    return Y.merged(_local(spark, sf_dir))


@query(f"""WITH RECURSIVE {LOCAL} SELECT global_id, first(canonical ORDER BY length(canonical) DESC, canonical) AS canonical, count(*) AS n_local,
  CAST(len(list_distinct(list(canonical) || coalesce(list(alias) FILTER (alias IS NOT NULL), []))) - 1 AS INTEGER) AS n_aliases FROM gl GROUP BY 1""")
def global_entities(spark, sf_dir):
    local = _local(spark, sf_dir)
    return Y.global_entities(local, Y.merged(local)).select("global_id", "canonical", "n_local", F.size("aliases").alias("n_aliases"))


@query(f"WITH RECURSIVE {LOCAL} SELECT global_id, doc_id, id AS local_id, canonical AS local_canonical FROM gl")
def merge_provenance(spark, sf_dir):
    local = _local(spark, sf_dir)
    return Y.provenance(local, Y.merged(local))


@query(f"""WITH RECURSIVE {LOCAL}, {TRI} SELECT coalesce(a.global_id, subj) AS subj, pred, coalesce(b.global_id, obj) AS obj, count(*) AS n FROM triples LEFT JOIN gl a ON a.id = subj LEFT JOIN gl b ON b.id = obj GROUP BY 1, 2, 3""")
def rewired_relations(spark, sf_dir):
    rows = Y.rewired(B.triples(spark, sf_dir), Y.merged(_local(spark, sf_dir)))
    return rows.groupBy("subj", "pred", "obj").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS}, m AS (SELECT subj, obj FROM rel GROUP BY 1, 2 HAVING count(DISTINCT pred) = 2)
SELECT 'single_valued' AS kind, subj, pred, count(DISTINCT obj) AS n FROM rel WHERE pred = 'married_to' GROUP BY 1, 2, 3 HAVING count(DISTINCT obj) > 1
UNION ALL SELECT 'contradiction', subj, 'married_to/parent_of', count(*) FROM m GROUP BY subj""")
def merge_conflicts(spark, sf_dir):
    return Y.conflicts(_pairs(spark, sf_dir), ["married_to"], [("married_to", "parent_of")])


# --- references -----------------------------------------------------------------------------------------------------

EIDS = rf"""ek AS (SELECT *, regexp_replace(regexp_replace(lower(trim(surface)), '\s+', ' ', 'g'), '^\W+|\W+$', '', 'g') AS key FROM spans),
eids AS (SELECT row_number() OVER (ORDER BY md5(key), key) AS eid, key, first(surface ORDER BY length(surface) DESC, surface) AS canonical, count(*) AS occurrence_count FROM ek WHERE length(key) >= 2 GROUP BY key),
refs AS (SELECT eid, doc_id AS did, start AS position, "end" - start AS length, surface, ek.key FROM ek JOIN eids USING (key))"""


def _store(spark, sf_dir):
    spans = M.mention_spans(table(spark, sf_dir, "documents"))
    eids = W.eid_registry(spans)
    return W.references(spans, eids), eids


def _keyed_relations(spark, sf_dir):
    """Neighbouring names of a document as relations between normal forms."""
    spans = M.mention_spans(table(spark, sf_dir, "documents"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = spans.select(T.surface_key(F.col("surface")).alias("subj"), F.lit("before").alias("pred"), T.surface_key(F.lead("surface").over(w)).alias("obj"))
    return rows.where("obj is not null").groupBy("subj", "pred", "obj").agg(F.count("*").alias("n"))


NEXT = """nx AS (SELECT subj, obj, count(*) AS n FROM (SELECT key AS subj, lead(key) OVER (PARTITION BY doc_id ORDER BY ord) AS obj FROM ek) WHERE obj IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {SPANS}, {EIDS} SELECT eid, key, canonical, occurrence_count FROM eids")
def eid_registry(spark, sf_dir):
    return W.eid_registry(M.mention_spans(table(spark, sf_dir, "documents")))


@query(f"WITH {SPANS}, {EIDS} SELECT eid, did, position, length, surface FROM refs")
def reference_store(spark, sf_dir):
    store, _ = _store(spark, sf_dir)
    return W.add_many(store.where("did % 2 = 0"), store)


@query(f"WITH {SPANS}, {EIDS} SELECT did, position, surface FROM refs WHERE key = 'the' ORDER BY did, position LIMIT 100")
def find_mentions(spark, sf_dir):
    store, eids = _store(spark, sf_dir)
    return W.find_mentions(store, eids, "The").select("did", "position", "surface")


@query(f"WITH {SPANS}, {EIDS}, {NEXT} SELECT subj, obj, n FROM nx WHERE (subj = 'the' OR obj = 'the') AND subj IN (SELECT key FROM eids) AND obj IN (SELECT key FROM eids)")
def find_relationships(spark, sf_dir):
    _, eids = _store(spark, sf_dir)
    return W.find_relationships(_keyed_relations(spark, sf_dir), eids, "The").select("subj", "obj", "n")


@query(f"""WITH {SPANS}, {EIDS}, {NEXT}, r AS (SELECT key, count(*) AS n_relationships FROM (SELECT subj AS key FROM nx UNION ALL SELECT obj FROM nx WHERE obj <> subj) GROUP BY 1)
SELECT e.eid, e.canonical, count(*) AS n_mentions, count(DISTINCT did) AS n_documents, count(DISTINCT surface) AS n_aliases, coalesce(any_value(n_relationships), 0) AS n_relationships
FROM eids e JOIN refs USING (eid) LEFT JOIN r ON r.key = e.key GROUP BY 1, 2""")
def reference_entity_stats(spark, sf_dir):
    store, eids = _store(spark, sf_dir)
    return W.entity_stats(store, _keyed_relations(spark, sf_dir), eids)


@query(f"""WITH {SPANS}, {EIDS}, {NEXT} SELECT (SELECT count(*) FROM refs) AS n_references, (SELECT count(DISTINCT did) FROM refs) AS n_documents, (SELECT count(DISTINCT surface) FROM refs) AS n_aliases,
  (SELECT count(*) FROM eids) AS n_entities, (SELECT max(occurrence_count) FROM eids) AS most_occurrences, (SELECT count(*) FROM nx) AS n_relations""")
def reference_global_stats(spark, sf_dir):
    store, eids = _store(spark, sf_dir)
    return W.global_stats(store, eids, _keyed_relations(spark, sf_dir))


@query(f"WITH {SPANS}, {EIDS} SELECT eid, count(*) AS n, any_value(canonical) AS canonical FROM refs JOIN eids USING (eid) GROUP BY 1 ORDER BY n DESC, canonical LIMIT 10")
def most_referenced(spark, sf_dir):
    return W.most_referenced(*_store(spark, sf_dir))


def _leb(v: str) -> str:
    return f"CASE WHEN {v} < 128 THEN printf('%02X', {v}) WHEN {v} < 16384 THEN printf('%02X%02X', {v} % 128 + 128, {v} // 128) WHEN {v} < 2097152 THEN printf('%02X%02X%02X', {v} % 128 + 128, ({v} // 128) % 128 + 128, {v} // 16384) END"


def _mix(h: str, v: str) -> str:
    return f"((({h}) * 31 + {v} + 2147483648) % 4294967296 - 2147483648)"


@query(f"""WITH {SPANS}, s AS (SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(start AS BIGINT) AS start, CAST("end" - start AS BIGINT) AS n FROM spans)
SELECT doc_id, ord, {_leb('ord')} || '00' || printf('%02X%02X%02X%02X00000000', doc_id % 256, (doc_id // 256) % 256, (doc_id // 65536) % 256, doc_id // 16777216) || '07' || {_leb('ord')} || {_leb('start')} || {_leb('n')} AS word,
  ord || ' @ d:' || doc_id || ' @ p:' || ord || ' @ t:' || start || '+' || n AS readable, ({_mix(_mix(_mix('0', 'ord'), 'start'), 'n')} + 4294967296) % 1048576 AS place FROM s""")
def reference_words(spark, sf_dir):
    s = M.mention_spans(table(spark, sf_dir, "documents")).withColumn("n", F.col("end") - F.col("start"))
    o, d, a, n = (F.col(c) for c in ("ord", "doc_id", "start", "n"))
    return s.select("doc_id", F.col("ord").cast("long").alias("ord"), F.hex(W.packed(o, d, W.confidence_bin(F.lit(1.0)), o, a, n)).alias("word"), W.readable(o, d, o, a, n).alias("readable"), W.location_hash(F.lit(None), F.lit(None), o, a, n).alias("place"))


# --- gates ----------------------------------------------------------------------------------------------------------

_l = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
FORMS = """wd AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+)', 1) AS w FROM documents),
tk AS (SELECT lower(x) AS token, count(*) AS total, count(*) FILTER (NOT big) AS lowercase, count(*) FILTER (big) AS capitalized, count(*) FILTER (big AND NOT coalesce(p, false) AND NOT coalesce(f, false)) AS standalone FROM
  (SELECT w[i] AS x, regexp_matches(w[i], '^[A-Z]') AS big, i > 1 AND regexp_matches(w[i - 1], '^[A-Z]') AS p, regexp_matches(w[i + 1], '^[A-Z]') AS f FROM wd, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)) GROUP BY 1)"""


@query(f"WITH {FORMS} SELECT *, capitalized > 0 AND standalone = 0 AND lowercase = 0 AS attached_only FROM tk")
def token_forms(spark, sf_dir):
    return A.tokens(table(spark, sf_dir, "documents"))


@query(rf"""WITH {FORMS}, sn AS (SELECT doc_id, list_filter([trim(x) FOR x IN regexp_extract_all(text, '([^.!?\n]+[.!?]*)', 1)], lambda x: x <> '') AS l FROM documents),
st AS (SELECT unnest(l) AS s FROM sn), sw AS (SELECT regexp_extract_all(s, '([A-Za-z]+(?: [A-Z][a-z]+)*)', 1) AS w, regexp_matches(s, '^[A-Za-z]') AS lead FROM st),
c AS (SELECT w[i] AS n, lower(w[i]) AS l, i = 1 AND lead AS initial, string_split(lower(w[i]), ' ') AS ws FROM sw, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i)),
k AS (SELECT c.*, len(ws) = 1 AS single, ws[1] AS f, coalesce(attached, false) AND len(ws) = 1 AS attached, len(list_filter(ws, lambda x: NOT (x IN ({_l([*A.CLOSED, *A.VERBS])}) OR x LIKE '%ly'))) > 0 AS nominal,
  len(list_filter(ws[2:], lambda x: x NOT IN ({_l([*A.CLOSED, *A.VERBS])}))) > 0 AS rest, regexp_matches(n, '(^| )[A-Z]') AS capital FROM c
  LEFT JOIN (SELECT token, capitalized > 0 AND standalone = 0 AND lowercase = 0 AS attached FROM tk) t ON t.token = c.l),
r AS (SELECT CASE WHEN length(n) < 2 THEN 'too_short' WHEN single AND f IN ({_l(A.PRONOUNS)}) THEN 'pronoun_only' WHEN single AND f IN ({_l(A.WH)}) THEN 'wh_word' WHEN single AND f IN ({_l(A.DISCOURSE)}) THEN 'discourse_marker'
  WHEN single AND f IN ({_l(A.INTERJECTIONS)}) THEN 'interjection' WHEN NOT single AND len(list_filter(ws, lambda x: x NOT IN ({_l(A.VERBS)}))) = 0 THEN 'verb_phrase' WHEN f IN ({_l(A.VERBS)}) AND NOT rest THEN 'verb_lead'
  WHEN f IN ({_l(A.MODALS)}) THEN 'modal_lead' WHEN f LIKE '%ly' AND NOT nominal THEN 'adverb_lead' WHEN f IN ({_l(A.COORDINATING)}) THEN 'conjunction_lead' WHEN f IN ({_l(A.SUBORDINATING)}) THEN 'subordinator_lead'
  WHEN f IN ({_l(A.PREPOSITIONS)}) THEN 'pp_lead_no_object' WHEN single AND f IN ({_l(A.DETERMINERS)}) THEN 'determiner_only' WHEN len(list_filter(ws, lambda x: x NOT IN ({_l(A.CLOSED)}))) = 0 THEN 'closed_class_only'
  WHEN attached THEN 'compound_fragment' WHEN NOT nominal AND NOT capital THEN 'incomplete_constituent' WHEN NOT capital THEN 'lowercase_non_noun' WHEN single AND f IN ({_l(A.ROLES)}) AND initial THEN 'role_without_identity'
  WHEN single AND initial THEN 'single_token_sentence_initial_unverified' WHEN regexp_matches(n, '^[A-Z ]{{8,}}$') THEN 'theme_slogan' ELSE 'none' END AS reason FROM k)
SELECT CASE WHEN reason = 'none' THEN 'DURABLE_CANDIDATE' WHEN reason IN ('role_without_identity', 'single_token_sentence_initial_unverified', 'theme_slogan') THEN 'CONTEXT_ONLY' ELSE 'NON_ENTITY' END AS verdict, reason, count(*) AS n FROM r GROUP BY 1, 2""")
def gate_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spoken = M.sentences(docs).select("text", F.regexp_extract_all("text", F.lit("([A-Za-z]+(?: [A-Z][a-z]+)*)"), F.lit(1)).alias("w"))
    found = spoken.select(F.col("text").rlike("^[A-Za-z]").alias("lead"), F.posexplode("w").alias("at", "name")).withColumn("initial", F.col("lead") & (F.col("at") == 0))
    attached = A.tokens(docs).where("attached_only").select("token", F.lit(True).alias("attached"))
    # Counted before the join: a candidate is one of few different names.
    names = found.groupBy("name", "initial").agg(F.count("*").alias("n")).withColumn("token", F.lower("name")).join(attached, "token", "left")
    judged = names.select("n", A.gate(F.col("name"), F.col("initial"), F.coalesce("attached", F.lit(False))).alias("g"))
    return judged.groupBy("g.verdict", F.coalesce("g.reason", F.lit("none")).alias("reason")).agg(F.sum("n").alias("n"))


NAMED = f"""{ENT}, tested AS (SELECT canonical, type FROM entities UNION ALL SELECT surface, 'PERSON' FROM mentions UNION ALL SELECT split_part(p_type, ' ', 1), 'ORG' FROM part
  UNION ALL SELECT unnest(['He', 'said', 'Chapter 4', 'the end', 'UK', 'ab', '1999', 'ABCDE FG', 'part 12', 'x']), 'PLACE')"""


@query(rf"""WITH {MEN}, {NAMED}, r AS (SELECT lower(trim(canonical)) AS l, canonical AS c, type FROM tested)
SELECT CASE WHEN l = '' THEN 'empty' WHEN l IN ({_l(sorted({*A.PRONOUNS, *A.REFLEXIVE}))}) THEN 'pronouns' WHEN l IN ({_l(A.COMMON)}) THEN 'common_words'
  WHEN regexp_matches(l, '^(and|or|but|the|a|an|when|where|seeing|meeting|before|after|if|take|gather|located)\s+') OR regexp_matches(l, '\s+(said|asked|replied|moved|came|went|told|there|here)$') OR (type <> 'DATE' AND NOT regexp_matches(l, '[a-z]'))
    OR regexp_matches(l, '^[a-z]$') OR regexp_matches(l, 'chapter|section|part\s+\d+|epilogue|prologue') OR regexp_matches(c, '^[A-Z\s]{{4,}}$') OR regexp_matches(l, '^(you|i|they|we)\s+(dared|use|my|your|their|our)') THEN 'bad_pattern'
  WHEN length(l) < 2 OR (length(l) = 2 AND l NOT IN ({_l(A.VALID_SHORT)}) AND type <> 'PERSON') THEN 'too_short' ELSE 'kept' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def entity_filter_stats(spark, sf_dir):
    docs, part = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    odd = spark.createDataFrame([(x,) for x in ("He", "said", "Chapter 4", "the end", "UK", "ab", "1999", "ABCDE FG", "part 12", "x")], "canonical string").withColumn("type", F.lit("PLACE"))
    rows = B.entities(spark, sf_dir).select("canonical", "type").unionByName(M.mentions(docs).select(F.col("surface").alias("canonical"), F.lit("PERSON").alias("type")))
    rows = rows.unionByName(part.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("canonical"), F.lit("ORG").alias("type"))).unionByName(odd)
    return A.filter_stats(rows)


@query(f"""WITH {MEN}, g AS (SELECT key, count(*) AS n, min(surface) AS s FROM keyed WHERE length(key) >= 2 GROUP BY 1), f AS (SELECT *, len(string_split(key, ' ')) AS w FROM g),
q AS (SELECT key, n, s, round(greatest(0, least(1, 1.0 - CASE WHEN key IN ({_l(A.COMMON)}) THEN 0.8 ELSE 0 END - CASE WHEN key IN ({_l(A.PRONOUNS)}) THEN 0.9 ELSE 0 END + CASE WHEN n > 1 THEN least(n - 1, 5) * 0.1 ELSE 0 END + 0.1
  + CASE WHEN w BETWEEN 2 AND 4 THEN 0.1 ELSE 0 END - CASE WHEN w > 5 THEN 0.2 ELSE 0 END)), 6) AS quality,
  round(least(1, 0.6 * least(1.5, 1 + n * 0.05) * CASE WHEN w = 1 AND key IN ({_l(A.GENERIC)}) THEN 0.3 ELSE 1 END * least(1.5, CASE WHEN w >= 3 THEN 1.4 WHEN w = 2 THEN 1.3 ELSE 1.0 END + CASE WHEN n >= 2 THEN 0.1 ELSE 0 END)), 6) AS confidence FROM f)
SELECT key, quality, confidence, round(least(1, CASE WHEN confidence < 0.5 THEN 0.4 WHEN confidence < 0.7 THEN 0.2 ELSE 0 END + CASE WHEN n <= 1 THEN 0.3 ELSE 0 END + CASE WHEN NOT contains(s, ' ') THEN 0.2 ELSE 0 END), 6) AS uncertainty FROM q""")
def entity_scores(spark, sf_dir):
    g = M.mentions(table(spark, sf_dir, "documents")).withColumn("key", T.surface_key(F.col("surface"))).where(F.length("key") >= 2).groupBy("key").agg(F.count("*").alias("n"), F.min("surface").alias("s"))
    kind = F.lit("PERSON")
    rows = g.select("key", "n", "s", A.quality(F.col("s"), kind, F.col("n")).alias("quality"), A.confidence(F.col("s"), F.col("n"), F.lit("FALLBACK"), kind, {"FALLBACK": 0.6}).alias("confidence"))
    return rows.select("key", "quality", "confidence", A.uncertainty(F.col("confidence"), F.col("n"), F.col("s")).alias("uncertainty"))


@query(f"""WITH {ENT}, w AS (SELECT DISTINCT unnest(string_split(canonical, ' ')) AS t FROM entities WHERE type = 'ORG'), x AS (SELECT id, type, canonical FROM entities UNION ALL SELECT 'X' || s_suppkey, 'PERSON', s_name FROM supplier)
SELECT id, canonical FROM x WHERE canonical <> lower(canonical) AND NOT (type = 'PERSON' AND NOT contains(canonical, ' ') AND canonical IN (SELECT t FROM w))""")
def global_filter(spark, sf_dir):
    extra = table(spark, sf_dir, "supplier").select(F.concat(F.lit("X"), "s_suppkey").alias("id"), F.lit("PERSON").alias("type"), F.col("s_name").alias("canonical"))
    return A.filter_global(B.entities(spark, sf_dir).unionByName(extra)).select("id", "canonical")


@query("""WITH e AS (SELECT user_id AS name, count(*) AS n, round(1 - exp(sum(ln(greatest(1 - least(value / 500, 0.9), 1e-12)))), 6) AS score FROM events GROUP BY 1)
SELECT name, n, score, CASE WHEN score >= 0.9 THEN 'confirmed' WHEN score >= 0.7 THEN 'likely' WHEN score >= 0.4 THEN 'tentative' ELSE 'rejected' END AS level FROM e""")
def evidence_levels(spark, sf_dir):
    return A.accumulated(table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.least(F.col("value") / 500, F.lit(0.9)).alias("weight")))


@query(f"""WITH {MEN}, d AS (SELECT DISTINCT surface AS s FROM mentions UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT lower(p_name) FROM part), x AS (SELECT s, lower(trim(s)) AS l, string_split(trim(s), ' ') AS w FROM d)
SELECT s AS name, (length(s) < 3 AND NOT contains(s, '.')) OR l IN ({_l(A.GARBAGE)}) OR (l LIKE 'the %' AND length(s) < 20 AND regexp_matches(s, '^.{{4}}[a-z]')) OR (len(w) >= 2 AND length(w[1]) <= 2 AND regexp_matches(w[1], '^[a-z]+$'))
  OR (len(w) >= 2 AND regexp_matches(l, '(ing| ed|ied|ang|ung)$') AND regexp_matches(w[-1], '^[a-z]')) OR len(w) > 4 AS garbage FROM x""")
def garbage_aliases(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = M.mentions(table(spark, sf_dir, "documents")).select(F.col("surface").alias("name")).unionByName(part.select(F.col("p_type").alias("name"))).unionByName(part.select(F.lower("p_name").alias("name"))).distinct()
    return names.select("name", A.is_garbage_alias(F.col("name")).alias("garbage"))


@query(f"""WITH w AS (SELECT lower(x) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS x FROM documents) GROUP BY 1)
SELECT CASE WHEN token IN ({_l(A.PERSONAL)}) THEN 'personal' WHEN token IN ({_l(A.DEMONSTRATIVE)}) THEN 'demonstrative' WHEN token IN ({_l(A.REFLEXIVE)}) THEN 'reflexive' WHEN token IN ({_l(A.INDEFINITE)}) THEN 'indefinite'
  WHEN token IN ({_l(A.RELATIVE)}) THEN 'relative' WHEN token IN ({_l(A.INTERROGATIVE)}) THEN 'interrogative' ELSE 'none' END AS category, token IN ({_l([*A.PRONOUNS, *A.DEICTIC])}) AS context_dependent, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1, 2""")
def pronoun_categories(spark, sf_dir):
    rows = M.token_stats(table(spark, sf_dir, "documents"))
    return rows.groupBy(F.coalesce(A.pronoun_category(F.col("token")), F.lit("none")).alias("category"), A.is_context_dependent(F.col("token")).alias("context_dependent")).agg(F.sum("total").alias("n"))


# --- profiles -------------------------------------------------------------------------------------------------------


def _seen(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (at * 1).alias("at"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("context"), F.col("event_type").alias("descriptor"))


PROFILE = """ev AS (SELECT user_id AS id, epoch_us(ts) AS tm, 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS context, event_type AS descriptor, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS r FROM events),
prof AS (SELECT id, count(*) AS n, min(tm) AS first_seen, max(tm) AS last_seen, array_to_string(list_sort(list(DISTINCT descriptor)), ',') AS descriptors, round(least(0.95, 0.5 + 0.05 * count(*)), 6) AS confidence,
  coalesce(string_agg(context, ',' ORDER BY tm, context) FILTER (r <= 20), '') AS contexts FROM ev GROUP BY 1)"""


@query(f"WITH {PROFILE} SELECT * FROM prof")
def entity_profiles(spark, sf_dir):
    rows = O.profiles(_seen(spark, sf_dir))
    return rows.select("id", "n", "first_seen", "last_seen", F.array_join("descriptors", ",").alias("descriptors"), "confidence", F.array_join("contexts", ",").alias("contexts"))


@query(f"WITH {PROFILE} SELECT id, n, descriptors, confidence FROM prof")
def profile_updates(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    middle = F.lit(1_705_000_000_000_000)
    both = O.updated(O.profiles(seen.where(F.col("at") < middle)), O.profiles(seen.where(F.col("at") >= middle)))
    schema = "id bigint, n bigint, first_seen bigint, last_seen bigint, descriptors array<string>, confidence double, contexts array<string>"
    back = O.deserialized(O.serialized(both), schema.replace("id bigint, ", ""))
    return back.select("id", "n", F.array_join("descriptors", ",").alias("descriptors"), "confidence")


@query(f"""WITH {PROFILE} SELECT id, round((CASE WHEN contains(descriptors, 'purchase') THEN 1 ELSE 0 END + CASE WHEN contains(descriptors, 'view') THEN 1 ELSE 0 END) / 2.0 * (1 + log10(n + 1) * 0.2) * confidence, 6) AS score FROM prof
WHERE contains(descriptors, 'purchase') OR contains(descriptors, 'view') ORDER BY score DESC, id LIMIT 10""")
def find_by_descriptor(spark, sf_dir):
    return O.by_descriptor(O.profiles(_seen(spark, sf_dir)), ["purchase", "view"])


@query("""WITH l AS (SELECT user_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS tm, event_type AS method, CAST(event_id AS VARCHAR) AS surface, least(value / 500, 1) AS confidence, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), CAST(event_id AS VARCHAR)) AS gap FROM events),
c AS (SELECT id, count(*) AS length, count(DISTINCT method) AS methods, round(coalesce(avg(gap), 0), 6) AS average_gap, coalesce(max(gap), 0) AS largest_gap, avg(confidence) AS sure FROM l GROUP BY 1)
SELECT id, length, methods, average_gap, largest_gap, round(least(1, 0.4 * sure + 0.2 * least(length / 5, 1) + 0.2 * least(methods / 3, 1) + 0.2 * greatest(0, 1 - average_gap / 1000)), 6) AS score FROM c""")
def coref_chains(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("method"), F.col("event_id").cast("string").alias("surface"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"))
    return O.chains(rows)


@query(f"""WITH {ENT}, {TRI}, per AS (SELECT 'P' || l_partkey AS id, l_orderkey AS d, l_linenumber AS p, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT id, string_agg(d || ':' || p, ',' ORDER BY n DESC, d, p) FILTER (r <= 3) AS top, sum(n) AS m, count(DISTINCT d) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, d, p) AS r FROM per) GROUP BY 1),
o AS (SELECT id, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT subj AS id, 1 AS o, 0 AS i FROM triples UNION ALL SELECT obj, 0, 1 FROM triples) GROUP BY 1)
SELECT e.id, canonical, CAST(coalesce(m, 0) AS BIGINT) AS n_mentions, coalesce(docs, 0) AS n_documents, CAST(coalesce(n_out, 0) AS BIGINT) AS n_out, CAST(coalesce(n_in, 0) AS BIGINT) AS n_in, coalesce(top, '') AS top_places
FROM entities e LEFT JOIN t ON t.id = e.id LEFT JOIN o ON o.id = e.id""")
def entity_fact_profile(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("paragraph"))
    return O.fact_profile(B.entities(spark, sf_dir).select("id", "canonical"), seen, B.triples(spark, sf_dir))


# --- learning -------------------------------------------------------------------------------------------------------

SEEDS = f"""top AS (SELECT key, count(*) AS n FROM keyed WHERE length(key) >= 2 AND NOT contains(surface, ' ') GROUP BY 1 ORDER BY n DESC, key LIMIT 30), seeds AS (SELECT DISTINCT surface AS name FROM keyed JOIN top USING (key) WHERE NOT contains(surface, ' ')),
lw AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z]+)', 1) AS w FROM documents), ctx AS (SELECT doc_id, w[i] AS name, array_to_string(w[greatest(i - 5, 1):i - 1], ' ') AS before, array_to_string(w[i + 1:i + 5], ' ') AS after
  FROM lw, LATERAL (SELECT unnest(generate_series(1, len(w))) AS i) WHERE w[i] IN (SELECT name FROM seeds) AND regexp_matches(w[i], '^[A-Z]')),
tp AS (SELECT name, unnest(list_filter([CASE WHEN regexp_matches(split_part(after, ' ', 1), '^[a-z]') THEN 'X ' || split_part(after, ' ', 1) END, CASE WHEN regexp_matches(split_part(before, ' ', -1), '^[a-z]') THEN split_part(before, ' ', -1) || ' X' END], lambda x: x IS NOT NULL)) AS template FROM ctx),
templates AS (SELECT template, count(*) AS n, count(DISTINCT name) AS n_examples FROM tp GROUP BY 1 HAVING count(DISTINCT name) >= 2)"""


def _seeds(spark, sf_dir):
    found = M.mentions(table(spark, sf_dir, "documents")).where(~F.contains("surface", F.lit(" "))).withColumn("key", T.surface_key(F.col("surface"))).where(F.length("key") >= 2)
    names = written(found.groupBy("key", F.col("surface").alias("name")).agg(F.count("*").alias("n")))  # the texts are read once
    top = names.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(30)
    return written(names.join(top.select("key"), "key", "left_semi").select("name").distinct())


@query(f"WITH {MEN}, {SEEDS} SELECT doc_id, name, before, after FROM ctx")
def seed_contexts(spark, sf_dir):
    return L.contexts(table(spark, sf_dir, "documents"), _seeds(spark, sf_dir))


@query(f"WITH {MEN}, {SEEDS} SELECT * FROM templates")
def learned_templates(spark, sf_dir):
    return L.generalized(L.contexts(table(spark, sf_dir, "documents"), _seeds(spark, sf_dir)))


FOUND = """pr AS (SELECT w[i] AS a, w[i + 1] AS b FROM lw, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS i)),
hit AS (SELECT name, template, count(*) AS n FROM (SELECT a AS name, 'X ' || b AS template FROM pr WHERE regexp_matches(a, '^[A-Z]') AND regexp_matches(b, '^[a-z]') UNION ALL SELECT b, a || ' X' FROM pr WHERE regexp_matches(b, '^[A-Z]') AND regexp_matches(a, '^[a-z]'))
  WHERE length(name) >= 3 AND lower(name) NOT IN ('the', 'this', 'that', 'there', 'then', 'they', 'and', 'but', 'for', 'with') AND template IN (SELECT template FROM templates) AND name NOT IN (SELECT name FROM seeds) GROUP BY 1, 2),
fs AS (SELECT name, count(DISTINCT template) AS n_templates, CAST(sum(n) AS BIGINT) AS n, round(1 - power(0.5, count(DISTINCT template)), 6) AS confidence, round(1 - abs(0.5 - power(0.5, count(DISTINCT template))) * 2, 6) AS uncertainty FROM hit GROUP BY 1)"""


@query(f"WITH {MEN}, {SEEDS}, {FOUND} SELECT name, n_templates, n, confidence, uncertainty FROM fs")
def pattern_finds(spark, sf_dir):
    docs, seeds = table(spark, sf_dir, "documents"), _seeds(spark, sf_dir)
    templates = L.generalized(L.contexts(docs, seeds))
    return L.scored(L.applied(docs, templates, seeds), templates)


@query(f"WITH {MEN}, {SEEDS}, {FOUND} SELECT name, n_templates, n, uncertainty FROM fs WHERE uncertainty >= 0.3 ORDER BY uncertainty DESC, n DESC, name LIMIT 10")
def active_learning(spark, sf_dir):
    return L.active_round(table(spark, sf_dir, "documents"), _seeds(spark, sf_dir)).select("name", "n_templates", "n", "uncertainty")


def _asking(k: int) -> str:
    """Round k of the learning loop, from the seeds s and the refused names x of the round before."""
    return f"""t{k} AS (SELECT template FROM occ WHERE name IN (SELECT name FROM s{k}) GROUP BY 1 HAVING count(*) >= 2),
u{k} AS (SELECT name, sum(n) AS n, round(1 - abs(0.5 - power(0.5, count(*))) * 2, 6) AS uncertainty FROM occ WHERE length(name) >= 3 AND lower(name) NOT IN ('the', 'this', 'that', 'there', 'then', 'they', 'and', 'but', 'for', 'with')
  AND template IN (SELECT template FROM t{k}) AND name NOT IN (SELECT name FROM s{k}) AND name NOT IN (SELECT name FROM x{k}) AND (SELECT g FROM go{k}) GROUP BY 1),
a{k} AS MATERIALIZED (SELECT name, length(name) % 3 <> 0 AS ok FROM u{k} WHERE uncertainty >= 0.3 ORDER BY uncertainty DESC, n DESC, name LIMIT 10),
s{k + 1} AS MATERIALIZED (SELECT name FROM s{k} UNION SELECT name FROM a{k} WHERE ok), x{k + 1} AS MATERIALIZED (SELECT name FROM x{k} UNION SELECT name FROM a{k} WHERE NOT ok), go{k + 1} AS MATERIALIZED (SELECT count(*) >= 2 AS g FROM a{k} WHERE ok)"""


LOOP = """pr AS (SELECT w[i] AS a, w[i + 1] AS b FROM lw, LATERAL (SELECT unnest(generate_series(1, len(w) - 1)) AS i)),
occ AS MATERIALIZED (SELECT name, template, count(*) AS n FROM (SELECT a AS name, 'X ' || b AS template FROM pr WHERE regexp_matches(a, '^[A-Z]') AND regexp_matches(b, '^[a-z]') UNION ALL SELECT b, a || ' X' FROM pr WHERE regexp_matches(b, '^[A-Z]') AND regexp_matches(a, '^[a-z]')) GROUP BY 1, 2),
s1 AS MATERIALIZED (SELECT name FROM seeds), x1 AS (SELECT name FROM seeds WHERE false), go1 AS (SELECT true AS g)"""


@query(f"WITH {MEN}, {SEEDS}, {LOOP}, {', '.join(_asking(k) for k in range(1, 6))} SELECT 0 AS round, name, 'seed' AS status FROM seeds {' '.join(f'UNION ALL SELECT {k}, name, CASE WHEN ok THEN $$confirmed$$ ELSE $$rejected$$ END FROM a{k}' for k in range(1, 6))}")
def learning_loop(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))).alias("name")).distinct()
    answers = words.select("name", (F.length("name") % 3 != 0).alias("is_correct"))
    return L.learning_loop(docs, written(_seeds(spark, sf_dir)), answers, shared_path(spark))


PATTERN = """cr AS (SELECT regexp_replace(regexp_replace(p_name, '[0-9]+', '0', 'g'), '[A-Z]', 'A', 'g') AS pattern, 'type' AS kind, CASE WHEN p_size % 5 = 0 THEN 'ARTIFACT' ELSE 'ITEM' END AS value FROM part),
pt AS (SELECT pattern, kind, value, count(*) AS support, round(count(*) / sum(count(*)) OVER (PARTITION BY pattern, kind), 6) AS confidence FROM cr GROUP BY 1, 2, 3)"""


def _patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.lit("type").alias("kind"), F.when(F.col("p_size") % 5 == 0, "ARTIFACT").otherwise("ITEM").alias("value"))
    return L.from_corrections(rows)


@query(f"WITH {PATTERN} SELECT pattern, kind, value, support, confidence FROM pt")
def correction_patterns(spark, sf_dir):
    return _patterns(spark, sf_dir).select("pattern", "kind", "value", "support", "confidence")


@query(f"""WITH {PATTERN}, b AS (SELECT pattern, first(value ORDER BY confidence DESC, support DESC, value) AS v FROM pt WHERE confidence >= 0.5 GROUP BY 1)
SELECT 'P' || p_partkey AS id, p_name AS name, coalesce(v, 'MISC') AS type, v IS NOT NULL AS applied FROM part LEFT JOIN b ON b.pattern = regexp_replace(regexp_replace(p_name, '[0-9]+', '0', 'g'), '[A-Z]', 'A', 'g')""")
def patterns_applied(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("MISC").alias("type"))
    return L.apply_corrections(rows, _patterns(spark, sf_dir))


@query(f"WITH {PATTERN} SELECT kind, count(*) AS n, CAST(sum(support) * 2 AS BIGINT) AS support FROM pt GROUP BY 1")
def library_stats(spark, sf_dir):
    p = _patterns(spark, sf_dir).select("pattern", "kind", "value", "support")
    return L.library_stats(L.merged_libraries(p, p).withColumn("confidence", F.lit(1.0))).select("kind", "n", "support")


@query(r"""WITH w AS (SELECT DISTINCT lower(x) AS w FROM (SELECT unnest(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS x FROM documents))
SELECT w AS word, CASE WHEN regexp_matches(w, '^.{2,}ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '^.{3,}ing$') THEN regexp_replace(w, 'ing$', '') WHEN regexp_matches(w, '^.{3,}ed$') THEN regexp_replace(w, 'ed$', '')
  WHEN regexp_matches(w, '^.+(s|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '^.{2,}[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS lemma FROM w""")
def lemmas(spark, sf_dir):
    rows = M.token_stats(table(spark, sf_dir, "documents")).select(F.col("token").alias("word"))
    return rows.select("word", L.lemma(F.col("word")).alias("lemma"))


@query("""WITH g AS (SELECT DISTINCT p_type AS phrase, split_part(p_type, ' ', 1) AS family FROM part), i AS (SELECT DISTINCT p_type AS phrase FROM part WHERE p_size < 10)
SELECT family, count(*) AS n, count(i.phrase) AS covered, round(count(i.phrase) / count(*), 6) AS share FROM g LEFT JOIN i USING (phrase) GROUP BY 1""")
def pattern_coverage(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    made = part.select(F.col("p_type").alias("phrase"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("family")).distinct()
    return L.coverage(made, part.where("p_size < 10").select(F.col("p_type").alias("phrase")))


@query("""WITH n AS (SELECT 'S' || s_suppkey AS name, 'ORG' AS type, 1 AS c FROM supplier UNION ALL SELECT 'S' || l_suppkey, NULL, 1 FROM lineitem UNION ALL SELECT 'Part' || (l_partkey % 10), 'ITEM', 1 FROM lineitem)
SELECT min(name) AS name, coalesce(max(type), 'MISC') AS type, count(*) AS mention_count FROM n GROUP BY lower(name)""")
def note_tags(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.lit("ORG").alias("type"), F.lit(1).alias("mention_count"))
    text = F.concat(F.lit("sold by [[Entity: S"), "l_suppkey", F.lit("]] as [[NewEntity: Part"), F.col("l_partkey") % 10, F.lit("|type=item]]."))
    notes = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("note_id"), text.alias("text"))
    return L.tagged_entities(known, notes)


# --- senses, corrections, queue -------------------------------------------------------------------------------------


@query("""SELECT count(DISTINCT p_name) AS names, (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1)) AS ambiguous, (SELECT max(c) FROM (SELECT count(DISTINCT p_size) AS c FROM part GROUP BY p_name)) AS most FROM part""")
def sense_stats(spark, sf_dir):
    return Y.sense_stats(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("sense")))


@query("""WITH s AS (SELECT p_partkey AS key, p_name AS name, p_brand AS type, p_size AS sense, list_distinct(string_split(lower(p_type), ' ')) AS w FROM part),
m AS (SELECT a.key, b.sense, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS sim FROM s a JOIN s b ON a.name = b.name AND a.type = b.type),
t AS (SELECT key, first(sense ORDER BY sim DESC, sense) AS sense, round(max(sim), 6) AS similarity FROM m WHERE sim > 0.7 GROUP BY 1) SELECT s.key, t.sense, t.similarity FROM s LEFT JOIN t USING (key)""")
def matching_senses(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_size").alias("sense"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("words"))
    return Y.matching_sense(rows.select("key", "name", "type", "words"), rows.select("name", "type", "sense", "words"))


@query("""WITH x AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand = b.p_brand AS same, len(list_intersect(string_split(lower(a.p_type), ' '), string_split(lower(b.p_type), ' '))) AS i,
  len(list_distinct(string_split(lower(a.p_type), ' ') || string_split(lower(b.p_type), ' '))) AS u FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey)
SELECT a, b, NOT same OR i / u < 0.5 AS different, CASE WHEN NOT same THEN 1.0 WHEN i / u < 0.3 THEN 0.9 WHEN i / u < 0.5 THEN 0.6 ELSE 0.8 END AS confidence FROM x""")
def discriminated_senses(spark, sf_dir):
    none = F.array().cast("array<string>")
    words = F.array_sort(F.array_distinct(F.split(F.lower("p_type"), " "))).alias("words")
    profile = F.struct(words, none.alias("descriptors"), none.alias("titles"))
    return Y.discriminated_pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), profile.alias("profile")))


@query("SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS entities, round(avg(n), 6) AS average FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def alias_stats(spark, sf_dir):
    return Y.alias_stats(table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("id")))


@query("""WITH k AS (SELECT p_brand AS id, lower(p_name) AS low, min(p_name) AS alias, count(*) AS version FROM part GROUP BY 1, 2), gone AS (SELECT p_brand AS id, lower(p_name) AS low FROM part WHERE p_size = 1)
SELECT id, alias, version FROM k WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = k.id AND gone.low = k.low)""")
def alias_versions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("id"), F.col("p_name").alias("alias"), F.lit(1).alias("version"))
    known = Y.with_aliases(names.where("false"), names.select("id", "alias"))
    return Y.without_aliases(known, part.where("p_size = 1").select(F.col("p_brand").alias("id"), F.upper("p_name").alias("alias")))


CORRECTIONS = f"""{TRI}, rel AS (SELECT subj, pred, obj, confidence FROM triples),
cor AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'remove' ELSE 'add' END AS kind, 'S' || (c_custkey % 60) AS subj, 'located_in' AS pred, 'N' || c_nationkey AS obj, c_acctbal < 0 AS back FROM customer),
lst AS (SELECT subj, pred, obj, arg_max(kind, seq) AS kind FROM cor WHERE NOT back GROUP BY 1, 2, 3)"""


@query(f"""WITH {ENT}, {CORRECTIONS} SELECT * FROM rel r WHERE NOT EXISTS (SELECT 1 FROM lst l WHERE l.kind = 'remove' AND l.subj = r.subj AND l.pred = r.pred AND l.obj = r.obj)
UNION ALL SELECT subj, pred, obj, 1.0 FROM lst l WHERE kind = 'add' AND subj IN (SELECT id FROM entities) AND obj IN (SELECT id FROM entities) AND NOT EXISTS (SELECT 1 FROM rel r WHERE l.subj = r.subj AND l.pred = r.pred AND l.obj = r.obj)""")
def corrected_relations(spark, sf_dir):
    corrections = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 3 == 0, "remove").otherwise("add").alias("kind"), F.concat(F.lit("S"), F.col("c_custkey") % 60).alias("subj"), F.lit("located_in").alias("pred"),
        F.concat(F.lit("N"), "c_nationkey").alias("obj"), (F.col("c_acctbal") < 0).alias("rolled_back"),
    )
    relations = B.triples(spark, sf_dir).select("subj", "pred", "obj", "confidence")
    return Y.corrected_relations(relations, corrections, B.entities(spark, sf_dir))


QUEUE = """q AS (SELECT c_custkey AS id, c_mktsegment AS kind, c_name AS name, round(c_acctbal / 10000, 4) AS confidence, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 0 THEN 'rejected' WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'approved' END AS status FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_custkey, c_mktsegment, c_name, round(c_acctbal / 10000, 4), CASE WHEN c_custkey % 7 = 0 THEN 'rejected' ELSE 'pending' END FROM customer WHERE c_custkey % 5 = 0)"""


def _queue(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") / 10000, 4).alias("confidence"))
    old = rows.where("id % 5 <> 0").withColumn("status", F.when(F.col("id") % 2 == 0, "pending").otherwise("approved"))
    return Y.dismissed(Y.queued(old, rows), rows.where("id % 7 = 0").select("id"))


@query(f"WITH {QUEUE} SELECT status, count(*) AS n FROM q GROUP BY 1")
def review_queue(spark, sf_dir):
    return _queue(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {QUEUE} SELECT id, name, confidence FROM q WHERE status = 'pending' AND kind = 'BUILDING' AND confidence >= 0.2 ORDER BY confidence DESC, id LIMIT 100")
def review_bulk(spark, sf_dir):
    return Y.bulk(Y.cleaned(_queue(spark, sf_dir)), kind="BUILDING", least=0.2).select("id", "name", "confidence")


@query(f"WITH {QUEUE}, b AS (SELECT * FROM q WHERE status = 'pending' AND confidence >= 0.5 ORDER BY confidence DESC, id LIMIT 500) SELECT count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY confidence DESC, id) FILTER (r <= 10) AS first FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS r FROM b)")
def review_bulk_preview(spark, sf_dir):
    return Y.bulk_preview(_queue(spark, sf_dir), least=0.5, most=500)


def blocked_words() -> str:
    """The words that are no names, as SQL."""
    return BLOCKED
