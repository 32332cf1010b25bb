"""Registered queries: rows to text, names, stores, outside contracts and the salience stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import time as D
from ..operators import rendering as X
from ..sources import exports
from ..sources import stores as S
from ..sources import tables as B
from ..sources.tables import table
from ..streaming import jobs as J
from .catalogue import ENT, TRI, query
from .narrative import FACTS, STORY

# --- text of relations ----------------------------------------------------------------------------------------------

KINDS = ("married_to", "parent_of", "lives_in", "rules", "killed", "alias_of", "hidden_in", "bought")
KINDS_SQL = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
TOLD = f"""tr AS (SELECT 'S' || l_suppkey AS id, {KINDS_SQL} AS pred, 'P' || l_partkey AS obj, CASE WHEN l_returnflag <> 'N' THEN CAST(year(l_shipdate) AS VARCHAR) END AS t, round(0.72 - l_discount, 2) AS c FROM lineitem),
told AS (SELECT id, pred, t, CASE pred WHEN 'bought' THEN id || ' has relation "bought" with ' || obj || '.'
  ELSE id || ' ' || CASE pred WHEN 'parent_of' THEN CASE WHEN c < 0.7 THEN 'is said to be ' ELSE 'is ' END WHEN 'alias_of' THEN '' WHEN 'hidden_in' THEN CASE WHEN c < 0.7 THEN 'is reportedly ' ELSE 'is ' END ELSE CASE WHEN c < 0.7 THEN 'reportedly ' ELSE '' END END
  || CASE pred WHEN 'married_to' THEN 'married' WHEN 'parent_of' THEN 'the parent of' WHEN 'lives_in' THEN 'lived in' WHEN 'alias_of' THEN 'is also known as' WHEN 'hidden_in' THEN 'hidden in' ELSE pred END || ' ' || obj
  || CASE WHEN t IS NOT NULL AND pred NOT IN ('parent_of', 'alias_of') THEN ' in ' || t ELSE '' END || '.' END AS line,
  CASE pred WHEN 'married_to' THEN 1.0 WHEN 'parent_of' THEN 0.65 WHEN 'lives_in' THEN 0.7 WHEN 'rules' THEN 0.95 WHEN 'killed' THEN 0.95 WHEN 'alias_of' THEN 0.05 WHEN 'hidden_in' THEN 0.6 ELSE 0.0 END AS weight FROM tr)"""


def _told(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pred = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("l_partkey") % 8 + 1).cast("int"))
    rows = lines.select(F.concat(F.lit("S"), "l_suppkey").alias("id"), pred.alias("pred"), F.concat(F.lit("P"), "l_partkey").alias("obj"), F.when(F.col("l_returnflag") != "N", F.year("l_shipdate").cast("string")).alias("t"), F.round(0.72 - F.col("l_discount"), 2).alias("c"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in X.WEIGHTS.items() for x in kv])[F.col("pred")], F.lit(0.0))
    return rows.select("id", "pred", D.sortable_year(F.col("t")).alias("year"), weight.alias("weight"), X.sentence(F.col("pred"), F.col("id"), F.col("obj"), F.col("t"), F.col("c")).alias("line"))


@query(f"WITH {TOLD} SELECT id, pred, line FROM told")
def relation_sentences(spark, sf_dir):
    return _told(spark, sf_dir).select("id", "pred", "line")


@query(f"""WITH {TOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY id, t IS NULL ORDER BY CAST(t AS INTEGER), weight DESC, line) AS r FROM told)
SELECT id, coalesce(string_agg(line, ' ' ORDER BY r) FILTER (t IS NOT NULL AND r <= 10), string_agg(line, ' ' ORDER BY r) FILTER (t IS NULL AND r <= 5)) AS text FROM r GROUP BY id""")
def biographies(spark, sf_dir):
    return X.biographies(_told(spark, sf_dir))


@query(f"""WITH {ENT} SELECT type, CAST(row_number() OVER (PARTITION BY type ORDER BY canonical, id) AS INTEGER) AS nth, '- [' || canonical || '](' || trim(regexp_replace(lower(canonical), '[^a-z0-9]+', '-', 'g'), '-') || '.md)' AS line FROM entities""")
def index_pages(spark, sf_dir):
    return X.index_lines(B.entities(spark, sf_dir))


@query(f"""WITH {ENT}, {TRI}, d AS (SELECT key, count(*) AS n FROM (SELECT subj AS key FROM triples UNION ALL SELECT obj FROM triples) GROUP BY 1 ORDER BY n DESC, key LIMIT 10)
SELECT 'type' AS section, type AS key, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'predicate', pred, count(*) FROM triples GROUP BY 2 UNION ALL SELECT 'degree', key, n FROM d""")
def stats_page(spark, sf_dir):
    return X.statistics(B.triples(spark, sf_dir), B.entities(spark, sf_dir))


@query(f"""WITH {TRI}, d AS (SELECT subj, pred, obj, max(confidence) AS c FROM triples GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY subj, pred ORDER BY c DESC, obj) AS r FROM d)
SELECT subj, pred, count(*) AS n, string_agg(obj, ', ' ORDER BY r) FILTER (r <= 5) AS first FROM r GROUP BY 1, 2""")
def entity_digest(spark, sf_dir):
    return X.digest(B.triples(spark, sf_dir))


@query("SELECT o_custkey AS section, '    ' || strftime(o_orderdate, '%Y-%m-%d') || ' : order ' || o_orderkey || ' is ' || o_orderstatus AS line FROM orders")
def timeline_mermaid(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), F.col("o_orderdate").alias("at"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" is "), "o_orderstatus").alias("label"))
    return X.mermaid(rows)


@query("""WITH m AS (SELECT o_custkey, o_orderdate, CASE WHEN date_diff('day', lag(o_orderdate) OVER w, o_orderdate) <= 30 THEN 0 ELSE 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)),
c AS (SELECT o_custkey, o_orderdate, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS cluster FROM m) SELECT o_custkey, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM c GROUP BY 1, 2""")
def timeline_clusters(spark, sf_dir):
    return X.clusters(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")


@query(f"WITH {FACTS}, w AS (SELECT 'kind' AS what, kind AS key FROM ass UNION ALL SELECT 'modality', modality FROM ass UNION ALL SELECT 'pred', pred FROM ass) SELECT what, key, count(*) AS n FROM w GROUP BY 1, 2")
def ir_summary(spark, sf_dir):
    from .narrative import _asserted

    return X.summary(_asserted(spark, sf_dir))


@query(f"""WITH {ENT}, {TRI} SELECT coalesce(s.canonical, subj) AS subject, pred AS relation, coalesce(o.canonical, obj) AS object, CASE WHEN confidence >= 0.9 THEN 'certain' WHEN confidence >= 0.7 THEN 'likely' ELSE 'possible' END AS certainty, doc_id || ':' || sent AS source
FROM triples LEFT JOIN entities s ON s.id = subj LEFT JOIN entities o ON o.id = obj""")
def meaning_records(spark, sf_dir):
    return X.meaning(B.triples(spark, sf_dir), B.entities(spark, sf_dir))


@query(f"""WITH {ENT}, {TRI} SELECT '{{"kind":"entity","id":"' || id || '","type":"' || type || '","canonical":"' || canonical || '"}}' AS line FROM entities
UNION ALL SELECT '{{"kind":"relation","subj":"' || subj || '","pred":"' || pred || '","obj":"' || obj || '","confidence":' || confidence || '}}' FROM triples""")
def export_json(spark, sf_dir):
    return X.json_lines(B.triples(spark, sf_dir), B.entities(spark, sf_dir))


@query(f"""WITH {ENT}, {TRI} SELECT '{{"@id":"' || id || '","@type":"' || type || '","name":"' || canonical || '"}}' AS line FROM entities
UNION ALL SELECT '{{"@type":"Relation","subject":{{"@id":"' || subj || '"}},"predicate":"' || pred || '","object":{{"@id":"' || obj || '"}}}}' FROM triples""")
def export_jsonld(spark, sf_dir):
    return exports.json_ld(B.entities(spark, sf_dir)).unionByName(X.linked_data(B.triples(spark, sf_dir)))


@query(f"""WITH {ENT} SELECT 'S' || l_suppkey AS id, coalesce(s.canonical, 'S' || l_suppkey) AS subject, 'supplies' AS predicate, coalesce(p.canonical, 'P' || l_partkey) AS object, printf('%.3f', round(1 - l_tax, 2)) AS confidence, CAST(year(l_shipdate) AS VARCHAR) AS time, '' AS place,
  'line ' || l_linenumber || ' of ' || l_orderkey AS evidence FROM lineitem LEFT JOIN entities s ON s.id = 'S' || l_suppkey LEFT JOIN entities p ON p.id = 'P' || l_partkey""".replace("'S' || l_suppkey AS id, ", ""))
def export_csv_full(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.concat(F.lit("S"), "l_suppkey").alias("subj"), F.lit("supplies").alias("pred"), F.concat(F.lit("P"), "l_partkey").alias("obj"), F.round(1 - F.col("l_tax"), 2).alias("confidence"),
        F.array(F.struct(F.lit("time").alias("type"), F.year("l_shipdate").cast("string").alias("value"))).alias("qualifiers"),
        F.array(F.lit(" "), F.concat(F.lit("line  "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_orderkey").cast("string"))).alias("evidence"),
    )
    return X.csv_rows(rows, B.entities(spark, sf_dir))


# --- names and times ------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT p_name AS x FROM part), v AS (SELECT x, unnest(['The ' || x || ' family', x || '''s', '"' || x || '",', 'Dr. ' || x || ' Jr.', x || ' High School', x || ' ' || x, x || ' River', x || ' LLC']) AS name, unnest(generate_series(0, 7)) AS k FROM n)
SELECT name, CASE k WHEN 0 THEN x WHEN 1 THEN x WHEN 2 THEN x WHEN 3 THEN 'Dr. ' || x || ' Jr.' WHEN 7 THEN x || ' LLC' ELSE name END AS clean, CASE WHEN k = 3 THEN 'Jr.' END AS suffix, CASE WHEN k = 4 THEN lower(x) WHEN k = 3 THEN 'dr ' || lower(x) END AS school_root,
  CASE k WHEN 7 THEN 'ORG' WHEN 6 THEN 'LOC' WHEN 3 THEN 'ANY' WHEN 4 THEN 'ANY' WHEN 5 THEN 'ANY' ELSE 'ANY' END AS kind FROM v""")
def name_forms(spark, sf_dir):
    x = F.col("p_name")
    rows = table(spark, sf_dir, "part").select("p_name").distinct()
    forms = F.array(F.concat(F.lit("The "), x, F.lit(" family")), F.concat(x, F.lit("'s")), F.concat(F.lit('"'), x, F.lit('",')), F.concat(F.lit("Dr. "), x, F.lit(" Jr.")), F.concat(x, F.lit(" High School")), F.concat(x, F.lit(" "), x), F.concat(x, F.lit(" River")), F.concat(x, F.lit(" LLC")))
    each = rows.select(F.posexplode(forms).alias("k", "name"))
    name, school = F.col("name"), N.school_parts(F.col("name"))
    kind = F.when(N.guessed_type(name).isin("ORG", "LOC") & F.col("k").isin(6, 7), N.guessed_type(name)).otherwise("ANY")
    return each.select("name", N.entity_name(N.entity_name(name)).alias("clean"), N.suffix_parts(name)["suffix"].alias("suffix"), F.when(school["suffix"] != "", school["root"]).alias("school_root"), kind.alias("kind"))


@query("""SELECT c_mktsegment AS kind, CASE c_mktsegment WHEN 'BUILDING' THEN 'PLACE' WHEN 'MACHINERY' THEN 'ORG' ELSE c_mktsegment END AS api, count(*) AS n FROM customer GROUP BY 1, 2""")
def api_types(spark, sf_dir):
    kind = F.col("c_mktsegment")
    asked = F.when(kind == "BUILDING", " location ").when(kind == "MACHINERY", "Organisation").otherwise(kind)
    return table(spark, sf_dir, "customer").select(kind.alias("kind"), N.api_type(asked).alias("api")).groupBy("kind", "api").agg(F.count("*").alias("n"))


@query(f"WITH {ENT} SELECT CASE type WHEN 'PERSON' THEN 'PERSON' WHEN 'ORG' THEN 'ORG' WHEN 'PLACE' THEN 'PLACE' ELSE 'ITEM' END AS ir, count(*) AS n FROM entities GROUP BY 1")
def ir_types(spark, sf_dir):
    return B.entities(spark, sf_dir).groupBy(N.ir_type(F.when(F.col("type") == "ITEM", "ARTIFACT").otherwise(F.col("type"))).alias("ir")).agg(F.count("*").alias("n"))


@query(f"""WITH {STORY}, e AS (SELECT doc_id, y FROM story WHERE t IN (3, 5)) SELECT doc_id, 'year' AS family, 'year' AS precision, y AS expression, y || '-01-01' AS starts FROM e WHERE y >= '1994' AND y <= '1996-12-31'""")
def temporal_events(spark, sf_dir):
    found = S.temporal_events(B.stories(spark, sf_dir))
    return S.between(found, "1994-01-01", "1996-12-31")


# --- stores ---------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_mktsegment AS text, TIMESTAMP '1990-01-01' AS updated_at FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT CAST(o_custkey AS VARCHAR), arg_max('order ' || o_orderkey, (o_orderdate, 'order ' || o_orderkey, o_orderstatus)), arg_max(o_orderstatus, (o_orderdate, 'order ' || o_orderkey, o_orderstatus)), max(o_orderdate) FROM orders GROUP BY o_custkey""")
def document_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text"), F.lit("1990-01-01").cast("timestamp_ntz").alias("updated_at"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("text"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    return S.upserted(old, new)


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 10")
def queued_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), F.col("o_orderdate").alias("created_at"))
    return S.queued_jobs(rows).select("id", "created_at")


@query("SELECT CASE WHEN o_orderstatus <> 'O' THEN 'running' WHEN o_totalprice > 100000 THEN 'done' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'O' AND o_totalprice <= 100000 THEN 'too small' END AS error, count(*) AS n FROM orders GROUP BY 1, 2")
def job_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    jobs = orders.select(F.col("o_orderkey").alias("id"), F.lit("running").alias("status"))
    results = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 100000).alias("ok"), F.lit("too small").alias("message"))
    return S.worked(jobs, results).groupBy("status", "error").agg(F.count("*").alias("n"))


@query("SELECT title, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT CASE WHEN source IS NULL OR lang <> 'en' THEN 'Untitled' ELSE source END AS title, text FROM documents) GROUP BY 1")
def new_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", F.col("source")).alias("title"), "text", F.lit("2020-01-01").cast("timestamp").alias("updated_at"))
    return S.new_document(rows).groupBy("title").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def _contracts(spark, sf_dir):
    """A contract as JSON text for each conversation: its roles are the characters, its turns mentions and quotations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.substring("text", 1, 40).alias("text"), F.length("text").alias("n"))
    who = turns.groupBy("conv_id", "role").agg(F.count("*").cast("int").alias("n")).groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("id"), F.upper("role").alias("canonical_name"), F.col("n").alias("mention_count"))).alias("characters"))
    said = turns.groupBy("conv_id").agg(
        F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("character_id"), F.col("role").alias("text"), F.lit(0).alias("start_char"), F.col("n").cast("int").alias("end_char"), F.col("turn").cast("int").alias("sentence_idx"), F.lit("NOM").alias("mention_type"))).alias("mentions"),
        F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), "text", F.lit(0).alias("start_char"), F.col("n").cast("int").alias("end_char"), F.col("role").alias("speaker_id"))).alias("quotes"),
    )
    return who.join(said, "conv_id").select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("document_id"), "characters", "mentions", "quotes")).alias("json"))


@query("""WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) SELECT CAST(t.conv_id AS VARCHAR) AS doc_id, t.role AS character, upper(t.role) AS name, CAST(t.turn AS INTEGER) AS sent, CAST(length(text) AS INTEGER) AS end
FROM conversations t JOIN c ON c.conv_id = t.conv_id AND c.role = t.role WHERE n >= 2""".replace(" AS end", ' AS "end"'))
def contract_mentions(spark, sf_dir):
    return S.contract_mentions(S.contract(_contracts(spark, sf_dir)), 2).select("doc_id", "character", "name", "sent", "end")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, role AS speaker, count(*) AS n, CAST(sum(length(left(text, 40))) AS BIGINT) AS n_chars FROM conversations GROUP BY 1, 2")
def contract_quotes(spark, sf_dir):
    rows = S.contract_quotes(S.contract(_contracts(spark, sf_dir)))
    return rows.groupBy("doc_id", "speaker").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# --- stream ---------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT user_id AS doc_id, event_type AS name, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS sent, sum(CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM events GROUP BY 1, 2, 3),
l AS (SELECT doc_id, name, list({'t': sent, 's': w} ORDER BY sent) AS l FROM d GROUP BY 1, 2),
r AS (SELECT doc_id, name, list_reduce(l, lambda a, x: {'t': x.t, 's': x.s + CASE WHEN a.s * power(0.8, x.t - a.t) < 0.3 THEN 0.0 ELSE a.s * power(0.8, x.t - a.t) END}) AS r FROM l)
SELECT doc_id, name, r.t AS sent, round(r.s, 6) AS salience FROM r""")
def stream_salience(spark, sf_dir):
    return J.run_salience(spark, f"{sf_dir}/events.parquet")
