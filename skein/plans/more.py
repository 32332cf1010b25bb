"""Further registered queries: references, review, validation, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec
from ..functions import text as T
from ..operators import mentions as M
from ..operators import relations as R
from ..operators import review as V
from ..sources import tables as B
from ..sources.tables import table
from .catalogue import BLOCKED, ENT, SPANS, TRI, query

LEB = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 ELSE 4 END"


@query(f"""WITH {SPANS} SELECT doc_id, ord, true AS same, {LEB.format('doc_id')} + {LEB.format('ord')} + {LEB.format('start')} + {LEB.format('("end" - start)')} AS n_bytes FROM spans""")
def reference_codec(spark, sf_dir):
    spans = M.mention_spans(table(spark, sf_dir, "documents")).withColumn("size", F.col("end") - F.col("start"))
    coded = spans.withColumn("word", codec.encode_reference(F.struct("doc_id", "ord", "start", "size")))
    back = coded.withColumn("v", codec.decode_reference("word"))
    same = (F.col("v")[0] == F.col("doc_id")) & (F.col("v")[1] == F.col("ord")) & (F.col("v")[2] == F.col("start")) & (F.col("v")[3] == F.col("size"))
    size = lambda c: F.when(F.col(c) < 128, 1).when(F.col(c) < 16384, 2).when(F.col(c) < 2097152, 3).otherwise(4)
    return back.select("doc_id", "ord", same.alias("same"), (size("doc_id") + size("ord") + size("start") + size("size")).alias("n_bytes"))


@query(rf"""WITH {SPANS}, hp AS (SELECT doc_id, regexp_extract_all(text, '(\bhe\b)', 1) AS m, string_split_regex(text, '(\bhe\b)') AS g FROM documents),
he AS (SELECT doc_id, sum(length(g[i]) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 AS start FROM hp, LATERAL (SELECT unnest(generate_series(1, len(m))) AS i)),
n AS (SELECT doc_id, start, surface FROM spans WHERE lower(surface) NOT IN ({BLOCKED}))
SELECT he.doc_id, CAST(he.start AS INTEGER) AS start, CASE WHEN he.start - n.start <= 500 THEN n.surface END AS antecedent FROM he ASOF LEFT JOIN n ON he.doc_id = n.doc_id AND he.start > n.start""")
def resolve_pronouns(spark, sf_dir):
    return M.resolve_pronouns(table(spark, sf_dir, "documents"))


@query(f"""WITH {TRI}, items AS (SELECT 'N' || s_nationkey AS subj, CASE WHEN s_suppkey % 2 = 0 THEN 'ally_of' ELSE 'part_of' END AS pred, CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE 'R' END || (s_suppkey % 5) AS obj,
  round(s_acctbal / 10000, 4) AS confidence, CASE WHEN s_acctbal > 4000 THEN 'approved' ELSE 'pending' END AS status FROM supplier),
w AS (SELECT subj, pred, obj, confidence FROM items WHERE status = 'approved' UNION ALL SELECT obj, pred, subj, confidence FROM items WHERE status = 'approved' AND pred = 'ally_of')
SELECT subj, pred, obj, max(confidence) AS confidence FROM w WHERE NOT EXISTS (SELECT 1 FROM triples t WHERE t.subj = w.subj AND t.pred = w.pred AND t.obj = w.obj) GROUP BY 1, 2, 3""")
def review_approve(spark, sf_dir):
    even = F.col("s_suppkey") % 2 == 0
    items = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("N"), "s_nationkey").alias("subj"), F.when(even, "ally_of").otherwise("part_of").alias("pred"), F.concat(F.when(even, "N").otherwise("R"), F.col("s_suppkey") % 5).alias("obj"),
        F.round(F.col("s_acctbal") / 10000, 4).alias("confidence"), F.when(F.col("s_acctbal") > 4000, "approved").otherwise("pending").alias("status"),
    )
    return V.approve(items, B.triples(spark, sf_dir), ["ally_of"])


@query("""WITH u AS (SELECT o_custkey AS c_custkey, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS c_mktsegment, CASE WHEN o_totalprice > 300000 THEN 'VIP' END AS c_name FROM orders),
l AS (SELECT c_custkey, arg_max(c_mktsegment, seq) FILTER (c_mktsegment IS NOT NULL) AS m, arg_max(c_name, seq) FILTER (c_name IS NOT NULL) AS n FROM u GROUP BY 1)
SELECT c.c_custkey, coalesce(n, c_name) AS c_name, coalesce(m, c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN l USING (c_custkey)""")
def job_patch(spark, sf_dir):
    updates = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("c_mktsegment"), F.when(F.col("o_totalprice") > 300000, "VIP").alias("c_name")
    )
    return V.patched(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), updates, "c_custkey", "seq", ["c_name", "c_mktsegment"])


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'F') AS n_F FROM orders GROUP BY 1""")
def status_counts(spark, sf_dir):
    return V.status_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["O", "F"])


@query("""WITH a AS (SELECT lower(p_name) AS name, p_size AS size FROM part), b AS (SELECT lower(p_name) AS name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part)
SELECT name, size, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT name, size, 'unexpected' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def record_differences(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a = part.select(F.lower("p_name").alias("name"), F.col("p_size").alias("size"))
    return V.differences(a, part.select(F.lower("p_name").alias("name"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size")))


@query(f"""WITH {ENT}, {TRI}, t AS (SELECT t.pred, s.type AS s, o.type AS o, confidence FROM triples t LEFT JOIN entities s ON s.id = subj AND s.type <> 'ITEM' LEFT JOIN entities o ON o.id = obj AND o.type <> 'ITEM')
SELECT pred, rule, count(*) AS n FROM (SELECT pred, unnest(list_filter([CASE WHEN s IS NULL OR o IS NULL THEN 'orphan' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'bad_confidence' END,
  CASE WHEN pred = 'located_in' AND (s <> 'PERSON' OR o <> 'PLACE') THEN 'type_mismatch' END], lambda x: x IS NOT NULL)) AS rule FROM t) GROUP BY 1, 2""")
def graph_violations(spark, sf_dir):
    return V.violations(B.triples(spark, sf_dir), B.entities(spark, sf_dir).where("type <> 'ITEM'"), {"located_in": ("PERSON", "PLACE")})


@query(f"""WITH {ENT} SELECT lower(canonical) AS key, count(*) AS n, count(DISTINCT type) AS n_types, min(id) AS first_id FROM entities GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, key LIMIT 20""")
def identity_report(spark, sf_dir):
    return V.identity_report(B.entities(spark, sf_dir), F.lower("canonical"))


@query("""WITH h AS (SELECT doc_id, text AS t, instr(lower(text), 'that') AS p, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN p > 31 THEN '...' ELSE '' END || substr(t, greatest(p - 30, 1), least(p + 53, n) - greatest(p - 30, 1) + 1) || CASE WHEN p + 53 < n THEN '...' ELSE '' END
  ELSE substr(t, 1, 100) || CASE WHEN n > 100 THEN '...' ELSE '' END END AS snippet FROM h""")
def search_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("that")).alias("snippet"))


@query("""SELECT o_custkey AS subject, string_agg('- ' || strftime(o_orderdate, '%Y-%m-%d') || ': order ' || o_orderkey, chr(10) ORDER BY o_orderdate, o_orderkey) AS page FROM orders GROUP BY 1""")
def timeline_markdown(spark, sf_dir):
    line = F.concat(F.lit("- "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": order "), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", line.alias("line")))).alias("l"))
    return rows.select("subject", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("page"))


@query(f"""WITH {TRI}, e AS (SELECT subj AS id, count(*) AS r, count(DISTINCT obj) AS e FROM triples GROUP BY 1)
SELECT id, e AS entities, r AS relations, 10 * e + 5 * r AS xp, CAST(greatest(1, floor(sqrt(e / 5 + r / 10))) AS BIGINT) AS level FROM e""")
def progress_levels(spark, sf_dir):
    rows = B.triples(spark, sf_dir).groupBy(F.col("subj").alias("id")).agg(F.countDistinct("obj").alias("entities"), F.count("*").alias("relations"))
    return rows.select("id", "entities", "relations", (F.col("entities") * 10 + F.col("relations") * 5).alias("xp"), F.greatest(F.lit(1).cast("long"), F.floor(F.sqrt(F.col("entities") / 5 + F.col("relations") / 10))).alias("level"))


@query(f"""WITH {TRI}, d AS (SELECT subj, pred, obj, max(confidence) AS c FROM triples GROUP BY 1, 2, 3)
SELECT subj || ' ' || replace(pred, '_', ' ') || ' ' || obj || CASE WHEN c < 0.95 THEN ' (likely).' ELSE '.' END AS sentence FROM d""")
def render_relations(spark, sf_dir):
    rows = B.triples(spark, sf_dir).groupBy("subj", "pred", "obj").agg(F.max("confidence").alias("c"))
    return rows.select(F.concat("subj", F.lit(" "), F.replace("pred", F.lit("_"), F.lit(" ")), F.lit(" "), "obj", F.when(F.col("c") < 0.95, " (likely).").otherwise(".")).alias("sentence"))


def inverse_pairs() -> dict[str, str]:
    """Inverse predicates, for callers that orient edges before they look for cycles."""
    return dict(R.INVERSES)
