"""One query for each operator, over the whole of its table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontaminate, language_id, packing, pii, prefix_trie, quality, runs, simhash, token_counts, toxicity, url_filter, vector_search
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", "offsets")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.train(pages))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predicted(docs, language_id.train(docs))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"))


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return context_tree.scored(docs, context_tree.train(docs))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_simhash, op3_toxicity, op4_pii, op5_best_fit_packing,
        op6_quality, op7_url_filter, op8_exact_top_k, op9_language_id, op10_token_counts,
        op11_periodic_runs, op12_context_tree, op13_prefix_trie,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of a string of ASCII characters, bit by bit; the constant is its polynomial.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(substr({0}, i, 1))::BIGINT FOR i IN range(1, length({0}) + 1)]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE_SQL = {
    "op11_periodic_runs": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  coalesce({_CRC32.format("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents),
m AS (SELECT r, doc_id, w, h % 10 = 0 AND len(w) > 0 AS m, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS z FROM t),
d AS (SELECT r, doc_id, len(w) AS n, CASE WHEN m THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + z)) END] FOR i IN range(len(w))] ELSE w END AS w FROM m),
g AS (SELECT r, n, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT r, n, w, unnest(range(n - 4)) AS i FROM d WHERE n >= 6)),
q AS (SELECT x.r, y.i - x.i AS q, x.i FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS o FROM q) GROUP BY r, q, o),
k AS (SELECT * FROM s WHERE l >= greatest(6, 4 * q)),
u AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.r = k.r AND o.q < k.q AND o.s <= k.s AND o.s + o.l >= k.s + k.l)),
b AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
             first(s ORDER BY l DESC, s, q) AS s, first(l ORDER BY l DESC, s, q) AS l, first(q ORDER BY l DESC, s, q) AS q FROM u GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM u),
kept AS (SELECT p.r, string_agg(p.x, ' ' ORDER BY p.i) AS x FROM (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM d SEMI JOIN b USING (r)) p ANTI JOIN gone USING (r, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(CASE WHEN b.r IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(kept.x, '') END) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN kept USING (r)""",
    "op13_prefix_trie": rf"""
WITH t AS (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, sha256(k)) AS own, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t GROUP BY conv_id),
c AS (SELECT o.conv_id, list_concat(coalesce(b.own, [])[1 : o.h], o.own[o.h + 1 : ]) AS s FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
p AS (SELECT conv_id, len(s) AS l, d, s[1 : d] AS p FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM c)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(p[-1].n, 0) AS own, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE l = d), '') AS ends FROM p GROUP BY p, d),
k AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p),
up AS (SELECT p[1 : a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN up ON up.p = f.p LEFT JOIN n q ON f.d > 0 AND q.p = f.p[1 : f.d - 1] AND q.d = f.d - 1""",
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
pat AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, list_slice(w, i, i + least(13, len(w)) - 1) AS win
        FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 12))) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM pat),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win
       FROM (SELECT d.doc_id, d.w, ks.k, unnest(generate_series(1, len(d.w) - ks.k + 1)) AS i FROM d, ks WHERE len(d.w) >= ks.k)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, pat.item_id FROM dw JOIN pat ON dw.k = pat.k AND dw.win = pat.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id""",
    "op8_exact_top_k": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
