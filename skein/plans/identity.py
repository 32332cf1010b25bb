"""Registered queries on who is who: persons of one name, clusters under constraints, names in pieces, texts rewritten, a search
index, the digest of the whole graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digest as D
from ..operators import homonyms as H
from ..operators import linking as L
from ..operators import stitching as S
from ..operators.mentions import mention_spans
from ..operators.resolution import without_siblings_as_parents
from ..operators.spans import first_interval
from ..sources import postings as I
from ..sources import tables as B
from ..sources.lineage import shared_path
from ..streaming.jobs import run_debounce
from .catalogue import ENT, TRI, query
from .language import PARTS

# --- persons of one name --------------------------------------------------------------------------------------------

#: What the words of each sentence of B.NAMESAKES say: occupations, relations, ages.
_SAY = "(0, [], [], []), (1, ['wizard'], [], []), (2, ['farmer'], [], []), (3, ['farmer'], ['father'], []), (4, ['wizard'], [], ['young']), (5, [], ['son'], []), (6, ['judge'], [], ['retired']), (7, [], [], ['died']), (8, [], [], [])"
_CLASH = """((len(a.o) > 0 AND len(b.o) > 0 AND NOT list_has_any(a.o, b.o)) OR (list_contains(a.r, 'father') AND list_contains(b.r, 'son')) OR (list_contains(a.r, 'son') AND list_contains(b.r, 'father'))
  OR (list_contains(a.g, 'retired') AND list_contains(b.g, 'young')) OR (list_contains(a.g, 'young') AND list_contains(b.g, 'retired')) OR list_contains(a.g, 'died') <> list_contains(b.g, 'died'))"""
_fits = lambda a, b: f"NOT {_CLASH.replace('a.', a + '.').replace('b.', b + '.')}"
PERSONS = f"""say(t, o, r, g) AS (SELECT t, CAST(o AS VARCHAR[]), CAST(r AS VARCHAR[]), CAST(g AS VARCHAR[]) FROM (VALUES {_SAY}) AS v(t, o, r, g)),
src AS (SELECT o_orderkey AS doc_id, 'Cu' || translate(CAST(o_custkey % 97 AS VARCHAR), '0123456789', 'abcdefghij') AS name, CASE WHEN o_custkey % 97 % 3 = 0 THEN o_orderkey % 2 ELSE (o_custkey + o_orderkey % 3) % 9 END AS t
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer)),
men AS MATERIALIZED (SELECT doc_id, name, {{'o': o, 'r': r, 'g': g}} AS c FROM src JOIN say USING (t)),
seen AS (SELECT name, c, count(*) AS n, min(doc_id) AS at_ FROM men GROUP BY 1, 2), rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY name ORDER BY at_) AS k FROM seen),
mix AS (SELECT name, sum(n) >= 3 AND ((bool_or(list_contains(c.r, 'father')) AND bool_or(list_contains(c.r, 'son'))) OR len(list_distinct(flatten(list(c.o)))) > 1
  OR (bool_or(list_has_any(c.g, ['died', 'retired'])) AND bool_or(list_contains(c.g, 'young')))) AS mixed FROM rk GROUP BY 1),
f AS (SELECT name, k, [c] AS acc FROM rk WHERE k = 1
  UNION ALL SELECT f.name, rk.k, CASE WHEN len(list_filter(acc, lambda y: {_fits("y", "rk.c")})) > 0 THEN acc ELSE list_append(acc, rk.c) END FROM f JOIN rk ON rk.name = f.name AND rk.k = f.k + 1),
reps AS (SELECT name, arg_max(acc, k) AS acc FROM f GROUP BY 1),
who AS MATERIALIZED (SELECT rk.name, rk.c, rk.n, rk.at_, CASE WHEN mixed THEN CAST(list_position(list_transform(acc, lambda y: {_fits("y", "rk.c")}), true) - 1 AS INTEGER) ELSE 0 END AS person FROM rk JOIN reps USING (name) JOIN mix USING (name))"""


def _mentions(spark, sf_dir):
    rows = B.namesakes(spark, sf_dir)
    return rows.select("doc_id", "name", F.col("doc_id").alias("at"), H.context_of(F.col("text")).alias("context"))


@query(f"WITH RECURSIVE {PERSONS} SELECT doc_id, name, person FROM men JOIN who USING (name, c)")
def homonym_split(spark, sf_dir):
    return H.split(_mentions(spark, sf_dir)).select("doc_id", "name", "person")


@query(f"""WITH RECURSIVE {PERSONS}, d AS (SELECT name, person, coalesce(min(c.o[1]), min(c.r[1]), min(c.g[1])) AS by_, CAST(sum(n) AS BIGINT) AS n, min(at_) AS first FROM who GROUP BY 1, 2)
SELECT name, person, name || CASE WHEN by_ IS NOT NULL AND max(person) OVER (PARTITION BY name) > 0 THEN ' (' || by_ || ')' ELSE '' END AS label, n, first FROM d""")
def homonym_people(spark, sf_dir):
    return H.described(H.persons(_mentions(spark, sf_dir)))


# --- clusters under constraints -------------------------------------------------------------------------------------

_CLASS = "concat_ws(chr(31), '~', {0}, coalesce({1}, ''), coalesce({2}, ''))".format
CLUES = f"""raw AS (SELECT 'C' || c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ORG' ELSE 'PERSON' END AS t0, CASE c_mktsegment WHEN 'BUILDING' THEN 'dr' WHEN 'MACHINERY' THEN 'lady' END AS title, c_custkey AS k FROM customer),
own AS (SELECT id, CASE WHEN title IS NULL THEN t0 ELSE 'PERSON' END AS type, title, k, coalesce(n, 0) AS weight FROM raw LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) USING (k)),
keys AS (SELECT id, 'a' || k // 4 AS key FROM own UNION SELECT id, 'b' || k // 12 FROM own WHERE k % 4 = 0), tied AS (SELECT * FROM keys JOIN own USING (id)),
lv AS (SELECT key, type, title FROM tied UNION SELECT key, type, NULL FROM tied UNION SELECT key, NULL, NULL FROM tied),
s0 AS (SELECT id AS root, type, title, weight FROM own UNION ALL SELECT {_CLASS("key", "type", "title")}, type, title, 0 FROM lv), g0 AS (SELECT root AS id, root FROM s0),
one AS (SELECT id AS a, {_CLASS("key", "type", "title")} AS b FROM tied UNION ALL SELECT {_CLASS("key", "type", "title")}, CASE WHEN title IS NULL THEN {_CLASS("key", "NULL", "NULL")} ELSE {_CLASS("key", "type", "NULL")} END FROM lv WHERE type IS NOT NULL),
lk AS MATERIALIZED (SELECT a, b FROM one UNION ALL SELECT b, a FROM one)"""


def _phase(i: int) -> str:
    """One contraction: of clusters that are alike (i even), or of each with the best that says more."""
    pick = f"SELECT a, b FROM e{i} WHERE la = lb" if i % 2 == 0 else f"SELECT a, first(b ORDER BY wb DESC, b) AS b FROM e{i} WHERE la < lb GROUP BY a"
    says = lambda x: f"(CASE WHEN {x}.type IS NULL THEN 0 ELSE 1 END + CASE WHEN {x}.title IS NULL THEN 0 ELSE 1 END)"
    return f"""e{i} AS MATERIALIZED (SELECT DISTINCT x.root AS a, y.root AS b, {says("x")} AS la, {says("y")} AS lb, y.weight AS wb FROM lk JOIN g{i} p ON lk.a = p.id JOIN g{i} q ON lk.b = q.id
  JOIN s{i} x ON x.root = p.root JOIN s{i} y ON y.root = q.root WHERE x.root <> y.root AND coalesce(x.type = y.type, true) AND coalesce(x.title = y.title, true)),
k{i} AS MATERIALIZED ({pick}), d{i} AS MATERIALIZED (SELECT a, b FROM k{i} UNION SELECT b, a FROM k{i}), u{i} AS (SELECT root AS id, root AS r FROM s{i} UNION SELECT u{i}.id, d{i}.b FROM u{i} JOIN d{i} ON u{i}.r = d{i}.a),
m{i} AS MATERIALIZED (SELECT id AS root, min(r) AS new FROM u{i} GROUP BY 1), g{i + 1} AS MATERIALIZED (SELECT g.id, m.new AS root FROM g{i} g JOIN m{i} m USING (root)),
s{i + 1} AS MATERIALIZED (SELECT new AS root, max(type) AS type, max(title) AS title, sum(weight) AS weight FROM s{i} JOIN m{i} USING (root) GROUP BY 1)"""


@query(f"WITH RECURSIVE {CLUES}, {', '.join(_phase(i) for i in range(6))} SELECT g6.id, g6.root, s6.type, s6.title FROM g6 JOIN s6 USING (root) WHERE g6.id NOT LIKE '~%'")
def constrained_clusters(spark, sf_dir):
    k = F.col("c_custkey")
    rows = B.table(spark, sf_dir, "customer").join(B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("weight")), "c_custkey", "left")
    kind = F.when(F.col("c_nationkey") % 4 == 1, "ORG").when(F.col("c_nationkey") % 4 > 1, "PERSON")
    title = F.when(F.col("c_mktsegment") == "BUILDING", "dr").when(F.col("c_mktsegment") == "MACHINERY", "lady")
    nodes = rows.select(F.concat(F.lit("C"), k).alias("id"), kind.alias("type"), title.alias("title"), F.coalesce("weight", F.lit(0)).alias("weight"), k.alias("k"))
    keys = nodes.select("id", F.explode(F.array(F.concat(F.lit("a"), F.expr("k div 4")), F.when(F.col("k") % 4 == 0, F.concat(F.lit("b"), F.expr("k div 12"))))).alias("key"))
    return L.united(*L.key_links(nodes.drop("k"), keys)).where("id not like '~%'")


# --- names in pieces, texts rewritten -------------------------------------------------------------------------------

_TYPES = {"Cu": "PERSON", "Qo": "PERSON", "Su": "ORG", "Pa": "ITEM", "Na": "PLACE", "Re": "TRIBE", "Mo": "HOUSE"}
PIECES = f"""{PARTS}, tx AS (SELECT *, doc_id % 4 AS t, CASE doc_id % 4 WHEN 0 THEN c || ' of ' || n || ' met ' || s || ' and ' || q || '. They lived there.'
  WHEN 1 THEN 'There ' || c || ' and ' || q || ' left ' || n || ' ' || p || '. ' || m || ' stayed there, there alone.' WHEN 2 THEN c || ' de ' || q || ' of ' || n || ' saw ' || s || '.' ELSE p || ' of ' || r || ' and ' || m || ' fell.' END AS text FROM cast_),
th AS (SELECT doc_id, n, text, CAST(unnest(CASE t WHEN 0 THEN [length(text) - 6] WHEN 1 THEN [strpos(text, 'stayed there') + 6, strpos(text, ', there') + 1] ELSE [] END) AS INTEGER) AS start FROM tx),
ed AS (SELECT doc_id, start, start + 5 AS "end", start + CAST((row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1) * (length(n) - 2) AS INTEGER) AS new_start, CAST(length(n) + 3 AS INTEGER) AS size FROM th)"""


@query(f"""WITH {PIECES}, x AS (SELECT doc_id, text AS full_, unnest(CASE t WHEN 0 THEN [{{'s': c || ' of ' || n, 'k': 'PERSON', 'n': 2}}, {{'s': s || ' and ' || q, 'k': 'PERSON', 'n': 2}}]
  WHEN 1 THEN [{{'s': c, 'k': 'PERSON', 'n': 1}}, {{'s': q, 'k': 'PERSON', 'n': 1}}, {{'s': n || ' ' || p, 'k': 'PLACE', 'n': 2}}, {{'s': m, 'k': 'HOUSE', 'n': 1}}]
  WHEN 2 THEN [{{'s': c || ' de ' || q || ' of ' || n, 'k': 'PERSON', 'n': 3}}, {{'s': s, 'k': 'ORG', 'n': 1}}] ELSE [{{'s': p || ' of ' || r || ' and ' || m, 'k': 'ITEM', 'n': 3}}] END) AS z FROM tx)
SELECT doc_id, CAST(strpos(full_, z.s) - 1 AS INTEGER) AS start, CAST(strpos(full_, z.s) - 1 + length(z.s) AS INTEGER) AS "end", z.s AS text, z.k AS type, CAST(z.n AS BIGINT) AS n FROM x""")
def stitched_spans(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    spans = mention_spans(B.pieces(spark, sf_dir), rf"(\b(?:{'|'.join(_TYPES)})[a-z]+)", gaps=True)
    return S.stitched(spans.withColumn("type", kind[F.substring("surface", 1, 2)]))


def _edits(docs):
    places = mention_spans(docs, r"(\bNa[a-z]+)").select("doc_id", "start", F.col("surface").alias("name"))
    return S.deictic_edits(docs, places)


@query(f"WITH {PIECES} SELECT doc_id, CASE t WHEN 0 THEN replace(text, ' there', ' in ' || n) WHEN 1 THEN replace(text, ' there', ' in ' || n) ELSE text END AS text FROM tx")
def deictic_rewritten(spark, sf_dir):
    docs = B.pieces(spark, sf_dir)
    return S.rewritten(docs, _edits(docs))


@query(f"""WITH {PIECES}, pt AS (SELECT doc_id, unnest(range(0, 70, 7)) AS at_ FROM tx),
j AS (SELECT pt.doc_id, CAST(at_ AS INTEGER) AS at_, arg_max({{'a': start, 'e': "end", 'na': new_start, 'ne': new_start + size}}, new_start) FILTER (new_start <= at_) AS x FROM pt LEFT JOIN ed ON ed.doc_id = pt.doc_id GROUP BY 1, 2)
SELECT doc_id, at_ AS place, CASE WHEN x IS NULL THEN at_ WHEN at_ < x.ne THEN x.a ELSE at_ - x.ne + x.e END AS old FROM j""")
def deictic_offsets(spark, sf_dir):
    docs = B.pieces(spark, sf_dir)
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(69), F.lit(7))).alias("at"))
    return S.to_old(points, S.placed(_edits(docs))).select("doc_id", F.col("at").alias("place"), "old")


@query(f"""WITH {PARTS}, e AS (SELECT doc_id, doc_id % 4 AS t, c, s, unnest([{{'subj': c, 'pred': 'parent_of', 'obj': s}}, {{'subj': q, 'pred': 'child_of', 'obj': s}}, {{'subj': m, 'pred': 'child_of', 'obj': c}}, {{'subj': s, 'pred': 'sibling_of', 'obj': c}}]) AS z FROM cast_)
SELECT doc_id, z.subj AS subj, z.pred AS pred, z.obj AS obj FROM e WHERE z.pred = 'sibling_of' OR CASE z.pred WHEN 'parent_of' THEN z.subj ELSE z.obj END <> CASE t WHEN 1 THEN s WHEN 2 THEN '' ELSE c END""")
def suppress_sibling_parents(spark, sf_dir):
    docs, relations = B.families(spark, sf_dir)
    return without_siblings_as_parents(relations, docs)


# --- windows by priority --------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT o_custkey AS cust, o_orderkey AS id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS start, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 60 AS end_ FROM orders),
pt AS (SELECT o_custkey AS cust, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS day, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
m AS (SELECT pt.cust, day, n, id, day >= start AND day < end_ AS inside, row_number() OVER (PARTITION BY pt.cust, day ORDER BY NOT (day >= start AND day < end_), start, end_, id) AS r FROM pt JOIN d ON pt.cust = d.cust AND day >= start - 10 AND day < end_ + 10)
SELECT cust, CAST(day AS INTEGER) AS day, n, id, inside FROM m WHERE r = 1""")
def shipment_windows(spark, sf_dir):
    day = lambda c: F.datediff(c, F.lit("1992-01-01").cast("date"))
    orders = B.table(spark, sf_dir, "orders")
    start = day("o_orderdate")
    windows = orders.select(F.col("o_custkey").alias("cust"), start.alias("start"), (start + F.col("o_orderkey") % 60).alias("end"), F.col("o_orderkey").alias("id"))
    lines = B.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    points = lines.groupBy(F.col("o_custkey").alias("cust"), day("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    return first_interval(points, windows, ["cust"], "day", 10, 60).select("cust", "day", "n", "id", "inside")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(make_timestamp(min(t)), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(make_timestamp(max(t)), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n FROM b GROUP BY user_id, k HAVING max(t) + 21600000000 <= (SELECT max(t) FROM e) - 3600000000""")
def event_bursts(spark, sf_dir):
    found = run_debounce(spark, f"{sf_dir}/events.parquet", ["user_id"], "6 hours", "1 hour")
    return found.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("first", "last")], "n")


# --- search index ---------------------------------------------------------------------------------------------------

#: Documents of quality 1 are changed after the index is built, toxic ones deleted.
INDEXED = """now AS (SELECT doc_id, CASE WHEN quality = 1 THEN text || ' der der thtion' ELSE text END AS text, source FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1),
w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '([a-z]+)', 1), []) AS a, coalesce(regexp_extract_all(lower(source), '([a-z]+)', 1), []) AS b FROM now),
sc AS (SELECT doc_id, len(list_filter(a, lambda x: x IN ('thtion', 'der', 'src'))) AS i, len(list_filter(b, lambda x: x IN ('thtion', 'der', 'src'))) AS j, greatest(len(a), 1) AS n, greatest(len(b), 1) AS m FROM w)"""


@query(f"WITH {INDEXED} SELECT doc_id AS id, round(i / sqrt(n) + 5 * j / sqrt(m), 6) AS score FROM sc WHERE i + j > 0 ORDER BY score DESC, id LIMIT 20")
def index_search(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    marks = B.table(spark, sf_dir, "labels").where("quality = 1 or toxic = 1").select(F.col("doc_id").alias("id"), "toxic")
    path, boosts = shared_path(spark), {"text": 1.0, "source": 5.0}
    I.build(docs, path, boosts)
    gone = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    I.merge(docs.join(marks, "id").select("id", F.when(~gone, F.concat("text", F.lit(" der der thtion"))).alias("text"), F.when(~gone, F.col("source")).alias("source")), path, boosts)
    return I.search(spark, path, "Der thtion src", 20)


# --- digest ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {ENT}, {TRI}, ln AS (SELECT 'entity' AS kind, '{{"aliases":[],"canonical":"' || canonical || '","type":"' || type || '"}}' AS line FROM entities
  UNION ALL SELECT 'relation', '{{"confidence":' || CAST(CAST(confidence AS DOUBLE) AS VARCHAR) || ',"extractor":' || coalesce('"' || extractor || '"', 'null') || ',"obj":"' || coalesce(o.canonical, obj) || '","pred":"' || pred || '","qualifiers":[],"subj":"' || coalesce(s.canonical, subj) || '"}}'
  FROM triples LEFT JOIN entities s ON s.id = subj LEFT JOIN entities o ON o.id = obj),
e AS (SELECT kind, sha256(line) AS h, count(*) AS n FROM ln GROUP BY 1, 2), p AS (SELECT kind, h[1:4] AS b, sum(n) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS p FROM e GROUP BY 1, 2)
SELECT kind, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(b || p, ',' ORDER BY b || p)) AS hash FROM p GROUP BY 1""")
def graph_digest(spark, sf_dir):
    entities = B.entities(spark, sf_dir).withColumn("aliases", F.lit(None).cast("array<string>"))
    relations = B.triples(spark, sf_dir).withColumn("qualifiers", F.lit(None).cast("array<struct<type: string, value: string>>"))
    return D.digest(D.canonical_lines(entities, relations))
