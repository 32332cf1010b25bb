"""Registered queries over ordinary sentences: clauses, pronouns, aliases.

Texts are put together from parts that the tables choose, so the SQL states from the parts alone what must be found.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aliases as A
from ..operators import coreference as C
from ..operators import dependency as D
from ..operators import grammar as G
from ..sources import tables as B
from .catalogue import query

_LETTERS = "'0123456789', 'abcdefghij'"
_NAME = lambda letter, key: f"'{letter}' || translate(CAST({key} AS VARCHAR), {_LETTERS})"
PARTS = f"""cast_ AS (SELECT o_orderkey AS doc_id, {_NAME("Cu", "o_custkey")} AS c, {_NAME("Su", "s")} AS s, {_NAME("Pa", "p")} AS p, {_NAME("Na", "c_nationkey")} AS n, {_NAME("Qo", "o_orderkey % 97")} AS q,
  {_NAME("Mo", "o_orderkey % 31")} AS m, {_NAME("Re", "o_orderkey % 53")} AS r, o_orderkey % 7 AS a, o_orderkey // 7 % 7 AS b, o_orderkey // 49 % 4 AS e
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


@query(f"""WITH {PARTS}, who AS (SELECT *, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT *, CASE a WHEN 1 THEN [c, s] WHEN 2 THEN [c, s, q] ELSE [c] END AS l FROM cast_)),
pr AS (SELECT doc_id, x, k, p AS patient, b, unnest(list_concat(CASE b WHEN 0 THEN [{{'v': 'visit', 'o': p, 'u': 'svo', 'neg': false, 'i': false}}] WHEN 1 THEN [{{'v': 'visit', 'o': p, 'u': 'svo', 'neg': true, 'i': false}}]
    WHEN 2 THEN [{{'v': 'kill', 'o': p, 'u': 'passive', 'neg': false, 'i': false}}] WHEN 3 THEN [{{'v': 'visit', 'o': p, 'u': 'svo', 'neg': false, 'i': false}}, {{'v': 'marry', 'o': m, 'u': 'svo', 'neg': false, 'i': true}}]
    WHEN 4 THEN [{{'v': 'travel_to', 'o': p, 'u': 'prep', 'neg': false, 'i': false}}] WHEN 5 THEN [{{'v': 'give', 'o': p, 'u': 'svo', 'neg': false, 'i': false}}, {{'v': 'give_to', 'o': m, 'u': 'prep', 'neg': false, 'i': false}}]
    ELSE [{{'v': 'meet', 'o': p, 'u': 'svo', 'neg': false, 'i': false}}, {{'v': 'meet', 'o': m, 'u': 'svo', 'neg': false, 'i': false}}] END,
    CASE WHEN e = 3 THEN [{{'v': ['visit', 'visit', 'kill', 'marry', 'travel', 'give', 'meet'][b + 1] || '_near', 'o': r, 'u': 'prep', 'neg': b = 1, 'i': b = 3}}] ELSE [] END)) AS z FROM who),
w AS (SELECT doc_id, CASE z.u WHEN 'passive' THEN z.o ELSE x END AS subj, z.v AS pred, CASE z.u WHEN 'passive' THEN x ELSE z.o END AS obj, z.u AS rule, z.neg AS negated, (z.u <> 'passive' AND k > 1) OR z.i AS less FROM pr
  UNION ALL SELECT doc_id, c, 'rule', n, 'svo', false, false FROM cast_ WHERE a = 3 UNION ALL SELECT doc_id, c, 'child_of', s, 'role', false, false FROM cast_ WHERE a = 4
  UNION ALL SELECT doc_id, c, 'sibling_of', s, 'role', false, false FROM cast_ WHERE a = 6 UNION ALL SELECT doc_id, q, 'love', c, 'passive', true, false FROM cast_ WHERE a = 6 UNION ALL SELECT doc_id, r, 'meet', q, 'svo', false, false FROM cast_ WHERE e = 2)
SELECT doc_id, subj, pred, obj, rule, negated, round(0.7 - CASE WHEN negated THEN 0.1 ELSE 0 END - CASE WHEN less THEN 0.05 ELSE 0 END, 2) AS confidence FROM w""")
def clause_relations(spark, sf_dir):
    sentences = B.grammar_texts(spark, sf_dir).withColumn("idx", F.lit(0))
    return G.clause_relations(sentences).drop("idx")


# What each sentence of a dialogue mentions, in order: place in the sentence, name or null, type, gender, number, pronoun.
_M = lambda at, name, kind="NULL", gender="NULL", number="one", pronoun="NULL": f"{{{{'pos': {at}, 'name': {name}, 'type': {kind}, 'gender': {gender}, 'number': '{number}', 'pronoun': {pronoun}}}}}"
_P = lambda at, word, gender, number="one": _M(at, "NULL", "NULL", f"'{gender}'", number, f"'{word}'")
DIALOGUES = f"""dlg AS (SELECT o_orderkey // 6 AS doc_id, CAST(o_orderkey % 6 AS INTEGER) AS sent, (o_orderkey % 6 + o_orderkey // 6) % 6 AS t, {_NAME("Cu", "o_orderkey // 6 % 89")} AS c, {_NAME("Su", "o_orderkey // 6 % 83")} AS s, {_NAME("Pa", "o_orderkey // 6 % 79")} AS p,
  {_NAME("Na", "o_orderkey // 6 % 25")} AS n, {_NAME("Re", "o_orderkey // 6 % 53")} AS r, {_NAME("Qo", "o_orderkey // 6 % 97")} AS q, {_NAME("Mo", "o_orderkey // 6 % 31")} AS m FROM orders),
men0 AS (SELECT doc_id, sent, unnest(CASE t WHEN 0 THEN [{_M(0, "c", "'PERSON'", "'m'")}, {_M(1, "s", "'PERSON'", "'f'")}, {_M(2, "n", "'PLACE'")}]
  WHEN 1 THEN [{_P(0, "she", "f")}, {_M(1, "p", "'ITEM'")}] WHEN 2 THEN [{_P(0, "he", "m")}, {_P(1, "it", "n")}]
  WHEN 3 THEN [{_M(0, "r || ' and ' || q", "NULL", "NULL", "many")}, {_M(0, "r", "'PERSON'")}, {_M(0, "q", "'PERSON'")}, {_M(1, "m", "'PLACE'")}]
  WHEN 4 THEN [{_P(0, "they", "any", "many")}, {_P(1, "him", "m")}] ELSE [{_P(0, "she", "f")}, {_M(1, "c", "'PERSON'")}] END) AS x FROM dlg),
men AS (SELECT doc_id, sent, x.pos AS pos, x.name AS name, x.type AS type, x.number AS number, x.pronoun AS pronoun, CASE WHEN x.name IS NULL THEN x.gender ELSE max(x.gender) OVER (PARTITION BY doc_id, x.name) END AS gender FROM men0)""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH {DIALOGUES}, pro AS (SELECT * FROM men WHERE pronoun IS NOT NULL), cand AS (SELECT p.doc_id, p.sent, p.pos, p.pronoun, n.name, max(n.sent * 1000 + n.pos) AS last,
    round(sum(CASE WHEN n.pos = 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * pow(0.5, p.sent - n.sent)) * CASE WHEN p.gender IN ('m', 'f') AND bool_or(n.gender IS NULL) THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score
  FROM pro p JOIN men n ON n.doc_id = p.doc_id AND n.pronoun IS NULL AND n.sent BETWEEN p.sent - 5 AND p.sent AND (n.sent < p.sent OR n.pos < p.pos) AND NOT (p.pronoun = 'him' AND n.sent = p.sent AND n.pos = 0)
   AND CASE p.gender WHEN 'n' THEN n.number = 'one' AND n.type <> 'PERSON' AND n.gender IS NULL WHEN 'any' THEN n.number = 'many' ELSE n.number = 'one' AND n.type = 'PERSON' AND coalesce(n.gender, p.gender) = p.gender END
  GROUP BY p.doc_id, p.sent, p.pos, p.pronoun, p.gender, n.name),
best AS (SELECT doc_id, sent, pos, first(name ORDER BY score DESC, last DESC, name) AS antecedent, max(score) AS score, CAST(count(*) AS INTEGER) AS n FROM cand GROUP BY 1, 2, 3)
SELECT doc_id, sent, pos AS "at", pronoun, antecedent, score, coalesce(n, 0) AS n_candidates FROM pro LEFT JOIN best USING (doc_id, sent, pos)""")
def scored_coreference(spark, sf_dir):
    found = C.mentions(B.dialogues(spark, sf_dir))
    kind = F.create_map(*[F.lit(x) for kv in {"Cu": "PERSON", "Su": "PERSON", "Re": "PERSON", "Qo": "PERSON", "Na": "PLACE", "Mo": "PLACE", "Pa": "ITEM"}.items() for x in kv])
    types = found.where("number = 'one' and pronoun is null").select("name").distinct().select("name", kind[F.substring("name", 1, 2)].alias("type"))
    return C.resolved(C.described(found, types))


# --- aliases --------------------------------------------------------------------------------------------------------

_TOK = r"'[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E]'"
#: The aliases: of every document its first one to four words, known by its number.
ALIASES = f"""tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), {_TOK}) AS w FROM documents),
als AS MATERIALIZED (SELECT array_to_string(w[1 : 1 + doc_id % 4], ' ') AS key, min('D' || doc_id) AS id FROM tok WHERE len(w) > 0 GROUP BY 1),
ln AS (SELECT key, id, len(string_split(key, ' ')) AS n FROM als),
pos AS (SELECT t.doc_id, i AS at_, s.n, array_to_string(t.w[i + 1 : i + s.n], ' ') AS key FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM tok) t JOIN (SELECT DISTINCT n FROM ln) s ON i + s.n <= len(t.w)),
can AS MATERIALIZED (SELECT doc_id, at_, n, key, id FROM pos JOIN ln USING (key, n))"""


def _aliases(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    begin = F.regexp_extract("text", rf"^(?:[\x00-\x20\x7F]*(?:{A.TOKEN})){{0,4}}", 0)  # no more words of a text are cut than an alias has
    words = F.regexp_extract_all(begin, F.lit(f"({A.TOKEN})"), F.lit(1))
    return docs.select(F.array_join(F.slice(words, F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")), " ").alias("alias"), F.concat(F.lit("D"), "doc_id").alias("id"))


@query(f"WITH {ALIASES} SELECT doc_id, id, count(*) AS n, CAST(min(at_) AS INTEGER) AS first FROM can GROUP BY 1, 2")
def alias_candidates(spark, sf_dir):
    found = A.candidates(B.table(spark, sf_dir, "documents"), A.keyed(_aliases(spark, sf_dir)))
    return found.groupBy("doc_id", "id").agg(F.count("*").alias("n"), F.min("at").alias("first"))


@query(f"""WITH RECURSIVE {ALIASES}, isl AS (SELECT *, sum(CASE WHEN at_ < before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY at_, n) AS island FROM
    (SELECT *, max(at_ + n) OVER (PARTITION BY doc_id ORDER BY at_, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM can)),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY length(key) DESC, at_, key) AS r FROM isl),
f AS (SELECT doc_id, island, 1 AS r, [{{'a': at_, 'n': n, 'id': id}}] AS acc FROM rk WHERE r = 1
  UNION ALL SELECT f.doc_id, f.island, f.r + 1, CASE WHEN len(list_filter(acc, lambda y: y.a < rk.at_ + rk.n AND rk.at_ < y.a + y.n)) > 0 THEN acc ELSE list_append(acc, {{'a': rk.at_, 'n': rk.n, 'id': rk.id}}) END
  FROM f JOIN rk ON rk.doc_id = f.doc_id AND rk.island = f.island AND rk.r = f.r + 1),
e AS (SELECT doc_id, island, unnest(arg_max(acc, r)) AS x FROM f GROUP BY 1, 2)
SELECT doc_id, CAST(x.a AS INTEGER) AS place, CAST(x.n AS INTEGER) AS n, x.id AS id FROM e""")
def alias_mentions(spark, sf_dir):
    return A.alias_mentions(B.table(spark, sf_dir, "documents"), _aliases(spark, sf_dir)).select("doc_id", F.col("at").alias("place"), "n", "id")


# --- dependency paths -----------------------------------------------------------------------------------------------

#: Patterns of paths and what they say.
PATHS = [("^[^:]+:↑nsubj:[^:]+:↓dobj:[^:]+$", "acts_on"), ("↑nsubj.*↓prep", "acts_at"), ("↓nsubj", "done_by")]
TREES = """tok AS (SELECT l_orderkey AS doc_id, i, 'w' || l_suppkey % 50 AS lemma, CASE l_returnflag WHEN 'A' THEN 'nsubj' WHEN 'R' THEN 'dobj' ELSE 'prep' END AS dep,
  CASE l_linestatus WHEN 'O' THEN 'VERB' ELSE 'ADP' END AS pos, CASE WHEN i = 0 THEN 0 ELSE l_partkey % i END AS head
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS INTEGER) AS i FROM lineitem))"""


@query(f"""WITH RECURSIVE {TREES}, n AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM tok GROUP BY 1), pr AS (SELECT doc_id, n - 1 AS a, n // 2 AS b FROM n),
up AS (SELECT doc_id, 0 AS side, a AS x, 0 AS d FROM pr WHERE a <> b UNION ALL SELECT doc_id, 1, b, 0 FROM pr WHERE a <> b
  UNION ALL SELECT u.doc_id, u.side, t.head, u.d + 1 FROM up u JOIN tok t ON t.doc_id = u.doc_id AND t.i = u.x WHERE u.x <> 0),
top AS (SELECT l.doc_id, arg_min(l.d, l.d) AS da, arg_min(r.d, l.d) AS db FROM up l JOIN up r ON l.doc_id = r.doc_id AND l.x = r.x AND l.side = 0 AND r.side = 1 GROUP BY 1),
l AS (SELECT u.doc_id, string_agg(':↑' || t.dep || ':' || h.lemma, '' ORDER BY u.d) AS s, bool_or(t.pos = 'VERB') AS v, bool_or(t.pos = 'ADP') AS a FROM up u JOIN top ON top.doc_id = u.doc_id AND u.side = 0 AND u.d < da JOIN tok t ON t.doc_id = u.doc_id AND t.i = u.x JOIN tok h ON h.doc_id = u.doc_id AND h.i = t.head GROUP BY 1),
r AS (SELECT u.doc_id, string_agg(':↓' || t.dep || ':' || t.lemma, '' ORDER BY u.d DESC) AS s, bool_or(t.pos = 'VERB') AS v, bool_or(t.pos = 'ADP') AS a FROM up u JOIN top ON top.doc_id = u.doc_id AND u.side = 1 AND u.d < db JOIN tok t ON t.doc_id = u.doc_id AND t.i = u.x GROUP BY 1),
m AS (SELECT u.doc_id, t.pos FROM up u JOIN top ON top.doc_id = u.doc_id AND u.side = 0 AND u.d = da JOIN tok t ON t.doc_id = u.doc_id AND t.i = u.x),
p AS (SELECT pr.doc_id, CASE WHEN top.doc_id IS NOT NULL THEN t.lemma || coalesce(l.s, '') || coalesce(r.s, '') END AS path, CASE WHEN top.doc_id IS NOT NULL THEN CAST(da + db + 1 AS INTEGER) END AS length,
  CASE WHEN top.doc_id IS NOT NULL THEN coalesce(l.v, false) OR coalesce(r.v, false) OR m.pos = 'VERB' END AS has_verb, CASE WHEN top.doc_id IS NOT NULL THEN coalesce(l.a, false) OR coalesce(r.a, false) OR m.pos = 'ADP' END AS has_preposition
  FROM pr JOIN tok t ON t.doc_id = pr.doc_id AND t.i = pr.a LEFT JOIN top ON top.doc_id = pr.doc_id LEFT JOIN l ON l.doc_id = pr.doc_id LEFT JOIN r ON r.doc_id = pr.doc_id LEFT JOIN m ON m.doc_id = pr.doc_id)
SELECT *, CASE {" ".join(f"WHEN regexp_matches(path, '{p}') THEN '{w}'" for p, w in PATHS)} END AS predicate FROM p""")
def dependency_paths(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    i = F.col("i")
    rows = B.table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w) - 1)
    token = F.struct(
        i, F.concat(F.lit("w"), F.col("l_suppkey") % 50).alias("lemma"), F.when(F.col("l_linestatus") == "O", "VERB").otherwise("ADP").alias("pos"),
        F.when(F.col("l_returnflag") == "A", "nsubj").when(F.col("l_returnflag") == "R", "dobj").otherwise("prep").alias("dep"), F.when(i == 0, 0).otherwise(F.expr("l_partkey % if(i = 0, 1, i)")).cast("int").alias("head"),
    )
    trees = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    pairs = trees.withColumn("a", F.size("tokens") - 1).withColumn("b", F.expr("size(tokens) div 2").cast("int"))
    found = D.with_paths(pairs).withColumn("predicate", D.predicate_of(F.col("path"), PATHS))
    return found.select("doc_id", "path", "length", "has_verb", "has_preposition", "predicate")
