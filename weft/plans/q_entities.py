"""Queries of entity resolution and name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.similarity import jaro_column, jaro_winkler_column
from weft.operators import entities as E
from weft.operators import resolve as R
from weft.plans.registry import query
from weft.plans.tables import EDGES_SQL, NODES_SQL, edges, nodes, table


def labels(spark, d):
    """Distinct labels of type and name, in a table of nodes."""
    part = table(spark, d, "part").withColumn("label", F.concat_ws(" ", "p_type", "p_name"))
    return part.groupBy("label").agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("part:"), F.col("k").cast("string")).alias("id"), "label", F.lit("concept").alias("file_type"), F.concat(F.lit("f"), (F.col("k") % 3).cast("string"), F.lit(".md")).alias("source_file"))


_LABELS = "lb AS (SELECT lower(p_type || ' ' || p_name) AS norm, 'f' || (min(p_partkey) % 3) || '.md' AS file FROM part GROUP BY 1)"
_PAIRS = "pp AS (SELECT a.norm AS na, b.norm AS nb, a.file AS fa, b.file AS fb FROM lb a JOIN lb b ON a.norm < b.norm)"


def _label_pairs(spark, d, near=None):
    """All pairs of labels, or those that near, a condition that loses none that count, leaves."""
    n = labels(spark, d).select(T.norm_label(F.col("label")).alias("n"), F.col("source_file").alias("f"))
    a, b = n.select(F.col("n").alias("na"), F.col("f").alias("fa")), n.select(F.col("n").alias("nb"), F.col("f").alias("fb"))
    return a.join(b, F.col("na") < F.col("nb") if near is None else (F.col("na") < F.col("nb")) & near)


@query("jaro_score", f"WITH {_LABELS}, {_PAIRS} SELECT na, nb, round(jaro_similarity(na, nb), 9) AS score FROM pp")
def jaro_score(spark, d):
    return _label_pairs(spark, d).select("na", "nb", F.round(jaro_column(F.col("na"), F.col("nb")), 9).alias("score"))


@query("jaro_winkler_score", f"WITH {_LABELS}, {_PAIRS} SELECT na, nb, round(jaro_winkler_similarity(na, nb), 9) AS score FROM pp")
def jaro_winkler_score(spark, d):
    return _label_pairs(spark, d).select("na", "nb", F.round(jaro_winkler_column(F.col("na"), F.col("nb")), 9).alias("score"))


@query("fuzzy_pairs_guarded", f"""WITH {_LABELS}, {_PAIRS}, s AS (SELECT *, 100 * CASE WHEN fa <> fb AND greatest(length(na), length(nb)) >= 12 THEN jaro_similarity(na, nb) ELSE jaro_winkler_similarity(na, nb) END AS score FROM pp)
SELECT na, nb, round(score, 6) AS score FROM s WHERE score >= 92 AND (greatest(length(na), length(nb)) >= 12 OR (score >= 97 AND length(na) = length(nb) AND damerau_levenshtein(na, nb) <= 1)) AND NOT (length(na) <> length(nb) AND (starts_with(na, nb) OR starts_with(nb, na)))""")
def fuzzy_pairs_guarded(spark, d):
    return E.scored(_label_pairs(spark, d, E.may_merge(F.col("na"), F.col("nb")))).where("merges").select("na", "nb", F.round("score", 6).alias("score"))


@query("exact_entities", f"""WITH {NODES_SQL}, n AS (SELECT id, file_type, source_file, trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM nodes WHERE file_type <> 'code'),
c AS (SELECT norm, unnest(string_split(norm, '')) AS ch, length(norm) AS n FROM (SELECT DISTINCT norm FROM n)), g AS (SELECT norm, ch, n, count(*) AS k FROM c GROUP BY ALL), h AS (SELECT norm, -sum(k / n * log2(k / n)) AS bits FROM g GROUP BY norm)
SELECT min(id) OVER (PARTITION BY source_file, norm) AS a, id AS b FROM n QUALIFY a <> b UNION SELECT min(id) OVER (PARTITION BY norm) AS a, id AS b FROM n JOIN h USING (norm) WHERE file_type = 'concept' AND bits >= 2.5 QUALIFY a <> b""")
def exact_entities(spark, d):
    return E.exact_pairs(nodes(spark, d))


@query("lsh_candidates")
def lsh_candidates(spark, d):
    return E.lsh_pairs(labels(spark, d).select("id", T.norm_label(F.col("label")).alias("norm")))


@query("entity_dedup")
def entity_dedup(spark, d):
    return E.entity_dedup(labels(spark, d))


# --- name resolution over orders as calls: an order calls a part by name, from the file of its customer's segment ---

_CALLS = "calls AS (SELECT o_orderkey AS call_id, 'order:' || o_orderkey AS caller, '.' || upper(p_name) || '()' AS callee, 'sales/' || lower(c_mktsegment) || '/run.py' AS caller_file FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % 800)"
_FUNCS = "funcs AS (SELECT 'part:' || p_partkey AS id, p_name || '()' AS label, CASE p_partkey % 4 WHEN 0 THEN 'sales/' || CASE p_size % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE 'tests' END || '/' || lower(p_brand) || '.py' WHEN 1 THEN 'lib/' || lower(p_brand) || '.py' WHEN 2 THEN 'web/' || lower(p_brand) || '.ts' ELSE 'sales/tests/t' || p_size || '.py' END AS file FROM part)"
_IMPORTS = "imports AS (SELECT DISTINCT 'sales/' || lower(c_mktsegment) || '/run.py' AS file, p_name AS symbol FROM customer JOIN part ON p_partkey = c_custkey % 50)"


def _calls(spark, d):
    o, c, p = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "part")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("p_partkey") == F.col("o_orderkey") % 800)
    return rows.select(F.col("o_orderkey").alias("call_id"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("caller"), F.concat(F.lit("."), F.upper("p_name"), F.lit("()")).alias("callee"), F.concat(F.lit("sales/"), F.lower("c_mktsegment"), F.lit("/run.py")).alias("caller_file"))


def _functions(spark, d):
    k, brand = F.col("p_partkey") % 4, F.lower("p_brand")
    area = F.when(F.col("p_size") % 3 == 0, "building").when(F.col("p_size") % 3 == 1, "machinery").otherwise("tests")
    file = F.when(k == 0, F.concat(F.lit("sales/"), area, F.lit("/"), brand, F.lit(".py"))).when(k == 1, F.concat(F.lit("lib/"), brand, F.lit(".py"))).when(k == 2, F.concat(F.lit("web/"), brand, F.lit(".ts"))).otherwise(F.concat(F.lit("sales/tests/t"), F.col("p_size").cast("string"), F.lit(".py")))
    return table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit("()")).alias("label"), file.alias("file"))


def _imports(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "part"), F.col("p_partkey") == F.col("c_custkey") % 50)
    return rows.select(F.concat(F.lit("sales/"), F.lower("c_mktsegment"), F.lit("/run.py")).alias("file"), F.col("p_name").alias("symbol")).distinct()


_CAND = f"""{_CALLS}, {_FUNCS}, {_IMPORTS}, cand AS (SELECT call_id, caller, caller_file, id, file, EXISTS (SELECT 1 FROM imports i WHERE i.file = caller_file AND lower(i.symbol) = lower(replace(label, '()', ''))) AS imported,
 count(*) OVER (PARTITION BY call_id) AS n, CASE WHEN regexp_matches(file, '(^|/)tests/') THEN 0 ELSE 1 END AS t,
 CASE WHEN file = caller_file THEN 1000002 WHEN regexp_extract(file, '^(.*)/[^/]*$', 1) = regexp_extract(caller_file, '^(.*)/[^/]*$', 1) THEN 1000001 WHEN split_part(file, '/', 1) = split_part(caller_file, '/', 1) THEN 1 ELSE 0 END AS near
 FROM calls JOIN funcs ON lower(regexp_replace(callee, '^\\.|\\(\\)$', '', 'g')) = lower(replace(label, '()', '')) AND ends_with(file, '.py'))"""


@query("raw_call_resolution", f"""WITH {_CAND}, r AS (SELECT *, max((t, near)) OVER (PARTITION BY call_id) AS top FROM cand), k AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS m FROM r WHERE (t, near) = top)
SELECT call_id, caller, id, CASE WHEN imported THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, CASE WHEN imported THEN 1.0 ELSE 0.8 END::double AS score FROM k WHERE m = 1""")
def raw_call_resolution(spark, d):
    return R.resolve_calls(_calls(spark, d), _functions(spark, d), _imports(spark, d))


@query("proximity_tiebreak", f"""WITH {_CAND}, r AS (SELECT *, max((t, near)) OVER (PARTITION BY call_id) AS top FROM cand), k AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS m FROM r WHERE (t, near) = top) SELECT call_id, id FROM k WHERE m = 1""")
def proximity_tiebreak(spark, d):
    f = _functions(spark, d).where(F.col("file").endswith(".py")).withColumn("name", T.bare_name(F.col("label")))
    return R.nearest(_calls(spark, d).withColumn("name", T.bare_name(F.col("callee"))), f, ["name"]).select("call_id", "id")


@query("import_guided_calls", f"""WITH {_CALLS}, fm AS (SELECT module, name, min(id) AS id FROM (SELECT 'part:' || p_partkey AS id, lower(p_name) AS name, lower(p_brand) AS module FROM part) GROUP BY ALL HAVING count(*) = 1),
al AS (SELECT DISTINCT 'sales/' || lower(c_mktsegment) || '/run.py' AS file, lower(p_name) AS symbol, lower(p_brand) AS module FROM customer JOIN part ON p_partkey = c_custkey % 50)
SELECT DISTINCT call_id, fm.id FROM calls JOIN al ON file = caller_file AND symbol = lower(regexp_replace(callee, '^\\.|\\(\\)$', '', 'g')) JOIN fm ON fm.module = al.module AND fm.name = al.symbol""")
def import_guided_calls(spark, d):
    part = table(spark, d, "part")
    f = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.lower("p_brand").alias("module"))
    rows = table(spark, d, "customer").join(part, F.col("p_partkey") == F.col("c_custkey") % 50)
    aliases = rows.select(F.concat(F.lit("sales/"), F.lower("c_mktsegment"), F.lit("/run.py")).alias("file"), F.col("p_name").alias("alias"), F.lower("p_brand").alias("module"), F.col("p_name").alias("symbol"))
    return R.import_guided(_calls(spark, d), aliases, f)


@query("member_calls", """WITH t AS (SELECT p_brand AS receiver, min(p_partkey) AS owner FROM part GROUP BY 1), m AS (SELECT p_brand AS owner_brand, p_name AS name, min('part:' || p_partkey) AS id FROM part GROUP BY ALL HAVING count(*) = 1)
SELECT l_orderkey * 10 + l_linenumber AS call_id, m.id FROM lineitem JOIN part p ON p_partkey = l_partkey JOIN m ON m.owner_brand = p.p_brand AND m.name = p.p_name""")
def member_calls(spark, d):
    part = table(spark, d, "part")
    types = part.select(F.col("p_brand").alias("label"), F.concat(F.lit("type:"), "p_brand").alias("id")).distinct()
    methods = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("type:"), "p_brand").alias("owner"), F.concat(F.lit("."), "p_name", F.lit("()")).alias("label"))
    line = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    calls = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("p_brand").alias("receiver"), F.col("p_name").alias("callee"))
    return R.member_calls(calls, types, methods)


@query("unique_stub_rewire", f"""WITH {NODES_SQL}, {EDGES_SQL}, n AS (SELECT id, label, source_file FROM nodes WHERE NOT starts_with(id, 'order:')), st AS (SELECT 'stub:' || n_nationkey AS sid, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'part ' || n_nationkey END AS label FROM nation),
u AS (SELECT label, min(id) AS id FROM n WHERE source_file <> '' GROUP BY label HAVING count(DISTINCT id) = 1) SELECT source, coalesce(u.id, 'stub:' || right(target, -7)) AS target, count(*) AS n FROM (SELECT source, target FROM edges WHERE starts_with(target, 'nation:')) LEFT JOIN st ON sid = 'stub:' || right(target, -7) LEFT JOIN u USING (label) GROUP BY ALL""")
def unique_stub_rewire(spark, d):
    nation = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    stubs = nation.select(F.concat(F.lit("stub:"), k).alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("part "), k)).alias("label"), F.lit("concept").alias("file_type"), F.lit("").alias("source_file"))
    n = nodes(spark, d).where(~F.col("id").startswith("order:")).union(stubs)
    e = edges(spark, d).where(F.col("target").startswith("nation:")).select("source", F.regexp_replace("target", "^nation:", "stub:").alias("target"))
    return R.rewire_stubs(e, n).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("citation_resolve", f"""WITH {NODES_SQL}, u AS (SELECT label, min(id) AS id FROM nodes GROUP BY label HAVING count(DISTINCT id) = 1), c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'customer:' || user_id WHEN 1 THEN 'Order ' || (event_id % 300) WHEN 2 THEN 'red widget' ELSE 'unknown ' || user_id END AS cite FROM events)
SELECT event_id, cite, coalesce(n.id, u.id) AS id FROM c LEFT JOIN nodes n ON n.id = cite LEFT JOIN u ON u.label = cite""")
def citation_resolve(spark, d):
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    cite = F.when(k == 0, F.concat(F.lit("customer:"), user)).when(k == 1, F.concat(F.lit("Order "), (F.col("event_id") % 300).cast("string"))).when(k == 2, "red widget").otherwise(F.concat(F.lit("unknown "), user))
    return R.resolve_citations(table(spark, d, "events").select("event_id", cite.alias("cite")), nodes(spark, d))
