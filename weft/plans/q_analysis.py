"""Queries of analytics and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import vocab
from weft.operators import analyze as A
from weft.operators import community as C
from weft.operators import degree as D
from weft.plans.q_graph import _DEG, _INSIDE
from weft.plans.q_projections import _list
from weft.plans.registry import query
from weft.plans.tables import COMMUNITIES_SQL, EDGES_SQL, NODES_SQL, communities, edges, nodes

_X = "lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
_CAT = f"CASE WHEN {_X} IN ({_list(vocab.CODE_EXTENSIONS)}) THEN 'code' WHEN {_X} = '.pdf' THEN 'paper' ELSE 'doc' END"
_ENDS = f"""k AS (SELECT nodes.*, coalesce(degree, 0) AS degree, community, {_CAT.format("source_file")} AS cat, split_part(source_file, '/', 1) AS top, CASE {_X.format("source_file")} WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' END AS fam,
 source_file <> '' AND label = regexp_extract(source_file, '[^/]*$') AS is_file, source_file = '' AS is_concept FROM nodes LEFT JOIN deg USING (id) LEFT JOIN communities ON id = node_id),
x2 AS (SELECT e.source, e.target, e.relation, e.confidence, s.cat AS sc, t.cat AS tc, s.top AS st, t.top AS tt, s.community AS c1, t.community AS c2, s.degree AS d1, t.degree AS d2, s.source_file AS f1, t.source_file AS f2, s.fam AS m1, t.fam AS m2, s.is_concept OR t.is_concept AS concept, s.is_file OR t.is_file AS isf
 FROM edges e JOIN k s ON s.id = e.source JOIN k t ON t.id = e.target WHERE relation NOT IN ({_list(vocab.STRUCTURAL_RELATIONS)}))"""


@query("surprise_score", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, {_ENDS}, m AS (SELECT *, confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND (coalesce(m1 <> m2, false) OR (sc = 'code' AND tc = 'doc') OR (sc = 'doc' AND tc = 'code')) AS muted FROM x2 WHERE NOT concept AND NOT isf AND f1 <> f2)
SELECT source, target, relation, confidence, (CASE WHEN muted THEN 0 ELSE CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN sc <> tc THEN 2 ELSE 0 END + CASE WHEN st <> tt THEN 2 ELSE 0 END + CASE WHEN c1 <> c2 THEN 1 ELSE 0 END END
 + CASE WHEN least(d1, d2) <= 2 AND greatest(d1, d2) >= 5 THEN 1 ELSE 0 END)::int AS score FROM m""")
def surprise_score(spark, d):
    return A.surprises(nodes(spark, d), edges(spark, d), communities(spark, d))


@query("cross_community_bridges", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, {_ENDS}, r AS (SELECT least(c1, c2) AS a, greatest(c1, c2) AS b, source, target, relation, confidence, row_number() OVER (PARTITION BY least(c1, c2), greatest(c1, c2) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, source, target, relation) AS n FROM x2 WHERE c1 <> c2 AND NOT isf)
SELECT a AS c1, b AS c2, source, target, relation, confidence FROM r WHERE n = 1""")
def cross_community_bridges(spark, d):
    return A.bridges(nodes(spark, d), edges(spark, d), communities(spark, d))


@query("questions_ambiguous", f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT 'ambiguous_edge' AS type, 'What is the exact relationship between `' || s.label || '` and `' || t.label || '`?' AS question, source || ' ' || target AS about FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE confidence = 'AMBIGUOUS'""")
def questions_ambiguous(spark, d):
    return A.ambiguous_questions(nodes(spark, d), edges(spark, d))


@query("questions_isolated", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, w AS (SELECT id, label FROM nodes LEFT JOIN deg USING (id) WHERE coalesce(degree, 0) <= 1 AND source_file <> '' AND file_type <> 'rationale')
SELECT 'isolated_nodes' AS type, 'What connects ' || (SELECT string_agg('`' || label || '`', ', ' ORDER BY id) FROM (SELECT * FROM w ORDER BY id LIMIT 3)) || ' to the rest of the system?' AS question, (SELECT count(*) FROM w)::varchar AS about WHERE (SELECT count(*) FROM w) > 0""")
def questions_isolated(spark, d):
    return A.isolated_questions(nodes(spark, d), edges(spark, d))


@query("questions_low_cohesion", f"""WITH {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, {_INSIDE}, s AS (SELECT community, count(*) AS size FROM communities GROUP BY 1), k AS (SELECT ca, count(*) AS links FROM x WHERE ca = cb AND a <> b GROUP BY 1)
SELECT 'low_cohesion' AS type, 'Should `Community ' || community || '` be split into smaller, more focused modules?' AS question, community::varchar AS about FROM s LEFT JOIN k ON ca = community WHERE size >= 5 AND coalesce(links, 0) / (size * (size - 1) / 2) < 0.15""")
def questions_low_cohesion(spark, d):
    return A.low_cohesion_questions(edges(spark, d), communities(spark, d))


@query("questions_verify_inferred", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, b AS (SELECT id, label FROM nodes JOIN deg USING (id) WHERE NOT (source_file <> '' AND label = regexp_extract(source_file, '[^/]*$')) ORDER BY degree DESC, id LIMIT 5),
ip AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE confidence = 'INFERRED'), i AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM ip UNION ALL SELECT b FROM ip) GROUP BY id HAVING count(*) >= 2)
SELECT 'verify_inferred' AS type, 'Are the ' || n || ' inferred relationships involving `' || label || '` actually correct?' AS question, id AS about FROM b JOIN i USING (id)""")
def questions_verify_inferred(spark, d):
    return A.verify_questions(nodes(spark, d), edges(spark, d))


@query("suggest_questions")
def suggest_questions(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return A.suggest_questions(n, e, communities(spark, d), between=lambda: C.betweenness(n, e))


@query("communities")
def detect(spark, d):
    return C.detect(nodes(spark, d), edges(spark, d))


_MOVED = "CASE WHEN right(node_id, 1) = '3' THEN (community + 1) % 25 ELSE community END + 100"


@query("modularity", f"WITH {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, {_INSIDE}, m AS (SELECT count(*) AS m FROM x WHERE a <> b), i AS (SELECT count(*) AS n FROM x WHERE a <> b AND ca = cb), k AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM x WHERE a <> b UNION ALL SELECT cb FROM x WHERE a <> b) GROUP BY c) SELECT n / m - (SELECT sum(k * k) FROM k) / (4 * m * m) AS modularity FROM m, i")
def modularity(spark, d):
    return C.modularity(edges(spark, d), communities(spark, d))


@query("community_remap", f"WITH {COMMUNITIES_SQL} SELECT node_id, ({_MOVED} - 100)::int AS community FROM communities")
def community_remap(spark, d):
    old = communities(spark, d)
    moved = F.when(F.right("node_id", F.lit(1)) == "3", (F.col("community") + 1) % 25).otherwise(F.col("community")) + 100
    return C.remap(old, old.select("node_id", moved.cast("int").alias("community")))


@query("hub_reattach", f"""WITH {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, h AS (SELECT id FROM deg WHERE degree > 100), b AS (SELECT a AS u, b AS v FROM pr UNION ALL SELECT b, a FROM pr), v AS (SELECT u, community, count(*) AS n FROM b JOIN h ON u = id JOIN communities ON v = node_id GROUP BY ALL)
SELECT u AS node_id, community FROM v QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, community) = 1""")
def hub_reattach(spark, d):
    e = edges(spark, d)
    return C.reattach(D.degrees(e).where("degree > 100"), e, communities(spark, d))


@query("betweenness")
def betweenness(spark, d):
    return C.betweenness(nodes(spark, d), edges(spark, d)).withColumn("score", F.round("score", 9))
