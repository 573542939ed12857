"""Queries of degrees, communities' figures and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import vocab
from weft.operators import components as C
from weft.operators import degree as D
from weft.operators import traverse as W
from weft.plans.q_projections import _list
from weft.plans.registry import query
from weft.plans.tables import COMMUNITIES_SQL, EDGES_SQL, NODES_SQL, communities, edges, nodes, table

_DEG = "pr AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges), deg AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM pr UNION ALL SELECT b FROM pr) GROUP BY id)"
_BOTH = "l AS (SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges)"


@query("degree", f"WITH {EDGES_SQL}, {_DEG} SELECT * FROM deg")
def degree(spark, d):
    return D.degrees(edges(spark, d))


@query("god_nodes", f"WITH {NODES_SQL}, {EDGES_SQL}, {_DEG} SELECT id, label, degree FROM nodes JOIN deg USING (id) WHERE source_file <> '' AND contains(regexp_extract(source_file, '[^/]*$'), '.') AND label <> regexp_extract(source_file, '[^/]*$') AND label NOT IN ({_list(vocab.BUILTIN_NOISE)}) ORDER BY degree DESC, id LIMIT 10")
def god_nodes(spark, d):
    return D.god_nodes(nodes(spark, d), edges(spark, d))


@query("graph_stats", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'nodes ' || file_type AS metric, count(*) AS value FROM nodes GROUP BY file_type UNION ALL SELECT 'edges ' || relation, count(*) FROM edges GROUP BY relation")
def graph_stats(spark, d):
    return D.graph_stats(nodes(spark, d), edges(spark, d))


@query("confidence_audit", f"WITH {EDGES_SQL}, c AS (SELECT confidence, count(*) AS edges FROM edges GROUP BY 1) SELECT *, round_even(100 * edges / sum(edges) OVER (), 0)::int AS percent FROM c")
def confidence_audit(spark, d):
    return D.confidence_audit(edges(spark, d))


_INSIDE = "x AS (SELECT pr.a, pr.b, ca.community AS ca, cb.community AS cb FROM pr JOIN communities ca ON pr.a = ca.node_id JOIN communities cb ON pr.b = cb.node_id)"


@query("cohesion", f"WITH {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, {_INSIDE}, s AS (SELECT community, count(*) AS size FROM communities GROUP BY 1), k AS (SELECT ca, count(*) AS links FROM x WHERE ca = cb AND a <> b GROUP BY 1) SELECT community, size, round(CASE WHEN size <= 1 THEN 1.0 ELSE coalesce(links, 0) / (size * (size - 1) / 2) END, 9) AS cohesion FROM s LEFT JOIN k ON ca = community")
def cohesion(spark, d):
    return D.cohesion(edges(spark, d), communities(spark, d))


@query("hub_labels", f"WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, r AS (SELECT community, id, label, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS k FROM nodes JOIN communities ON id = node_id LEFT JOIN deg USING (id)) SELECT community, id, label FROM r WHERE k = 1")
def hub_labels(spark, d):
    return D.hub_labels(nodes(spark, d), edges(spark, d), communities(spark, d))


@query("community_sigs", f"WITH {COMMUNITIES_SQL} SELECT community, left(sha256(string_agg(node_id || chr(0), '' ORDER BY node_id)), 16) AS signature FROM communities GROUP BY community")
def community_sigs(spark, d):
    return D.signatures(communities(spark, d))


@query("community_matrix", f"WITH {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, {_INSIDE} SELECT least(ca, cb) AS c1, greatest(ca, cb) AS c2, count(*) AS links FROM x WHERE ca <> cb GROUP BY ALL")
def community_matrix(spark, d):
    return D.community_matrix(edges(spark, d), communities(spark, d))


@query("community_confidence", f"WITH {EDGES_SQL}, {COMMUNITIES_SQL} SELECT community, confidence, count(*) AS edges FROM edges JOIN communities ON source = node_id GROUP BY ALL")
def community_confidence(spark, d):
    return D.community_confidence(edges(spark, d), communities(spark, d))


@query("community_reindex", f"WITH {COMMUNITIES_SQL}, s AS (SELECT community, row_number() OVER (ORDER BY count(*) DESC, min(node_id)) - 1 AS number FROM communities GROUP BY 1) SELECT node_id, number::int AS community FROM communities JOIN s USING (community)")
def community_reindex(spark, d):
    return D.reindex(communities(spark, d))


@query("dir_rollup", f"WITH {NODES_SQL}, f AS (SELECT source_file, unnest(generate_series(1, len(string_split(source_file, '/')))) AS k FROM nodes WHERE source_file <> '') SELECT array_to_string(string_split(source_file, '/')[1:k], '/') AS directory, (k - 1)::int AS depth, count(*) AS nodes FROM f GROUP BY ALL")
def dir_rollup(spark, d):
    return D.directory_rollup(nodes(spark, d))


@query("entry_points", f"WITH {EDGES_SQL} SELECT id, sum(k)::bigint AS surplus FROM (SELECT source AS id, 1 AS k FROM edges UNION ALL SELECT target, -1 FROM edges) GROUP BY id ORDER BY surplus DESC, id LIMIT 20")
def entry_points(spark, d):
    return D.entry_points(edges(spark, d))


_CUT = "cut AS (SELECT greatest(50, coalesce((SELECT coalesce(degree, 0) FROM nodes LEFT JOIN deg USING (id) ORDER BY coalesce(degree, 0) OFFSET (SELECT floor(count(*) * 0.99)::bigint FROM nodes) LIMIT 1), 0)) AS cut)"


@query("bfs_hub_cut", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, {_CUT}, {_BOTH}, h1 AS (SELECT DISTINCT v AS id FROM l WHERE u IN ('supplier:1', 'customer:1') AND v NOT IN ('supplier:1', 'customer:1')),
h2 AS (SELECT DISTINCT v AS id FROM l JOIN deg ON u = id WHERE u IN (SELECT id FROM h1) AND degree < (SELECT cut FROM cut) AND v NOT IN (SELECT id FROM h1) AND v NOT IN ('supplier:1', 'customer:1'))
SELECT 'supplier:1' AS id, 0 AS hop UNION ALL SELECT 'customer:1', 0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def bfs_hub_cut(spark, d):
    return W.bfs(nodes(spark, d), edges(spark, d), spark.createDataFrame([("supplier:1",), ("customer:1",)], "id string"), 2)


@query("walked_edges", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, {_CUT}, {_BOTH}, h1 AS (SELECT DISTINCT v AS id FROM l WHERE u IN ('supplier:1', 'customer:1') AND v NOT IN ('supplier:1', 'customer:1')),
w1 AS (SELECT id FROM h1 JOIN deg USING (id) WHERE degree < (SELECT cut FROM cut)), n AS (SELECT u, v, 1 AS hop FROM l WHERE u IN ('supplier:1', 'customer:1') AND v IN (FROM h1) UNION SELECT u, v, 2 FROM l WHERE u IN (FROM w1) AND v NOT IN (FROM h1) AND v NOT IN ('supplier:1', 'customer:1'))
SELECT source, target, relation, weight, u, v, hop FROM edges JOIN n ON (source = u AND target = v) OR (source = v AND target = u)""")
def walked_edges(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    seen = W.bfs(n, e, spark.createDataFrame([("supplier:1",), ("customer:1",)], "id string"), 2)
    return W.walked(n, e, seen).select("source", "target", "relation", "weight", "u", "v", "hop")


@query("affected", f"""WITH {EDGES_SQL}, b AS (SELECT target AS t, source AS id, relation FROM edges WHERE relation IN ({_list(vocab.IMPACT_RELATIONS)})), s AS (SELECT 'nation:3' AS id UNION SELECT target FROM edges WHERE source = 'nation:3' AND relation IN ('method', 'contains')),
a1 AS (SELECT id, min(relation) AS relation FROM b WHERE t IN (SELECT id FROM s) AND id NOT IN (SELECT id FROM s) GROUP BY id),
a2 AS (SELECT id, min(relation) AS relation FROM b WHERE t IN (SELECT id FROM a1) AND id NOT IN (SELECT id FROM s) AND id NOT IN (SELECT id FROM a1) GROUP BY id) SELECT id, relation, 1 AS hop FROM a1 UNION ALL SELECT id, relation, 2 FROM a2""")
def affected(spark, d):
    return W.affected(edges(spark, d), "nation:3", 2)


@query("shortest_path_len", f"""WITH {EDGES_SQL}, {_BOTH}, h0 AS (SELECT 'region:1' AS id), h1 AS (SELECT DISTINCT v AS id FROM l WHERE u = 'region:1' AND v <> u), h2 AS (SELECT DISTINCT v AS id FROM l WHERE u IN (FROM h1) AND v NOT IN (FROM h1) AND v <> 'region:1'),
h3 AS (SELECT DISTINCT v AS id FROM l WHERE u IN (FROM h2) AND v NOT IN (FROM h1) AND v NOT IN (FROM h2) AND v <> 'region:1') SELECT id, 0 AS hops FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3""")
def shortest_path_len(spark, d):
    return W.shortest_lengths(edges(spark, d), "region:1", 3)


#: The nodes that are so many hops from region:1, each with its first shortest path.
_PATHS = "p0 AS (SELECT 'region:1' AS id, ['region:1'] AS path)" + "".join(
    f", p{k} AS (SELECT v AS id, min(list_append(path, v)) AS path FROM l JOIN p{k - 1} ON u = p{k - 1}.id WHERE " + " AND ".join(f"v NOT IN (SELECT id FROM p{j})" for j in range(k)) + " GROUP BY v)" for k in range(1, 6)
)


@query("shortest_path", f"WITH {EDGES_SQL}, {_BOTH}, {_PATHS} SELECT array_to_string(path, ' -> ') AS path FROM (" + " UNION ALL ".join(f"FROM p{k}" for k in range(6)) + ") WHERE id = 'supplier:5'")
def shortest_path(spark, d):
    return W.shortest_path(edges(spark, d), "region:1", "supplier:5").select(F.array_join("path", " -> ").alias("path"))


@query("dfs")
def dfs(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    return spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(W.dfs(e, ["region:0", "customer:1"], 3, cutoff=W.hub_cutoff(n, e)))], "place int, id string, depth int")


@query("neighbors", f"WITH {NODES_SQL}, {EDGES_SQL}, n AS (SELECT 'out' AS direction, relation, target AS id FROM edges WHERE source = 'part:7' UNION SELECT 'in', relation, source FROM edges WHERE target = 'part:7') SELECT direction, relation, id, label FROM n JOIN nodes USING (id) WHERE contains(relation, 's')")
def neighbors(spark, d):
    return W.neighbors(nodes(spark, d), edges(spark, d), "part:7", "s")


@query("find_node", f"""WITH {NODES_SQL}, t AS (SELECT id, label, CASE WHEN lower(source_file) = 'blue' THEN 0 WHEN lower(label) = 'blue' OR lower(id) = 'blue' THEN 1 WHEN starts_with(lower(label), 'blue') OR starts_with(lower(id), 'blue') THEN 2 WHEN contains(lower(label), 'blue') THEN 3 END AS tier FROM nodes)
SELECT * FROM t WHERE tier IS NOT NULL ORDER BY tier, length(label), id LIMIT 20""")
def find_node(spark, d):
    return W.find_node(nodes(spark, d), "Blue")


_SEEDS = ["nation:3", "Supplier#000000005", "supplier#000000007", "customer#000000011", "supply/supplier.go", "geo/nation.md/", "order 77", "no such thing", "r#000000009"]


@query("seed_resolve", f"""WITH {NODES_SQL}, q AS (SELECT unnest([{_list(_SEEDS)}]) AS query), k AS (SELECT query, regexp_replace(query, '[/\\\\]+$', '') AS w FROM q),
m AS (SELECT query, id, CASE WHEN w = id THEN 0 WHEN lower(w) = lower(label) THEN 1 WHEN lower(w) = lower(source_file) THEN 3 WHEN contains(lower(label), lower(w)) THEN 4 END AS tier FROM k CROSS JOIN nodes),
c AS (SELECT query, tier, min(id) AS id, count(*) AS n FROM m WHERE tier IS NOT NULL GROUP BY ALL), ok AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier) AS r FROM c WHERE n = 1) SELECT query, id, tier FROM ok WHERE r = 1""")
def seed_resolve(spark, d):
    return W.resolve_seeds(nodes(spark, d), spark.createDataFrame([(q,) for q in _SEEDS], "query string"))


_BRANDS = "imp AS (SELECT DISTINCT a.p_brand AS source, b.p_brand AS target FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN part a ON a.p_partkey = x.l_partkey JOIN part b ON b.p_partkey = y.l_partkey)"


@query("import_cycles", f"""WITH RECURSIVE {_BRANDS}, p AS (SELECT source AS first, target AS last, [source, target] AS path FROM imp WHERE target > source UNION ALL SELECT first, target, list_append(path, target) FROM p JOIN imp ON last = source WHERE target > first AND NOT list_contains(path, target) AND len(path) < 5)
SELECT cycle, length FROM (SELECT array_to_string(path, ' -> ') AS cycle, len(path)::int AS length FROM p JOIN imp ON last = source AND target = first UNION ALL SELECT source, 1 FROM imp WHERE source = target) ORDER BY length, cycle LIMIT 20""")
def import_cycles(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    x = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("p_brand").alias("source"))
    y = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("p_brand").alias("target"))
    return W.import_cycles(x.join(y, ["l_orderkey", "n"]))


@query("connected_components", f"""WITH RECURSIVE s AS (SELECT DISTINCT p_brand || '/' || (p_partkey % 400) AS g, p_partkey AS k FROM part), e AS (SELECT g, k, min(k) OVER (PARTITION BY g) AS m FROM s UNION ALL SELECT p_name || '/' || (p_partkey % 97), p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_partkey % 97) FROM part),
l AS (SELECT k AS u, m AS v FROM e UNION SELECT m, k FROM e), r AS (SELECT DISTINCT u AS node, u AS reached FROM l UNION SELECT r.node, l.v FROM r JOIN l ON r.reached = l.u) SELECT node, min(reached) AS component FROM r GROUP BY node""")
def connected_components(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    groups = part.select(k.alias("src"), F.explode(F.array(F.concat_ws("/", "p_brand", (k % 400).cast("string")), F.concat_ws("/", F.lit("n"), "p_name", (k % 97).cast("string")))).alias("g"))
    least = groups.groupBy("g").agg(F.min("src").alias("dst"))
    return C.connected_components(groups.join(least, "g"))
