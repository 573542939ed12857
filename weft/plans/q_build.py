"""Queries of validation, building, merging and comparing."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import vocab
from weft.operators import build as B
from weft.operators import validate as V
from weft.plans.q_projections import _case, _list
from weft.plans.registry import query
from weft.plans.tables import EDGES_SQL, FILES_SQL, NODES_SQL, edges, files, nodes, table

_RAW_NODES = "raw AS (SELECT CASE WHEN right(id, 2) = '77' THEN '' ELSE id END AS id, CASE WHEN right(id, 2) = '33' THEN NULL ELSE label END AS label, CASE WHEN right(id, 2) = '55' THEN 'tool' ELSE file_type END AS file_type, source_file FROM nodes)"
_RAW_EDGES = "rawe AS (SELECT source, CASE WHEN right(target, 2) = '99' THEN target || '-gone' ELSE target END AS target, relation, CASE WHEN right(source, 2) = '11' THEN 'MAYBE' ELSE confidence END AS confidence, context, weight, source_file FROM edges)"


def raw_nodes(spark, d):
    """The nodes with faults sown in."""
    end = F.right(F.col("id"), F.lit(2))
    return nodes(spark, d).select(
        F.when(end == "77", "").otherwise(F.col("id")).alias("id"), F.when(end != "33", F.col("label")).alias("label"), F.when(end == "55", "tool").otherwise(F.col("file_type")).alias("file_type"), "source_file"
    )


def raw_edges(spark, d):
    """The edges with faults sown in."""
    return edges(spark, d).withColumn("target", F.when(F.right("target", F.lit(2)) == "99", F.concat("target", F.lit("-gone"))).otherwise(F.col("target"))).withColumn("confidence", F.when(F.right("source", F.lit(2)) == "11", "MAYBE").otherwise(F.col("confidence")))


@query("validate_nodes", f"""WITH {NODES_SQL}, {_RAW_NODES}
SELECT id, 'missing id' AS problem FROM raw WHERE id = '' UNION ALL SELECT id, 'missing label' FROM raw WHERE label IS NULL UNION ALL SELECT id, 'invalid file_type' FROM raw WHERE file_type NOT IN ({_list(vocab.FILE_TYPES)})""")
def validate_nodes(spark, d):
    return V.validate_nodes(raw_nodes(spark, d))


@query("validate_edges", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_RAW_EDGES}
SELECT source, target, relation, 'invalid confidence' AS problem FROM rawe WHERE confidence = 'MAYBE' UNION ALL SELECT source, target, relation, 'unknown target' FROM rawe WHERE target NOT IN (SELECT id FROM nodes) UNION ALL SELECT source, target, relation, 'unknown source' FROM rawe WHERE source NOT IN (SELECT id FROM nodes)""")
def validate_edges(spark, d):
    return V.validate_edges(raw_edges(spark, d), nodes(spark, d))


@query("dangling_edges", f"WITH {NODES_SQL}, {EDGES_SQL}, {_RAW_EDGES} SELECT relation, target, count(*) AS n FROM rawe WHERE target NOT IN (SELECT id FROM nodes) OR source NOT IN (SELECT id FROM nodes) GROUP BY ALL")
def dangling_edges(spark, d):
    return V.dangling(raw_edges(spark, d), nodes(spark, d)).groupBy("relation", "target").agg(F.count(F.lit(1)).alias("n"))


@query("edge_diagnostics", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_RAW_EDGES}, ok AS (SELECT * FROM rawe WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
dp AS (SELECT source, target, count(*) AS n FROM ok GROUP BY ALL), up AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM ok GROUP BY ALL), ex AS (SELECT count(*) AS n FROM rawe GROUP BY source, target, relation, confidence, context, weight, source_file)
SELECT (SELECT count(*) FROM rawe) AS raw_edges, 0::bigint AS missing_endpoint_edges, (SELECT count(*) FROM rawe) - (SELECT count(*) FROM ok) AS dangling_endpoint_edges, (SELECT count(*) FROM ok) AS valid_edges,
 (SELECT count(*) FROM ok WHERE source = target) AS self_loops, (SELECT count(*) FROM dp) AS directed_pairs, (SELECT sum(n - 1)::bigint FROM dp) AS directed_collapsed, (SELECT count(*) FROM dp WHERE n > 1) AS same_endpoint_groups,
 (SELECT count(*) FROM up) AS undirected_pairs, (SELECT sum(n - 1)::bigint FROM up) AS undirected_collapsed, (SELECT sum(n - 1)::bigint FROM ex) AS exact_duplicates""")
def edge_diagnostics(spark, d):
    return V.diagnostics(raw_edges(spark, d), nodes(spark, d))


@query("edge_variants", f"""WITH {EDGES_SQL}, g AS (SELECT source, target, relation, count(DISTINCT source_file) AS f, count(DISTINCT context) AS c, count(*) AS n FROM edges GROUP BY ALL),
p AS (SELECT source, target, count(*) AS relations, count_if(f > 1) AS file_variants, count_if(c > 1) AS context_variants, sum(n)::bigint AS edges FROM g GROUP BY ALL) SELECT * FROM p WHERE relations > 1 OR file_variants > 0 OR context_variants > 0""")
def edge_variants(spark, d):
    return V.edge_variants(edges(spark, d))


@query("language_guard", f"""WITH {NODES_SQL}, {EDGES_SQL}, f AS (SELECT id, lower(regexp_extract(regexp_extract(source_file, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS x FROM nodes), g AS (SELECT id, x, {_case("x", vocab.BUILD_FAMILY)} AS fam FROM f)
SELECT relation, count(*) AS n FROM edges LEFT JOIN g s ON source = s.id LEFT JOIN g t ON target = t.id WHERE NOT coalesce(relation IN ('imports', 'imports_from', 'references') AND s.fam <> t.fam, false) AND NOT coalesce(relation = 'calls' AND confidence = 'INFERRED' AND s.x <> '' AND t.x <> '' AND s.fam IS DISTINCT FROM t.fam, false) GROUP BY relation""")
def language_guard(spark, d):
    return V.language_guard(edges(spark, d), nodes(spark, d)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_endpoints", f"""WITH {NODES_SQL}, {EDGES_SQL}, e AS (SELECT CASE WHEN relation = 'calls' THEN upper(replace(source, ':', ' / ')) ELSE source END AS source, target, relation FROM edges WHERE relation <> 'uses'),
n AS (SELECT lower(trim(regexp_replace(id, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS norm, min(id) AS id FROM nodes GROUP BY 1 HAVING count(*) = 1)
SELECT coalesce(x.id, n.id) AS source, target, relation FROM e LEFT JOIN nodes x ON e.source = x.id LEFT JOIN n ON x.id IS NULL AND n.norm = lower(trim(regexp_replace(e.source, '[^a-zA-Z0-9]+', '_', 'g'), '_')) WHERE coalesce(x.id, n.id) IS NOT NULL""")
def resolve_endpoints(spark, d):
    loose = F.when(F.col("relation") == "calls", F.upper(F.replace("source", F.lit(":"), F.lit(" / ")))).otherwise(F.col("source"))
    e = edges(spark, d).where("relation <> 'uses'").select(loose.alias("source"), "target", "relation")
    return B.resolve_endpoints(e, nodes(spark, d)).select("source", "target", "relation")


@query("build_simple_graph", f"""WITH {EDGES_SQL}, r AS (SELECT least(source, target) AS a, greatest(source, target) AS b, *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY source DESC, target DESC, relation DESC, weight DESC, confidence DESC, context DESC) AS k, count(*) OVER (PARTITION BY least(source, target), greatest(source, target)) AS parallel FROM edges)
SELECT a, b, relation, confidence, context, weight, source_file, parallel FROM r WHERE k = 1""")
def build_simple_graph(spark, d):
    return B.simple_graph(edges(spark, d))


@query("dedupe_edges_first", f"WITH {EDGES_SQL} SELECT source, target, relation, min(weight) AS weight FROM edges GROUP BY ALL")
def dedupe_edges_first(spark, d):
    return B.dedupe_edges(edges(spark, d), ["weight"]).select("source", "target", "relation", "weight")


@query("dedupe_nodes_last", f"WITH {NODES_SQL} SELECT label AS id, max(id) AS last FROM nodes GROUP BY label")
def dedupe_nodes_last(spark, d):
    named = nodes(spark, d).select(F.col("label").alias("id"), F.col("id").alias("last"))
    return B.dedupe_nodes(named, ["last"])


_ORIGIN = "o AS (SELECT id, label, source_file, CASE WHEN right(id, 1) IN ('0', '1', '2') THEN 'ast' ELSE 'llm' END AS origin FROM nodes WHERE starts_with(id, 'part:'))"


@query("ghost_merge", f"""WITH {NODES_SQL}, {_ORIGIN}, a AS (SELECT source_file, label, min(id) AS id FROM o WHERE origin = 'ast' GROUP BY ALL HAVING count(*) = 1)
SELECT o.id AS ghost, a.id FROM o JOIN a USING (source_file, label) WHERE origin <> 'ast'""")
def ghost_merge(spark, d):
    origin = F.when(F.right("id", F.lit(1)).isin("0", "1", "2"), "ast").otherwise("llm")
    return B.ghost_merge(nodes(spark, d).where(F.col("id").startswith("part:")).withColumn("origin", origin))


@query("id_collision_survivor", f"""WITH {NODES_SQL}, c AS (SELECT 'p' || right(id, 3) AS id, label, source_file FROM nodes WHERE starts_with(id, 'part:')), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(label), label, source_file) AS k FROM c) SELECT id, label, source_file FROM r WHERE k = 1""")
def id_collision_survivor(spark, d):
    parts = nodes(spark, d).where(F.col("id").startswith("part:"))
    return B.id_survivors(parts.select(F.concat(F.lit("p"), F.right("id", F.lit(3))).alias("id"), "label", "source_file"))


_OLD = "old AS (SELECT id, source_file, label FROM nodes WHERE NOT starts_with(id, 'supplier:'))"
_NEW = "fresh AS (SELECT id, source_file, upper(label) AS label FROM nodes WHERE starts_with(id, 'customer:') OR starts_with(id, 'supplier:'))"


def _old_new(spark, d):
    n = nodes(spark, d).select("id", "source_file", "label")
    return n.where(~F.col("id").startswith("supplier:")), n.where(F.col("id").startswith("customer:") | F.col("id").startswith("supplier:")).withColumn("label", F.upper("label"))


@query("incremental_merge", f"WITH {NODES_SQL}, {_OLD}, {_NEW} SELECT * FROM old WHERE source_file NOT IN (SELECT source_file FROM fresh) AND source_file <> 'geo/nation.md' UNION ALL SELECT * FROM fresh")
def incremental_merge(spark, d):
    old, new = _old_new(spark, d)
    return B.incremental_merge(old, new, spark.createDataFrame([("geo/nation.md",)], "source_file string"))


@query("compose_graphs", f"WITH {NODES_SQL}, {_OLD}, {_NEW} SELECT * FROM old WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh")
def compose_graphs(spark, d):
    return B.compose(*_old_new(spark, d), ["id"])


@query("global_prefix", f"WITH {NODES_SQL} SELECT 'shop::' || id AS id, id AS local_id, 'shop' AS repo, label FROM nodes")
def global_prefix(spark, d):
    return B.global_prefix(nodes(spark, d), "shop").select("id", "local_id", "repo", "label")


@query("graph_diff_nodes", f"WITH {NODES_SQL}, {_OLD}, {_NEW} SELECT id, 'added' AS change FROM fresh WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT id, 'removed' FROM old WHERE id NOT IN (SELECT id FROM fresh)")
def graph_diff_nodes(spark, d):
    return B.diff(*_old_new(spark, d), ["id"])


@query("graph_diff_edges", f"""WITH {EDGES_SQL}, o AS (SELECT DISTINCT source, target, relation FROM edges WHERE context <> 'import'), n AS (SELECT DISTINCT source, target, relation FROM edges WHERE context <> 'call')
SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def graph_diff_edges(spark, d):
    e = edges(spark, d)
    return B.diff(e.where("context <> 'import'"), e.where("context <> 'call'"), ["source", "target", "relation"])


@query("hyperedge_filter", """WITH m AS (SELECT l_orderkey, list('part:' || l_partkey ORDER BY l_linenumber, l_partkey) AS ms FROM lineitem GROUP BY ALL), k AS (SELECT l_orderkey, list_filter(ms, lambda x: right(x, 1) <> '7') AS ms FROM m)
SELECT 'order:' || l_orderkey AS id, array_to_string(ms, ' ') AS members FROM k WHERE len(ms) >= 2""")
def hyperedge_filter(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    hyper = line.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("id"), F.transform("m", lambda x: F.concat(F.lit("part:"), x["l_partkey"].cast("string"))).alias("members"))
    known = nodes(spark, d).where(F.right("id", F.lit(1)) != "7")
    return B.filter_hyperedges(hyper, known, 2).select("id", F.array_join("members", " ").alias("members"))


@query("rationale_fold", f"""SELECT 'customer:' || o_custkey AS id, string_agg('Order ' || o_orderkey, chr(10) ORDER BY 'order:' || o_orderkey) AS rationale FROM orders GROUP BY o_custkey""")
def rationale_fold(spark, d):
    e = edges(spark, d).where("relation = 'calls'").withColumn("relation", F.lit("rationale_for"))
    kept, _ = B.fold_rationale(nodes(spark, d), e)
    return kept.where("rationale IS NOT NULL").select("id", "rationale")


@query("file_label_disambiguate", f"""WITH {FILES_SQL}, p AS (SELECT DISTINCT regexp_replace(path, '[0-9]+', (doc_id % 40)::varchar, 'g') AS path FROM files), s AS (SELECT path, unnest(generate_series(1, len(string_split(path, '/')))) AS k FROM p),
x AS (SELECT path, k, array_to_string(string_split(path, '/')[-k:], '/') AS label FROM s), a AS (SELECT label, min(path) AS path, min(k) AS k FROM x GROUP BY label HAVING count(*) = 1) SELECT p.path, coalesce(arg_min(label, k), p.path) AS label FROM p LEFT JOIN a USING (path) GROUP BY p.path""")
def file_label_disambiguate(spark, d):
    paths = files(spark, d).select(F.regexp_replace("path", F.lit("[0-9]+"), (F.col("doc_id") % 40).cast("string")).alias("path"))
    return B.unique_file_labels(paths)


_MANIFEST = "m AS (SELECT path, md5(text) AS sha FROM files WHERE doc_id % 5 <> 0), now AS (SELECT path, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS sha FROM files WHERE doc_id % 11 <> 0)"


@query("incremental_scan", f"WITH {FILES_SQL}, {_MANIFEST} SELECT coalesce(m.path, now.path) AS path, CASE WHEN m.path IS NULL THEN 'new' WHEN now.path IS NULL THEN 'deleted' WHEN m.sha <> now.sha THEN 'changed' ELSE 'unchanged' END AS status FROM m FULL JOIN now USING (path)")
def incremental_scan(spark, d):
    from weft.sources.files import scan_changes

    f = files(spark, d)
    before = f.where("doc_id % 5 <> 0").select("path", F.md5(F.col("text").cast("binary")).alias("sha"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    now = f.where("doc_id % 11 <> 0").select("path", F.md5(changed.cast("binary")).alias("sha"))
    return scan_changes(now, before)


@query("cache_miss_split", f"WITH {FILES_SQL} SELECT doc_id, sha256(encode(text) || '\\x00'::blob || encode(path)) IN (SELECT sha256(encode(text) || '\\x00'::blob || encode(path)) FROM files WHERE doc_id % 3 = 0) AS hit FROM files")
def cache_miss_split(spark, d):
    from weft.sources.files import cache_split

    f = files(spark, d)
    return cache_split(f, f.where("doc_id % 3 = 0")).select("doc_id", "hit")


@query("stale_sources", f"WITH {NODES_SQL} SELECT source_file, count(*) AS nodes FROM nodes WHERE source_file <> '' AND source_file NOT IN (SELECT 'catalog/' || p_brand || '.md' FROM part WHERE p_size > 10) GROUP BY ALL")
def stale_sources(spark, d):
    scan = table(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("catalog/"), "p_brand", F.lit(".md")).alias("source_file"))
    n = nodes(spark, d).where("source_file <> ''")
    return n.join(scan, "source_file", "left_anti").groupBy("source_file").agg(F.count(F.lit(1)).alias("nodes"))


@query("shrink_guard", f"WITH {NODES_SQL}, {_OLD}, {_NEW} SELECT id, source_file FROM old WHERE id NOT IN (SELECT id FROM fresh) AND source_file <> '' AND source_file <> 'sales/orders.py'")
def shrink_guard(spark, d):
    return V.shrink_guard(*_old_new(spark, d), spark.createDataFrame([("sales/orders.py",)], "source_file string"))


@query("reconcile_sources", f"""WITH {FILES_SQL} SELECT 'd' || doc_id AS id, path AS source_file, 'old' AS state FROM files WHERE doc_id % 6 > 0 AND doc_id % 3 < 2
UNION ALL SELECT 'd' || doc_id, path, 'new' FROM files WHERE doc_id % 12 = 0""")
def reconcile_sources(spark, d):
    f = files(spark, d)
    row = lambda df, state: df.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("path").alias("source_file"), F.lit(state).alias("state"))
    paths = lambda condition: f.where(condition).select(F.col("path").alias("source_file"))
    # a third is collected, another third only on disk, the last third gone; half of the first is read anew, half of that empty now
    return B.reconcile(row(f, "old"), row(f.where("doc_id % 12 = 0"), "new"), paths("doc_id % 6 = 0"), paths("doc_id % 3 = 0"), paths("doc_id % 3 < 2"), ["id"])
