"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.plans.registry import query
from weft.plans.tables import COMMUNITIES_SQL, EDGES_SQL, FILES_SQL, NODES_SQL, communities, edges, files, nodes, table
from weft.sources import documents, languages, sinks
from weft.sources.files import apply_ignores, ignore_pattern


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"''#]+)', 1)) AS href FROM pages""")
def page_links(spark, d):
    return documents.page_links(table(spark, d, "pages"))


@query("extract_facts", f"WITH {FILES_SQL} SELECT path AS file, count(*) AS n FROM files GROUP BY path")
def extract_facts(spark, d):
    return languages.extract(files(spark, d)).where("kind = 'node'").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("read_graph_json", f"WITH {NODES_SQL} SELECT id, label, file_type, source_file FROM nodes")
def read_graph_json(spark, d):
    doc = nodes(spark, d).select(F.to_json(F.struct(F.array(F.struct(F.col("id"), F.col("label").alias("name"), "file_type", F.col("source_file").alias("path"))).alias("nodes"))).alias("text"))
    return documents.read_graph(doc)[0]


@query("cypher_script", f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT 0 AS place, 'MERGE (n:' || upper(file_type[1]) || file_type[2:] || ' {{id: ''' || id || '''}}) SET n.label = ''' || label || ''';' AS line FROM nodes
UNION ALL SELECT 1, 'MATCH (a {{id: ''' || source || '''}}), (b {{id: ''' || target || '''}}) MERGE (a)-[:' || upper(relation) || ' {{confidence: ''' || confidence || '''}}]->(b);' FROM edges""")
def cypher_script(spark, d):
    return sinks.cypher(nodes(spark, d), edges(spark, d))


@query("graphml", f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT 0 AS place, '<node id="' || id || '"><data key="label">' || label || '</data></node>' AS line FROM nodes UNION ALL SELECT 1, '<edge source="' || source || '" target="' || target || '"><data key="relation">' || relation || '</data></edge>' FROM edges""")
def graphml(spark, d):
    return sinks.graphml(nodes(spark, d), edges(spark, d))


@query("wiki_articles", f"WITH {COMMUNITIES_SQL} SELECT community, count(*) AS size FROM communities GROUP BY 1")
def wiki_articles(spark, d):
    return sinks.wiki(nodes(spark, d), edges(spark, d), communities(spark, d)).select("community", "size")


@query("vault_notes", f"WITH {NODES_SQL} SELECT regexp_replace(label, '[\\\\/*?:\"<>|#^\\[\\]]', '_', 'g') || ' ' || substr(sha1(id), 1, 6) AS name FROM nodes")
def vault_notes(spark, d):
    return sinks.notes(nodes(spark, d), edges(spark, d)).select("name")


_IGNORES = ["*.png", "secrets/", "!secrets/deploy_4.yaml", "docs/**/note_*", "!docs/guide/note_1.md", "/web", "media/talk?.mp4"]


@query("ignore_rules", f"""WITH {FILES_SQL} SELECT path, ends_with(path, '.png') OR starts_with(path, 'secrets/') OR (regexp_matches(path, '^docs/(.*/)?note_[^/]*$') AND path <> 'docs/guide/note_1.md') OR regexp_matches(path, '(^|/)web/') OR regexp_matches(path, '^media/talk[^/]\\.mp4$') AS ignored FROM files""")
def ignore_rules(spark, d):
    rows = [("", *p, i) for i, p in enumerate(map(ignore_pattern, _IGNORES)) if p]
    patterns = spark.createDataFrame(rows, "base string, regex string, negated boolean, dirs_only boolean, place int")
    return apply_ignores(files(spark, d).select("path"), patterns)


@query("manifest_dependencies", "SELECT DISTINCT 'package_' || lower(trim(regexp_replace(p_brand, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS source, 'package_' || lower(trim(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS target, 'depends_on' AS relation FROM part")
def manifest_dependencies(spark, d):
    part = table(spark, d, "part").select("p_brand", F.replace("p_name", F.lit(" "), F.lit("-")).alias("dep"))
    text = F.concat(F.lit('{"name": "'), "p_brand", F.lit('", "dependencies": {"'), "dep", F.lit('": "1"}}'))
    return documents.manifest_edges(part.select(F.concat("p_brand", F.lit("/package.json")).alias("path"), text.alias("text")))


@query("memory_notes", "SELECT event_id AS doc_id, 'about ' || event_type AS question, CASE WHEN value > 10 THEN 'useful' ELSE 'dead_end' END AS outcome, 'customer:' || user_id || ',event' AS cited FROM events")
def memory_notes(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit("---\ntype: query\ndate: 2024-01-02\nquestion: \""), F.lit("about "), "event_type", F.lit("\"\noutcome: "), F.when(F.col("value") > 10, "useful").otherwise("dead_end"), F.lit("\nsource_nodes: [\"customer:"), F.col("user_id").cast("string"), F.lit("\", \"event\"]\n---\nbody"))
    notes = documents.parse_memory(e.select(F.col("event_id").alias("doc_id"), text.alias("text")))
    return notes.select("doc_id", "question", "outcome", F.array_join("source_nodes", ",").alias("cited"))


@query("tool_servers", "SELECT 'srv' || n_nationkey AS server, 'npx' AS command, 'pkg-' || n_nationkey AS package, 'KEY_' || n_regionkey AS env FROM nation")
def tool_servers(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit('{"mcpServers": {"srv'), k, F.lit('": {"command": "npx", "args": ["-y", "pkg-'), k, F.lit('"], "env": {"KEY_'), F.col("n_regionkey").cast("string"), F.lit('": "x"}}}}'))
    return documents.tool_servers(n.select(text.alias("text")))


@query("symbol_index", """SELECT 'f' || n_regionkey || '#s' || n_nationkey AS source, CASE WHEN n_regionkey = (n_nationkey + 1) % 25 % 5 AND false THEN '' ELSE coalesce('f' || m.r || '#s' || ((n_nationkey + 1) % 30), 'stub#s' || ((n_nationkey + 1) % 30)) END AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'scip_impl' ELSE 'scip_ref' END AS relation, m.r IS NOT NULL AS known
FROM nation LEFT JOIN (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) m ON m.k = (n_nationkey + 1) % 30""")
def symbol_index(spark, d):
    n = table(spark, d, "nation")
    symbol = lambda x: F.concat(F.lit("s"), x.cast("string"))
    rel = F.struct(symbol((F.col("n_nationkey") + 1) % 30).alias("symbol"), (F.col("n_nationkey") % 2 == 0).alias("is_implementation"))
    doc = F.struct(F.array(F.struct(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("relative_path"), F.array(F.struct(symbol(F.col("n_nationkey")).alias("symbol"), F.array(rel).alias("relationships"))).alias("symbols"))).alias("documents"))
    return documents.symbol_edges(n.select(F.to_json(doc).alias("text")))


@query("html_markdown", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS n FROM pages")
def html_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(T.html_text(F.col("html"))).cast("long").alias("n"))
