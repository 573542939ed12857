"""Queries of what drawings and reports of a graph need."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import degree as D
from weft.operators import diagram as V
from weft.operators import search as S
from weft.plans.q_graph import _DEG, _INSIDE
from weft.plans.q_search import _SCORES, QUESTION
from weft.plans.registry import query
from weft.plans.tables import COMMUNITIES_SQL, EDGES_SQL, NODES_SQL, communities, edges, nodes, table



def _score():
    return F.col("weight") / 100 + 0.5


@query("drawn_edges", f"""WITH {EDGES_SQL}, s AS (SELECT *, weight / 100 + 0.5 AS score FROM edges) SELECT source, target, relation, confidence, round(score + CASE confidence WHEN 'EXTRACTED' THEN 2 ELSE 0 END + CASE WHEN relation IN ('calls', 'uses') THEN 1 WHEN relation = 'imports_from' THEN 0.6 WHEN relation = 'contains' THEN -0.2 ELSE 0 END, 6) AS rank,
 confidence = 'EXTRACTED' OR (confidence = 'INFERRED' AND score >= 0.85) AS shown FROM s""")
def drawn_edges(spark, d):
    rank = F.round(V.rank(F.col("relation"), F.col("confidence"), _score()), 6)
    return edges(spark, d).select("source", "target", "relation", "confidence", rank.alias("rank"), V.shown(F.col("confidence"), _score()).alias("shown"))


@query("section_edges", f"""WITH {EDGES_SQL}, {COMMUNITIES_SQL}, s AS (SELECT node_id, 's' || community % 5 AS section FROM communities WHERE community < 20)
SELECT source, target, relation, a.section AS source_section, b.section AS target_section, CASE WHEN a.section IS NULL OR b.section IS NULL THEN 'orphan' WHEN a.section = b.section THEN 'intra' ELSE 'inter' END AS kind FROM edges LEFT JOIN s a ON source = a.node_id LEFT JOIN s b ON target = b.node_id""")
def section_edges(spark, d):
    sections = communities(spark, d).where("community < 20").select("node_id", F.concat(F.lit("s"), (F.col("community") % 5).cast("string")).alias("section"))
    return V.section_edges(edges(spark, d).select("source", "target", "relation"), sections)


@query("meta_edges", f"WITH {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, {_INSIDE}, m AS (SELECT least(ca, cb) AS c1, greatest(ca, cb) AS c2, count(*) AS n FROM x WHERE ca <> cb GROUP BY ALL) SELECT c1::varchar AS source, c2::varchar AS target, n AS weight, n || ' cross-community edges' AS relation, 'AGGREGATED' AS confidence FROM m")
def meta_edges(spark, d):
    return V.meta_edges(edges(spark, d), communities(spark, d))


@query("meta_hyperedges", f"""WITH {COMMUNITIES_SQL}, m AS (SELECT 'order:' || l_orderkey AS id, community, min(row(l_linenumber, l_partkey)) AS pos FROM lineitem JOIN communities ON node_id = 'part:' || l_partkey GROUP BY ALL)
SELECT id, string_agg(community::varchar, ' ' ORDER BY pos) AS members FROM m GROUP BY id HAVING count(*) > 1""")
def meta_hyperedges(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    hyper = line.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("id"), F.transform("m", lambda x: F.concat(F.lit("part:"), x["l_partkey"].cast("string"))).alias("members"))
    return V.meta_hyperedges(hyper, communities(spark, d)).select("id", F.array_join("members", " ").alias("members"))


@query("report_counters", f"""WITH {NODES_SQL}, c AS (SELECT id, label, source_file, split_part(id, ':', 2)::bigint % 9973 AS community FROM nodes), s AS (SELECT community, count_if(NOT (source_file <> '' AND label = regexp_extract(source_file, '[^/]*$'))) AS n FROM c GROUP BY 1)
SELECT count(*) AS communities, count_if(n = 0) AS empty, count_if(n BETWEEN 1 AND 2) AS thin, count(*) - count_if(n BETWEEN 1 AND 2) AS shown FROM s""")
def report_counters(spark, d):
    n = nodes(spark, d)
    groups = n.select(F.col("id").alias("node_id"), (F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 9973).alias("community"))
    return V.report_counters(n, edges(spark, d), groups)


@query("inferred_average", f"WITH {EDGES_SQL} SELECT count(*) AS edges, round(avg(CASE WHEN weight > 40 THEN 0.5 ELSE weight / 100 + 0.5 END), 2) AS average FROM edges WHERE confidence = 'INFERRED'")
def inferred_average(spark, d):
    return V.inferred_average(edges(spark, d).withColumn("confidence_score", F.when(F.col("weight") <= 40, _score())))


_SIGNED = "left(sha256(string_agg(node_id || chr(0), '' ORDER BY node_id)), 16)"


@query("stale_labels", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, {COMMUNITIES_SQL}, was AS (SELECT community, 'Saved ' || community AS label, {_SIGNED} AS signature FROM communities WHERE community <> 4 AND NOT (community % 3 = 0 AND right(node_id, 1) = '3') GROUP BY 1),
now AS (SELECT community, {_SIGNED} AS signature FROM communities GROUP BY 1), hub AS (SELECT community, label FROM nodes JOIN communities ON id = node_id LEFT JOIN deg USING (id) QUALIFY row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) = 1)
SELECT community, CASE WHEN was.signature = now.signature THEN was.label ELSE hub.label END AS label, was.signature IS DISTINCT FROM now.signature AS stale FROM now LEFT JOIN was USING (community) LEFT JOIN hub USING (community)""")
def stale_labels(spark, d):
    now = communities(spark, d)
    before = now.where("community <> 4 AND NOT (community % 3 = 0 AND right(node_id, 1) = '3')")
    saved = D.signatures(before).withColumn("label", F.concat(F.lit("Saved "), F.col("community").cast("string")))
    return V.fresh_labels(saved, nodes(spark, d), edges(spark, d), now)


@query("explain_rest", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, x AS (SELECT 'out' AS direction, relation, target AS id, min(source_file) AS source_file FROM edges WHERE source = 'supplier:3' GROUP BY ALL UNION ALL SELECT 'in', relation, source, min(source_file) FROM edges WHERE target = 'supplier:3' GROUP BY ALL),
r AS (SELECT x.direction, x.source_file, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, id, direction, relation) AS place FROM x JOIN nodes USING (id) LEFT JOIN deg USING (id)) SELECT direction, source_file, count(*) AS links FROM r WHERE place > 20 GROUP BY ALL ORDER BY links DESC, direction, source_file LIMIT 20""")
def explain_rest(spark, d):
    return S.explain_rest(nodes(spark, d), edges(spark, d), "supplier:3")


@query("ambiguous_match", f"""WITH {_SCORES}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC, length(label), id) AS k FROM sc WHERE score > 0), t AS (SELECT max(CASE k WHEN 1 THEN score END) AS top, max(CASE k WHEN 2 THEN score END) AS runner FROM r)
SELECT round(top, 6) AS top, round(runner, 6) AS runner, coalesce((top - runner) / top < 0.1, false) AS ambiguous FROM t""")
def ambiguous_match(spark, d):
    found = S.ambiguity(nodes(spark, d), S.terms_of(QUESTION))
    return found.select(F.round("top", 6).alias("top"), F.round("runner", 6).alias("runner"), "ambiguous")


@query("sentence_labels", f"""WITH {NODES_SQL}, v AS (SELECT id, label FROM nodes UNION ALL SELECT 'doc:' || doc_id, text FROM documents UNION ALL SELECT 'turn:' || conv_id || ':' || turn, text FROM conversations), t AS (SELECT id, regexp_replace(coalesce(label, ''), '^\\s+|\\s+$', '', 'g') AS label FROM v)
SELECT id, (length(label) >= 80 OR len(regexp_extract_all(label, '[^\\s]+')) >= 8) AND regexp_matches(label, '[.!?:]') AS sentence FROM t""")
def sentence_labels(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "text")
    turns = table(spark, d, "conversations").select(F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")), "text")
    return nodes(spark, d).select("id", "label").union(docs).union(turns).select("id", T.is_sentence(F.col("label")).alias("sentence"))


@query("cost_estimate", """WITH p AS (SELECT * FROM (VALUES ('src0', 3.0, 15.0), ('src3', 0.25, 1.25), ('src5', 1.0, 5.0)) v(source, a, b)) SELECT doc_id, round(coalesce((length(text) * a + len(regexp_extract_all(text, '[^\\s]+')) * b) / 1000000, 0), 9)::double AS cost FROM documents LEFT JOIN p USING (source)""")
def cost_estimate(spark, d):
    prices = spark.createDataFrame([("src0", 3.0, 15.0), ("src3", 0.25, 1.25), ("src5", 1.0, 5.0)], "source string, price_in double, price_out double")
    docs = table(spark, d, "documents").join(F.broadcast(prices), "source", "left")  # a row a model
    cost = T.cost(F.length("text"), T.word_count(F.col("text")), F.col("price_in"), F.col("price_out"))
    return docs.select("doc_id", F.round(cost, 9).alias("cost"))
