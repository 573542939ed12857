"""Graphs as text: rows for scripts, notes and pages, written by Spark in parallel or as one small file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import degree as D


def _xml(value):
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """place, line: a MERGE statement for each node, then for each edge."""
    label = F.initcap(F.regexp_replace(F.coalesce("file_type", F.lit("concept")), "[^A-Za-z]", ""))
    n = nodes.select(F.lit(0).alias("place"), F.concat(F.lit("MERGE (n:"), label, F.lit(" {id: '"), T.cypher_string(F.col("id")), F.lit("'}) SET n.label = '"), T.cypher_string(F.col("label")), F.lit("';")).alias("line"))
    relation = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    e = edges.select(F.lit(1), F.concat(F.lit("MATCH (a {id: '"), T.cypher_string(F.col("source")), F.lit("'}), (b {id: '"), T.cypher_string(F.col("target")), F.lit("'}) MERGE (a)-[:"), relation, F.lit(" {confidence: '"), F.col("confidence"), F.lit("'}]->(b);")))
    return n.union(e)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """place, line: the elements of a GraphML document, nodes before edges."""
    n = nodes.select(F.lit(0).alias("place"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="label">'), _xml(F.col("label")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(1), F.concat(F.lit('<edge source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('"><data key="relation">'), _xml(F.col("relation")), F.lit("</data></edge>")))
    return n.union(e)


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """place, line: the members of a node-link JSON document, nodes before links."""
    return nodes.select(F.lit(0).alias("place"), F.to_json(F.struct(*nodes.columns)).alias("line")).union(edges.select(F.lit(1), F.to_json(F.struct(*edges.columns))))


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, body: a note for each node, with links to all its neighbours, by their ids."""
    name = F.regexp_replace("label", r'[\\/*?:"<>|#^\[\]]', "_")
    named = nodes.select("id", "label", "file_type", "source_file", F.concat(name, F.lit(" "), F.substring(F.sha1(F.col("id").cast("binary")), 1, 6)).alias("name"))
    both = edges.select(F.col("source").alias("id"), "relation", F.col("target").alias("other")).union(edges.select("target", "relation", "source")).distinct()
    other = named.select(F.col("id").alias("other"), F.col("name").alias("to"))
    lines = both.join(other, "other").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", "relation", "to"))), lambda x: F.concat(F.lit("- "), x["relation"], F.lit(" [["), x["to"], F.lit("]]"))), "\n").alias("links"))
    head = F.concat(F.lit("---\ntype: "), "file_type", F.lit("\nsource: "), T.yaml_string(F.col("source_file")), F.lit("\n---\n# "), "label", F.lit("\n\n"))
    return named.join(lines, "id", "left").select("name", F.concat(head, F.coalesce("links", F.lit(""))).alias("body"))


def wiki(nodes: DataFrame, edges: DataFrame, communities: DataFrame, labels: int = 8) -> DataFrame:
    """community, title, size, body: an article for each community, with its best-linked members and its ties to others."""
    members = D.with_degree(nodes, edges).join(communities, F.col("id") == F.col("node_id"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    best = members.withColumn("k", place).where(F.col("k") <= labels)
    top = best.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("top"))
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    ties = D.community_matrix(edges, communities)
    ties = ties.select(F.col("c1").alias("community"), F.col("c2").alias("other"), "links").union(ties.select("c2", "c1", "links"))
    ties = ties.groupBy("community").agg(F.array_sort(F.collect_list(F.struct((-F.col("links")).alias("n"), "other"))).alias("ties"))
    body = F.concat(
        F.lit("## Members\n"), F.array_join(F.transform("top", lambda x: F.concat(F.lit("- "), x["label"])), "\n"),
        F.lit("\n## Ties\n"), F.array_join(F.transform(F.coalesce("ties", F.array().cast("array<struct<n:bigint,other:int>>")), lambda x: F.concat(F.lit("- Community "), x["other"].cast("string"), F.lit(": "), (-x["n"]).cast("string"))), "\n"),
    )
    return top.join(sizes, "community").join(ties, "community", "left").select("community", F.get("top", 0)["label"].alias("title"), "size", body.alias("body"))


def report(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> str:
    """A report in Markdown of the graph's figures; only bounded results come to the driver."""
    lines = ["# Graph report", "", "## Best-connected nodes"]
    lines += [f"- {r['label']} ({r['degree']})" for r in D.god_nodes(nodes, edges).collect()]
    lines += ["", "## Confidence"] + [f"- {r['confidence']}: {r['edges']} ({r['percent']} %)" for r in D.confidence_audit(edges).orderBy("confidence").collect()]
    lines += ["", "## Largest communities"]
    lines += [f"- Community {r['community']}: {r['size']} nodes, cohesion {r['cohesion']:.3f}" for r in D.cohesion(edges, communities).orderBy(F.desc("size"), "community").limit(20).collect()]
    return "\n".join(lines) + "\n"


def lessons(scores: DataFrame, most: int = 50) -> str:
    """The lessons in Markdown: the `most` first nodes of each status."""
    place = F.row_number().over(Window.partitionBy("status").orderBy(F.desc("score"), "node"))
    rows = scores.withColumn("k", place).where(F.col("k") <= most).orderBy("status", "k").collect()
    lines, status = ["# Lessons"], None
    for r in rows:
        if r["status"] != status:
            status = r["status"]
            lines += ["", f"## {status}"]
        lines.append(f"- {r['node']} ({r['score']:+.3f})")
    return "\n".join(lines) + "\n"


def write_lines(lines: DataFrame, path: str) -> None:
    """Write rows of place and line as text, in the order of their places; a folder of parts, by Spark."""
    lines.repartitionByRange("place", "line").sortWithinPartitions("place", "line").select("line").write.mode("overwrite").text(path)
