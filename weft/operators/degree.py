"""Degrees, counts and communities' figures over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vocab


def pairs(edges: DataFrame) -> DataFrame:
    """The unordered pairs (a <= b) that edges link, each once."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree in the simple graph; a self-loop counts twice."""
    return pairs(edges).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def is_file_node() -> Column:
    """Whether a node (label, source_file, degree) stands for a file or is a mere method stub."""
    label, path = F.col("label"), F.col("source_file")
    file_label = (path != "") & ((label == T.basename(path)) | path.endswith(F.concat(F.lit("/"), label)))
    stub = (label.startswith(".") & label.endswith("()")) | (label.endswith("()") & (F.col("degree") <= 1))
    return F.coalesce((label != "") & (file_label | stub), F.lit(False))


def is_concept_node() -> Column:
    path = F.coalesce(F.col("source_file"), F.lit(""))
    return (path == "") | ~T.basename(path).contains(".")


def is_noise_node() -> Column:
    json_key = F.lower("source_file").endswith(".json") & F.lower(F.trim("label")).isin(*vocab.JSON_NOISE)
    return json_key | F.col("label").isin(*vocab.BUILTIN_NOISE)


def god_nodes(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The n best-connected real entities: id, label, degree. Ties go to the lesser id."""
    real = with_degree(nodes, edges).where(~(is_file_node() | is_concept_node() | F.coalesce(is_noise_node(), F.lit(False))))
    return real.select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(n)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric and value: numbers of nodes and edges, and nodes by file type."""
    kinds = nodes.groupBy(F.concat(F.lit("nodes "), "file_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    relations = edges.groupBy(F.concat(F.lit("edges "), "relation").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return kinds.union(relations)


def confidence_audit(edges: DataFrame) -> DataFrame:
    """confidence, edges and percent (half-even) of all edges."""
    counts = edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("edges"))
    return counts.withColumn("percent", F.bround(100 * F.col("edges") / F.sum("edges").over(Window.partitionBy()), 0).cast("int"))


def _communities(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Simple edges with the communities of both ends."""
    side = lambda end, name: communities.select(F.col("node_id").alias(end), F.col("community").alias(name))
    return pairs(edges).join(side("a", "ca"), "a").join(side("b", "cb"), "b")


def cohesion(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """community, size and cohesion: the share of possible pairs that are linked; 1 for a single node."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    inside = _communities(edges, communities).where("ca = cb AND a <> b").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("links"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    share = F.when(F.col("size") <= 1, 1.0).otherwise(F.coalesce("links", F.lit(0)) / possible)
    return sizes.join(inside, "community", "left").select("community", "size", F.round(share, 9).alias("cohesion"))


def hub_labels(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """community and the id and label of its member of the highest degree; ties go to the lesser id."""
    members = with_degree(nodes, edges).join(communities, F.col("id") == F.col("node_id"))
    best = members.groupBy("community").agg(F.max_by(F.struct("id", "label"), F.struct("degree", F.transform(F.split("id", ""), lambda c: -F.ascii(c)))).alias("hub"))
    return best.select("community", "hub.id", "hub.label")


def signatures(communities: DataFrame) -> DataFrame:
    """community and the first 16 digits of the SHA-256 of its members in order, each followed by NUL."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: F.concat(x, F.lit("\0"))), "")
    return communities.groupBy("community").agg(F.left(F.sha2(members, 256), F.lit(16)).alias("signature"))


def community_matrix(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """c1 < c2 and the simple edges between the two communities."""
    between = _communities(edges, communities).where("ca <> cb")
    return between.groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(F.count(F.lit(1)).alias("links"))


def community_confidence(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """community, confidence and the edges that leave its members."""
    rows = edges.join(communities, F.col("source") == F.col("node_id"))
    return rows.groupBy("community", "confidence").agg(F.count(F.lit(1)).alias("edges"))


def reindex(communities: DataFrame) -> DataFrame:
    """Communities numbered from 0, the largest first, ties by the least member."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node_id").alias("first"))
    # one row a community
    numbered = sizes.withColumn("number", (F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1).cast("int"))
    return communities.join(numbered.select("community", "number"), "community").select("node_id", F.col("number").alias("community"))


def directory_rollup(nodes: DataFrame) -> DataFrame:
    """directory, depth and the nodes in files at or below it."""
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("source_file", "/"))), lambda k: F.array_join(F.slice(F.split("source_file", "/"), 1, k), "/"))
    # files are few: count them first
    by_file = nodes.where("source_file <> ''").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    rows = by_file.select(F.posexplode(ups).alias("depth", "directory"), "n")
    return rows.groupBy("directory", "depth").agg(F.sum("n").alias("nodes"))


def entry_points(edges: DataFrame, n: int = 20) -> DataFrame:
    """The n nodes with the largest surplus of outgoing over incoming edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("d")), F.struct(F.col("target").alias("id"), F.lit(-1).alias("d")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.d").alias("surplus")).orderBy(F.desc("surplus"), "id").limit(n)
