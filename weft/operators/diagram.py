"""What drawings of a graph need: which edges to show, sections, the view of communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators import degree as D


def shown(confidence: Column, score: Column) -> Column:
    """Whether an edge is drawn: it is extracted, or inferred with a score of 0.85 or more."""
    kind = F.upper(F.coalesce(confidence, F.lit("EXTRACTED")))
    return (kind == "EXTRACTED") | ((kind == "INFERRED") & (F.coalesce(score, F.lit(1.0)) >= 0.85))


def rank(relation: Column, confidence: Column, score: Column) -> Column:
    """How useful an edge is in a drawing: its score, 2 more if extracted, and what its relation is worth."""
    sure = F.when(F.upper(confidence) == "EXTRACTED", 2.0).otherwise(0.0)
    worth = F.when(relation.isin("calls", "uses", "method"), 1.0).when(relation.isin("imports", "imports_from"), 0.6).when(relation == "contains", -0.2).when(relation == "rationale_for", -0.6).otherwise(0.0)
    return F.coalesce(score, F.lit(1.0)) + sure + worth


def section_edges(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """edges with source_section, target_section and kind: intra, inter, or orphan where an end is in no section.

    sections: node_id, section, one row a node.
    """
    out = edges
    for end in ("source", "target"):
        side = sections.select(F.col("node_id").alias(end), F.col("section").alias(f"{end}_section"))
        out = out.join(side, end, "left")
    both = F.col("source_section").isNotNull() & F.col("target_section").isNotNull()
    return out.withColumn("kind", F.when(~both, "orphan").when(F.col("source_section") == F.col("target_section"), "intra").otherwise("inter"))


def meta_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """source, target, weight, relation, confidence between communities, for graphs too large to draw node by node."""
    links = D.community_matrix(edges, communities)
    words = F.concat(F.col("links").cast("string"), F.lit(" cross-community edges"))
    return links.select(F.col("c1").cast("string").alias("source"), F.col("c2").cast("string").alias("target"), F.col("links").alias("weight"), words.alias("relation"), F.lit("AGGREGATED").alias("confidence"))


def meta_hyperedges(hyper: DataFrame, communities: DataFrame) -> DataFrame:
    """Hyperedges (id, members) between communities: those of the members, each once in order, if there are two or more."""
    members = hyper.select("id", F.posexplode("members").alias("pos", "node_id")).join(communities, "node_id")
    first = members.groupBy("id", "community").agg(F.min("pos").alias("pos"))
    lists = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "community"))), lambda x: x["community"].cast("string")).alias("members"))
    return lists.where(F.size("members") > 1)


def report_counters(nodes: DataFrame, edges: DataFrame, communities: DataFrame, least: int = 3) -> DataFrame:
    """One row: communities, empty (no real member), thin (fewer than least) and shown (all that aren't thin).

    Nodes that stand for files are no real members.
    """
    real = D.with_degree(nodes, edges).select(F.col("id").alias("node_id"), (~D.is_file_node()).cast("int").alias("_real"))
    sizes = communities.join(real, "node_id", "left").groupBy("community").agg(F.sum(F.coalesce("_real", F.lit(0))).alias("_real"))
    thin = F.count_if((F.col("_real") > 0) & (F.col("_real") < least))
    every = F.count(F.lit(1))
    return sizes.agg(every.alias("communities"), F.count_if(F.col("_real") == 0).alias("empty"), thin.alias("thin"), (every - thin).alias("shown"))


def inferred_average(edges: DataFrame) -> DataFrame:
    """One row: the number of inferred edges and their mean confidence_score, 0.5 where it is missing; null without any."""
    rows = edges.where("confidence = 'INFERRED'")
    return rows.agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg(F.coalesce("confidence_score", F.lit(0.5))), 2).alias("average"))


def fresh_labels(saved: DataFrame, nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """community, label, stale: the saved label (community, label, signature) while the members are the same, else the hub's."""
    kept = saved.select("community", F.col("label").alias("_label"), F.col("signature").alias("_saved"))
    now = D.signatures(communities).join(kept, "community", "left")
    hubs = D.hub_labels(nodes, edges, communities).select("community", F.col("label").alias("_hub"))
    same = F.coalesce(F.col("_saved") == F.col("signature"), F.lit(False))
    return now.join(hubs, "community", "left").select("community", F.when(same, F.col("_label")).otherwise(F.col("_hub")).alias("label"), (~same).alias("stale"))
