"""Analytics over the simple graph: surprising links, bridges between communities, and questions to ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vocab
from weft.operators import degree as D
from weft.runtime import materialize

CONFIDENCE_ORDER = {"AMBIGUOUS": 0, "INFERRED": 1, "EXTRACTED": 2}


def _ends(edges: DataFrame, nodes: DataFrame, all_edges: DataFrame, communities: DataFrame | None) -> DataFrame:
    """edges with label, file, degree and community of both ends (prefix s_ and t_)."""
    known = D.with_degree(nodes, all_edges)
    known = known.withColumn("is_file", D.is_file_node()).withColumn("is_concept", D.is_concept_node())
    if communities is not None:
        known = known.join(communities, F.col("id") == F.col("node_id"), "left").drop("node_id")
    else:
        known = known.withColumn("community", F.lit(None).cast("int"))
    columns = ("id", "label", "source_file", "degree", "community", "is_file", "is_concept", "file_type")
    side = lambda p: known.select(*[F.col(c).alias(f"{p}_{c}") for c in columns])
    return edges.join(side("s"), F.col("source") == F.col("s_id")).join(side("t"), F.col("target") == F.col("t_id"))


def surprise_score() -> Column:
    """The score of an edge with its ends' columns: how little its two ends would be expected to be linked."""
    cat_s, cat_t = T.file_category(F.col("s_source_file")), T.file_category(F.col("t_source_file"))
    fam_s, fam_t = T.language_family(F.col("s_source_file")), T.language_family(F.col("t_source_file"))
    across = F.coalesce(fam_s != fam_t, F.lit(False)) | (F.array_sort(F.array(cat_s, cat_t)) == F.array(F.lit("code"), F.lit("doc")))
    muted = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & across
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    bonus = F.when(cat_s != cat_t, 2).otherwise(0) + F.when(T.top_dir(F.col("s_source_file")) != T.top_dir(F.col("t_source_file")), 2).otherwise(0)
    bonus = bonus + F.when(F.col("s_community") != F.col("t_community"), 1).otherwise(0)
    score = F.when(muted, 0).otherwise(base + bonus)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score)
    edge_case = (F.least("s_degree", "t_degree") <= 2) & (F.greatest("s_degree", "t_degree") >= 5)
    return (score + F.when(edge_case, 1).otherwise(0)).cast("int")


def surprises(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """source, target, relation, confidence and score of links between real entities of different files."""
    rows = _ends(edges.where(~F.col("relation").isin(*vocab.STRUCTURAL_RELATIONS)), nodes, edges, communities)
    rows = rows.where("NOT s_is_concept AND NOT t_is_concept AND NOT s_is_file AND NOT t_is_file AND s_source_file <> t_source_file")
    return rows.select("source", "target", "relation", "confidence", surprise_score().alias("score"))


def bridges(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One link for each pair of communities: the least certain, then the first by its ends."""
    rows = _ends(edges.where(~F.col("relation").isin(*vocab.STRUCTURAL_RELATIONS)), nodes, edges, communities)
    rows = rows.where("s_community <> t_community AND NOT s_is_file AND NOT t_is_file")
    order = F.struct(F.coalesce(T.lookup(F.col("confidence"), CONFIDENCE_ORDER), F.lit(3)), "source", "target", "relation")
    best = rows.groupBy(F.least("s_community", "t_community").alias("c1"), F.greatest("s_community", "t_community").alias("c2")).agg(
        F.min_by(F.struct("source", "target", "relation", "confidence"), order).alias("e")
    )
    return best.select("c1", "c2", "e.*")


def ambiguous_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    label = lambda p, on: nodes.select(F.col("id").alias(on), F.col("label").alias(p))
    rows = edges.where("confidence = 'AMBIGUOUS'").join(label("s", "source"), "source").join(label("t", "target"), "target")
    question = F.concat(F.lit("What is the exact relationship between `"), "s", F.lit("` and `"), "t", F.lit("`?"))
    return rows.select(F.lit("ambiguous_edge").alias("type"), question.alias("question"), F.concat("source", F.lit(" "), "target").alias("about"))


def isolated_questions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, if there are weakly linked nodes: the first three by id, and how many there are."""
    weak = D.with_degree(nodes, edges).where((F.col("degree") <= 1) & ~D.is_file_node() & ~D.is_concept_node() & (F.col("file_type") != "rationale"))
    count = weak.agg(F.count(F.lit(1)).alias("n"))
    first = weak.orderBy("id").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: F.concat(F.lit("`"), x["label"], F.lit("`"))), ", ").alias("names"))
    question = F.concat(F.lit("What connects "), "names", F.lit(" to the rest of the system?"))
    return count.join(first).where("n > 0").select(F.lit("isolated_nodes").alias("type"), question.alias("question"), F.col("n").cast("string").alias("about"))


def low_cohesion_questions(edges: DataFrame, communities: DataFrame) -> DataFrame:
    rows = D.cohesion(edges, communities).where("cohesion < 0.15 AND size >= 5")
    question = F.concat(F.lit("Should `Community "), F.col("community").cast("string"), F.lit("` be split into smaller, more focused modules?"))
    return rows.select(F.lit("low_cohesion").alias("type"), question.alias("question"), F.col("community").cast("string").alias("about"))


def verify_questions(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """For the best-linked nodes that aren't files: those with two inferred links or more."""
    best = D.with_degree(nodes, edges).where(~D.is_file_node()).orderBy(F.desc("degree"), "id").limit(top).select("id", "label")
    inferred = D.pairs(edges.where("confidence = 'INFERRED'")).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    question = F.concat(F.lit("Are the "), F.col("n").cast("string"), F.lit(" inferred relationships involving `"), "label", F.lit("` actually correct?"))
    return best.join(inferred, "id").select(F.lit("verify_inferred").alias("type"), question.alias("question"), F.col("id").alias("about"))


def bridge_questions(nodes: DataFrame, edges: DataFrame, communities: DataFrame, between: DataFrame) -> DataFrame:
    """Of the three entities with the largest scores above 0 in between (id, score): those with a neighbour in another community."""
    # a node between others has two neighbours at least, and that is all that is_file_node asks of its degree
    entities = nodes.withColumn("degree", F.lit(2)).where(~D.is_file_node() & ~D.is_concept_node()).select("id", "label")
    named = F.broadcast(materialize(between.where("score > 0").join(entities, "id").orderBy(F.desc("score"), "id").limit(3), "bridges"))
    links = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source"))
    links = links.join(named.select("id").distinct(), "id").distinct()
    at = lambda node, name: communities.select(F.col("node_id").alias(node), F.col("community").alias(name))
    across = links.join(at("id", "_c1"), "id", "left").join(at("other", "_c2"), "other", "left").where("NOT _c1 <=> _c2").select("id")
    named = named.join(across, "id", "left_semi")
    return named.select(F.lit("bridge_node").alias("type"), F.concat(F.lit("Why does `"), "label", F.lit("` connect so much of the graph?")).alias("question"), F.col("id").alias("about"))


def suggest_questions(nodes: DataFrame, edges: DataFrame, communities: DataFrame, n: int = 7, between: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """The first n questions by kind, then by what they are about.

    A kind is looked for only while there are fewer than n of the kinds before it, as it can't be among the first n otherwise.
    between: id and score of the nodes, or a function that gives them, which is called if bridges are looked for.
    """
    kinds = [lambda: ambiguous_questions(nodes, edges), lambda: verify_questions(nodes, edges), lambda: isolated_questions(nodes, edges), lambda: low_cohesion_questions(edges, communities)]
    if between is not None:
        kinds.insert(1, lambda: bridge_questions(nodes, edges, communities, between() if callable(between) else between))
    found, many = None, 0
    for place, kind in enumerate(kinds):
        rows = materialize(kind().withColumn("place", F.lit(place)).orderBy("about", "question").limit(n - many), "questions")
        found = rows if found is None else found.union(rows)
        many += rows.count()
        if many >= n:
            break
    return found.orderBy("place", "about", "question").limit(n).select("type", "question", "about")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
