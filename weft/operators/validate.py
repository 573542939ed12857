"""Schema checks and repair of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vocab


def _empty(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def _problems(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row for each failed check, all in one pass."""
    found = F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()])
    return df.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def validate_nodes(nodes: DataFrame) -> DataFrame:
    """id and problem of every fault: a missing field, a file type outside the vocabulary. source_file may be empty, not null."""
    checks = {f"missing {f}": (_empty(f) if f != "source_file" else F.col(f).isNull()) for f in vocab.NODE_FIELDS}
    checks["invalid file_type"] = ~_empty("file_type") & ~F.col("file_type").isin(*vocab.FILE_TYPES)
    return _problems(nodes, ["id"], checks)


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, relation and problem of every fault: missing fields, unknown confidence, ends that no node has."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    known = (
        edges.join(ids.select(F.col("_id").alias("_s"), F.lit(True).alias("_has_s")), F.col("source") == F.col("_s"), "left")
        .join(ids.select(F.col("_id").alias("_t"), F.lit(True).alias("_has_t")), F.col("target") == F.col("_t"), "left")
    )
    checks = {f"missing {f}": (_empty(f) if f != "source_file" else F.col(f).isNull()) for f in vocab.EDGE_FIELDS}
    checks["invalid confidence"] = ~_empty("confidence") & ~F.col("confidence").isin(*vocab.CONFIDENCES)
    checks["unknown source"] = ~_empty("source") & F.col("_has_s").isNull()
    checks["unknown target"] = ~_empty("target") & F.col("_has_t").isNull()
    return _problems(known, ["source", "target", "relation"], checks)


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with an end that is no node."""
    ids = nodes.select("id").distinct()
    left = edges.join(ids, edges["source"] == ids["id"], "left_anti")
    right = edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_anti")
    return left.unionByName(right)


def language_guard(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without edges that cross languages by mistake.

    Imports and references go if both ends' families are known and differ; inferred calls go if both ends
    have an extension and the families differ.
    """
    files = nodes.select("id", T.extension(F.col("source_file")).alias("_x"))
    files = files.withColumn("_f", T.lookup(F.col("_x"), vocab.BUILD_FAMILY))
    both = (
        edges.join(files.select(F.col("id").alias("_s"), F.col("_x").alias("_xs"), F.col("_f").alias("_fs")), F.col("source") == F.col("_s"), "left")
        .join(files.select(F.col("id").alias("_t"), F.col("_x").alias("_xt"), F.col("_f").alias("_ft")), F.col("target") == F.col("_t"), "left")
    )
    differ = F.col("_fs") != F.col("_ft")
    imports = F.col("relation").isin("imports", "imports_from", "references") & F.coalesce(differ, F.lit(False))
    calls = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & (F.col("_xs") != "") & (F.col("_xt") != "") & ~F.col("_fs").eqNullSafe(F.col("_ft"))
    return both.where(~(imports | F.coalesce(calls, F.lit(False)))).select(*edges.columns)


def diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counters on what a simple graph of these edges would lose."""
    ids = nodes.select("id").distinct()
    marked = (
        edges.join(ids.select(F.col("id").alias("_s")), F.col("source") == F.col("_s"), "left")
        .join(ids.select(F.col("id").alias("_t")), F.col("target") == F.col("_t"), "left")
    )
    missing = _empty("source") | _empty("target")
    hanging = ~missing & (F.col("_s").isNull() | F.col("_t").isNull())
    marked = marked.select(*edges.columns, missing.alias("_missing"), hanging.alias("_dangling"))
    valid = ~F.col("_missing") & ~F.col("_dangling")
    flags = marked.agg(
        F.count(F.lit(1)).alias("raw_edges"),
        F.count_if("_missing").alias("missing_endpoint_edges"),
        F.count_if("_dangling").alias("dangling_endpoint_edges"),
        F.count_if(valid).alias("valid_edges"),
        F.count_if(valid & (F.col("source") == F.col("target"))).alias("self_loops"),
    )
    good = marked.where(valid)
    directed = good.groupBy("source", "target").count()
    pairs = directed.agg(F.count(F.lit(1)).alias("directed_pairs"), F.sum(F.col("count") - 1).alias("directed_collapsed"), F.count_if(F.col("count") > 1).alias("same_endpoint_groups"))
    undirected = good.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).count()
    undirected = undirected.agg(F.count(F.lit(1)).alias("undirected_pairs"), F.sum(F.col("count") - 1).alias("undirected_collapsed"))
    exact = edges.groupBy(*edges.columns).count().agg(F.sum(F.col("count") - 1).alias("exact_duplicates"))
    return flags.join(pairs).join(undirected).join(exact).select([F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*flags.columns, *pairs.columns, *undirected.columns, *exact.columns)])


def edge_variants(edges: DataFrame) -> DataFrame:
    """source and target of edges that differ in relation, or, within one relation, in file or context; with the numbers of values."""
    groups = edges.groupBy("source", "target", "relation").agg(F.count_distinct("source_file").alias("files"), F.count_distinct("context").alias("contexts"), F.count(F.lit(1)).alias("edges"))
    pairs = groups.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("relations"),
        F.count_if(F.col("files") > 1).alias("file_variants"),
        F.count_if(F.col("contexts") > 1).alias("context_variants"),
        F.sum("edges").alias("edges"),
    )
    return pairs.where("relations > 1 OR file_variants > 0 OR context_variants > 0")


def shrink_guard(old: DataFrame, new: DataFrame, rebuilt: DataFrame | None = None) -> DataFrame:
    """The nodes (id, source_file) that would be lost, when new replaces old, without their source being rebuilt.

    rebuilt: source_file of the rebuilt sources. Lost nodes without a source are no loss. An empty result allows
    the overwrite.
    """
    lost = old.select("id", "source_file").join(new.select("id"), "id", "left_anti").where("source_file <> ''")
    return lost if rebuilt is None else lost.join(rebuilt.select("source_file"), "source_file", "left_anti").select("id", "source_file")


def last_by(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row for each of keys: the last (or first) in order."""
    sort = [F.col(c).asc() if first else F.col(c).desc() for c in order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
