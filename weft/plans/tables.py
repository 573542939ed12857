"""The canonical property graph over the relational tables: one nodes and one edges DataFrame.

Every query over the tables shares these two plans; Catalyst prunes the columns and the union
branches that a query doesn't need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, col: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(col).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, file_type, source_file of every region, nation, customer, supplier, part and order."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        t("region").select(_key("region", "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("concept").alias("file_type"), F.lit("").alias("source_file")),
        t("nation").select(_key("nation", "n_nationkey"), "n_name", F.lit("document"), F.lit("geo/nation.md")),
        t("customer").select(_key("customer", "c_custkey"), "c_name", F.lit("code"), F.concat(F.lit("sales/"), F.lower("c_mktsegment"), F.lit(".py"))),
        t("supplier").select(_key("supplier", "s_suppkey"), "s_name", F.lit("code"), F.lit("supply/supplier.go")),
        t("part").select(_key("part", "p_partkey"), "p_name", F.lit("concept"), F.concat(F.lit("catalog/"), F.col("p_brand"), F.lit(".md"))),
        t("orders").select(_key("order", "o_orderkey"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.lit("rationale"), F.lit("sales/orders.py")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, relation, confidence, context, weight, source_file; parallel edges are kept."""
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem")
    confidence = F.when(F.col("l_returnflag") == "R", "AMBIGUOUS").when(F.col("l_returnflag") == "A", "INFERRED").otherwise("EXTRACTED")
    context = F.when(F.col("l_linestatus") == "F", "call").otherwise("import")

    def plain(df, source, target, relation, file):
        return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit("field").alias("context"), F.lit(1.0).alias("weight"), F.lit(file).alias("source_file"))

    def lines(source, target, relation, file):
        return line.select(source, target, F.lit(relation), confidence, context, F.col("l_quantity"), F.lit(file))

    return (
        plain(t("customer"), _key("customer", "c_custkey"), _key("nation", "c_nationkey"), "references", "sales/customer.py")
        .union(plain(t("supplier"), _key("supplier", "s_suppkey"), _key("nation", "s_nationkey"), "references", "supply/supplier.go"))
        .union(plain(t("nation"), _key("nation", "n_nationkey"), _key("region", "n_regionkey"), "contains", "geo/nation.md"))
        .union(plain(t("orders"), _key("order", "o_orderkey"), _key("customer", "o_custkey"), "calls", "sales/orders.py"))
        .union(lines(_key("order", "l_orderkey"), _key("part", "l_partkey"), "uses", "sales/orders.py"))
        .union(lines(_key("part", "l_partkey"), _key("supplier", "l_suppkey"), "imports_from", "catalog/part.md"))
    )


#: The same two tables as DuckDB common table expressions, for the oracles.
NODES_SQL = """nodes AS (
SELECT 'region:' || r_regionkey AS id, r_name AS label, 'concept' AS file_type, '' AS source_file FROM region
UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'document', 'geo/nation.md' FROM nation
UNION ALL SELECT 'customer:' || c_custkey, c_name, 'code', 'sales/' || lower(c_mktsegment) || '.py' FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'code', 'supply/supplier.go' FROM supplier
UNION ALL SELECT 'part:' || p_partkey, p_name, 'concept', 'catalog/' || p_brand || '.md' FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, 'rationale', 'sales/orders.py' FROM orders)"""
EDGES_SQL = """edges AS (
SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'references' AS relation, 'EXTRACTED' AS confidence, 'field' AS context, 1.0::double AS weight, 'sales/customer.py' AS source_file FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'references', 'EXTRACTED', 'field', 1.0, 'supply/supplier.go' FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'contains', 'EXTRACTED', 'field', 1.0, 'geo/nation.md' FROM nation
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'calls', 'EXTRACTED', 'field', 1.0, 'sales/orders.py' FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses', CASE l_returnflag WHEN 'R' THEN 'AMBIGUOUS' WHEN 'A' THEN 'INFERRED' ELSE 'EXTRACTED' END, CASE l_linestatus WHEN 'F' THEN 'call' ELSE 'import' END, l_quantity, 'sales/orders.py' FROM lineitem
UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'imports_from', CASE l_returnflag WHEN 'R' THEN 'AMBIGUOUS' WHEN 'A' THEN 'INFERRED' ELSE 'EXTRACTED' END, CASE l_linestatus WHEN 'F' THEN 'call' ELSE 'import' END, l_quantity, 'catalog/part.md' FROM lineitem)"""


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, community: nations with their customers, suppliers and orders, and parts by key."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        t("nation").select(_key("nation", "n_nationkey").alias("node_id"), F.col("n_nationkey").cast("int").alias("community"))
        .union(t("customer").select(_key("customer", "c_custkey"), F.col("c_nationkey").cast("int")))
        .union(t("supplier").select(_key("supplier", "s_suppkey"), F.col("s_nationkey").cast("int")))
        .union(orders.select(_key("order", "o_orderkey"), F.col("c_nationkey").cast("int")))
        .union(t("part").select(_key("part", "p_partkey"), (F.col("p_partkey") % 25).cast("int")))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text: the documents under paths of many kinds."""
    n = F.col("doc_id").cast("string")
    kinds = [F.concat(*[n if p == "#" else F.lit(p) for p in parts]) for parts in FILE_PATHS]
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*kinds), (F.col("doc_id") % len(FILE_PATHS) + 1).cast("int")).alias("path"), "text")


#: Paths of the documents, by doc_id modulo their number; "#" is the doc_id.
FILE_PATHS = [
    ("src/core/mod_", "#", ".py"), ("docs/guide/note_", "#", ".md"), ("web/src/view_", "#", ".tsx"), ("tests/unit/test_", "#", ".py"), ("secrets/deploy_", "#", ".yaml"), ("config/api_token_", "#", "_token.json"),
    ("assets/img_", "#", ".png"), ("papers/p", "#", ".pdf"), ("lib/java/Item", "#", "Test.java"), ("bin/run_", "#"), ("media/talk", "#", ".mp4"), ("home/.ssh/key_", "#"), ("srv/handler_", "#", ".go"),
    ("docs/token_economics_of_recall_", "#", ".md"), ("pkg/.env", "#", ".example"), ("Assets.xcassets/icon.imageset/i", "#", ".pdf"), ("certs/site", "#", ".pem"), ("office/plan_", "#", ".docx"),
]
COMMUNITIES_SQL = """communities AS (
SELECT 'nation:' || n_nationkey AS node_id, n_nationkey AS community FROM nation
UNION ALL SELECT 'customer:' || c_custkey, c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'part:' || p_partkey, (p_partkey % 25)::int FROM part)"""
FILES_SQL = (
    "files AS (SELECT doc_id, CASE doc_id % "
    + str(len(FILE_PATHS))
    + "".join(f" WHEN {i} THEN " + " || ".join("doc_id::varchar" if p == "#" else f"'{p}'" for p in parts) for i, parts in enumerate(FILE_PATHS))
    + " END AS path, text FROM documents)"
)
