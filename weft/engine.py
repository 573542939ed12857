"""The engine: one object over a graph's tables, with an operation for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import analyze, build, community, degree, entities, identity, modules, resolve, search, traverse, validate
from weft.plans import tables
from weft.sources import documents, files, languages, sinks


class Engine:
    """A property graph (nodes, edges) and what can be asked of it. All operations return DataFrames."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None):
        self.nodes, self.edges = nodes, edges
        self._communities = communities

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> Engine:
        return cls(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), tables.communities(spark, sf_dir))

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str) -> Engine:
        """Scan a folder, read its files, resolve names across them, and build the graph."""
        found = files.scan(spark, root).where("status = 'ok'").select("path", "text")
        nodes, edges, calls = languages.graph_of(found)
        functions = nodes.where("label LIKE '%()'").select("id", "label", F.col("source_file").alias("file"))
        edges = cls._script_imports(edges, found)
        imports = edges.where("symbol IS NOT NULL").select(F.col("source_file").alias("file"), "symbol")
        calls = calls.withColumn("call_id", F.xxhash64("caller", "callee", "caller_file", "source_location"))
        solved = resolve.resolve_calls(calls, functions, imports)
        more = solved.select(F.col("caller").alias("source"), F.col("id").alias("target"), F.lit("calls").alias("relation"), "confidence", F.lit("call").alias("context")).distinct()
        nodes, edges = build.build_graph(nodes.withColumn("origin", F.lit("ast")), edges.drop("source_location", "symbol").unionByName(more, allowMissingColumns=True))
        return cls(nodes, edges.select(F.col("a").alias("source"), F.col("b").alias("target"), "relation", "confidence", "weight", "source_file").withColumn("context", F.lit(None).cast("string")))

    @staticmethod
    def _script_imports(edges: DataFrame, found: DataFrame) -> DataFrame:
        """edges in which the import of a script leads to the file that it means; that of a package outside stays."""
        spec = F.when(F.col("context") == "script", F.col("symbol"))
        asked = edges.where(spec.isNotNull()).select(F.col("source_file").alias("file"), F.col("symbol").alias("spec"))
        meant = modules.resolve_imports(asked, found.select("path"), documents.script_aliases(found), documents.workspace_packages(found))
        meant = meant.where("path IS NOT NULL").select(F.col("file").alias("source_file"), F.col("spec").alias("_spec"), T.norm_id(identity.without_suffix(F.col("path"))).alias("_to"))
        out = edges.withColumn("_spec", spec).join(meant, ["source_file", "_spec"], "left")
        plain = F.when(F.col("_spec").isNull(), F.col("symbol")).alias("symbol")
        kept = [c for c in edges.columns if c not in ("target", "context", "symbol")]
        return out.select(*kept, F.coalesce("_to", "target").alias("target"), F.when(F.col("_spec").isNotNull(), "import").otherwise(F.col("context")).alias("context"), plain)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> Engine:
        nodes, edges, _ = documents.load_graph(spark, path)
        return cls(nodes, edges.withColumn("context", F.lit(None).cast("string")))

    @property
    def communities(self) -> DataFrame:
        if self._communities is None:
            self._communities = community.detect(self.nodes, self.edges)
        return self._communities

    def register(self) -> None:
        """Make `nodes` and `edges` views, so that any SQL can be asked."""
        self.nodes.createOrReplaceTempView("nodes")
        self.edges.createOrReplaceTempView("edges")

    def validate(self) -> DataFrame:
        return validate.validate_edges(self.edges, self.nodes)

    def diagnose(self) -> DataFrame:
        return validate.diagnostics(self.edges, self.nodes)

    def query(self, question: str, depth: int = 2, tokens: int = search.BUDGET, deep: bool = False) -> DataFrame:
        """The lines of an answer: what the question is about, what is near it and how they are linked, within a budget of tokens."""
        return search.answer(self.nodes, self.edges, question, depth, tokens, deep)

    def search(self, text: str, n: int = 20) -> DataFrame:
        return search.ranked(self.nodes, search.terms_of(text), n)

    def affected(self, node: str, depth: int = 2) -> DataFrame:
        """What depends on a node, named by id, label or file."""
        spark = self.nodes.sparkSession
        seed = traverse.resolve_seeds(self.nodes, spark.createDataFrame([(node,)], "query string")).first()
        return traverse.affected(self.edges, seed["id"] if seed else node, depth)

    def path(self, start: str, end: str) -> DataFrame:
        a, b = (search.pick_endpoint(self.nodes, x).first() for x in (start, end))
        return traverse.shortest_path(self.edges, a["id"] if a else start, b["id"] if b else end)

    def explain(self, node: str) -> DataFrame:
        return search.explain(self.nodes, self.edges, node)

    def neighbors(self, node: str, relation: str = "") -> DataFrame:
        return traverse.neighbors(self.nodes, self.edges, node, relation)

    def get_node(self, text: str) -> DataFrame:
        return traverse.find_node(self.nodes, text)

    def get_community(self, number: int) -> DataFrame:
        return self.communities.where(F.col("community") == number).join(self.nodes.select(F.col("id").alias("node_id"), "label"), "node_id")

    def god_nodes(self, n: int = 10) -> DataFrame:
        return degree.god_nodes(self.nodes, self.edges, n)

    def stats(self) -> DataFrame:
        return degree.graph_stats(self.nodes, self.edges)

    def surprises(self, n: int = 5) -> DataFrame:
        """The n most surprising links; bridges between communities where there are none."""
        found = analyze.surprises(self.nodes, self.edges, self.communities).orderBy(F.desc("score"), "source", "target", "relation").limit(n)
        if not found.isEmpty():
            return found
        return analyze.bridges(self.nodes, self.edges, self.communities).select("source", "target", "relation", "confidence", F.lit(0).alias("score")).limit(n)

    def questions(self, n: int = 7) -> DataFrame:
        return analyze.suggest_questions(self.nodes, self.edges, self.communities, n, lambda: community.betweenness(self.nodes, self.edges))

    def deduplicate(self) -> Engine:
        """The graph with similar entities merged."""
        mapping = entities.entity_dedup(self.nodes)
        gone = mapping.select(F.col("old").alias("id"))
        return Engine(self.nodes.join(gone, "id", "left_anti"), build.remap(self.edges, mapping))

    def merge(self, nodes: DataFrame, edges: DataFrame, deleted: DataFrame) -> Engine:
        """The graph with the rows of new sources in place of old ones, and deleted sources gone."""
        return Engine(build.incremental_merge(self.nodes, nodes, deleted), build.incremental_merge(self.edges, edges, deleted))

    def diff(self, other: Engine) -> DataFrame:
        return build.diff(self.nodes, other.nodes, ["id"])

    def report(self) -> str:
        return sinks.report(self.nodes, self.edges, self.communities)

    def cypher(self) -> DataFrame:
        return sinks.cypher(self.nodes, self.edges)

    def wiki(self) -> DataFrame:
        return sinks.wiki(self.nodes, self.edges, self.communities)

    def notes(self) -> DataFrame:
        return sinks.notes(self.nodes, self.edges)
