"""Building graphs: repair, merging, collapsing and comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vocab
from weft.operators.validate import last_by, without_dangling
from weft.runtime import materialize


def first_of(*names: str, df: DataFrame) -> Column:
    """The first of these columns that df has with a value that isn't empty."""
    present = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def fold_nodes(raw: DataFrame, origin: bool = False) -> DataFrame:
    """Nodes in the canonical columns, from rows that may use the names `name` and `path`; file types are folded.

    origin: with that column too, empty where it is null.
    """
    return raw.select(
        first_of("id", df=raw).alias("id"),
        first_of("label", "name", df=raw).alias("label"),
        T.file_type(first_of("file_type", df=raw)).alias("file_type"),
        F.coalesce(F.replace(first_of("source_file", "path", df=raw), F.lit("\\"), F.lit("/")), F.lit("")).alias("source_file"),
        *([F.coalesce("origin", F.lit("")).alias("origin")] if origin else []),
    )


def fold_edges(raw: DataFrame) -> DataFrame:
    """Edges in the canonical columns, from rows that may use `from`, `to` and `type`."""
    score = F.col("confidence_score") if "confidence_score" in raw.columns else F.lit(None).cast("double")
    confidence = F.coalesce(first_of("confidence", df=raw), F.when(score.isNotNull(), "INFERRED"), F.lit("EXTRACTED"))
    return raw.select(
        first_of("source", "from", df=raw).alias("source"),
        first_of("target", "to", df=raw).alias("target"),
        first_of("relation", "type", df=raw).alias("relation"),
        confidence.alias("confidence"),
        T.confidence_score(score, confidence).alias("confidence_score"),
        T.weight(F.col("weight").cast("string") if "weight" in raw.columns else F.lit(None).cast("string")).alias("weight"),
        F.coalesce(first_of("source_file", "path", df=raw), F.lit("")).alias("source_file"),
    )


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with ends that are node ids: as they stand, else by their normalised form where one node alone has it."""
    ids = nodes.select("id").distinct()
    norm = ids.groupBy(T.norm_id(F.col("id")).alias("norm")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    out = edges
    for end in ("source", "target"):
        exact = ids.select(F.col("id").alias("_exact"))
        loose = norm.select(F.col("norm").alias("_norm"), F.col("id").alias("_loose"))
        out = out.join(exact, F.col(end) == F.col("_exact"), "left").withColumn("_key", F.when(F.col("_exact").isNull(), T.norm_id(F.col(end))))
        out = out.join(loose, F.col("_key") == F.col("_norm"), "left").withColumn(end, F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "_norm", "_key")
    return out.where("source IS NOT NULL AND target IS NOT NULL")


def simple_graph(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair: of all its edges in the order (source, target, relation), each attribute's last value.

    Self-loops of import relations are left out.
    """
    edges = edges.where(~((F.col("source") == F.col("target")) & F.col("relation").isin(*vocab.NO_SELF_LOOP_RELATIONS)))
    order = F.struct("source", "target", "relation", *[c for c in ("weight", "confidence", "context") if c in edges.columns])
    rest = [c for c in edges.columns if c not in ("source", "target")]
    pair = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    return edges.groupBy(*pair).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest], F.count(F.lit(1)).alias("parallel"))


def dedupe_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """The first edge, in order, for each source, target and relation."""
    return last_by(edges, ["source", "target", "relation"], order, first=True)


def dedupe_nodes(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The last node, in order, for each id."""
    return last_by(nodes, ["id"], order)


def ghost_merge(nodes: DataFrame) -> DataFrame:
    """ghost, id: nodes of other origin that a parsed node (origin 'ast') of the same file and label stands for.

    Where several parsed nodes share file and label, none stands for another.
    """
    key = ["source_file", "label"]
    parsed = nodes.where("origin = 'ast' AND source_file <> ''").groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    others = nodes.where("origin <> 'ast' AND source_file <> ''").select(*key, F.col("id").alias("ghost"))
    return others.join(parsed, key).where("ghost <> id").select("ghost", "id")


def remap(edges: DataFrame, mapping: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """edges with both ends replaced by mapping; self-loops that this makes are dropped."""
    out = edges.withColumn("_was", F.col("source") == F.col("target"))
    for end in ("source", "target"):
        side = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
        out = out.join(side, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return out.where("_was OR source <> target").drop("_was")


def id_survivors(nodes: DataFrame) -> DataFrame:
    """Of nodes with one id, the survivor: one whose id tells its file, then the shortest label, then label and file in order."""
    stem = F.regexp_replace(F.lower(F.regexp_replace("source_file", r"\.[^./]*$", "")), "[^a-z0-9]+", "_")
    defines = (F.col("source_file") != "") & (F.lower("id").startswith(stem))
    ranked = nodes.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy((~defines).cast("int"), F.length("label"), "label", "source_file")))
    return ranked.where("_rank = 1").drop("_rank")


def incremental_merge(old: DataFrame, new: DataFrame, deleted: DataFrame, key: str = "source_file") -> DataFrame:
    """old without the rows of sources that new brings again or that are deleted, and new."""
    gone = new.select(key).union(deleted.select(key)).distinct()
    return old.join(gone, key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def reconcile(old: DataFrame, new: DataFrame, rebuilt: DataFrame, collected: DataFrame, present: DataFrame, keys: list[str], under: str = "") -> DataFrame:
    """old with new in place of the rows of rebuilt sources, and without those of sources that are gone.

    rebuilt, collected, present: source_file of what was read anew, what a scan takes now, and what is on disk. A source that
    is no longer collected is gone only if it isn't on disk either: one that is merely excluded keeps its rows. Only sources
    below the folder `under` can be gone. Rows without a source stay, unless new has their keys.
    """
    known = old.where("source_file <> ''").select("source_file").distinct()
    known = known.where(F.col("source_file").startswith(under.rstrip("/") + "/")) if under else known
    gone = known.join(collected.select("source_file"), "source_file", "left_anti").join(present.select("source_file"), "source_file", "left_anti")
    gone = gone.union(rebuilt.where("source_file <> ''").select("source_file")).distinct()
    kept = old.join(gone, "source_file", "left_anti").join(new.select(*keys), keys, "left_anti")
    return kept.select(*old.columns).unionByName(new, allowMissingColumns=True)


def compose(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two tables; where both have a row of the same keys, the right one's."""
    return left.join(right.select(*keys), keys, "left_anti").select(*left.columns).unionByName(right)


def global_prefix(nodes: DataFrame, repo: str) -> DataFrame:
    """nodes with ids of their own in a graph of many repositories: repo and local_id are kept."""
    return nodes.withColumn("local_id", F.col("id")).withColumn("repo", F.lit(repo)).withColumn("id", F.concat(F.lit(f"{repo}::"), F.col("id")))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change ('added' or 'removed') between two snapshots."""
    removed = old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti").withColumn("change", F.lit("removed"))
    added = new.select(*keys).distinct().join(old.select(*keys), keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(removed)


def same_topology(old: DataFrame, new: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    return old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()


def filter_hyperedges(hyper: DataFrame, nodes: DataFrame, least: int = 1) -> DataFrame:
    """Hyperedges (id, members) with their known members, in order, if there are at least so many."""
    members = hyper.select("id", F.posexplode("members").alias("pos", "member"))
    known = members.join(nodes.select(F.col("id").alias("member")).distinct(), "member", "left_semi")
    kept = known.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "member"))), lambda x: x["member"]).alias("members"))
    return kept.where(F.size("members") >= least)


def fold_rationale(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rationale nodes become an attribute of the nodes that they explain, joined in the order of their ids."""
    reasons = nodes.where("file_type = 'rationale'").select(F.col("id").alias("reason"), F.col("label").alias("words"))
    told = edges.where("relation = 'rationale_for'").join(reasons, F.col("source") == F.col("reason"))
    folded = told.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason", "words"))), lambda x: x["words"]), "\n").alias("rationale"))
    kept = nodes.where("file_type <> 'rationale'").join(folded, F.col("id") == F.col("target"), "left").drop("target")
    out = edges.join(reasons, F.col("source") == F.col("reason"), "left_anti").join(reasons, F.col("target") == F.col("reason"), "left_anti")
    return kept, out


def unique_file_labels(files: DataFrame) -> DataFrame:
    """path and label: the shortest suffix of whole path segments that no other path has."""
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, -k, k), "/").alias("label")))
    every = files.select("path").distinct().select("path", F.inline(suffixes))
    alone = every.groupBy("label").agg(F.min("path").alias("path"), F.min("k").alias("k"), F.count(F.lit(1)).alias("n")).where("n = 1")
    best = alone.groupBy("path").agg(F.min_by("label", "k").alias("label"))
    return files.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("label", "path").alias("label"))


def renamed(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes and edges under the new ids of mapping (old, new); with merge, nodes of old ids go, as those of new ones are there."""
    side = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    if merge:
        out = nodes.join(side, F.col("id") == F.col("_old"), "left_anti")
    else:
        out = nodes.join(side, F.col("id") == F.col("_old"), "left").withColumn("id", F.coalesce("_new", "id"))
    return out.select(*nodes.columns), remap(edges, mapping)


def told_apart(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges under the new ids of mapping (id, source_file, new): an edge's ends are those of its own file."""
    out, links = nodes, edges
    side = mapping.select(F.col("id").alias("_id"), F.col("source_file").alias("_file"), F.col("new").alias("_new"))
    same = lambda end: (F.col(end) == F.col("_id")) & (F.col("source_file") == F.col("_file"))
    out = out.join(side, same("id"), "left").withColumn("id", F.coalesce("_new", "id")).select(*nodes.columns)
    for end in ("source", "target"):
        links = links.join(side, same(end), "left").withColumn(end, F.coalesce("_new", end)).select(*edges.columns)
    return out, links


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw nodes and edges as a clean graph.

    In this order: columns folded; ids with a former stem of their file renewed; ids of several files told apart; twins of
    documents and nodes that a parsed one (origin 'ast') stands for merged; one node an id; ends resolved, by former ids
    too; edges that cross languages by mistake and dangling ones dropped; parallel edges collapsed.
    """
    from weft.operators import identity as I  # which builds on this module
    from weft.operators.validate import language_guard

    raw = nodes if "origin" in nodes.columns else nodes.withColumn("origin", F.lit(""))
    clean = materialize(fold_nodes(raw, origin=True), "folded")
    links = fold_edges(edges)
    clean, links = renamed(clean, links, materialize(I.rekeyed_ids(clean), "rekeyed"))
    clean = materialize(clean, "rekeyed-nodes")
    clean, links = told_apart(clean, links, materialize(I.collided_ids(clean), "collided"))
    clean = materialize(clean, "apart")
    clean, links = renamed(clean, links, materialize(I.doc_twins(clean), "twins"), merge=True)
    clean = materialize(clean, "no-twins")
    ghosts = materialize(ghost_merge(clean).select(F.col("ghost").alias("old"), F.col("id").alias("new")), "ghosts")
    clean, links = renamed(clean, materialize(links, "links"), ghosts, merge=True)
    clean = materialize(id_survivors(clean).drop("origin"), "nodes")
    former = materialize(I.former_ids(clean), "former")
    for end in ("source", "target"):
        links = links.join(former.select(F.col("alias").alias("_alias"), F.col("id").alias("_id")), T.norm_id(F.col(end)) == F.col("_alias"), "left").withColumn(end, F.coalesce("_id", end)).drop("_alias", "_id")
    ends = resolve_endpoints(links, clean)
    return clean, simple_graph(without_dangling(language_guard(ends, clean), clean))
