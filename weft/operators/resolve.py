"""Resolving names to nodes: joins that only count where one candidate is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T


def unique_index(df: DataFrame, keys: list[str], value: str = "id") -> DataFrame:
    """keys and value where only one value has these keys."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def rewire_stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges whose targets without a source file become the one real node of that label, where there is just one."""
    stubs = nodes.where("source_file = ''").select(F.col("id").alias("_stub"), "label")
    real = unique_index(nodes.where("source_file <> ''"), ["label"]).withColumnRenamed("id", "_real")
    known = stubs.join(real, "label").select("_stub", "_real")
    return edges.join(known, F.col("target") == F.col("_stub"), "left").withColumn("target", F.coalesce("_real", "target")).drop("_stub", "_real")


def _levels(path: Column) -> Column:
    """rank and key of each level at which a function can be near path: its file, its directory, its leading directories."""
    up = T.parents(path)
    above = F.transform(F.sequence(F.lit(0), F.size(up)), lambda d: F.struct(d.alias("rank"), F.concat(F.lit("p"), d.cast("string"), F.lit(":"), F.array_join(F.slice(up, 1, d), "/")).alias("key")))
    here = F.array(F.struct(F.lit(1_000_002).alias("rank"), F.concat(F.lit("f:"), path).alias("key")), F.struct(F.lit(1_000_001).alias("rank"), F.concat(F.lit("d:"), F.array_join(up, "/")).alias("key")))
    return F.concat(here, above)


def nearest(calls: DataFrame, functions: DataFrame, by: list[str]) -> DataFrame:
    """calls with id: the function that is nearest to the caller's file; none where two are equally near.

    calls: caller, caller_file and by. functions: id, file and by, the columns in which both agree; a caller isn't its own
    candidate. Functions outside tests come first if there are any; then the same file, the same directory, the longest
    common path. Candidates are counted by name and level before the join, so a name that many functions have adds no rows:
    at the first level that has any, all that are counted there are equally near.
    """
    at = functions.select(*by, "id", T.is_test_path(F.col("file")).cast("int").alias("_t"), F.inline(_levels(F.col("file"))))
    level = [*by, "_t", "key"]
    counts = at.groupBy(*level).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_least"), F.max("id").alias("_most"))
    # a caller that has the name it calls is taken off the counts of its own levels
    same = functions.select(*by, F.col("id").alias("caller")).distinct().withColumn("_self", F.col("caller"))
    calls = calls.join(same, [*by, "caller"], "left")
    sites = calls.select(*by, "caller_file", "_self").distinct()
    own = at.join(sites.where("_self IS NOT NULL").select(*by, F.col("_self").alias("id")).distinct(), [*by, "id"], "left_semi")
    own = own.groupBy(*level, F.col("id").alias("_self")).agg(F.count(F.lit(1)).alias("_k"))
    tests = F.explode(F.array(F.lit(0), F.lit(1)))
    looked = sites.select("*", F.inline(_levels(F.col("caller_file")))).withColumn("_t", tests)
    left = looked.join(counts, level).join(own, [*level, "_self"], "left").withColumn("_n", F.col("_n") - F.coalesce("_k", F.lit(0)))
    other = F.when(F.col("_least").eqNullSafe(F.col("_self")), F.col("_most")).otherwise(F.col("_least"))
    best = left.where("_n > 0").groupBy(*by, "caller_file", "_self").agg(F.min_by(F.struct("_n", other.alias("id")), F.struct(F.col("_t"), -F.col("rank"))).alias("_best"))
    best = best.where("_best._n = 1").select(*by, "caller_file", F.coalesce(F.concat(F.lit("="), "_self"), F.lit("")).alias("_own"), "_best.id")
    return calls.withColumn("_own", F.coalesce(F.concat(F.lit("="), "_self"), F.lit(""))).join(best, [*by, "caller_file", "_own"]).drop("_self", "_own")


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """call_id, caller, id, confidence, score of the calls that resolve.

    calls: call_id, caller, callee, caller_file. functions: id, label, file. imports: file, symbol (what a file
    imports by name). A call resolves to the function of its name and language family that is the only one, else the
    nearest. With an import as evidence it is EXTRACTED (1.0), else INFERRED (0.8), and in JavaScript dropped.
    """
    index = functions.select("id", T.bare_name(F.col("label")).alias("_name"), "file", T.language_family(F.col("file")).alias("_family"))
    rows = calls.where("caller IS NOT NULL").withColumn("_name", T.bare_name(F.col("callee"))).withColumn("_family", T.language_family(F.col("caller_file")))
    found = nearest(rows, index, ["_name", "_family"])
    known = imports.select(F.col("file").alias("_importer"), T.bare_name(F.col("symbol")).alias("_symbol")).distinct()
    found = found.join(known, (F.col("caller_file") == F.col("_importer")) & (F.col("_name") == F.col("_symbol")), "left")
    found = found.withColumn("_imported", F.col("_symbol").isNotNull())
    chosen = found.where(F.col("_imported") | ~F.col("_family").eqNullSafe(F.lit("js")))
    return chosen.select("call_id", "caller", "id", F.when(F.col("_imported"), "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.when(F.col("_imported"), 1.0).otherwise(0.8).alias("score"))


def import_guided(calls: DataFrame, aliases: DataFrame, functions: DataFrame) -> DataFrame:
    """call_id and id of calls through an import: alias in the file, to module and symbol, to the one function there.

    calls: call_id, callee, caller_file. aliases: file, alias, module, symbol. functions: id, label, module.
    """
    target = unique_index(functions.select("id", "module", T.bare_name(F.col("label")).alias("_symbol")), ["module", "_symbol"])
    named = aliases.select(F.col("file").alias("caller_file"), T.bare_name(F.col("alias")).alias("_alias"), "module", T.bare_name(F.col("symbol")).alias("_symbol")).distinct()
    return calls.withColumn("_alias", T.bare_name(F.col("callee"))).join(named, ["caller_file", "_alias"]).join(target, ["module", "_symbol"]).select("call_id", "id").distinct()


def member_calls(calls: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """call_id and id of calls on a receiver: the one type of that name, and its one method of that name."""
    owner = unique_index(types.select("id", F.col("label").alias("receiver")), ["receiver"]).withColumnRenamed("id", "owner")
    method = unique_index(methods.select("id", "owner", T.bare_name(F.col("label")).alias("_name")), ["owner", "_name"])
    return calls.withColumn("_name", T.bare_name(F.col("callee"))).join(owner, "receiver").join(method, ["owner", "_name"]).select("call_id", "id")


def resolve_citations(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """citations (cite) with id: the node of that id, else the one node of that label, else null."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    labels = unique_index(nodes, ["label"]).select(F.col("label").alias("_label"), F.col("id").alias("_by_label"))
    rows = citations.join(ids, F.col("cite") == F.col("_id"), "left").join(labels, F.col("cite") == F.col("_label"), "left")
    return rows.withColumn("id", F.coalesce("_id", "_by_label")).drop("_id", "_label", "_by_label")


def identifiers(name: Column) -> Column:
    """The identifiers of three characters or more in a name, up to its first bracket, in lower case."""
    return F.regexp_extract_all(F.lower(F.substring_index(name, "(", 1)), F.lit("[a-z_][a-z0-9_]{2,}"), F.lit(0))


def unverified(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """ids of code nodes of which no identifier, of label or id, is in their file's text.

    nodes: id, label, file_type, source_file, confidence. texts: source_file, text. Only nodes that claim to be extracted
    count (confidence EXTRACTED, empty or null); a file without a text and a node without identifiers tell nothing.
    """
    claimed = nodes.where("file_type = 'code' AND source_file <> '' AND coalesce(confidence, '') IN ('', 'EXTRACTED')")
    names = claimed.select("id", "source_file", F.explode(F.array_distinct(F.concat(identifiers(F.coalesce("label", F.lit(""))), identifiers(F.col("id"))))).alias("name"))
    # each text is met once for each distinct name in its file, not for each node
    asked = names.select("source_file", "name").distinct()
    met = asked.join(texts.select("source_file", F.lower("text").alias("_text")), "source_file").groupBy("source_file", "name").agg(F.bool_or(F.coalesce(F.contains("_text", "name"), F.lit(False))).alias("_in"))
    return names.join(met, ["source_file", "name"]).groupBy("id").agg(F.bool_or("_in").alias("_in")).where("NOT _in").select("id")


def suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))


def match_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r of paths where one is the other or ends with '/' and the other. left: l; right: r. An equi-join on suffixes."""
    one = left.select("l", F.explode(suffixes(F.col("l"))).alias("s")).join(right.select("r", F.col("r").alias("s")), "s").select("l", "r")
    two = right.select("r", F.explode(suffixes(F.col("r"))).alias("s")).join(left.select("l", F.col("l").alias("s")), "s").select("l", "r")
    return one.union(two).distinct()


def follow_exports(names: DataFrame, exports: DataFrame, most: int = 8) -> DataFrame:
    """module, symbol, origin, origin_symbol, hops: where each exported name comes from, through at most so many re-exports.

    names: module, symbol to look up. exports: module, symbol, from_module, from_symbol (null: defined here).
    Names that lead in a circle or out of the table don't resolve.
    """
    here = names.select("module", "symbol", F.col("module").alias("origin"), F.col("symbol").alias("origin_symbol"), F.lit(0).alias("hops"))
    step = exports.select(F.col("module").alias("_m"), F.col("symbol").alias("_s"), "from_module", "from_symbol")
    done = None
    for _ in range(most + 1):
        at = here.join(step, (F.col("origin") == F.col("_m")) & (F.col("origin_symbol") == F.col("_s")))
        defined = at.where("from_module IS NULL").select("module", "symbol", "origin", "origin_symbol", "hops")
        done = defined if done is None else done.union(defined)
        here = at.where("from_module IS NOT NULL").select("module", "symbol", F.col("from_module").alias("origin"), F.col("from_symbol").alias("origin_symbol"), (F.col("hops") + 1).alias("hops"))
    return done


@dataclass(frozen=True)
class Resolver:
    """A named step over the facts of files with certain extensions."""

    name: str
    extensions: frozenset[str]
    resolve: Callable[[DataFrame], DataFrame]


class Registry:
    """Resolvers in the order of their registration; a name is registered once."""

    def __init__(self) -> None:
        self.resolvers: list[Resolver] = []

    def register(self, resolver: Resolver) -> None:
        if any(r.name == resolver.name for r in self.resolvers):
            raise ValueError(f"{resolver.name} is registered twice")
        self.resolvers.append(resolver)

    def run(self, facts: DataFrame, extensions: set[str]) -> DataFrame:
        """facts after the resolvers that any of these extensions calls for."""
        for r in self.resolvers:
            if r.extensions & extensions:
                facts = facts.transform(r.resolve)
        return facts
