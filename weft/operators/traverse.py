"""Walks over the graph: level by level, each level a join of the frontier with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vocab
from weft.operators.degree import degrees
from weft.runtime import materialize, sized_broadcast

#: Nodes of this degree or a higher one, or of the 99th percentile's if that is more, aren't walked through.
HUB_FLOOR = 50
#: No walk goes farther than this.
MAX_DEPTH = 6


def hub_cutoff(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> int:
    """max(HUB_FLOOR, the degree at place int(0.99 n) in ascending order), found from counts by degree.

    known: the degrees of edges, if they are at hand.
    """
    known = degrees(edges) if known is None else known
    total, linked = nodes.count(), known.count()
    by_degree = known.groupBy("degree").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("degree"))
    if not total:
        return HUB_FLOOR
    above = total - int(total * 0.99)  # the place counted from the top, from 1
    running = by_degree.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("degree"))))  # a row for each degree that occurs
    row = running.where(F.col("upto") >= above).orderBy("upto").first() if above <= linked else None
    return max(HUB_FLOOR, row["degree"] if row else 0)


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) for each edge in both directions, without repeats."""
    e = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    return e.union(e.select("v", "u")).where("u <> v").distinct()


def _reach(edges: DataFrame, known: DataFrame, seeds: DataFrame, depth: int, cutoff: int | None) -> DataFrame:
    """id and hop of the nodes within depth hops; those of cutoff links or more, but for seeds, aren't walked through."""
    ends = materialize(edges.select(F.col("source").alias("u"), F.col("target").alias("v")).where("u <> v"), "ends")
    links = ends.union(ends.select("v", "u"))  # with repeats: only what a hop finds is made distinct
    hubs = known.where(F.col("degree") >= cutoff).select(F.col("id").alias("u")) if cutoff is not None else None
    frontier = materialize(seeds.select("id").distinct(), "frontier")
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        walkers = frontier.select(F.col("id").alias("u"))
        if hop > 1 and hubs is not None:
            walkers = walkers.join(hubs, "u", "left_anti")
        found = links.join(sized_broadcast(materialize(walkers, "walkers")), "u").select(F.col("v").alias("id")).distinct()
        frontier = materialize(found.join(seen.select("id"), "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.withColumn("hop", F.lit(hop)))
    return seen


def bfs(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, cutoff: int | None = None) -> DataFrame:
    """id and hop (0 for seeds) of the nodes within depth hops, MAX_DEPTH at most, whatever the edges' direction.

    Nodes whose degree is the hub cutoff or more are reached but not walked through, unless they are seeds.
    """
    known = materialize(degrees(edges), "degrees")
    cutoff = hub_cutoff(nodes, edges, known) if cutoff is None else cutoff
    return _reach(edges, known, seeds, min(depth, MAX_DEPTH), cutoff)


def walked(nodes: DataFrame, edges: DataFrame, seen: DataFrame, cutoff: int | None = None) -> DataFrame:
    """The edges over which bfs went to get seen (id, hop), with u, v and hop: from u, over hop - 1 others, to v.

    These are the edges from a node that is walked through to one that is a hop farther; each keeps its own direction.
    """
    known = materialize(degrees(edges), "degrees")
    cutoff = hub_cutoff(nodes, edges, known) if cutoff is None else cutoff
    at = sized_broadcast(materialize(seen.select("id", "hop"), "seen"))
    ends = edges.join(at.select(F.col("id").alias("source"), F.col("hop").alias("_s")), "source").join(at.select(F.col("id").alias("target"), F.col("hop").alias("_t")), "target")
    onward = F.col("_s") < F.col("_t")
    steps = ends.where("abs(_s - _t) = 1").withColumn("u", F.when(onward, F.col("source")).otherwise(F.col("target"))).withColumn("v", F.when(onward, F.col("target")).otherwise(F.col("source"))).withColumn("hop", F.greatest("_s", "_t"))
    hubs = known.where(F.col("degree") >= cutoff).join(at.where("hop > 0"), "id", "left_semi").select(F.col("id").alias("u"))
    return steps.join(hubs, "u", "left_anti").select(*edges.columns, "u", "v", "hop")


def dfs(edges: DataFrame, seed: str | list[str], depth: int = 2, limit: int = 100_000, cutoff: int | None = None) -> list[tuple[str, int]]:
    """Nodes in depth-first order, with their depth, from one seed or several, neighbours in the order of their ids.

    Nodes of cutoff links or more are visited but not walked through, unless they are seeds; without a cutoff, all are.
    The order of visits decides what is reached, so this runs on the driver, over the part of the graph within
    depth hops of the seeds; a part with more than limit links is refused.
    """
    spark = edges.sparkSession
    seeds = [seed] if isinstance(seed, str) else list(seed)
    start = spark.createDataFrame([(s,) for s in seeds], "id string")
    known = materialize(degrees(edges), "degrees")
    near = materialize(_reach(edges, known, start, depth, cutoff), "near").select("id")
    hubs = known.where(F.col("degree") >= cutoff).select("id").join(start, "id", "left_anti") if cutoff is not None else known.limit(0).select("id")
    through = materialize(near.join(hubs, "id", "left_anti"), "through")
    inner = both_ways(edges).join(through, F.col("u") == F.col("id"), "left_semi").join(near, F.col("v") == F.col("id"), "left_semi").limit(limit + 1).collect()
    if len(inner) > limit:
        raise ValueError(f"more than {limit} links within {depth} hops")
    neighbours: dict[str, list[str]] = {}
    for row in inner:
        neighbours.setdefault(row["u"], []).append(row["v"])
    out, seen, stack = [], set(), [(s, 0) for s in reversed(seeds)]
    while stack:
        node, at = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append((node, at))
        if at < depth:
            stack += [(v, at + 1) for v in sorted(neighbours.get(node, ()), reverse=True) if v not in seen]
    return out


def affected(edges: DataFrame, seed: str, depth: int = 2, relations: tuple[str, ...] = vocab.IMPACT_RELATIONS) -> DataFrame:
    """id, hop, relation of what depends on seed: backwards over impact relations, from seed and its members.

    A node's relation is the first by hop, then by relation. Seed and members aren't reported.
    """
    spark = edges.sparkSession
    back = edges.where(F.col("relation").isin(*relations)).select(F.col("target").alias("t"), F.col("source").alias("id"), "relation")
    members = edges.where((F.col("source") == seed) & F.col("relation").isin(*vocab.MEMBER_RELATIONS)).select(F.col("target").alias("id"))
    frontier = materialize(spark.createDataFrame([(seed,)], "id string").union(members).distinct(), "frontier")
    seen, hits = frontier, None
    for hop in range(1, depth + 1):
        walkers = sized_broadcast(frontier.select(F.col("id").alias("t")))
        found = back.join(walkers, "t").groupBy("id").agg(F.min("relation").alias("relation"))
        level = materialize(found.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)), "affected")
        hits = level if hits is None else hits.unionByName(level)
        frontier = level.select("id")
        if level.isEmpty():
            break
        seen = seen.union(frontier)
    return hits


def shortest_lengths(edges: DataFrame, seed: str, most: int = 8) -> DataFrame:
    """id and hops from seed, whatever the direction, within most hops; one search for all targets."""
    spark = edges.sparkSession
    links = materialize(both_ways(edges), "links")
    frontier = materialize(spark.createDataFrame([(seed,)], "id string"), "frontier")
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, most + 1):
        found = links.join(sized_broadcast(frontier.select(F.col("id").alias("u"))), "u").select(F.col("v").alias("id")).distinct()
        frontier = materialize(found.join(seen.select("id"), "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.withColumn("hops", F.lit(hop)))
    return seen


def shortest_path(edges: DataFrame, seed: str, goal: str, most: int = 8) -> DataFrame:
    """One row: path, the lexicographically first of the shortest paths (ids); empty if there is none within most hops.

    The search runs from the seed; then the path is followed back from the goal, over nodes each one hop nearer.
    """
    spark = edges.sparkSession
    hops = materialize(shortest_lengths(edges, seed, most), "hops")
    end = hops.where(F.col("id") == goal).first()
    if end is None:
        return spark.createDataFrame([], "path array<string>")
    links = both_ways(edges)
    # the nodes on shortest paths to the goal, level by level from the goal
    levels = [materialize(spark.createDataFrame([(goal,)], "id string"), "on-path")]
    for hop in range(end["hops"] - 1, -1, -1):
        nearer = hops.where(F.col("hops") == hop).select("id")
        back = links.join(sized_broadcast(levels[-1].select(F.col("id").alias("u"))), "u").select(F.col("v").alias("id")).distinct()
        levels.append(materialize(nearer.join(back, "id", "left_semi"), "on-path"))
    path = [seed]
    for level in reversed(levels[:-1]):
        step = links.where(F.col("u") == path[-1]).select(F.col("v").alias("id")).join(level, "id", "left_semi")
        path.append(step.agg(F.min("id")).first()[0])
    return spark.createDataFrame([(path,)], "path array<string>")


def neighbors(nodes: DataFrame, edges: DataFrame, node: str, relation: str = "") -> DataFrame:
    """direction ('in' or 'out'), relation, id and label of a node's edges whose relation contains a text."""
    chosen = edges.where(F.col("relation").contains(relation))
    out = chosen.where(F.col("source") == node).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("id"))
    into = chosen.where(F.col("target") == node).select(F.lit("in"), "relation", "source")
    return out.union(into).distinct().join(nodes.select("id", "label"), "id").select("direction", "relation", "id", "label")


def find_node(nodes: DataFrame, text: str, n: int = 20) -> DataFrame:
    """id, label and tier of the nodes that a text names: 0 source file, 1 exact label or id, 2 prefix, 3 part of the label."""
    label, want = F.lower(T.plain_letters(F.col("label"))), F.lower(T.plain_letters(F.lit(text)))
    tier = (
        F.when(F.lower("source_file") == want, 0)
        .when((label == want) | (T.bare_name(F.col("label")) == want) | (F.lower("id") == want), 1)
        .when(label.startswith(want) | F.lower("id").startswith(want), 2)
        .when(label.contains(want), 3)
    )
    return nodes.select("id", "label", tier.alias("tier")).where("tier IS NOT NULL").orderBy("tier", F.length("label"), "id").limit(n)


def resolve_seeds(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query and id for each of queries (query): the first tier with exactly one node decides.

    Tiers: the id, the label, the bare name, the source file, a part of the label. The last is tried for queries
    that no other tier resolves; it compares them with all labels.
    """
    q = queries.select(F.col("query"), F.regexp_replace("query", r"[/\\]+$", "").alias("_q")).distinct()
    low = F.lower(F.trim("_q"))
    n = nodes.select("id", F.lower(F.trim("label")).alias("label"), T.bare_name(F.col("label")).alias("bare"), F.lower("source_file").alias("file"))
    tiers = [("id", F.col("_q")), ("label", low), ("bare", T.bare_name(F.col("_q"))), ("file", low)]
    found = None
    for place, (column, key) in enumerate(tiers):
        index = n.groupBy(F.col(column).alias("_k")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("_k", "id")
        hit = q.withColumn("_key", key).join(index, F.col("_key") == F.col("_k")).select("query", "id", F.lit(place).alias("tier"))
        found = hit if found is None else found.union(hit)
    best = materialize(found.groupBy("query").agg(F.min_by("id", "tier").alias("id"), F.min("tier").alias("tier")), "seeds")
    left = q.join(best, "query", "left_anti").withColumn("_low", low)
    part = n.join(sized_broadcast(materialize(left, "unresolved")), F.col("label").contains(F.col("_low")))
    part = part.groupBy("query").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("query", "id", F.lit(4).alias("tier"))
    return best.union(part)


def import_cycles(files: DataFrame, most: int = 5, n: int = 20) -> DataFrame:
    """cycle (files joined by ' -> ', the least first) and length of simple cycles of up to most files, n of them.

    files: source and target file of each import. A cycle is found once, from its least file: a path only
    goes on to files greater than that. Shorter cycles come first, so paths aren't extended once n are found.
    """
    links = materialize(files.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "imports")
    paths = links.where("target >= source").select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("path"))
    loops = paths.where("first = last").select(F.array("first").alias("path"))
    paths = paths.where("first <> last")
    step = links.select(F.col("source").alias("s"), F.col("target").alias("t"))
    for _ in range(2, most + 1):
        loops = materialize(loops, "cycles")
        if loops.limit(n).count() == n:
            break
        paths = materialize(paths, "paths")
        onward = paths.join(step, F.col("last") == F.col("s"))
        loops = loops.union(onward.where("t = first").select("path"))
        paths = onward.where("t > first AND NOT array_contains(path, t)").select("first", F.col("t").alias("last"), F.concat("path", F.array("t")).alias("path"))
    cycles = loops.select(F.array_join("path", " -> ").alias("cycle"), F.size("path").alias("length"))
    return cycles.orderBy("length", "cycle").limit(n)


