"""Edges of walks, depth-first walks, answers with edges, and divided communities, on small graphs worked out by hand."""

from __future__ import annotations

import itertools

from weft.operators import community, search, traverse

NODE = "id string, label string, file_type string, source_file string"
EDGE = "source string, target string, relation string, confidence string, context string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def graph(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(i, i.upper(), "code", f"{i}.py") for i in ids], NODE)
    return nodes, spark.createDataFrame([(a, b, "calls", "EXTRACTED", "") for a, b in pairs], EDGE)


STAR = [("s", "h"), ("h", "a"), ("h", "b"), ("a", "b"), ("s", "c"), ("d", "c"), ("s", "s"), ("s", "c")]


def test_a_node_at_the_cutoff_is_reached_and_not_walked_through(spark):
    nodes, edges = graph(spark, STAR)
    seeds = spark.createDataFrame([("s",)], "id string")
    assert rows(traverse.bfs(nodes, edges, seeds, 2, cutoff=3)) == [("c", 1), ("d", 2), ("h", 1), ("s", 0)]
    seen = traverse.bfs(nodes, edges, seeds, 2, cutoff=4)
    assert rows(seen) == [("a", 2), ("b", 2), ("c", 1), ("d", 2), ("h", 1), ("s", 0)]
    # d-c keeps its direction, a-b is no step, a parallel edge stays
    assert rows(traverse.walked(nodes, edges, seen, 4), "source", "target", "u", "v", "hop") == [("d", "c", "c", "d", 2), ("h", "a", "h", "a", 2), ("h", "b", "h", "b", 2), ("s", "c", "s", "c", 1), ("s", "c", "s", "c", 1), ("s", "h", "s", "h", 1)]
    cut = traverse.bfs(nodes, edges, seeds, 2, cutoff=3)
    assert rows(traverse.walked(nodes, edges, cut, 3), "u", "v") == [("c", "d"), ("s", "c"), ("s", "c"), ("s", "h")]
    assert rows(traverse.walked(nodes, edges, cut.limit(0), 3)) == []


def test_depth_first_from_several_seeds_with_a_cutoff(spark):
    _, edges = graph(spark, STAR)
    assert traverse.dfs(edges, ["s", "d"], 2) == [("s", 0), ("c", 1), ("d", 2), ("h", 1), ("a", 2), ("b", 2)]
    assert traverse.dfs(edges, ["s"], 2, cutoff=3) == [("s", 0), ("c", 1), ("d", 2), ("h", 1)]
    assert traverse.dfs(edges, ["h"], 1, cutoff=3) == [("h", 0), ("a", 1), ("b", 1), ("s", 1)]


def test_answers_have_edges_and_say_what_is_cut(spark):
    nodes, edges = graph(spark, [("alpha", "beta"), ("gamma", "alpha"), ("beta", "gamma")], ["far"])
    whole = [r["line"] for r in search.answer(nodes, edges, "alpha", 1).orderBy("place").collect()]
    assert whole == ["NODE ALPHA [alpha]", "NODE BETA [beta]", "NODE GAMMA [gamma]", "EDGE ALPHA --calls [EXTRACTED]--> BETA", "EDGE GAMMA --calls [EXTRACTED]--> ALPHA"]
    few = [r["line"] for r in search.answer(nodes, edges, "alpha", 1, tokens=34).orderBy("place").collect()]
    assert few[:4] == whole[:4] and few[4].startswith("... 3 of 3 nodes and 1 of 2 edges") and len(few) == 5
    least = [r["line"] for r in search.answer(nodes, edges, "alpha", 1, tokens=8).orderBy("place").collect()]
    assert least[0] == whole[0] and least[-1].startswith("... 1 of 3 nodes and 0 of 2 edges") and len(least) == 2
    deep = search.query_subgraph(nodes, edges, "alpha", 2, deep=True)
    assert rows(deep, "id", "hop") == [("alpha", 0), ("beta", 1), ("gamma", 2)]
    assert search.answer(nodes, edges, "zzz", 1).isEmpty()


def test_hubs_stay_out_and_come_back_to_most_of_their_neighbours(spark):
    pairs = [(a, b) for g in "xyz" for a, b in itertools.combinations([f"{g}{i}" for i in range(6)], 2)]
    hub = [("hub", f"{g}{i}") for g in "xyz" for i in range(4 if g == "x" else 3)]
    nodes, edges = graph(spark, pairs + hub, ["lone", "stray"])
    edges = edges.union(spark.createDataFrame([("hub", "stray", "calls", "EXTRACTED", "")], EDGE))
    assert rows(community.hubs(nodes, edges, 95)) == [("hub",)]
    assert rows(community.hubs(nodes, edges, 100)) == []
    got = dict(rows(community.detect(nodes, edges, hub_percentile=95), "node_id", "community"))
    groups = sorted(sorted(n for n, c in got.items() if c == k) for k in set(got.values()))
    assert groups == sorted([["hub", *[f"x{i}" for i in range(6)]], [f"y{i}" for i in range(6)], [f"z{i}" for i in range(6)], ["lone"], ["stray"]])
    assert got["hub"] == 0  # the largest


def test_large_communities_are_divided_along_their_inner_links(spark):
    pairs = [(a, b) for g in "pq" for a, b in itertools.combinations([f"{g}{i}" for i in range(5)], 2)] + [("p0", "q0")]
    nodes, edges = graph(spark, pairs, ["t"])
    whole = nodes.selectExpr("id AS node_id", "CASE WHEN id = 't' THEN 't' ELSE 'p0' END AS community")
    lone = whole.union(spark.createDataFrame([("u", "p0")], "node_id string, community string"))
    got = dict(rows(community.split(edges, lone, spark.createDataFrame([("p0",)], "community string"))))
    parts = sorted(sorted(n for n, c in got.items() if c == k) for k in set(got.values()))
    assert parts == [[f"p{i}" for i in range(5)], [f"q{i}" for i in range(5)], ["t"], ["u"]]
    assert rows(community.split(edges, lone, spark.createDataFrame([], "community string"))) == rows(lone)
