"""Graph operators on small graphs with answers worked out by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import analyze, build, community, components, degree, memory, resolve, search, traverse, validate

NODES = [
    ("auth", "AuthService", "code", "src/auth.py"), ("login", ".login()", "code", "src/auth.py"), ("db", "Database", "code", "src/db.py"), ("api", "ApiRouter", "code", "web/api.ts"),
    ("doc", "Guide", "document", "docs/guide.md"), ("idea", "Caching", "concept", ""), ("file", "auth.py", "code", "src/auth.py"), ("why", "Because it is fast", "rationale", "src/db.py"),
]
EDGES = [
    ("auth", "login", "method", "EXTRACTED", 1.0, "call"), ("api", "login", "calls", "INFERRED", 1.0, "call"), ("auth", "db", "uses", "EXTRACTED", 2.0, "field"), ("auth", "db", "calls", "AMBIGUOUS", 3.0, "call"),
    ("doc", "auth", "references", "EXTRACTED", 1.0, None), ("file", "auth", "contains", "EXTRACTED", 1.0, None), ("why", "db", "rationale_for", "EXTRACTED", 1.0, None), ("db", "db", "calls", "EXTRACTED", 1.0, "call"),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, label string, file_type string, source_file string")
    edges = spark.createDataFrame(EDGES, "source string, target string, relation string, confidence string, weight double, context string").withColumn("source_file", F.lit("src/x.py"))
    return nodes, edges


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_degrees(graph):
    nodes, edges = graph
    assert dict(rows(degree.degrees(edges), "id", "degree")) == {"auth": 4, "login": 2, "db": 4, "api": 1, "doc": 1, "file": 1, "why": 1}
    # a file, a method stub and a concept are none
    assert [r["id"] for r in degree.god_nodes(nodes, edges, 3).collect()] == ["auth", "db", "api"]


def test_validation(spark, graph):
    nodes, edges = graph
    bad = spark.createDataFrame([("x", None, "tool", "a.py"), ("", "l", "code", None)], nodes.schema)
    assert rows(validate.validate_nodes(bad), "id", "problem") == [("", "missing id"), ("", "missing source_file"), ("x", "invalid file_type"), ("x", "missing label")]
    loose = edges.limit(0).union(spark.createDataFrame([("auth", "gone", "calls", "MAYBE", 1.0, None, "f")], edges.schema))
    assert rows(validate.validate_edges(loose, nodes), "problem") == [("invalid confidence",), ("unknown target",)]
    d = validate.diagnostics(edges.union(loose), nodes).first()
    assert (d["raw_edges"], d["dangling_endpoint_edges"], d["self_loops"], d["directed_pairs"], d["directed_collapsed"]) == (9, 1, 1, 7, 1)


def test_simple_graph_keeps_last(graph):
    got = build.simple_graph(graph[1]).where("a = 'auth' AND b = 'db'").first()
    assert (got["relation"], got["confidence"], got["weight"], got["parallel"]) == ("uses", "EXTRACTED", 2.0, 2)


def test_build_repairs(spark):
    raw = spark.createDataFrame([("src/a", "A", "markdown", "src\\a.md"), ("b", "B", "code", "")], "id string, name string, file_type string, path string")
    links = spark.createDataFrame([("SRC/A", "b", "calls", "-3"), ("b", "nowhere", "calls", "1")], "from string, to string, type string, weight string")
    nodes, edges = build.build_graph(raw, links)
    assert rows(nodes, "id", "label", "file_type", "source_file") == [("b", "B", "code", ""), ("src/a", "A", "document", "src/a.md")]
    assert rows(edges, "a", "b", "weight") == [("b", "src/a", 1.0)]


def test_merge_and_diff(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, source_file string")
    new = spark.createDataFrame([("9", "a")], old.schema)
    merged = build.incremental_merge(old, new, spark.createDataFrame([("c",)], "source_file string"))
    assert rows(merged, "id", "source_file") == [("2", "b"), ("9", "a")]
    assert rows(build.diff(old, merged, ["id"]), "id", "change") == [("1", "removed"), ("3", "removed"), ("9", "added")]
    assert rows(build.diff(merged, old, ["id"]), "id", "change") == [("1", "added"), ("3", "added"), ("9", "removed")]
    assert build.same_topology(old, old) and not build.same_topology(old, merged)
    assert rows(validate.shrink_guard(old, merged, new), "id") == [("3",)]


def test_rationale_and_hyperedges(spark, graph):
    nodes, edges = build.fold_rationale(*graph)
    assert nodes.where("id = 'db'").first()["rationale"] == "Because it is fast"
    assert nodes.where("id = 'why'").isEmpty() and edges.where("source = 'why'").isEmpty()
    hyper = spark.createDataFrame([("h", ["db", "nope", "auth"]), ("g", ["nope"])], "id string, members array<string>")
    assert [tuple(r["members"]) for r in build.filter_hyperedges(hyper, graph[0], 2).collect()] == [("db", "auth")]


def test_walks(spark, graph):
    nodes, edges = graph
    seeds = spark.createDataFrame([("api",)], "id string")
    assert dict(rows(traverse.bfs(nodes, edges, seeds, 3), "id", "hop")) == {"api": 0, "login": 1, "auth": 2, "db": 3, "doc": 3, "file": 3}
    assert dict(rows(traverse.bfs(nodes, edges, seeds, 3, cutoff=1), "id", "hop")) == {"api": 0, "login": 1}
    assert traverse.shortest_path(edges, "api", "why").first()["path"] == ["api", "login", "auth", "db", "why"]
    assert traverse.shortest_path(edges, "api", "idea").isEmpty()
    # api calls login, a member of auth; doc refers to auth
    assert rows(traverse.affected(edges, "auth", 1), "id", "relation", "hop") == [("api", "calls", 1), ("doc", "references", 1)]
    assert traverse.dfs(edges, "api", 2) == [("api", 0), ("login", 1), ("auth", 2)]
    queries = spark.createDataFrame([(q,) for q in ("db", "authservice", "login", "docs/guide.md/", "Cach", "zzz")], "query string")
    assert dict(rows(traverse.resolve_seeds(nodes, queries), "query", "id")) == {"db": "db", "authservice": "auth", "login": "login", "docs/guide.md/": "doc", "Cach": "idea"}


def test_cycles(spark):
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("s", "s"), *[(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]]
    got = traverse.import_cycles(spark.createDataFrame(links, "source string, target string"))
    assert rows(got, "cycle") == [("a -> b",), ("a -> b -> c",), ("s",)]


def test_components_of_random_graphs(spark):
    r = random.Random(1)
    for _ in range(3):
        pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)]
        parent = {x: x for p in pairs for x in p}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        got = components.connected_components(spark.createDataFrame(pairs, "src long, dst long"))
        assert dict(rows(got, "node", "component")) == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_communities(spark):
    names = [f"{g}{i}" for g in "abc" for i in range(6)]
    links = [(x, y) for g in "abc" for x in names if x[0] == g for y in names if y[0] == g and x < y] + [("a0", "b0"), ("b1", "c1")]
    nodes = spark.createDataFrame([(n, n, "code", "f.py") for n in [*names, "alone"]], "id string, label string, file_type string, source_file string")
    edges = spark.createDataFrame([(*e, "calls") for e in links], "source string, target string, relation string")
    found = community.detect(nodes, edges)
    groups = {}
    for n, c in rows(found, "node_id", "community"):
        groups.setdefault(c, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted([["alone"], *[[f"{g}{i}" for i in range(6)] for g in "abc"]])
    assert community.modularity(edges, found).first()[0] > 0.5
    renamed = community.remap(found.withColumn("community", F.col("community") + 50), found)
    assert rows(renamed, "node_id", "community") == rows(found.withColumn("community", F.col("community") + 50), "node_id", "community")
    line = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r")], "source string, target string, relation string")
    ids = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert dict((i, round(s, 6)) for i, s in rows(community.betweenness(ids, line), "id", "score")) == {"a": 0.0, "b": 0.666667, "c": 0.666667, "d": 0.0}


def test_betweenness_takes_links_in_any_number_of_parts(spark, monkeypatch):
    monkeypatch.setattr(community, "PART_LINKS", 7)
    ids = [f"n{i}" for i in range(14)]
    links = {(i, (i * i + 1) % 12) for i in range(12)} | {(i, i + 1) for i in range(0, 11, 2)} | {(12, 13), (3, 3)}
    near = {i: {b for a, b in links | {(b, a) for a, b in links} if a == i and b != i} for i in range(14)}

    def ways(s):
        hops, count, level = {s: 0}, {s: 1}, [s]
        while level:
            onward = {v for u in level for v in near[u] if v not in hops}
            hops |= dict.fromkeys(onward, hops[level[0]] + 1)
            count |= {v: sum(count[u] for u in level if v in near[u]) for v in onward}
            level = list(onward)
        return hops, count

    found = [ways(s) for s in range(14)]
    want = {}
    for v in range(14):
        between = [(s, t) for s in range(14) for t in found[s][0] if v not in (s, t) and s != t and v in found[s][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]]
        want[f"n{v}"] = round(sum(found[s][1][v] * found[v][1][t] / found[s][1][t] for s, t in between) / (13 * 12), 6)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", "r") for a, b in sorted(links)] * 2, "source string, target string, relation string")
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    got = {i: round(s, 6) for i, s in rows(community.betweenness(nodes, edges), "id", "score")}
    assert got == want and max(want.values()) > 0
    assert rows(community.betweenness(nodes, edges.limit(0)), "id", "score") == sorted((x, 0.0) for x in ids)


def test_surprises(spark, graph):
    nodes, edges = graph
    cs = spark.createDataFrame([("auth", 0), ("db", 1), ("api", 1), ("login", 0), ("doc", 2)], "node_id string, community int")
    got = {(s, t, r): n for s, t, r, n in rows(analyze.surprises(nodes, edges, cs), "source", "target", "relation", "score")}
    # uses: extracted 1 + communities 1; calls: ambiguous 3 + communities 1; the guide: 1 + file types 2 + directories 2 + communities 1
    assert got == {("auth", "db", "uses"): 2, ("auth", "db", "calls"): 4, ("doc", "auth", "references"): 6}
    assert {r["type"] for r in analyze.suggest_questions(nodes, edges, cs).collect()} >= {"ambiguous_edge"}


def test_search(spark, graph):
    nodes, edges = graph
    assert search.terms_of("How does the Authservice work with a Database?") == ["authservice", "database"]
    assert search.terms_of("how does it work") == ["how", "does", "work"]
    best = search.ranked(nodes, ["authservice"]).first()
    assert best["id"] == "auth"
    assert search.pick_seeds(nodes, edges, ["authservice", "database"]) == ["db", "auth"]
    lines = search.within_budget(search.query_subgraph(nodes, edges, "AuthService", 1), edges, 10).orderBy("place").collect()
    assert [r["id"] for r in lines] == ["auth"]
    text = "# A\n" + "x" * 50 + "\n\n" + "y" * 60 + "\n# B\n" + "z" * 30
    docs = spark.createDataFrame([(1, text), (2, None), (3, "q" * 250)], "doc_id long, text string")
    for i, whole in ((1, text), (2, ""), (3, "q" * 250)):
        cuts = rows(search.slices(docs, 100).where(F.col("doc_id") == i), "place", "start", "end")
        assert "".join(whole[a:b] for _, a, b in cuts) == whole and all(b - a <= 100 for _, a, b in cuts)


def test_calls_resolve_by_evidence(spark):
    functions = spark.createDataFrame([("f1", "run()", "src/a/x.py"), ("f2", "run()", "src/b/y.py"), ("f3", "run()", "tests/t.py"), ("g", "only()", "lib/z.py"), ("j", "only()", "web/z.js")], "id string, label string, file string")
    calls = spark.createDataFrame([(1, "c", "run", "src/a/c.py"), (2, "c", "run", "other/c.py"), (3, "c", "only", "src/c.py"), (4, "c", "none", "src/c.py"), (5, "c", "only", "web/c.js")], "call_id long, caller string, callee string, caller_file string")
    imports = spark.createDataFrame([("src/c.py", "only")], "file string, symbol string")
    got = resolve.resolve_calls(calls, functions, imports)
    assert rows(got, "call_id", "id", "confidence") == [(1, "f1", "INFERRED"), (3, "g", "EXTRACTED")]
    exports = spark.createDataFrame([("m", "x", "n", "y"), ("n", "y", None, None), ("l", "z", "l", "z")], "module string, symbol string, from_module string, from_symbol string")
    found = resolve.follow_exports(exports.select("module", "symbol"), exports)
    assert rows(found.where("module = 'm'"), "origin", "origin_symbol", "hops") == [("n", "y", 1)]
    assert found.where("module = 'l'").isEmpty()


def test_lessons(spark):
    data = [(1, "2024-01-01", "useful", ["a", "a"]), (2, "2024-01-31", "useful", ["a"]), (3, "2024-01-31", "dead_end", ["b"]), (4, None, "useful", ["b"]), (5, "2030-01-01", "useful", ["c"])]
    mem = spark.createDataFrame(data, "doc_id long, date string, outcome string, source_nodes array<string>").withColumn("date", F.to_timestamp("date")).withColumn("question", F.lit("q"))
    got = memory.verdicts(memory.lesson_scores(mem, F.lit("2024-01-31").cast("timestamp")))
    assert rows(got, "node", "score", "pos", "neg", "status") == [("a", 1.5, 2, 0, "preferred"), ("b", 0.0, 1, 1, "contested even"), ("c", 1.0, 1, 0, "tentative")]
    assert memory.last_by_question(mem).first()["doc_id"] == 5
    assert rows(memory.provenance(mem), "node", "docs") == [("a", [2, 1]), ("b", [4]), ("c", [5])]


def test_questions_look_for_a_kind_only_if_it_can_be_among_the_first(spark):
    names = [f"{g}{i}" for g in "ab" for i in range(7)] + ["c0"]
    links = [(x, y, "INFERRED" if "2" in x + y else "EXTRACTED") for x in names for y in names if x < y and x[0] == y[0]] + [("a0", "b0", "EXTRACTED"), ("a1", "a2", "AMBIGUOUS"), ("b1", "b3", "AMBIGUOUS"), ("b0", "c0", "EXTRACTED")]
    nodes = spark.createDataFrame([(n, n.upper(), "code", f"{n}.py") for n in names], "id string, label string, file_type string, source_file string")
    edges = spark.createDataFrame([(x, y, "calls", c) for x, y, c in links], "source string, target string, relation string, confidence string")
    cs = spark.createDataFrame([(n, 0 if n[0] == "a" else 1) for n in names], "node_id string, community int")
    asked = []

    def between():
        asked.append(1)
        return community.betweenness(nodes, edges)

    whole = [tuple(r) for r in analyze.suggest_questions(nodes, edges, cs, 100, community.betweenness(nodes, edges)).collect()]
    kinds = list(dict.fromkeys(r[0] for r in whole))
    assert kinds == ["ambiguous_edge", "bridge_node", "verify_inferred", "isolated_nodes"] and [r[2] for r in whole[:4]] == ["a1 a2", "b1 b3", "a0", "b0"]
    for n in range(1, len(whole) + 1):
        asked.clear()
        assert [tuple(r) for r in analyze.suggest_questions(nodes, edges, cs, n, between).collect()] == whole[:n]
        assert len(asked) == (n > 2)


def test_searches_from_the_side_with_fewer_links(monkeypatch):
    monkeypatch.setattr(community, "NEAR_LINKS", 5)
    r = random.Random(5)
    shapes = [[(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 20)] + [(i, i + 20) for i in range(1, 15)], [(r.randrange(25), r.randrange(25)) for _ in range(60)], [(r.randrange(40), r.randrange(40)) for _ in range(35)]]
    for links in shapes:
        n = 41  # some have no links
        links = sorted({(min(x), max(x)) for x in links if x[0] != x[1]})
        keys = np.array([a << 32 | b for a, b in links])
        starts, to = community._adjacency((community._packed(x) for x in (keys[:9], keys[9:])), n)
        near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(n)}
        assert [sorted(to[starts[i] : starts[i + 1]]) for i in range(n)] == [sorted(near[i]) for i in range(n)]
        for s in range(n):
            hops, ways, order = {s: 0}, {s: 1}, [s]
            for u in order:
                for v in near[u]:
                    if v not in hops:
                        hops[v] = hops[u] + 1
                        order.append(v)
                    if hops[v] == hops[u] + 1:
                        ways[v] = ways.get(v, 0) + ways[u]
            want = dict.fromkeys(range(n), 0.0)
            for v in reversed(order):
                want[v] = sum(ways[v] / ways[w] * (1 + want[w]) for w in near[v] if hops[w] == hops[v] + 1)
            want[s] = 0.0
            got = np.zeros(n)
            community._shares(starts, to, s, got)
            assert np.allclose(got, [want[i] for i in range(n)], rtol=1e-12)


def test_betweenness_tells_names_with_one_hash_apart(spark, monkeypatch):
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "cc", "dd", "e")], "id string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "cc", "r"), ("cc", "dd", "r"), ("dd", "elsewhere", "r")], "source string, target string, relation string")
    want = rows(community.betweenness(nodes, edges), "id", "score")
    key, tried = community._key, []

    def poor(seed, name):
        tried.append(seed)
        return key(seed, name) if seed else F.length(name).cast("long")

    monkeypatch.setattr(community, "_key", poor)
    assert rows(community.betweenness(nodes, edges), "id", "score") == want and tried[:2] == [0, 1]
    assert [i for i, score in want if score > 0] == ["b", "cc", "dd"]
