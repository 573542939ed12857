"""Queries over their whole input, held against versions that compare everything."""

from __future__ import annotations

import random

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from weft.engine import Engine
from weft.operators import entities, resolve
from weft.sources import files, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", ["raw_call_resolution", "proximity_tiebreak"])
def test_calls_see_every_definition(spark, duck, name):
    whole = __spark_entry__.oracle_sql()[name].replace(" WHERE p_partkey % 10 = 3", "")
    got = sorted(map(tuple, __spark_entry__.queries()[name](spark, SF).collect()))
    assert got and got == sorted(duck.execute(whole).fetchall())


def test_nearest_of_hot_names(spark):
    r = random.Random(3)
    paths = [f"{a}{b}{c}.py" for a in ("", "a/", "tests/") for b in ("", "b/", "b/c/", "d/") for c in "xy"]
    functions = [(f"f{i}", r.choice(["run()", "go()", "one()"]) if i else "rare()", r.choice(paths)) for i in range(40)]
    calls = [(i, r.choice(["c", *[f[0] for f in functions]]), r.choice(["run", "go", "one", "rare"]), r.choice(paths)) for i in range(300)]

    def rank(file, at):
        x, y = file.split("/")[:-1], at.split("/")[:-1]
        depth = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        return "tests" not in x, 1_000_002 if file == at else 1_000_001 if x == y else depth

    want = []
    for call, caller, name, at in calls:
        best = sorted(((rank(file, at), f) for f, label, file in functions if label == f"{name}()" and f != caller), reverse=True)
        if best and (len(best) == 1 or best[0][0] > best[1][0]):
            want.append((call, best[0][1]))
    df = spark.createDataFrame(calls, "call_id long, caller string, callee string, caller_file string")
    got = resolve.resolve_calls(df, spark.createDataFrame(functions, "id string, label string, file string"), spark.createDataFrame([], "file string, symbol string"))
    assert sorted((x["call_id"], x["id"]) for x in got.collect()) == want


def test_cypher_escape_takes_whole_texts(spark, duck):
    whole = __spark_entry__.oracle_sql()["cypher_escape"].replace("substr(text, 1, 200)", "text")
    got = sorted(map(tuple, __spark_entry__.queries()["cypher_escape"](spark, SF).collect()))
    assert max(len(x[1]) for x in got) > 1000 and got == sorted(duck.execute(whole).fetchall())


def test_long_buckets_lose_no_pair(spark):
    text = "a graph of files and functions with their calls and imports and what the documents say about all of them"
    labels = [(f"n{i:03}", f"{text} {i % 40} {'xyz'[i % 3]}{'uvw'[i % 7 % 3]}") for i in range(130)]
    df = spark.createDataFrame(labels, "id string, norm string")
    signatures = {r["id"]: r["s"] for r in df.select("id", entities.minhash(F.col("norm")).alias("s")).collect()}
    k = entities.ROWS
    agree = lambda a, b: any(signatures[a][i : i + k] == signatures[b][i : i + k] for i in range(0, k * entities.BANDS, k))
    want = [(a, b) for a, _ in labels for b, _ in labels if a < b and agree(a, b)]
    assert len(want) > 130 * 50
    assert sorted(map(tuple, entities.lsh_pairs(df).collect())) == want
    nodes = df.select("id", F.col("norm").alias("label"), F.lit("concept").alias("file_type"), F.concat("id", F.lit(".md")).alias("source_file"))
    one = {}
    for i, label in labels:
        one.setdefault(label, i)
    pairs = [(a, b, x, y, f"{a}.md", f"{b}.md") for x, a in one.items() for y, b in one.items() if a < b and agree(a, b)]
    merging = entities.scored(spark.createDataFrame(pairs, "a string, b string, na string, nb string, fa string, fb string")).where("merges")
    got = sorted((r["a"], r["b"]) for r in entities.fuzzy_pairs(nodes).collect())
    assert got and got == sorted((r["a"], r["b"]) for r in merging.collect())


@pytest.mark.parametrize("name", ["jaro_score", "jaro_winkler_score", "fuzzy_pairs_guarded"])
def test_labels_are_compared_across_first_words(spark, duck, name):
    whole = __spark_entry__.oracle_sql()[name].replace("split_part(a.norm, ' ', 1) = split_part(b.norm, ' ', 1) AND ", "")
    rows = lambda found: sorted((a, b, round(float(s), 6)) for a, b, s in found)
    got, want = rows(__spark_entry__.queries()[name](spark, SF).collect()), rows(duck.execute(whole).fetchall())
    if name != "fuzzy_pairs_guarded":
        assert any(a.split()[0] != b.split()[0] for a, b, _ in got)
    assert got and got == want


def test_labels_differing_in_the_first_word_merge(spark, tmp_path):
    types = ["STANDARD", "STANDRAD", "STANDARDS", "ECONOMY", "ECONMOY", "PROMO"]
    parts = [(i, t, n, "Brand#1", 1) for i, (t, n) in enumerate((t, n) for t in types for n in ("blue widget", "red ring"))]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["na"], r["nb"]) for r in __spark_entry__.queries()["fuzzy_pairs_guarded"](spark, str(tmp_path)).collect()}
    names = sorted(f"{t} {n}".lower() for _, t, n, _, _ in parts)
    file = {f"{t} {n}".lower(): f"f{k % 3}.md" for k, t, n, _, _ in parts}
    pairs = spark.createDataFrame([(a, b, file[a], file[b]) for a in names for b in names if a < b], "na string, nb string, fa string, fb string")
    want = {(r["na"], r["nb"]) for r in entities.scored(pairs).where("merges").collect()}
    assert ("standard blue widget", "standrad blue widget") in got and got == want


def test_questions_name_bridges(spark):
    names = [f"{g}{i}" for g in "ab" for i in range(5)]
    links = [(x, y) for x in names for y in names if x < y and x[0] == y[0]] + [("a0", "b0")]
    nodes = spark.createDataFrame([(n, n, "code", f"{n}.py") for n in names], "id string, label string, file_type string, source_file string")
    edges = spark.createDataFrame([(*e, "calls", "EXTRACTED") for e in links], "source string, target string, relation string, confidence string")
    got = {(r["type"], r["about"]) for r in Engine(nodes, edges).questions().collect()}
    assert {about for kind, about in got if kind == "bridge_node"} == {"a0", "b0"}


def test_centrality_and_communities_take_every_edge(spark):
    query = __spark_entry__.queries()
    scores = {r["id"]: r["score"] for r in query["betweenness"](spark, SF).collect()}
    kinds = {i.split(":")[0] for i, score in scores.items() if score > 0}
    assert kinds >= {"customer", "part", "order", "nation"}
    sizes = query["communities"](spark, SF).where("node_id LIKE 'part:%'").groupBy("community").count()
    assert sizes.where("count > 1").count() > 0


def test_import_cycles_take_every_part(spark, duck):
    whole = __spark_entry__.oracle_sql()["import_cycles"].replace(" WHERE a.p_size < 4 AND b.p_size < 4", "").replace("len(path) < 5", "len(path) < 2")
    got = [tuple(r) for r in __spark_entry__.queries()["import_cycles"](spark, SF).collect()]
    want = duck.execute(whole).fetchall()
    # 20 cycles of up to two files come before all longer ones
    assert len(want) == 20 and got == want


@pytest.mark.parametrize(
    ("name", "cut"),
    [("read_graph_json", " WHERE starts_with(id, 'nation:') OR starts_with(id, 'region:')"), ("cypher_script", " WHERE relation <> 'uses'"), ("graphml", " WHERE relation = 'calls'"), ("vault_notes", " WHERE NOT starts_with(id, 'order:')")],
)
def test_sinks_take_whole_graphs(spark, duck, name, cut):
    whole = __spark_entry__.oracle_sql()[name].replace(cut, "")
    got = sorted(map(tuple, __spark_entry__.queries()[name](spark, SF).collect()))
    assert got == sorted(duck.execute(whole).fetchall())


def test_facts_of_all_kinds(spark):
    found = {r["file"].rsplit(".", 1)[-1] for r in __spark_entry__.queries()["extract_facts"](spark, SF).select("file").collect()}
    assert found >= {"py", "md", "json"}


def test_hubs_keep_links_and_trees_keep_rules(spark):
    names = ["hub", *[f"n{i:03}" for i in range(250)]]
    nodes = spark.createDataFrame([(n, n, "code", "x.py") for n in names], "id string, label string, file_type string, source_file string")
    edges = spark.createDataFrame([("hub", n, "calls") for n in names[1:]], "source string, target string, relation string")
    body = sinks.notes(nodes, edges).where("name LIKE 'hub %'").first()["body"]
    assert body.count("[[") == 250
    rules = [("", f"^f{i}$", False, False, i) for i in range(10_500)] + [("", "^f3$", True, False, 10_500)]
    patterns = spark.createDataFrame(rules, "base string, regex string, negated boolean, dirs_only boolean, place int")
    got = files.apply_ignores(spark.createDataFrame([("f3",), ("f10400",)], "path string"), patterns)
    assert dict(map(tuple, got.collect())) == {"f3": False, "f10400": True}
