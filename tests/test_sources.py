"""Text functions, sources, sinks, streams and the entry point."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from weft.engine import Engine
from weft.functions import similarity
from weft.functions import text as T
from weft.operators import entities
from weft.sources import documents, files, languages, sinks
from weft.streaming import watch


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_identifiers(spark):
    values = ["Foo::Bar(baz)", "héllo wörld", "__x__", "ﬁle", "ÀB", None, ""]
    got = column(spark, values, T.norm_id)
    assert got == ["foo_bar_baz", "héllo_wörld", "x", "file", "àb", None, ""]
    assert column(spark, got, T.norm_id) == got
    assert column(spark, ["Foo_Bar!", "a--b"], T.norm_label) == ["foo bar", "a b"]
    assert column(spark, ["aabb", "", "aaaa"], T.entropy_bits) == [1.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("path", "kind", "sensitive", "test"),
    [
        ("src/app.py", "code", False, False), ("docs/token-economics-of-recall.md", "document", False, False), ("config/api_token.json", "code", True, False), ("a/.ssh/config", None, True, False),
        (".env", None, True, False), (".env.example", None, False, False), ("certs/site.pem", None, True, False), ("lib/passwords_controller.rb", "code", False, False), ("tests/test_x.py", "code", False, True),
        ("src/latest.py", "code", False, False), ("src/FooTest.java", "code", False, True), ("src/contest.cs", "code", False, False), ("x/paper.pdf", "paper", False, False), ("A.xcassets/i.imageset/v.pdf", None, False, False),
    ],
)
def test_paths(spark, path, kind, sensitive, test):
    row = spark.createDataFrame([(path, "")], "p string, t string").select(T.classify_file(F.col("p"), F.col("t")), T.is_sensitive(F.col("p")), T.is_test_path(F.col("p"))).first()
    assert tuple(row) == (kind, sensitive, test)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_similarities(a, b):
    j, w = similarity.jaro(a, b), similarity.jaro_winkler(a, b)
    assert 0 <= j <= w <= 1 and j == similarity.jaro(a, b) and (j == 1) == (a == b)
    assert abs(similarity.jaro("martha", "marhta") - 0.944444) < 1e-5 and abs(similarity.jaro_winkler("abc", "abd") - 0.822222) < 1e-5


def test_entities(spark):
    labels = ["Graph Extraction Pipeline", "graph extraction pipelines", "Graph-Extraction Pipeline", "Payment Gateway 1", "Payment Gateway 2", "Something Else Entirely"]
    nodes = spark.createDataFrame([(f"n{i}", x, "concept", f"d{i}.md") for i, x in enumerate(labels)], "id string, label string, file_type string, source_file string")
    got = {r["old"]: r["new"] for r in entities.entity_dedup(nodes).collect()}
    # numbers and mere extensions keep labels apart
    assert got == {"n2": "n0"}


def test_sources_that_no_parser_takes_keep_their_node(spark):
    texts = [("deep.py", "x = " + "-" * 20000 + "1"), ("half.json", '{"a\\ud800": 1}'), ("half.py", 'def f():\n    """a long docstring \\ud800 of one line"""\n'), ("ok.py", "def g(): pass\n")]
    facts = languages.extract(spark.createDataFrame(texts, "path string, text string")).where("kind = 'node'")
    assert sorted((r["file"], r["label"]) for r in facts.collect()) == [("deep.py", "deep.py"), ("half.json", "a?"), ("half.json", "half.json"), ("half.py", "a long docstring ? of one line"), ("half.py", "f()"), ("half.py", "half.py"), ("ok.py", "g()"), ("ok.py", "ok.py")]


def test_readers(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("from b import helper\n\nclass A(Base):\n    def go(self):\n        return helper()\n")
    (tmp_path / "src/b.py").write_text("def helper():\n    return 1\n")
    (tmp_path / "guide.md").write_text("# Guide\n## Use\n[a](src/a.py)\n```\n# no heading\n```\n")
    (tmp_path / ".env").write_text("KEY=1")
    (tmp_path / "src/__init__.py").write_text("")
    scanned = {r["path"]: r["status"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert scanned == {"src/a.py": "ok", "src/b.py": "ok", "src/__init__.py": "ok", "guide.md": "ok", ".env": "sensitive"}
    graph = Engine.from_folder(spark, str(tmp_path))
    labels = {r["label"] for r in graph.nodes.collect()}
    assert {"A", ".go()", "helper()", "Guide", "Use", "a.py"} <= labels
    links = {(r["source"], r["target"], r["relation"]) for r in graph.edges.collect()}
    assert ("src_a_a_go", "src_b_helper", "calls") in links
    evidence = {(r["source"], r["confidence"]) for r in graph.edges.where("relation = 'calls'").collect()}
    assert evidence == {("src_a_a_go", "EXTRACTED")}
    assert "Best-connected" in graph.report()
    for path, text, want in (
        ("x.js", "class K extends L { run() {} }\nfunction foo() { bar(1) }", {"K", "foo()"}), ("x.go", "type T struct {}\nfunc (t T) Run(a int) {}", {"T", "Run()"}),
        ("x.sql", "CREATE TABLE a (id int, b int REFERENCES b(id));", {"a"}), ("x.unknown", "?", set()), ("x.py", "def broken(:", set()),
    ):
        found = languages.read_file(path, text)
        assert want <= {r.get("label") for r in found if r["kind"] == "node"} and found[0]["label"] == path


def test_documents(spark):
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "text string")
    nodes, edges, hyper = documents.read_graph(text('{"nodes":[{"id":"a","name":"A"}],"links":[{"from":"a","to":"b","type":"calls"}],"hyperedges":[{"id":"h","node_ids":["a"]}]}', "broken"))
    assert (nodes.first()["label"], edges.first()["relation"], hyper.first()["members"]) == ("A", "calls", ["a"])
    rows = [("pyproject.toml", '[project]\nname = "me"\ndependencies = [\n "numpy>=1",\n "pandas"\n]\n'), ("go.mod", "module me.org/x\nrequire a.org/y v1.0\n"), ("package.json", '{"name":"me","dependencies":{"z":"1"}}')]
    got = {r["target"] for r in documents.manifest_edges(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"package_numpy", "package_pandas", "package_a_org_y", "package_z"}
    note = spark.createDataFrame([(1, '---\ndate: 2024-01-02\nquestion: "why?"\noutcome: useful\nsource_nodes: ["a", "b"]\n---\nx'), (2, "none")], "doc_id long, text string")
    assert [tuple(r)[2:] for r in documents.parse_memory(note).orderBy("doc_id").collect()] == [("why?", "useful", None, ["a", "b"]), (None, None, None, [])]


def test_ignore_rules(spark):
    lines = ["build/", "*.log", "!keep.log", "/top.txt", "# comment", ""]
    rows = [("", *p, i) for i, p in enumerate(map(files.ignore_pattern, lines)) if p]
    patterns = spark.createDataFrame(rows, "base string, regex string, negated boolean, dirs_only boolean, place int")
    paths = {"a/build/x.py": True, "build": False, "a/b.log": True, "keep.log": False, "build/keep.log": True, "top.txt": True, "a/top.txt": False}
    got = files.apply_ignores(spark.createDataFrame([(p,) for p in paths], "path string"), patterns)
    assert {r["path"]: r["ignored"] for r in got.collect()} == paths


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a'", 'A "x"', "code", "f.py"), ("b", "<B>", "concept", "")], "id string, label string, file_type string, source_file string")
    edges = spark.createDataFrame([("a'", "b", "uses", "EXTRACTED")], "source string, target string, relation string, confidence string")
    lines = [r["line"] for r in sinks.cypher(nodes, edges).collect()]
    assert lines[0] == "MERGE (n:Code {id: 'a\\''}) SET n.label = 'A \"x\"';" and "-[:USES" in lines[2]
    assert any("&lt;B&gt;" in r["line"] for r in sinks.graphml(nodes, edges).collect())
    assert {r["name"][:3] for r in sinks.notes(nodes, edges).collect()} == {"A _", "_B_"}
    sinks.write_lines(sinks.node_link(nodes, edges), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_streams(spark, tmp_path):
    schema = "source_file string, id string"
    for i, batch in enumerate(([("a", "1"), ("b", "2")], [("a", "3")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    stream = watch.read_changes(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, 1)
    got = watch.rebuild(spark, stream, "source_file", stream.schema)
    assert sorted(r["source_file"] for r in got.collect()) in (["a", "b"],)
    base = f"file://{tmp_path}/graph"
    first = watch.rebuild(spark, stream, "source_file", stream.schema, base)
    assert {(r["source_file"], r["id"]) for r in first.collect()} == {("a", "3"), ("b", "2")}
    spark.createDataFrame([("c", "4"), ("b", "5")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b2")
    again = watch.read_changes(spark, f"{tmp_path}/in/*", stream.schema, 1)
    second = watch.rebuild(spark, again, "source_file", stream.schema, base)  # goes on from the newest version
    assert {(r["source_file"], r["id"]) for r in second.collect()} == {("a", "3"), ("b", "5"), ("c", "4")}
    assert watch._versions(spark, base) == [1, 2]
    ts = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:02"), ("u", "2024-01-01 00:00:09")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["changes"] for r in watch.quiet_sessions(ts, "k").collect()) == [1, 2]


def test_entry_point(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 100
