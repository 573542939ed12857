"""The whole build, on cases worked out by hand: each step's repair reaches the edges."""

from __future__ import annotations

from weft.operators import build

NODE = "id string, label string, file_type string, source_file string, origin string"
EDGE = "source string, target string, relation string, confidence string, weight string, source_file string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_every_repair_of_ids_reaches_the_edges(spark):
    n = [
        ("src_app_main", "main.py", "code", "src/app/main.py", "ast"), ("src_app_main_run", "run()", "code", "src/app/main.py", "ast"), ("ghost_run", "run()", "code", "src/app/main.py", ""),
        ("app_util_help", "help()", "code", "src/app/util.py", ""),  # a former stem
        ("same", "One", "code", "a/x.py", "ast"), ("same", "Two", "code", "b/y.py", "ast"),
        ("docs_note", "note.md", "document", "docs/note.md", ""), ("docs_note_doc", "Note", "document", "docs/note.md", ""),
        ("idea", "Idea", "concept", "", ""), ("web_page", "page.ts", "code", "web/page.ts", "ast"),
    ]
    e = [
        ("ghost_run", "app_util_help", "calls", "EXTRACTED", "1", "src/app/main.py"), ("same", "idea", "references", "EXTRACTED", "2", "a/x.py"), ("same", "idea", "references", "EXTRACTED", "3", "b/y.py"),
        ("docs_note", "idea", "references", "EXTRACTED", "1", "docs/note.md"), ("docs_note_doc", "docs_note", "references", "EXTRACTED", "1", "docs/note.md"),
        ("main", "idea", "references", "EXTRACTED", "1", ""),  # a former id of the file
        ("src_app_main", "web_page", "imports", "EXTRACTED", "1", "src/app/main.py"), ("idea", "gone", "references", "EXTRACTED", "1", ""),
    ]
    nodes, edges = build.build_graph(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE))
    assert rows(nodes, "id") == [(i,) for i in ("a_x_py_same", "b_y_py_same", "docs_note_doc", "idea", "src_app_main", "src_app_main_run", "src_app_util_help", "web_page")]
    # Python doesn't import TypeScript; a document doesn't refer to its own twin
    assert rows(edges, "a", "b", "weight") == [("a_x_py_same", "idea", 2.0), ("b_y_py_same", "idea", 3.0), ("docs_note_doc", "idea", 1.0), ("idea", "src_app_main", 1.0), ("src_app_main_run", "src_app_util_help", 1.0)]
    assert nodes.columns == ["id", "label", "file_type", "source_file"]


def test_an_empty_graph_stays_empty(spark):
    nodes, edges = build.build_graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    assert nodes.isEmpty() and edges.isEmpty()


def test_sources_are_gone_only_when_they_are_not_on_disk(spark):
    table = lambda data: spark.createDataFrame(data, "id string, source_file string")
    paths = lambda *x: spark.createDataFrame([(v,) for v in x], "source_file string")
    old = table([("1", "a/kept"), ("2", "a/excluded"), ("3", "a/gone"), ("4", "a/again"), ("5", "a/emptied"), ("6", "b/gone"), ("stub", ""), ("stub2", ""), ("none", None), ("7", "ab/gone")])
    new = table([("4b", "a/again"), ("stub", "")])
    given = (paths("a/again", "a/emptied", ""), paths("a/kept", "a/again", "a/emptied"), paths("a/kept", "a/again", "a/emptied", "a/excluded"))
    got = [r[0] for r in rows(build.reconcile(old, new, *given, ["id"]), "id")]
    assert got == ["1", "2", "4b", "none", "stub", "stub2"]
    assert [r[0] for r in rows(build.reconcile(old, new, *given, ["id"], under="a"), "id")] == ["1", "2", "4b", "6", "7", "none", "stub", "stub2"]
    assert rows(build.reconcile(old, old.limit(0), paths(), paths(), paths(), ["id"]), "id") == [("none",), ("stub",), ("stub2",)]
