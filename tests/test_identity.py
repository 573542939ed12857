"""Twins, former ids, declarations, packages, externals, evidence and drawings, on small cases worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import diagram, identity, memory, resolve, search

NODE = "id string, label string, file_type string, source_file string"
EDGE = "source string, target string, relation string, source_file string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_doc_twins_need_the_same_file_and_two_documents(spark):
    n = [("a", "", "document", "a.md"), ("a_doc", "", "document", "a.md"), ("b", "", "document", "b.md"), ("b_doc", "", "document", "c.md"), ("c", "", "code", "c.md"), ("c_doc", "", "document", "c.md"), ("d", "", "document", ""), ("d_doc", "", "document", "")]
    assert rows(identity.doc_twins(spark.createDataFrame(n, NODE))) == [("a", "a_doc")]
    assert rows(identity.doc_twins(spark.createDataFrame([], NODE))) == []


def test_former_ids_name_one_node_and_shadow_none(spark):
    n = [
        ("src_pkg_mod_run", "run()", "code", "src/pkg/mod.py"), ("salted_9", "mod.py", "code", "src/pkg/mod.py"), ("src_a_util", "x", "code", "src/a/util.py"), ("src_b_util", "y", "code", "src/b/util.py"),
        ("top", "top.py", "code", "top.py"), ("deep_top", "top.md", "document", "deep/top.md"), ("out", "o", "code", "/abs/o.py"), ("none", None, "concept", ""),
    ]
    # util alone could be either file; top is a node's id now
    assert rows(identity.former_ids(spark.createDataFrame(n, NODE))) == [("a_util", "src_a_util"), ("b_util", "src_b_util"), ("mod", "salted_9"), ("mod_run", "src_pkg_mod_run"), ("pkg_mod", "salted_9"), ("pkg_mod_run", "src_pkg_mod_run")]


def test_declarations_merge_only_beside_one_header(spark):
    n = [
        ("a", "A", "code", "x/a.h"), ("a", "A::f()", "code", "x/a.cpp"), ("a", "A", "code", "x/a+More.mm"), ("b", "B", "code", "x/b.h"), ("b", "B", "code", "x/b.hpp"), ("b", "B", "code", "x/b.cc"),
        ("c", "C", "code", "x/c.h"), ("c", "C", "code", "y/c.cpp"), ("d", "D", "code", "x/d.h"), ("d", "D", "code", "x/d.py"), ("e", "E", "code", "x/e.cpp"), ("a", "note", "document", "x/a.md"),
    ]
    kept = rows(identity.merge_declarations(spark.createDataFrame(n, NODE)), "id", "source_file")
    assert kept == sorted([("a", "x/a.h"), ("a", "x/a.md"), *[(i, f) for i, _, _, f in n if i not in "a"]])


def test_imports_lead_into_packages_below_the_root(spark):
    paths = ["src/pkg/__init__.py", "src/pkg/sub/__init__.py", "src/pkg/sub/mod.py", "src/loose.py", "top.py", "lib/dup/__init__.py", "lib/dup/m.py", "ext/dup/__init__.py", "ext/dup/m.py", "flat/__init__.py", "flat/m.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = dict(rows(identity.package_aliases(files), "alias", "id"))
    # two files claim dup; flat lies at the root, where ids agree
    assert found == {"pkg": "src_pkg_init", "pkg_init": "src_pkg_init", "pkg_sub": "src_pkg_sub_init", "pkg_sub_init": "src_pkg_sub_init", "pkg_sub_mod": "src_pkg_sub_mod"}
    e = [("x", "pkg_sub_mod", "imports", "a.py"), ("x", "pkg_sub_mod", "imports", "a.go"), ("x", "pkg_sub_mod", "calls", "a.py"), ("x", "pkg", "imports_from", "a.py")]
    out = identity.repoint_imports(spark.createDataFrame(e, EDGE), files, spark.createDataFrame([("pkg",)], "id string"))
    assert rows(out, "target", "relation", "source_file") == sorted([("src_pkg_sub_mod", "imports", "a.py"), ("pkg_sub_mod", "imports", "a.go"), ("pkg_sub_mod", "calls", "a.py"), ("pkg", "imports_from", "a.py")])


def test_externals_are_shared_and_make_no_loops(spark):
    known = spark.createDataFrame([("a::numpy", "numpy", "concept", ""), ("b::numpy", "numpy", "concept", ""), ("a::f", "f", "code", "f.py")], NODE)
    mine = spark.createDataFrame([("c::numpy", "numpy", "concept", ""), ("c::np", "numpy", "concept", ""), ("c::f", "f", "code", "g.py"), ("c::q", "", "concept", "")], NODE)
    e = spark.createDataFrame([("c::f", "c::numpy", "imports", ""), ("c::np", "c::numpy", "uses", ""), ("c::f", "c::q", "uses", "")], EDGE)
    added, edges = identity.merge_externals(known, mine, e)
    assert rows(added, "id") == [("c::f",), ("c::q",)]
    assert rows(edges, "source", "target") == [("c::f", "a::numpy"), ("c::f", "c::q")]


def test_classes_use_what_their_file_imports(spark):
    classes = spark.createDataFrame([("A", "a.py", "p.a", "A"), ("A2", "a.py", "p.a", "A2"), ("B", "b.py", "p.b", "B"), ("B'", "b2.py", "q.b", "B")], "id string, file string, module string, symbol string")
    imports = spark.createDataFrame([("a.py", "p.b", "B"), ("a.py", "p.b", "B"), ("b.py", "else.a", "A"), ("a.py", "q.b", "No"), ("a.py", None, "B")], "file string, module string, symbol string")
    assert rows(identity.uses_of_imports(imports, classes), "source", "target") == [("A", "B"), ("A2", "B"), ("B", "A")]


def test_uses_of_imports_once_each_without_a_shuffle_of_pairs(spark):
    classes = spark.createDataFrame([("A", "a.py", "p.a", "A"), ("A", "a2.py", "p.a", "A"), ("A2", "a.py", "p.a", "A2"), ("A2", "a.py", "p.z", "A2"), (None, "a.py", "p.a", "N"), ("B", "b.py", "p.b", "B")], "id string, file string, module string, symbol string")
    imports = spark.createDataFrame([("a.py", "p.b", "B"), ("a2.py", "p.b", "B"), ("b.py", "p.a", "A"), ("b.py", "p.a", "A2"), ("b.py", "p.z", "A2")], "file string, module string, symbol string")
    uses = identity.uses_of_imports(imports, classes)
    assert sorted((str(r["source"]), r["target"]) for r in uses.collect()) == [("A", "B"), ("A2", "B"), ("B", "A"), ("B", "A2"), ("None", "B")]
    # all pairs pass one shuffle less than those of classes in several files
    plan = uses._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any(line.startswith(("Aggregate", "Deduplicate")) for line in plan[:2])


def test_unverified_nodes_have_no_name_in_their_text(spark):
    n = [
        ("1", "Run(x)", "code", "a", None), ("2", "Gone.made_up()", "code", "a", "EXTRACTED"), ("3", "Gone", "code", "a", "INFERRED"), ("4", "Gone", "document", "a", ""), ("5", "Gone", "code", "b", ""),
        ("6", "ab", "code", "a", ""), ("x:runner", "Gone", "code", "a", ""), ("7", None, "code", "a", ""), ("8", "Gone", "code", "null", ""),
    ]
    nodes = spark.createDataFrame(n, NODE + ", confidence string")
    texts = spark.createDataFrame([("a", "the RUNNER runs"), ("null", None)], "source_file string, text string")
    assert rows(resolve.unverified(nodes, texts)) == [("2",), ("8",)]


def test_known_citations_go_by_id_or_label(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "", ""), ("b", None, "", "")], NODE)
    cites = spark.createDataFrame([("a",), ("Alpha",), ("b",), ("gone",), (None,)], "cite string")
    assert rows(memory.still_known(cites, nodes)) == [("Alpha",), ("a",), ("b",)]


def test_prose_and_costs(spark):
    df = spark.createDataFrame([("Short: one",), ("one two three four five six seven eight",), (" one two three four five six seven eight. ",), ("x" * 79 + ".",), ("x" * 78 + ".",), ("",), (None,)], "label string")
    assert [r[0] for r in df.select(T.is_sentence(F.col("label"))).collect()] == [False, False, True, True, False, False, False]
    assert spark.range(1).select(T.cost(F.lit(2_000_000), F.lit(1_000), F.lit(3.0), F.lit(15.0)), T.cost(F.lit(1), F.lit(1), F.lit(None).cast("double"), F.lit(1.0))).first() == (6.015, 0.0)


def test_drawings_and_counters(spark):
    e = spark.createDataFrame([("a", "b", "calls", "INFERRED", 0.85), ("a", "c", "contains", "inferred", 0.8), ("b", "c", "imports", "AMBIGUOUS", 1.0), ("c", "z", "x", None, None)], "source string, target string, relation string, confidence string, confidence_score double")
    shown = e.select("target", diagram.shown(F.col("confidence"), F.col("confidence_score")).alias("s"), F.round(diagram.rank(F.col("relation"), F.col("confidence"), F.col("confidence_score")), 6).alias("r"))
    assert rows(shown, "s", "r") == [(False, 0.6), (False, 1.6), (True, 1.0), (True, 1.85)]
    sections = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "node_id string, section string")
    assert rows(diagram.section_edges(e, sections), "source", "target", "kind") == [("a", "b", "intra"), ("a", "c", "inter"), ("b", "c", "inter"), ("c", "z", "orphan")]
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("f", 3)], "node_id string, community int")
    assert rows(diagram.meta_edges(e, groups)) == [("1", "2", 2, "2 cross-community edges", "AGGREGATED")]
    hyper = spark.createDataFrame([("h", ["c", "a", "b"]), ("i", ["a", "b", "gone"])], "id string, members array<string>")
    assert rows(diagram.meta_hyperedges(hyper, groups)) == [("h", ["2", "1"])]
    nodes = spark.createDataFrame([("a", "A", "code", "m.py"), ("b", "B", "code", "m.py"), ("c", "C", "code", "m.py"), ("f", "m.py", "code", "m.py")], NODE)
    assert rows(diagram.report_counters(nodes, e, groups)) == [(3, 1, 2, 1)]
    assert rows(diagram.inferred_average(e)) == [(1, 0.85)]
    assert rows(diagram.inferred_average(e.limit(0))) == [(0, None)]


def test_labels_go_with_their_members(spark):
    from weft.operators.degree import signatures

    nodes = spark.createDataFrame([(x, x.upper(), "code", "m.py") for x in "abcd"], NODE)
    e = spark.createDataFrame([("a", "b", "", ""), ("c", "d", "", ""), ("c", "a", "", "")], EDGE)
    now = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "node_id string, community int")
    saved = signatures(now.where("node_id <> 'd'")).withColumn("label", F.lit("Saved"))
    assert rows(diagram.fresh_labels(saved, nodes, e, now)) == [(1, "Saved", False), (2, "C", True)]


def test_rest_of_an_explanation_and_ambiguous_matches(spark):
    nodes = spark.createDataFrame([("hub", "hub", "code", "h.py")] + [(f"n{i}", f"node {i}", "code", "n.py") for i in range(6)], NODE)
    e = spark.createDataFrame([("hub", f"n{i}", "calls", "a.py" if i < 4 else "") for i in range(6)] + [("n0", "hub", "calls", "b.py"), ("hub", "gone", "calls", "c.py")], EDGE)
    # n0 is shown twice, as both its links come first
    assert rows(search.explain_rest(nodes, e, "hub", n=3)) == [("out", "(unknown file)", 2), ("out", "a.py", 2)]
    assert rows(search.explain_rest(nodes, e, "nobody")) == []
    assert search.ambiguity(nodes, ["node"]).first()["ambiguous"]
    assert rows(search.ambiguity(nodes, ["hub"]), "runner", "ambiguous") == [(None, False)]
    assert rows(search.ambiguity(nodes, ["absent"])) == [(None, None, False)]


def test_ids_are_rekeyed_once(spark):
    n = [
        ("pkg_mod_run", "src/pkg/mod.py", "llm"), ("mod", "src/pkg/mod.py", None), ("src_pkg_mod_run", "src/pkg/mod.py", "llm"), ("mod_x", "src/pkg/mod.py", "ast"), ("claude_claude_x", ".claude/CLAUDE.md", "llm"),
        ("other", "src/pkg/mod.py", "llm"), ("o_x", "/abs/o.py", "llm"), ("", "a.py", "llm"), ("n", None, "llm"),
    ]
    df = spark.createDataFrame(n, "id string, source_file string, origin string")
    found = identity.rekeyed_ids(df)
    assert rows(found) == [("mod", "src_pkg_mod"), ("pkg_mod_run", "src_pkg_mod_run")]
    again = df.join(found, F.col("id") == F.col("old"), "left").withColumn("id", F.coalesce("new", "id"))
    assert rows(identity.rekeyed_ids(again.select("id", "source_file", "origin"))) == []


def test_collided_ids_are_told_apart(spark):
    n = [("x", "a/b/c.md", None), ("x", "a.b/c.md", None), ("x", "z.md", None), ("x", "", None), ("y", "one.py", None), ("y", "one.py", None), ("m", "p.py", "module"), ("m", "q.py", "module"), (None, "p.py", None)]
    found = rows(identity.collided_ids(spark.createDataFrame(n, "id string, source_file string, type string")))
    assert [r[:2] for r in found] == [("x", "a.b/c.md"), ("x", "a/b/c.md"), ("x", "z.md")]
    new = [r[2] for r in found]
    assert len(set(new)) == 3 and new[2] == "z_md_x" and all(v.startswith("a_b_c_md_x_") and len(v) == 17 for v in new[:2])


def test_manifest_keeps_other_files_and_matching_hashes(spark):
    from weft.sources.files import merge_manifest

    old = spark.createDataFrame([("same", 1.0, "h", "s"), ("new", 1.0, "h", "s"), ("rest", 1.0, "r", "s"), ("dead", 1.0, "d", "s"), ("out", 1.0, "o", "s"), ("clear", 1.0, "c", "s")], "path string, mtime double, ast_hash string, semantic_hash string")
    now = spark.createDataFrame([("same", 2.0, "h"), ("new", 2.0, "k"), ("first", 2.0, "f")], "path string, mtime double, hash string")
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    alive = paths("same", "new", "rest", "out", "clear")
    out = merge_manifest(old, now, alive, "ast", paths("same", "new", "rest", "clear"), paths("clear"))
    assert rows(out) == [("clear", 1.0, "c", ""), ("first", 2.0, "f", ""), ("new", 2.0, "k", ""), ("rest", 1.0, "r", "s"), ("same", 2.0, "h", "s")]
    assert rows(merge_manifest(old, now, alive, "semantic"), "path", "ast_hash", "semantic_hash") == [("clear", "c", "s"), ("first", "", "f"), ("new", "h", "k"), ("out", "o", "s"), ("rest", "r", "s"), ("same", "h", "h")]
    assert rows(merge_manifest(old, now.limit(0), alive.limit(0))) == []
