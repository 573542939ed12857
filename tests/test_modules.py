"""Import paths, re-exports, types by namespace and extensions, on small cases worked out by hand."""

from __future__ import annotations

from weft.operators import modules as M

ALIAS = "root string, pattern string, targets array<string>"
PACKAGE = "name string, directory string, entries array<string>, exports array<struct<key:string,target:string>>"
NODE = "id string, label string, file_type string, source_file string"
EDGE = "source string, target string, relation string, source_file string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def imported(spark, imports, files, aliases=(), packages=()):
    out = M.resolve_imports(spark.createDataFrame(imports, "file string, spec string"), spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(list(aliases), ALIAS), spark.createDataFrame(list(packages), PACKAGE))
    return {(r["file"], r["spec"]): r["path"] for r in out.collect()}


def test_relative_imports_try_the_forms_in_order(spark):
    files = ["a/x.ts", "a/x.js", "a/y/index.tsx", "a/y.svelte", "a/z/index.js", "b/w.tsx", "b/n.d.ts", "index.ts"]
    asked = {"./x": "a/x.ts", "./x.js": "a/x.js", "./y": "a/y.svelte", "./z": "a/z/index.js", "./z/": "a/z/index.js", "../b/w.jsx": "b/w.tsx", "../b/./n.d": "b/n.d.ts", "..": "index.ts", "../../x": None, "./gone": None, "react": None, "": None}
    got = imported(spark, [("a/m.ts", s) for s in asked] * 2 + [(None, "./x"), ("a/m.ts", None)], files)
    assert got == {("a/m.ts", s): p for s, p in asked.items()}


def test_aliases_of_the_nearest_config_by_specificity(spark):
    files = ["src/a.ts", "src/ui/b.ts", "lib/c.ts", "gen/d.ts", "src/d.ts", "app/src/a.ts", "base/loose.ts", "exact.ts", "src/dir/e.ts"]
    aliases = [("", "@/*", ["src/*"]), ("", "@/ui/*", ["gen/*", "src/ui/*"]), ("", "@/lib", ["exact"]), ("", "dir", ["src/dir"]), ("", "two*stars*", ["src/a"]), ("", None, ["base"]), ("app", "@/*", ["src/*"])]
    asked = {"@/a": "src/a.ts", "@/ui/b": "src/ui/b.ts", "@/ui/d": "gen/d.ts", "@/lib": "exact.ts", "@/lib/c": None, "dir/e": "src/dir/e.ts", "loose": "base/loose.ts", "twoXstarsY": None, "react": None}
    got = imported(spark, [("m.ts", s) for s in asked] + [("app/x/m.ts", "@/a"), ("app/x/m.ts", "@/lib")], files, aliases)
    assert got == {("m.ts", s): p for s, p in asked.items()} | {("app/x/m.ts", "@/a"): "app/src/a.ts", ("app/x/m.ts", "@/lib"): None}


def test_workspace_packages_by_entries_and_exports(spark):
    files = ["p/kit/src/main.ts", "p/kit/lib/browser.ts", "p/kit/feat/one.ts", "p/kit/raw.ts", "p/bare/index.ts", "secret.ts"]
    packages = [("@s/kit", "p/kit", ["dist/gone.js", "src/main"], [("./browser", "./lib/browser.ts"), ("./f/*", "./feat/*.ts"), ("./evil", "../../secret.ts")]), ("bare", "p/bare", [], [])]
    asked = {"@s/kit": "p/kit/src/main.ts", "@s/kit/browser": "p/kit/lib/browser.ts", "@s/kit/f/one": "p/kit/feat/one.ts", "@s/kit/raw": "p/kit/raw.ts", "@s/kit/evil": None, "bare": "p/bare/index.ts", "bareword": None, "@s/kitten": None}
    assert imported(spark, [("a.ts", s) for s in asked], files, packages=packages) == {("a.ts", s): p for s, p in asked.items()}


def test_exports_are_followed_depth_first_and_circles_end(spark):
    symbols = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("deep", "z")], "module string, symbol string")
    exports = [
        ("i", "x", "b", "x", 0), ("i", None, "a", None, 1), ("j", None, "k", None, 0), ("j", None, "a", None, 1), ("k", None, "c", None, 0), ("c", None, "a", None, 0), ("r", "new", "i", "x", 0), ("loop", None, "pool", None, 0),
        ("pool", None, "loop", None, 0), ("pool", None, "deep", None, 1), ("self", "q", "self", "q", 0), ("out", "o", "nowhere", "o", 0), *[(f"h{i}", None, f"h{i + 1}", None, 0) for i in range(12)], ("h12", None, "deep", None, 0),
    ]
    exports = spark.createDataFrame(exports, "module string, symbol string, from_module string, from_symbol string, place int")
    names = [("i", "x"), ("i", "y"), ("j", "x"), ("c", "x"), ("r", "new"), ("loop", "z"), ("self", "q"), ("out", "o"), ("h0", "z"), ("i", None), ("h0", "z")]
    got = rows(M.export_origins(spark.createDataFrame(names, "module string, symbol string"), symbols, exports))
    assert got == [("c", "x", "c", "x"), ("h0", "z", "deep", "z"), ("i", "x", "b", "x"), ("j", "x", "c", "x"), ("loop", "z", "deep", "z"), ("r", "new", "b", "x")]
    assert rows(M.export_origins(spark.createDataFrame([], "module string, symbol string"), symbols, exports)) == []


def test_types_by_import_namespace_and_whole_namespaces(spark):
    types = spark.createDataFrame([("a.T", "1"), ("a.b.T", "2"), ("c.T", "3"), ("c.U", "4"), ("d.U", "5"), ("G", "6"), ("c.d.V", "7"), ("a.b.T", "9")], "type string, id string")
    scopes = spark.createDataFrame([("f", "a.b"), ("g", None), ("h", "a.b")], "file string, namespace string")
    imports = spark.createDataFrame([("f", "T", "c.T"), ("f", "k", "c"), ("f", None, "c"), ("g", None, "c"), ("g", None, "d"), ("h", "T", "gone.T")], "file string, alias string, target string")
    refs = spark.createDataFrame([("f", "T"), ("f", "k.d.V"), ("f", "U"), ("f", ".a.T"), ("f", "G"), ("g", "U"), ("g", "T"), ("g", "G"), ("h", "T"), ("none", "G"), (None, "T"), ("f", "")], "file string, name string")
    java = {("f", ".a.T"): "1", ("f", "T"): "3", ("f", "U"): "4", ("f", "k.d.V"): "7", ("g", "G"): "6", ("g", "T"): "3", ("h", "T"): "2", ("none", "G"): "6"}
    find = lambda rule: {(f, n): i for f, n, i in rows(M.type_references(refs, scopes, imports, types, rule))}
    assert find(M.JAVA) == java
    assert find(M.PHP) == {k: v for k, v in java.items() if k != ("h", "T")}  # imported, and found nowhere
    assert find(M.CSHARP) == java | {("f", "G"): "6"}


def test_edges_to_stubs_lead_to_the_type_that_the_file_means(spark):
    n = spark.createDataFrame([("s", "T", "code", ""), ("s2", "V", "code", ""), ("t1", "T", "code", "x/T.java"), ("t2", "T", "code", "y/T.java"), ("u", "U", "code", "u.java")], NODE)
    e = spark.createDataFrame([("u", "s", "implements", "u.java"), ("u", "s", "calls", "w.java"), ("u", "s2", "inherits", "u.java")], EDGE)
    found = spark.createDataFrame([("u.java", "T", "t2"), ("u.java", "V", "t1"), ("w.java", "T", "t1")], "file string, name string, id string")
    nodes, edges = M.repoint_types(e, n, found)
    assert rows(edges, "target", "relation") == [("s", "calls"), ("t1", "inherits"), ("t2", "implements")]
    assert [r[0] for r in rows(nodes, "id")] == ["s", "t1", "t2", "u"]  # s is still called


def test_extensions_become_the_one_type_of_their_name(spark):
    n = spark.createDataFrame([("f", "Foo", "code", "a.swift"), ("x1", "Foo", "code", "b.swift"), ("x2", "Bar", "code", "b.swift"), ("b1", "Baz", "code", "c.swift"), ("b2", "Baz", "code", "d.swift"), ("x3", "Baz", "code", "e.swift")], NODE)
    e = spark.createDataFrame([("b", "x1", "contains", "b"), ("x1", "f", "calls", "b"), ("q", "x1", "uses", "q"), ("q", "f", "uses", "q"), ("q", "x3", "uses", "q")], EDGE)
    nodes, edges = M.merge_extensions(n, e, spark.createDataFrame([("x1", "Foo"), ("x2", "Bar"), ("x3", "Baz")], "id string, label string"))
    assert [r[0] for r in rows(nodes, "id")] == ["b1", "b2", "f", "x2", "x3"]
    assert rows(edges, "source", "target") == [("b", "f"), ("q", "f"), ("q", "x3")]


def test_configs_and_packages_are_read_from_their_files(spark):
    from weft.sources import documents

    texts = [
        ("tsconfig.json", '{ // top\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"], "url": ["http://x/*y*/z"],}, }, /* end */ }'),
        ("app/tsconfig.json", '{"extends": ["./gone.json", "../cfg/tsconfig.base"]}'), ("cfg/tsconfig.base.json", '{"compilerOptions": {"paths": {"~/*": ["./lib/*"]}}}'),
        ("bad/tsconfig.json", "{"), ("list/tsconfig.json", "[1]"), ("none/tsconfig.json", None), ("x/package.json", '{"name": "x", "main": "m.js", "types": 3, "exports": {".": {"node": "n.js"}, "./a": {"default": {"import": "./a.mjs"}}, "./b": null}}'),
        ("package.json", '{"name": "top", "exports": "./t.js"}'), ("y/package.json", '{"main": "m.js"}'), ("z/package.json", "broken"), ("w/package.json", None),
    ]
    files = spark.createDataFrame(texts, "path string, text string")
    aliases = {(r["root"], r["pattern"]): r["targets"] for r in documents.script_aliases(files).collect()}
    assert aliases == {("", "@/*"): ["src/*"], ("", "url"): ["src/http://x/*y*/z"], ("", None): ["src"], ("app", "~/*"): ["../cfg/././lib/*"]}
    packages = {r["name"]: (r["directory"], r["entries"], [tuple(e) for e in r["exports"]]) for r in documents.workspace_packages(files).collect()}
    assert packages == {"x": ("x", ["m.js"], [("./a", "./a.mjs")]), "top": ("", ["./t.js"], [])}


def test_a_folder_of_scripts_is_linked_by_its_imports(spark, tmp_path):
    from weft.engine import Engine

    for path, text in {
        "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "src/a.ts": 'import { b } from "./b.js";\nimport c from "@/c";\nimport k from "kit";\nimport React from "react";\n',
        "src/b.ts": "export function b() {}\n", "src/c/index.ts": "export default 1;\n", "kit/package.json": '{"name": "kit", "main": "lib/k.js"}', "kit/lib/k.js": "module.exports = 1;\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    graph = Engine.from_folder(spark, str(tmp_path))
    found = {frozenset((r["source"], r["target"])) for r in graph.edges.where("relation = 'imports_from'").collect()}
    assert found == {frozenset(("src_a", t)) for t in ("src_b", "src_c_index", "kit_lib_k")}
