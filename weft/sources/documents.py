"""Graph files, manifests, tool configurations, symbol indexes, notes and pages as tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators.build import fold_edges, fold_nodes
from weft.runtime import materialize

# The conditions of a package's export and the fields that name its entry, in the order in which they count.
EXPORT_CONDITIONS = ("source", "import", "module", "svelte", "types", "require", "default")
ENTRY_FIELDS = ("svelte", "module", "main", "types")

_NODE = "struct<id:string,label:string,name:string,file_type:string,source_file:string,path:string,community:int>"
_EDGE = "struct<source:string,target:string,from:string,to:string,relation:string,type:string,confidence:string,confidence_score:double,weight:string,source_file:string,context:string>"
GRAPH = f"struct<nodes:array<{_NODE}>,links:array<{_EDGE}>,edges:array<{_EDGE}>,hyperedges:array<struct<id:string,label:string,nodes:array<string>,members:array<string>,node_ids:array<string>>>>"


def read_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and hyperedges of graph files (column text, JSON); edges may be under `links` or `edges`."""
    parsed = docs.select(F.from_json("text", GRAPH).alias("g")).where("g IS NOT NULL")
    nodes = fold_nodes(parsed.select(F.inline(F.coalesce("g.nodes", F.array().cast(f"array<{_NODE}>")))))
    edges = fold_edges(parsed.select(F.inline(F.coalesce("g.links", "g.edges", F.array().cast(f"array<{_EDGE}>")))))
    hyper = parsed.select(F.inline("g.hyperedges")).select("id", "label", F.coalesce("nodes", "members", "node_ids").alias("members"))
    return nodes, edges, hyper


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_graph of the files at path, each read whole."""
    return read_graph(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def _package(file: Column, name: Column) -> list[Column]:
    return [F.concat(F.lit("package_"), T.norm_id(file)).alias("source"), F.concat(F.lit("package_"), T.norm_id(name)).alias("target"), F.lit("depends_on").alias("relation")]


def manifest_edges(files: DataFrame) -> DataFrame:
    """source, target, relation (depends_on) of package manifests (path, text): pyproject.toml, requirements, package.json, go.mod, pom.xml, Cargo.toml."""
    base = T.basename(F.col("path"))
    own = F.when(base == "go.mod", F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)).when(base == "pom.xml", F.regexp_extract("text", r"<artifactId>([^<]+)", 1)).when(base == "package.json", F.get_json_object("text", "$.name")).otherwise(F.regexp_extract("text", r'(?m)^\s*"?name"?\s*[=:]\s*"([^"]+)"', 1))
    block = F.regexp_extract("text", r"(?s)\bdependencies\s*=\s*\[(.*?)\n\s*\]", 1)
    names = (
        F.when(base == "pyproject.toml", F.regexp_extract_all(block, F.lit(r"""["']\s*([A-Za-z0-9][\w.-]*)"""), F.lit(1)))
        .when(base.rlike(r"^requirements.*\.txt$"), F.regexp_extract_all("text", F.lit(r"(?m)^\s*([A-Za-z0-9][\w.-]*)"), F.lit(1)))
        .when(base == "package.json", F.map_keys(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>")))
        .when(base == "go.mod", F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v"), F.lit(1)))
        .when(base == "pom.xml", F.regexp_extract_all("text", F.lit(r"(?s)<dependency>.*?<artifactId>([^<]+)"), F.lit(1)))
        .when(base == "Cargo.toml", F.regexp_extract_all(F.regexp_extract("text", r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1), F.lit(r"(?m)^\s*([\w-]+)\s*="), F.lit(1)))
    )
    return files.select(own.alias("own"), F.explode(names).alias("name")).where("own <> ''").select(*_package(F.col("own"), F.col("name"))).distinct()


def tool_servers(configs: DataFrame) -> DataFrame:
    """server, command, package, env of tool-server configurations (text: JSON with mcpServers); one row for each variable."""
    server = "struct<command:string,args:array<string>,env:map<string,string>>"
    parsed = configs.select(F.explode(F.from_json(F.get_json_object("text", "$.mcpServers"), f"map<string,{server}>")).alias("server", "s"))
    package = F.get(F.filter(F.coalesce("s.args", F.array().cast("array<string>")), lambda a: ~a.startswith("-")), 0)
    return parsed.select("server", F.col("s.command").alias("command"), package.alias("package"), F.explode_outer(F.map_keys("s.env")).alias("env"))


SYMBOLS = "struct<documents:array<struct<relative_path:string,language:string,symbols:array<struct<symbol:string,kind:string,display_name:string,relationships:array<struct<symbol:string,is_implementation:boolean,is_type_definition:boolean,is_definition:boolean,is_reference:boolean>>>>>>>"


def symbol_edges(indexes: DataFrame) -> DataFrame:
    """source, target, relation, known of symbol indexes (text: JSON): relationships of symbols, those of the same file first.

    A target is the symbol of the same document, else the only one of that name anywhere, else a stub (known is false).
    """
    docs = indexes.select(F.inline(F.from_json("text", SYMBOLS)["documents"]))
    symbols = docs.select("relative_path", F.inline("symbols"))
    here = symbols.select("relative_path", F.col("symbol").alias("to")).distinct().withColumn("same", F.lit(True))
    alone = symbols.select("relative_path", "symbol").distinct().groupBy(F.col("symbol").alias("to")).agg(F.min("relative_path").alias("file"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    rel = symbols.select("relative_path", "symbol", F.explode("relationships").alias("r"))
    relation = F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_typed").when(F.col("r.is_definition"), "scip_def").otherwise("scip_ref")
    rows = rel.select("relative_path", "symbol", F.col("r.symbol").alias("to"), relation.alias("relation")).join(here, ["relative_path", "to"], "left").join(alone, "to", "left")
    file = F.when(F.col("same"), F.col("relative_path")).otherwise(F.col("file"))
    target = F.when(file.isNotNull(), F.concat_ws("#", file, "to")).otherwise(F.concat(F.lit("stub#"), "to"))
    return rows.select(F.concat_ws("#", "relative_path", "symbol").alias("source"), target.alias("target"), "relation", file.isNotNull().alias("known"))


def parse_memory(notes: DataFrame) -> DataFrame:
    """doc_id, date, question, outcome, correction, source_nodes of notes (doc_id, text) with a header between lines of three dashes."""
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    value = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf'(?m)^{name}:\s*"?(.*?)"?\s*$', 1)), F.lit(""))
    listed = F.regexp_extract(head, r"(?m)^source_nodes:\s*\[(.*?)\]", 1)
    nodes = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(F.regexp_replace(x, "[\"']", ""))), lambda x: x != "")
    return notes.select("doc_id", value("date").try_cast("timestamp").alias("date"), value("question").alias("question"), value("outcome").alias("outcome"), value("correction").alias("correction"), nodes.alias("source_nodes"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href of the links of pages (page_id, html)."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"""href\s*=\s*["']([^"'#]+)"""), F.lit(1))).alias("href"))


def jdbc_schema(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> DataFrame:
    """table_schema, table_name, column_name, data_type of a database, from its information schema."""
    table = "(SELECT table_schema, table_name, column_name, data_type FROM information_schema.columns WHERE table_schema NOT IN ('pg_catalog', 'information_schema')) AS c"
    return spark.read.jdbc(url, table, properties=properties or {})


def script_aliases(files: DataFrame) -> DataFrame:
    """root, pattern, targets of the path aliases in the tsconfig.json and jsconfig.json of files (path, text).

    Comments and trailing commas are allowed. A baseUrl is where targets start, and gives a row without a pattern. A config
    that extends another takes that one's aliases, by a relative path, where it has none of its own. Broken ones give nothing.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def parse(text: str) -> dict:
        tokens = re.sub(r'("(?:\\.|[^"\\])*")|/\*.*?\*/|//[^\n]*', lambda m: m[1] or "", text, flags=re.S)
        tokens = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", tokens)
        try:
            data = json.loads(tokens)
        except (ValueError, RecursionError):
            return {}
        return data if isinstance(data, dict) else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                root = path.rpartition("/")[0]
                data = parse(text or "")
                options = data.get("compilerOptions") if isinstance(data.get("compilerOptions"), dict) else {}
                base, paths = options.get("baseUrl"), options.get("paths")
                base = base if isinstance(base, str) and base else None
                parents = data.get("extends")
                parents = [x for x in (parents if isinstance(parents, list) else [parents]) if isinstance(x, str) and x.startswith(".")]
                rows = [(k, [f"{base or '.'}/{t}" for t in v if isinstance(t, str)]) for k, v in paths.items() if isinstance(v, list)] if isinstance(paths, dict) else []
                rows += [(None, [base])] if base else []
                rows = rows or [(None, [])]
                out += [(path, root, k, v, parents) for k, v in rows]
            c = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds, strict=True)], ["path", "root", "pattern", "targets", "parents"])

    from weft.operators.modules import normal_path

    chosen = files.where(F.regexp_extract("path", "[^/]*$", 0).rlike(r"^(ts|js)config(\.[\w.-]+)?\.json$")).select("path", "text")
    found = materialize(chosen.mapInArrow(read, "path string, root string, pattern string, targets array<string>, parents array<string>"), "configs")
    own = found.where("size(targets) > 0").select("path", "root", "pattern", "targets")
    bare = found.join(own.select("path").distinct(), "path", "left_anti").select("path", "root", F.explode("parents").alias("_up")).distinct()
    at = normal_path(F.concat("root", F.lit("/"), "_up"))
    wanted = bare.select("root", F.col("path").alias("_child"), F.when(at.endswith(".json"), at).otherwise(F.concat(at, F.lit(".json"))).alias("path"))
    # targets of a parent start at the parent's own folder
    up = own.select("path", F.col("root").alias("_base"), "pattern", "targets").join(wanted, "path")
    depth = F.size(F.filter(F.split("root", "/"), lambda p: p != ""))
    given = up.select(F.col("_child").alias("path"), "root", "pattern", F.transform("targets", lambda t: F.concat(F.repeat(F.lit("../"), depth), "_base", F.lit("/"), t)).alias("targets"))
    main = F.regexp_extract("path", "[^/]*$", 0).isin("tsconfig.json", "jsconfig.json")
    return own.union(given).where(main).select("root", "pattern", "targets")


def workspace_packages(files: DataFrame) -> DataFrame:
    """name, directory, entries, exports (key, target) of the package.json of files (path, text); broken ones give nothing.

    Of an entry's conditions the first that is there counts: source, import, module, svelte, types, require, default.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def target(value: object) -> str | None:
        if isinstance(value, str):
            return value
        if isinstance(value, dict):
            return next((t for c in EXPORT_CONDITIONS if (t := target(value.get(c)))), None)
        return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    data = json.loads(text or "")
                except (ValueError, RecursionError):
                    continue
                if not isinstance(data, dict) or not isinstance(data.get("name"), str) or not data["name"]:
                    continue
                exports = data.get("exports")
                exports = {".": exports} if isinstance(exports, str) else exports if isinstance(exports, dict) else {}
                whole = target(exports.get("."))
                entries = [whole] if whole else [data[k] for k in ENTRY_FIELDS if isinstance(data.get(k), str)]
                told = [{"key": k, "target": t} for k, v in exports.items() if k.startswith("./") and (t := target(v))]
                out.append({"name": data["name"], "directory": path.rpartition("/")[0], "entries": entries, "exports": told})
            fields = pa.schema([("name", pa.string()), ("directory", pa.string()), ("entries", pa.list_(pa.string())), ("exports", pa.list_(pa.struct([("key", pa.string()), ("target", pa.string())])))])
            yield pa.RecordBatch.from_pylist(out, fields)

    chosen = files.where(F.regexp_extract("path", "[^/]*$", 0) == "package.json").select("path", "text")
    return chosen.mapInArrow(read, "name string, directory string, entries array<string>, exports array<struct<key:string,target:string>>")
