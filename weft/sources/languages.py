"""Source files of many languages as nodes, edges and unresolved calls.

One table of patterns for each language says how definitions, imports and base types look; one function
reads a file by them. Python is read by its own syntax tree. All give the same facts, so the steps that
resolve names across files don't depend on the language.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a file yields: kind is 'node', 'edge' or 'call'.
FACTS = "kind string, file string, id string, label string, file_type string, source string, target string, relation string, context string, line int"
_WORDS = re.compile(r"[^\w]+")


def slug(*parts: str) -> str:
    """An identifier of parts: word characters only, lower case."""
    return "_".join(x for x in (_WORDS.sub("_", p).strip("_").lower() for p in parts) if x)


@dataclass
class Facts:
    """The facts of one file, collected."""

    file: str
    rows: list[dict] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.root = slug(self.file.rsplit(".", 1)[0] if "." in self.file.rsplit("/", 1)[-1] else self.file)
        self.node(self.root, self.file.rsplit("/", 1)[-1], 1)

    def node(self, id_: str, label: str, line: int, kind: str = "code") -> str:
        if id_ not in self.seen:
            self.seen.add(id_)
            # an escape in the source can name half a surrogate pair, which no UTF-8 text holds
            label = label.encode("utf-8", "replace").decode("utf-8")
            self.rows.append({"kind": "node", "id": id_, "label": label, "file_type": kind, "line": line})
        return id_

    def edge(self, source: str, target: str, relation: str, line: int, context: str | None = None, symbol: str | None = None) -> None:
        if target:
            self.rows.append({"kind": "edge", "source": source, "target": target, "relation": relation, "context": context, "line": line, "label": symbol})

    def call(self, caller: str, callee: str, line: int) -> None:
        self.rows.append({"kind": "call", "source": caller, "label": callee, "line": line})

    def done(self) -> list[dict]:
        return [{"file": self.file, **r} for r in self.rows]


def read_python(path: str, text: str) -> list[dict]:
    """Modules, classes, functions, bases, imports, decorators and calls of a Python file; a broken file gives its own node alone."""
    f = Facts(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return f.done()
    except MemoryError as e:
        # the parser says so of nesting that is too deep for it; anything else is a real lack of memory
        if "too complex" not in str(e):
            raise
        return f.done()

    def name_of(x: ast.expr) -> str:
        return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else name_of(x.value) if isinstance(x, ast.Subscript) else ""

    def calls(owner: str, body: ast.AST) -> None:
        for x in ast.walk(body):
            if isinstance(x, ast.Call) and (name := name_of(x.func)):
                f.call(owner, name, x.lineno)

    def walk(body: list[ast.stmt], owner: str, in_class: bool) -> None:
        for x in body:
            if isinstance(x, ast.ClassDef):
                me = f.node(slug(owner, x.name), x.name, x.lineno)
                f.edge(owner, me, "contains", x.lineno)
                for b in x.bases:
                    f.edge(me, slug(name_of(b)), "inherits", x.lineno, "base")
                walk(x.body, me, True)
            elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                me = f.node(slug(owner, x.name), f".{x.name}()" if in_class else f"{x.name}()", x.lineno)
                f.edge(owner, me, "method" if in_class else "contains", x.lineno)
                for d in x.decorator_list:
                    f.edge(me, slug(name_of(d.func if isinstance(d, ast.Call) else d)), "references", x.lineno, "decorator")
                for a, context in [*((a.annotation, "parameter_type") for a in x.args.args), (x.returns, "return_type")]:
                    if a is not None and name_of(a):
                        f.edge(me, slug(name_of(a)), "references", x.lineno, context)
                calls(me, x)
                doc = ast.get_docstring(x)
                if doc and len(doc) > 20:
                    why = f.node(slug(me, "rationale"), doc.split("\n")[0][:120], x.lineno, "rationale")
                    f.edge(why, me, "rationale_for", x.lineno)
            elif isinstance(x, ast.Import):
                for a in x.names:
                    f.edge(f.root, slug(a.name), "imports", x.lineno, "import")
            elif isinstance(x, ast.ImportFrom):
                module = "." * x.level + (x.module or "")
                f.edge(f.root, slug(module) or slug(path.rsplit("/", 1)[0]), "imports_from", x.lineno, "import")
                for a in x.names:
                    f.edge(f.root, slug(module, a.name), "imports", x.lineno, "import", a.asname or a.name)
            elif isinstance(x, ast.If | ast.Try | ast.With | ast.For | ast.While):
                walk([y for part in ("body", "orelse", "finalbody") for y in getattr(x, part, [])], owner, in_class)
            else:
                calls(owner, x)

    walk(tree.body, f.root, False)
    return f.done()


@dataclass(frozen=True)
class Language:
    """Patterns of a language; the first group of each is the name. `bases` has a group with a list."""

    types: str = ""
    functions: str = ""
    imports: str = ""
    bases: str = ""
    comment: str = r"//[^\n]*|/\*.*?\*/"
    calls: bool = True


_C_FUNCTION = r"^[A-Za-z_][\w\s\*&:<>,~]*?[\s\*&]([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{"
_JVM_BASES = r"\b(?:class|interface)\s+(\w+)[^{]*?\b(?:extends|implements)\s+([\w\s,.<>]+?)\s*(?:\bimplements\b|\{)"
_JS = Language(r"\b(?:class|interface|enum)\s+(\w+)", r"\bfunction\s*\*?\s*(\w+)\s*\(|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", r"""\b(?:import|export)\b[^'"\n;]*?from\s*['"]([^'"]+)|\brequire\(\s*['"]([^'"]+)|\bimport\s*\(?\s*['"]([^'"]+)""", r"\bclass\s+(\w+)\s+extends\s+([\w.]+)")
_JVM = Language(r"\b(?:class|interface|enum|record|object|trait)\s+(\w+)", r"\b(?:public|private|protected|static|final|override|def|fun|suspend)\b[^;={(]*?\b(\w+)\s*\([^;{]*\)\s*[^;{=]*[{=]", r"\bimport\s+(?:static\s+)?([\w.]+)", _JVM_BASES)
_C = Language(r"\b(?:struct|class|enum|union|namespace)\s+(\w+)\s*[^;()]*?\{", _C_FUNCTION, r'#\s*include\s*[<"]([^>"]+)', r"\b(?:class|struct)\s+(\w+)\s*:\s*([^{;]+)\{")
_HASH = r"#[^\n]*"
#: Languages by extension.
LANGUAGES: dict[str, Language] = {
    **dict.fromkeys((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".vue", ".svelte", ".astro", ".ejs"), _JS),
    **dict.fromkeys((".java", ".kt", ".kts", ".scala", ".groovy", ".gradle"), _JVM),
    **dict.fromkeys((".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".cu", ".cuh", ".metal", ".m", ".mm"), _C),
    ".cs": Language(r"\b(?:class|interface|struct|enum|record)\s+(\w+)", r"\b(?:public|private|protected|internal|static)\b[^;={(]*?\b(\w+)\s*\([^;{]*\)\s*(?:\{|=>)", r"\busing\s+(?:static\s+)?([\w.]+)\s*;", r"\b(?:class|interface|struct)\s+(\w+)[^{:]*:\s*([\w\s,.<>]+?)\s*\{"),
    ".go": Language(r"\btype\s+(\w+)\s+(?:struct|interface)", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$'),
    ".rs": Language(r"\b(?:struct|enum|trait|mod)\s+(\w+)", r"\bfn\s+(\w+)", r"\buse\s+([\w:]+)", r"\bimpl\s+(?:<[^>]*>\s*)?(?P<b>\w+)[^{]*?\bfor\s+(?P<a>\w+)"),
    **dict.fromkeys((".rb", ".rake"), Language(r"\b(?:class|module)\s+(\w+)", r"\bdef\s+(?:self\.)?(\w+[?!]?)", r"""\brequire(?:_relative)?\s*\(?['"]([^'"]+)""", r"\bclass\s+(\w+)\s*<\s*([\w:]+)", _HASH)),
    ".php": Language(r"\b(?:class|interface|trait|enum)\s+(\w+)", r"\bfunction\s+&?(\w+)\s*\(", r"""\buse\s+([\w\\]+)|\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)""", _JVM_BASES),
    ".swift": Language(r"\b(?:class|struct|enum|protocol|extension|actor)\s+(\w+)", r"\bfunc\s+(\w+)", r"\bimport\s+(\w+)", r"\b(?:class|struct|enum|extension)\s+(\w+)\s*:\s*([\w\s,.]+?)\s*\{"),
    **dict.fromkeys((".lua", ".luau"), Language("", r"\bfunction\s+([\w.:]+)\s*\(|\blocal\s+function\s+(\w+)", r"""\brequire\s*\(?\s*['"]([^'"]+)""", "", r"--[^\n]*")),
    **dict.fromkeys((".sh", ".bash"), Language("", r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{", r"^\s*(?:source|\.)\s+([\w./-]+)", "", _HASH)),
    **dict.fromkeys((".ps1", ".psm1"), Language(r"\bclass\s+(\w+)", r"(?i)\bfunction\s+([\w-]+)", r"(?i)\b(?:Import-Module|using\s+module)\s+([\w./\\-]+)", r"\bclass\s+(\w+)\s*:\s*(\w+)", _HASH)),
    **dict.fromkeys((".ex", ".exs"), Language(r"\bdefmodule\s+([\w.]+)", r"\bdefp?\s+(\w+[?!]?)", r"\b(?:alias|import|use|require)\s+([\w.]+)", "", _HASH)),
    ".jl": Language(r"\b(?:struct|module|abstract type)\s+(\w+)", r"\bfunction\s+(\w+)", r"\b(?:using|import)\s+([\w.]+)", r"\bstruct\s+(\w+)\s*<:\s*(\w+)", _HASH),
    **dict.fromkeys((".f", ".f90", ".f95", ".f03", ".f08"), Language(r"(?i)^\s*(?:module|type(?:\s*,[^:]*)?\s*::|program)\s+(\w+)", r"(?i)\b(?:subroutine|function)\s+(\w+)", r"(?i)^\s*use\s+(\w+)", "", r"![^\n]*")),
    **dict.fromkeys((".v", ".sv", ".svh"), Language(r"\b(?:module|interface|class|package)\s+(\w+)", r"\b(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)?(\w+)\s*[;(]", r'`include\s+"([^"]+)|\bimport\s+(\w+)::', r"\bclass\s+(\w+)\s+extends\s+(\w+)")),
    ".zig": Language(r"\bconst\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)", r"\bfn\s+(\w+)", r'@import\("([^"]+)'),
    ".dart": Language(r"\b(?:class|mixin|enum|extension)\s+(\w+)", r"^\s*(?:static\s+|Future<[^>]*>\s+|void\s+|\w+\s+)(\w+)\s*\([^;{]*\)\s*(?:async\s*)?\{", r"""\b(?:import|export|part)\s+['"]([^'"]+)""", _JVM_BASES),
    **dict.fromkeys((".cls", ".trigger"), Language(r"(?i)\b(?:class|interface|enum|trigger)\s+(\w+)", r"(?i)\b(?:public|private|global|protected|static)\b[^;={(]*?\b(\w+)\s*\([^;{]*\)\s*\{", "", r"(?i)\bclass\s+(\w+)[^{]*?\b(?:extends|implements)\s+([\w\s,.]+?)\s*(?:\bimplements\b|\{)")),
    **dict.fromkeys((".pas", ".pp", ".dpr", ".lpr", ".inc"), Language(r"(?i)\b(\w+)\s*=\s*(?:class|record|interface)\b", r"(?i)\b(?:procedure|function|constructor|destructor)\s+([\w.]+)", r"(?i)\buses\s+([\w\s,.]+);", r"(?i)\b(\w+)\s*=\s*class\s*\(([\w\s,.]+)\)", r"//[^\n]*|\{.*?\}|\(\*.*?\*\)")),
    **dict.fromkeys((".dm", ".dme"), Language(r"^(/\w[\w/]*)\s*$", r"\b(?:proc|verb)/(\w+)\s*\(", r'#include\s+"([^"]+)')),
    **dict.fromkeys((".tf", ".hcl", ".tfvars"), Language(r'^\s*(?:resource|data)\s+"\w+"\s+"(\w+)"|^\s*(?:module|variable|output|provider)\s+"(\w+)"', "", r'^\s*source\s*=\s*"([^"]+)"', "", _HASH, False)),
    **dict.fromkeys((".razor", ".cshtml", ".xaml"), Language(r'\bx:Class="([\w.]+)"', r"\b(?:void|Task|async)\s+(\w+)\s*\(", r"@using\s+([\w.]+)|@inject\s+([\w.]+)", "", r"<!--.*?-->|@\*.*?\*@")),
    **dict.fromkeys((".csproj", ".fsproj", ".vbproj", ".sln", ".slnx"), Language("", "", r'(?:Include|Path)="([^"]+)"|=\s*"[^"]*",\s*"([^"]+proj)"', "", r"<!--.*?-->", False)),
}
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_BLOCK = re.compile("[{};]")
#: Words before a bracket that are no calls: fixed values.
_KEYWORDS = frozenset("if for while switch catch return function fn func def class sizeof typeof new await super this elif else try with unless until match when using lock foreach and or not in do".split())


def _name(match: re.Match) -> str:
    return next((g for g in match.groups() if g), "")


def read_code(path: str, text: str) -> list[dict]:
    """Types, functions, base types, imports and calls of a file, by its language's patterns."""
    f = Facts(path)
    language = LANGUAGES.get("." + path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if language is None:
        return f.done()
    # comments become blanks, so that places stay
    code = re.sub(language.comment, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S) if language.comment else text
    starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def line(at: int) -> int:
        return bisect.bisect_right(starts, at)

    def end_of(at: int) -> int:
        """Where the block that opens after `at` closes; the end of the text where none opens."""
        depth = 0
        for m in _BLOCK.finditer(code, at):
            if m[0] == ";" and not depth:
                return m.end()
            depth += {"{": 1, "}": -1, ";": 0}[m[0]]
            if not depth:
                return m.end()
        return len(code)

    owners: list[tuple[int, str]] = [(0, f.root)]
    blocks: list[tuple[int, int, str]] = [(0, len(code) + 1, f.root)]
    for m in re.finditer(language.types, code, re.M) if language.types else ():
        if name := _name(m):
            me = f.node(slug(f.root, name), name, line(m.start()))
            f.edge(f.root, me, "contains", line(m.start()))
            owners.append((m.start(), me))
            blocks.append((m.start(), end_of(m.end()), me))
    for m in re.finditer(language.functions, code, re.M) if language.functions else ():
        name = _name(m)
        if name and name not in _KEYWORDS:
            owner = max((b for b in blocks if b[0] <= m.start() < b[1]), key=lambda b: b[0])[2]
            me = f.node(slug(owner, name), f".{name}()" if owner != f.root else f"{name}()", line(m.start()))
            f.edge(owner, me, "method" if owner != f.root else "contains", line(m.start()))
            owners.append((m.start(), me))
    for m in re.finditer(language.bases, code, re.S) if language.bases else ():
        parts = m.groupdict() or {"a": m[1], "b": m[2]}
        for base in re.split(r"[,\s]+", re.sub(r"<[^>]*>|\b(?:public|private|protected|virtual|implements|with)\b", " ", parts["b"])):
            if base:
                f.edge(slug(f.root, parts["a"]), slug(base), "inherits", line(m.start()), "base")
    for m in re.finditer(language.imports, code, re.M) if language.imports else ():
        for name in re.split(r"[,\s]+", _name(m)):
            if name:
                # what a script imports is a path, which is resolved when all files are known
                f.edge(f.root, slug(name), "imports_from", line(m.start()), "script" if language is _JS else "import", name if language is _JS else None)
    if language.calls:
        places, names = zip(*sorted(owners), strict=True)
        for m in _CALL.finditer(code):
            if m[1] not in _KEYWORDS:
                owner = names[bisect.bisect_right(places, m.start()) - 1]
                if not owner.endswith(slug(m[1])):
                    f.call(owner, m[1], line(m.start()))
    return f.done()


def read_markdown(path: str, text: str) -> list[dict]:
    """Headings as nested nodes, and links to other files; fenced code is passed over."""
    f = Facts(path)
    f.rows[0]["file_type"] = "document"
    above: list[tuple[int, str]] = []
    fenced = False
    targets: set[str] = set()
    for n, row in enumerate(text.split("\n"), 1):
        if re.match(r"\s*(```|~~~)", row):
            fenced = not fenced
        if fenced:
            continue
        if m := re.match(r"(#{1,6})\s+(.+)", row):
            level, title = len(m[1]), m[2].strip()
            while above and above[-1][0] >= level:
                above.pop()
            id_ = slug(f.root, title)
            id_ = slug(id_, f"l{n}") if id_ in f.seen else id_
            f.node(id_, title, n, "document")
            f.edge(above[-1][1] if above else f.root, id_, "contains", n)
            above.append((level, id_))
        for m in re.finditer(r"\[\[([^\]|#]+)[^\]]*\]\]|\[[^\]]*\]\(([^)\s]+)[^)]*\)|^\[[^\]]+\]:\s*(\S+)", row):
            to = _name(m).split("#")[0].split("?")[0]
            if to and "://" not in to and not to.startswith("mailto:"):
                to = to if "." in to.rsplit("/", 1)[-1] else f"{to}.md"
                if to not in targets:
                    targets.add(to)
                    f.edge(f.root, slug(to.rsplit(".", 1)[0]), "references", n)
    return f.done()


def read_sql(path: str, text: str) -> list[dict]:
    """Tables, views, functions, triggers, foreign keys, and what views read from."""
    f = Facts(path)
    code = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    word = r'["`\[]?([\w.]+)["`\]]?'
    at = lambda m: code.count("\n", 0, m.start()) + 1
    for m in re.finditer(rf"(?is)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|materialized\s+)?(table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?{word}([^;]*)", code):
        kind, name, body = m[1].lower(), m[2], m[3]
        me = f.node(slug(name), name, at(m))
        f.edge(f.root, me, "contains", at(m))
        if kind == "trigger":
            for t in re.finditer(rf"(?i)\bon\s+{word}", body):
                f.edge(me, slug(t[1]), "triggers", at(m))
                break
        elif kind == "table":
            for t in re.finditer(rf"(?i)\breferences\s+{word}", body):
                f.edge(me, slug(t[1]), "references", at(m), "foreign_key")
        if kind in ("view", "function", "procedure"):
            for t in sorted({slug(t[1]) for t in re.finditer(rf"(?i)\b(?:from|join)\s+{word}", body)}):
                f.edge(me, t, "reads_from", at(m))
    return f.done()


def read_json(path: str, text: str) -> list[dict]:
    """Keys of the two upper levels, and the dependencies of a package file."""
    import json

    f = Facts(path)
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return f.done()
    for key, value in data.items() if isinstance(data, dict) else ():
        me = f.node(slug(f.root, key), key, 1)
        f.edge(f.root, me, "contains", 1)
        if re.fullmatch(r"(?:dev|peer|optional)?[dD]ependencies", key) and isinstance(value, dict):
            for name in value:
                f.edge(f.root, f.node(slug("package", name), name, 1), "depends_on", 1, "dependency")
        elif key == "extends" and isinstance(value, str):
            f.edge(f.root, slug(value), "extends", 1)
        else:
            for sub in value if isinstance(value, dict) else ():
                f.edge(me, f.node(slug(me, str(sub)), str(sub), 1), "contains", 1)
    return f.done()


def read_html(path: str, text: str) -> list[dict]:
    """Links, scripts and styles of a page, and component tags and includes of a template."""
    f = Facts(path)
    for m in re.finditer(r"""(?:href|src)\s*=\s*["']([^"'#?]+)|@(?:include|extends|component)\(\s*['"]([^'"]+)""", text):
        f.edge(f.root, slug(_name(m)), "references", text.count("\n", 0, m.start()) + 1)
    return f.done()


#: Readers by extension, where it isn't a language of patterns.
READERS = {".py": read_python, ".pyw": read_python, ".md": read_markdown, ".mdx": read_markdown, ".qmd": read_markdown, ".sql": read_sql, ".json": read_json, ".html": read_html, ".htm": read_html}


def read_file(path: str, text: str | None) -> list[dict]:
    """The facts of a file by its extension. A reader that fails leaves the file's own node."""
    extension = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    reader = read_html if path.lower().endswith(".blade.php") else READERS.get(extension, read_code)
    try:
        return reader(path, text or "")
    except (ValueError, IndexError, KeyError, RecursionError):
        return Facts(path).done()


def extract(files: DataFrame) -> DataFrame:
    """FACTS of files (path, text)."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, x in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in read_file(p, x)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.int32() if n == "line" else pa.string()) for n in names], names)

    return files.select("path", "text").mapInArrow(run, FACTS)


def graph_of(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and unresolved calls of files (path, text)."""
    from weft.runtime import materialize

    facts = materialize(extract(files), "facts")
    location = F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location")
    nodes = facts.where("kind = 'node'").select("id", "label", "file_type", F.col("file").alias("source_file"), location)
    edges = facts.where("kind = 'edge'").select("source", "target", "relation", F.lit("EXTRACTED").alias("confidence"), "context", F.col("label").alias("symbol"), F.col("file").alias("source_file"), location)
    calls = facts.where("kind = 'call'").select(F.col("source").alias("caller"), F.col("label").alias("callee"), F.col("file").alias("caller_file"), location)
    return nodes, edges, calls
