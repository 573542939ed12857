"""The vocabularies and patterns that results depend on."""

from __future__ import annotations

# --- fixed values ---
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
FILE_TYPE_SYNONYMS = {
    "markdown": "document", "text": "document", "tool": "code", "library": "code", "pattern": "concept", "principle": "concept",
    "constraint": "concept", "tech": "concept", "technology": "concept", "data-source": "concept", "data_source": "concept", "gotcha": "concept", "framework": "concept",
}
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
CONFIDENCE_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}
NODE_FIELDS = ("id", "label", "file_type", "source_file")
EDGE_FIELDS = ("source", "target", "relation", "confidence", "source_file")
IMPACT_RELATIONS = ("calls", "indirect_call", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds", "requires")
STRUCTURAL_RELATIONS = ("imports", "imports_from", "contains", "method")
CYCLE_RELATIONS = ("imports_from", "re_exports")
MEMBER_RELATIONS = ("method", "contains")
NO_SELF_LOOP_RELATIONS = ("imports", "imports_from", "re_exports")
CODE_EXTENSIONS = (
    ".py", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".ejs", ".ets", ".go", ".rs", ".java", ".groovy", ".gradle", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp",
    ".cu", ".cuh", ".metal", ".rb", ".rake", ".swift", ".kt", ".kts", ".cs", ".scala", ".php", ".lua", ".luau", ".toc", ".zig", ".ps1", ".psm1", ".psd1", ".ex", ".exs", ".m",
    ".mm", ".jl", ".vue", ".svelte", ".astro", ".dart", ".v", ".sv", ".svh", ".sql", ".r", ".f", ".f90", ".f95", ".f03", ".f08", ".pas", ".pp", ".dpr", ".dpk", ".lpr", ".inc",
    ".dfm", ".lfm", ".lpk", ".sh", ".bash", ".json", ".tf", ".tfvars", ".hcl", ".dm", ".dme", ".dmi", ".dmm", ".dmf", ".sln", ".slnx", ".csproj", ".fsproj", ".vbproj", ".xaml",
    ".razor", ".cshtml", ".cls", ".trigger",
)
DOC_EXTENSIONS = (".md", ".mdx", ".qmd", ".skill", ".txt", ".rst", ".html", ".yaml", ".yml")
PAPER_EXTENSIONS = (".pdf",)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
OFFICE_EXTENSIONS = (".docx", ".xlsx")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mp3", ".wav", ".m4a", ".ogg")
LANGUAGE_FAMILY = {
    ".py": "python", ".pyw": "python", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ejs": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js", ".vue": "js",
    ".svelte": "js", ".go": "go", ".rs": "rust", ".java": "jvm", ".kt": "jvm", ".kts": "jvm", ".scala": "jvm", ".c": "c", ".h": "c", ".cpp": "c", ".cc": "c", ".cxx": "c",
    ".hpp": "c", ".rb": "ruby", ".rake": "ruby", ".swift": "swift", ".cs": "dotnet", ".php": "php", ".r": "r",
}
BUILD_FAMILY = {
    ".py": "py", ".pyi": "py", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js", ".go": "go", ".rs": "rs", ".java": "jvm",
    ".kt": "jvm", ".scala": "jvm", ".groovy": "jvm", ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".hpp": "c", ".cxx": "c", ".hh": "c", ".hxx": "c", ".cu": "c", ".cuh": "c",
    ".metal": "c", ".m": "c", ".mm": "c", ".rb": "rb", ".rake": "rb", ".php": "php", ".cs": "cs", ".swift": "swift", ".lua": "lua",
}
JSON_NOISE = (
    "start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version", "dependencies", "devdependencies", "peerdependencies",
    "optionaldependencies", "bundleddependencies", "bundledependencies",
)
BUILTIN_NOISE = (
    "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object", "True", "False", "MagicMock", "Mock", "AsyncMock", "NonCallableMock", "NonCallableMagicMock",
    "PropertyMock", "patch", "sentinel", "Path", "Any", "Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable", "Type", "ClassVar", "Final", "Literal", "Protocol", "Counter",
    "defaultdict", "OrderedDict", "datetime", "Enum", "os", "sys", "re", "json", "io", "abc", "typing", "Foundation", "SwiftUI", "UIKit", "AppKit", "Combine", "String", "Int",
    "Double", "Float", "Bool", "Data", "URL", "Date", "UUID", "Sendable", "Codable", "Decodable", "Encodable", "Equatable", "Hashable", "Identifiable", "Comparable", "AnyObject",
    "Error", "LocalizedError", "NSObject", "NSString", "NSError", "NSLock", "View", "Color", "Font", "DispatchQueue",
)
PAPER_SIGNALS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]",
    r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)
CREDENTIAL_DIRS = (".ssh", ".gnupg", ".aws", ".gcloud")
SECRET_DIRS = ("secrets", ".secrets", "credentials")
SECRET_NAMES = (
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(?i)(^|[^A-Za-z0-9])(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)^secring(\.(gpg|pgp))?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto)$",
)
ENV_TEMPLATE = r"(?i)^\.(env|envrc)\..*(\.example|\.sample|\.template|\.dist)$|(?i)^\.(env|envrc)(\.example|\.sample|\.template|\.dist)$"
SECRET_WORDS = (r"(credential|secret|passwd|password|private_key)s?", r"tokens?", r"service[._-]?account")
PROSE_EXTENSIONS = (".md", ".markdown", ".rst", ".org", ".adoc", ".tex")
SECRET_PRONE = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".config", ".xml", ".properties", ".env", ".txt", ".tfvars")
TEST_DIRS = ("tests", "test", "spec", "specs", "__tests__")
TEST_NAMES = r"(?i)^test_.*|.*_test\..+$|.*\.test\..+$|.*\.spec\..+$|.*_spec\..+$|.*\.tests\.ps1$"
TEST_NAMES_CASED = r"^.*Tests?\.java$|^.*Tests\.cs$"
STOPWORDS = (
    "how", "what", "why", "when", "where", "which", "who", "whom", "whose", "does", "did", "is", "are", "was", "were", "be", "been", "being", "can", "could", "should", "would", "will",
    "shall", "may", "might", "must", "has", "have", "had", "the", "and", "but", "not", "for", "from", "with", "without", "into", "onto", "off", "that", "this", "these", "those", "there",
    "here", "its", "their", "them", "they", "about", "any", "all", "some", "work", "works", "working", "der", "die", "das", "den", "dem", "ein", "eine", "und", "oder", "nicht", "wie",
    "wer", "wann", "wo", "warum", "wieso", "welche", "welcher", "welches", "ist", "sind", "wird", "wurde", "hat", "haben", "kann", "koennen", "können", "soll", "muss", "sich", "bei",
    "mit", "von", "fuer", "für", "ueber", "über", "nach", "aus", "gibt", "es", "funktioniert", "geaendert", "geändert", "aendert", "ändert", "pourquoi", "quand", "quel", "quelle",
    "quels", "quelles", "quoi", "qui", "que", "est", "sont", "fonctionne", "cette", "dans", "avec", "où", "cómo", "como", "qué", "cuál", "cuáles", "cuándo", "dónde", "donde", "porque",
    "por", "para", "funciona", "está", "están", "hay", "qual", "quais", "quando", "onde", "são", "estão", "tem", "uma", "não", "perché", "cosa", "quale", "quali", "dove", "funziona",
    "sono", "che", "della",
)
CONTEXT_HINTS = {
    "call": ("call", "calls", "called", "invoke", "invokes", "invoked"), "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"), "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"),
    "return_type": ("return", "returns", "returned"), "generic_arg": ("generic", "generics", "template", "templates"),
}
CONTEXT_ALIASES = {
    "param": "parameter_type", "params": "parameter_type", "parameter": "parameter_type", "parameters": "parameter_type", "argument": "parameter_type", "arguments": "parameter_type",
    "arg": "parameter_type", "args": "parameter_type", "return": "return_type", "returns": "return_type", "returned": "return_type", "generic": "generic_arg", "generics": "generic_arg",
    "template": "generic_arg", "templates": "generic_arg", "annotation": "attribute", "annotations": "attribute", "decorator": "attribute", "decorators": "attribute", "calls": "call",
    "called": "call", "invoke": "call", "invocation": "call", "fields": "field", "property": "field", "properties": "field", "member": "field", "members": "field", "imports": "import",
    "imported": "import", "module": "import", "modules": "import", "exports": "export", "exported": "export",
}

HEADER_EXTENSIONS = (".h", ".hh", ".hpp", ".hxx")
IMPLEMENTATION_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".m", ".mm")

# How an import of a script becomes a file, in the order in which the forms are tried.
SCRIPT_TWINS = ((".js", ".ts"), (".jsx", ".tsx"))
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".svelte", ".js", ".jsx", ".mjs", ".cjs")
SCRIPT_INDEXES = ("index.ts", "index.tsx", "index.svelte", "index.js", "index.jsx", "index.mjs")
# Relations that lead to a type.
TYPE_RELATIONS = ("implements", "inherits", "extends", "imports", "references", "mixes_in")
