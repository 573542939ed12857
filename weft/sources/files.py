"""Files as tables: scanning, change tracking and content-addressed caching."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.runtime import materialize, sized_broadcast

#: Corpus sizes that call for a warning: fixed values.
FEW_WORDS, MANY_WORDS, MANY_FILES = 50_000, 500_000, 500
#: Directories that are never scanned: fixed values.
NOISE_DIRS = ("node_modules", "__pycache__", ".git", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "site-packages")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size, mtime, text, sha, kind, words and status of every file below root.

    status: 'noise' (in a directory that is never scanned), 'sensitive', 'other' (no kind), or 'ok'. Names, sizes and times
    are listed on the driver, hidden files and those that begin with an underscore included; contents are read by the
    executors, one file at a time.
    """
    uri = root if "://" in root else f"file://{root}"
    fs, top = pafs.FileSystem.from_uri(uri)
    top = top.rstrip("/")
    found = [i for i in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if i.is_file]
    listed = spark.createDataFrame([(i.path[len(top) + 1 :], i.size, i.mtime) for i in found], "path string, size long, mtime timestamp")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for at, path in enumerate(batch.column("path").to_pylist()):
                with files.open_input_file(f"{base.rstrip('/')}/{path}") as f:
                    data = f.readall()
                row = batch.slice(at, 1)
                text = pa.array([data.decode("utf-8", "replace")])
                yield pa.RecordBatch.from_arrays([*row.columns, text, pa.array([hashlib.sha256(data).hexdigest()])], ["path", "size", "mtime", "text", "sha"])

    parts = max(1, min(len(found), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = listed.repartition(parts).mapInArrow(read, "path string, size long, mtime timestamp, text string, sha string")
    noise = F.exists(T.parents(F.col("path")), lambda p: p.isin(*NOISE_DIRS))
    kind = T.classify_file(F.col("path"), F.col("text"))
    status = F.when(noise, "noise").when(T.is_sensitive(F.col("path")), "sensitive").when(kind.isNull(), "other").otherwise("ok")
    return rows.withColumn("kind", kind).withColumn("words", T.word_count(F.col("text"))).withColumn("status", status)


def scan_changes(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and status ('new', 'changed', 'unchanged' or 'deleted') of each file of either table (path, sha)."""
    both = now.select("path", F.col("sha").alias("_now")).join(manifest.select("path", F.col("sha").alias("_was")), "path", "full")
    status = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_was"), "changed").otherwise("unchanged")
    return both.select("path", status.alias("status"))


def merge_manifest(old: DataFrame, now: DataFrame, alive: DataFrame, kind: str = "both", corpus: DataFrame | None = None, cleared: DataFrame | None = None) -> DataFrame:
    """path, mtime, ast_hash, semantic_hash after a pass of kind ast, semantic or both over the files of now (path, mtime, hash).

    Rows of old for files that are not in now stay while the file is there (alive) and, if corpus is given, in it; those in
    cleared lose their semantic_hash. A pass over the syntax keeps the semantic_hash of a file only while its content is the
    same, a semantic pass keeps the ast_hash.
    """
    kept = old.join(alive.select("path").distinct(), "path", "left_semi")
    if corpus is not None:
        kept = kept.join(corpus.select("path").distinct(), "path", "left_semi")
    kept = kept.join(now.select("path"), "path", "left_anti").select("path", "mtime", "ast_hash", "semantic_hash")
    if cleared is not None:
        gone = cleared.select("path").distinct().withColumn("_gone", F.lit(True))
        kept = kept.join(gone, "path", "left").select("path", "mtime", "ast_hash", F.when(F.col("_gone").isNull(), F.col("semantic_hash")).otherwise("").alias("semantic_hash"))
    before = old.select("path", F.coalesce("ast_hash", F.lit("")).alias("_ast"), F.coalesce("semantic_hash", F.lit("")).alias("_semantic"))
    rows = now.join(before, "path", "left")
    ast = F.col("hash") if kind in ("ast", "both") else F.coalesce("_ast", F.lit(""))
    same = F.coalesce(F.col("hash") == F.col("_ast"), F.lit(False))
    semantic = F.col("hash") if kind in ("semantic", "both") else F.when(same, F.col("_semantic")).otherwise("")
    return kept.unionByName(rows.select("path", "mtime", ast.alias("ast_hash"), semantic.alias("semantic_hash")))


def cache_split(files: DataFrame, cached: DataFrame) -> DataFrame:
    """files with sha and hit: whether cached has the same content at the same path."""
    sha = T.content_hash(F.col("text"), F.col("path"))
    known = cached.select(sha.alias("_sha")).distinct()
    return files.withColumn("sha", sha).join(known, F.col("sha") == F.col("_sha"), "left").withColumn("hit", F.col("_sha").isNotNull()).drop("_sha")


def apply_ignores(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """files (path) with ignored, by patterns (base, regex, negated, place) whose regex is matched against a path below base.

    Of the patterns that match a path, the last by place decides. A path is ignored if it or any directory above it is:
    a negated pattern can't bring back what lies in an ignored directory.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("above"), (k < F.size(parts)).alias("is_dir")))
    every = files.select("path").distinct().select("path", F.inline(ups))
    inside = (F.col("base") == "") | F.col("above").startswith(F.concat("base", F.lit("/")))
    hits = every.join(sized_broadcast(materialize(patterns, "patterns")), inside & F.expr("rlike(CASE WHEN base = '' THEN above ELSE substring(above, length(base) + 2) END, regex)") & (~F.col("dirs_only") | F.col("is_dir")))
    verdict = hits.groupBy("path", "above").agg(F.max_by(~F.col("negated"), "place").alias("out"))
    out = verdict.groupBy("path").agg(F.bool_or("out").alias("_out"))
    return files.join(out, "path", "left").withColumn("ignored", F.coalesce("_out", F.lit(False))).drop("_out")


def ignore_pattern(line: str) -> tuple[str, bool, bool] | None:
    """regex, negated and dirs_only of a line of an ignore file; None for blank lines and comments."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    dirs_only, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    out, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (line[i] if line[i].isalnum() or line[i] in "/_-[]" else "\\" + line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, dirs_only


def corpus_totals(files: DataFrame) -> DataFrame:
    """files, words and warning ('small', 'large' or null) of a scan."""
    totals = files.where("status = 'ok'").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    warning = F.when(F.col("words") < FEW_WORDS, "small").when((F.col("words") >= MANY_WORDS) | (F.col("files") >= MANY_FILES), "large")
    return totals.withColumn("warning", warning)
