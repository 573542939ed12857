"""Making one node of rows that mean the same thing: twins, former ids, declarations, packages, shared externals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions import vocab
from weft.operators.build import remap
from weft.operators.resolve import unique_index

#: Tasks to which the pairs that one file makes are dealt.
SPREAD = 8

def doc_twins(nodes: DataFrame) -> DataFrame:
    """old, new: the document x and the document x_doc of the same file are one, under the latter id.

    Nodes without a file have no twin; ids are taken as unique.
    """
    docs = nodes.where("file_type = 'document' AND source_file <> ''").select("id", "source_file")
    long = docs.where(F.col("id").endswith("_doc")).select(F.col("id").alias("new"), F.expr("left(id, length(id) - 4)").alias("old"), "source_file")
    return long.join(docs.select(F.col("id").alias("old"), "source_file"), ["old", "source_file"]).select("old", "new")


def without_suffix(path: Column) -> Column:
    """path without the last extension of its file's name; a name that begins with its only dot keeps it."""
    return F.regexp_replace(path, r"([^/])\.[^./]*$", "$1")


def former_ids(nodes: DataFrame) -> DataFrame:
    """alias, id: ids that a node had when they were made of its file's name, with or without the directory above it.

    Today an id begins with the whole path. Of an alias that several nodes could have had, and of one that is a node's id
    now, nothing is told. Nodes of files outside the tree (absolute paths) have none.
    """
    path = without_suffix(F.col("source_file"))
    parts = F.split(path, "/")
    own, parent = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    rows = nodes.where("source_file <> '' AND NOT startswith(source_file, '/')").select("id", "label", "source_file", T.norm_id(path).alias("_stem"), T.norm_id(F.col("id")).alias("_norm"), T.norm_id(own).alias("_own"), T.norm_id(F.concat(parent, F.lit("."), own)).alias("_parent"))
    is_file = F.col("label").eqNullSafe(T.basename(F.col("source_file")))
    tail = F.when(~is_file & F.col("_norm").startswith(F.col("_stem")), F.expr("substring(_norm, length(_stem) + 1)")).otherwise("")
    old = rows.select("id", "_stem", tail.alias("_tail"), F.explode(F.array("_parent", "_own")).alias("_old")).where("_old <> '' AND _old <> _stem")
    alone = unique_index(old.select(F.concat("_old", "_tail").alias("alias"), "id"), ["alias"])
    return alone.join(nodes.select(T.norm_id(F.col("id")).alias("alias")), "alias", "left_anti").select("alias", "id")


def merge_declarations(nodes: DataFrame) -> DataFrame:
    """nodes in which a class declared in a header and defined beside it is the header's node alone.

    Code nodes of one id become one where all of them are in header or implementation files of one directory and one base
    name (up to a `+`), and just one is in a header. Any other group stays as it is.
    """
    ext = T.extension(F.col("source_file"))
    head, body = ext.isin(*vocab.HEADER_EXTENSIONS), ext.isin(*vocab.IMPLEMENTATION_EXTENSIONS)
    base = F.regexp_replace(without_suffix(F.col("source_file")), r"\+[^/]*$", "")
    considered = (F.col("file_type") == "code") & (F.col("source_file") != "") & F.col("id").isNotNull()
    groups = nodes.where(considered).groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(head).alias("_heads"), F.count_if(head | body).alias("_fit"), F.min(base).alias("_least"), F.max(base).alias("_most"))
    merged = groups.where("_n > 1 AND _heads = 1 AND _fit = _n AND _least = _most").select(F.col("id").alias("_id"))
    marked = nodes.join(merged, F.col("id") == F.col("_id"), "left")
    return marked.where(F.col("_id").isNull() | ~F.coalesce(considered, F.lit(False)) | head).drop("_id")


def package_aliases(files: DataFrame) -> DataFrame:
    """alias, id: the id that an import by module path has, and the id of the one Python file (path) meant by it.

    A file's package is the chain of directories right above it that hold an __init__.py; the alias leaves out what is above
    that. A package's directory is an alias of its __init__.py. None where the chain reaches the root, as the ids agree there.
    """
    python = files.where(T.extension(F.col("path")).isin(".py", ".pyi")).select("path").distinct()
    start = T.basename(F.col("path")).isin("__init__.py", "__init__.pyi")
    packages = python.where(start).select(F.array_join(T.parents(F.col("path")), "/").alias("above")).distinct()
    ups = T.parents(F.col("path"))
    levels = python.where(F.size(ups) > 0).select("path", F.size(ups).alias("_deep"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(ups)), lambda k: F.array_join(F.slice(ups, 1, k), "/"))).alias("_at", "above"))
    # the deepest directory above the file that is no package ends the chain
    known = levels.join(packages.withColumn("_package", F.lit(True)), "above", "left")
    chain = known.groupBy("path", "_deep").agg(F.max(F.when(F.col("_package").isNull(), F.col("_at") + 1)).alias("_end"))
    inside = chain.where("_end IS NOT NULL AND _end < _deep")
    parts = F.split(without_suffix(F.col("path")), "/")
    module = F.slice(parts, F.col("_end") + 1, F.size(parts))
    named = inside.select("path", "_end", "_deep", F.array_join(module, "/").alias("_module"))
    folder = named.where(start).select("path", F.regexp_replace("_module", "/[^/]*$", "").alias("_module"))
    every = named.select("path", "_module").union(folder)
    return unique_index(every.select(T.norm_id(F.col("_module")).alias("alias"), T.norm_id(without_suffix(F.col("path"))).alias("id")), ["alias"])


def repoint_imports(edges: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges whose imports from Python files lead to the file that package_aliases names; an id of a node is no alias."""
    aliases = package_aliases(files).join(nodes.select(F.col("id").alias("alias")), "alias", "left_anti").withColumnRenamed("id", "_to")
    python = T.extension(F.col("source_file")).isin(".py", ".pyi") & F.col("relation").isin("imports", "imports_from")
    out = edges.join(aliases, (F.col("target") == F.col("alias")) & python, "left")
    return out.withColumn("target", F.coalesce("_to", "target")).drop("alias", "_to")


def external_twins(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """old, new: nodes without a file whose label a node without a file in known has; of several there, the least id."""
    shared = known.where("source_file = '' AND label <> ''").groupBy("label").agg(F.min("id").alias("new"))
    return nodes.where("source_file = ''").select(F.col("id").alias("old"), "label").join(shared, "label").select("old", "new")


def merge_externals(known: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a repository adds to known: externals that are there already are not added, and edges lead
    to them; no edge leads to its own source."""
    twins = external_twins(known, nodes)
    added = nodes.join(twins.select(F.col("old").alias("id")), "id", "left_anti").select(*nodes.columns)
    return added, remap(edges, twins).where("source <> target")


def uses_of_imports(imports: DataFrame, classes: DataFrame) -> DataFrame:
    """source, target, relation, confidence, weight: each class of a file uses each class that the file imports.

    imports: file, module, symbol. classes: id, file, module, symbol; of one name twice in a module, the least id counts.
    A module that isn't found is looked for by its last segment, if it has one; of modules with that segment, the least.
    """
    symbols = classes.groupBy("module", "symbol").agg(F.min("id").alias("target"))
    bare = lambda c: F.regexp_extract(c, r"[^./]*$", 0)
    modules = classes.select("module").distinct()
    short = modules.groupBy(bare(F.col("module")).alias("_bare")).agg(F.min("module").alias("_by_bare"))
    asked = imports.select("file", "module", "symbol").distinct().join(modules.withColumnRenamed("module", "_exact"), F.col("module") == F.col("_exact"), "left")
    asked = asked.withColumn("_bare", F.when(F.col("_exact").isNull(), bare(F.col("module")))).join(short, "_bare", "left")
    found = asked.select("file", F.coalesce("_exact", "_by_bare").alias("module"), "symbol").distinct().join(symbols, ["module", "symbol"]).select("file", "target")
    local = classes.select("file", F.col("id").alias("source")).distinct()
    homes = local.groupBy("source").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("_n"))
    several = local.join(homes.where("_n > 1").select(F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")), "left_semi")
    # few classes and imports make many pairs: each file's are dealt to SPREAD tasks, and only those of a class in several files
    # can be equal and need a shuffle
    parts = SPREAD * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = found.distinct().select("file", "target", F.explode(F.array(*map(F.lit, range(SPREAD)))).alias("_p")).repartition(parts, "file", "_p")
    meet = lambda c: c.select("file", "source", F.pmod(F.xxhash64("source"), F.lit(SPREAD)).cast("int").alias("_p")).repartition(parts, "file", "_p").join(places, ["file", "_p"]).select("source", "target")
    pairs = meet(homes.where("_n = 1")).union(meet(several).distinct())
    return pairs.select("*", F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("weight"))


def rekeyed_ids(nodes: DataFrame) -> DataFrame:
    """old, new: ids that begin with a former stem of their file, made to begin with its whole path.

    Parsed nodes (origin 'ast'), nodes of files outside the tree and ids that begin with the whole path already keep theirs.
    The stem with the directory above goes before the bare one. Of an id that is in several files, the last file counts.
    """
    path = without_suffix(F.col("source_file"))
    parts = F.split(path, "/")
    own, parent = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    loose = nodes.where("coalesce(origin, '') <> 'ast' AND source_file <> '' AND NOT startswith(source_file, '/') AND id <> ''")
    rows = loose.select("id", "source_file", T.norm_id(path).alias("_stem"), T.norm_id(F.col("id")).alias("_norm"), F.array(T.norm_id(F.concat(parent, F.lit("."), own)), T.norm_id(own)).alias("_olds"))
    rows = rows.select("id", "source_file", "_stem", "_norm", F.posexplode("_olds").alias("_pos", "_old"))
    rows = rows.where("_stem <> '' AND _norm <> _stem AND NOT startswith(_norm, concat(_stem, '_')) AND _old <> '' AND _old <> _stem")
    rest = F.expr("substring(_norm, length(_old) + 1)")
    new = rows.where("_norm = _old OR startswith(_norm, concat(_old, '_'))").select(F.col("id").alias("old"), "source_file", "_pos", F.concat("_stem", rest).alias("new"))
    return new.groupBy("old").agg(F.max_by("new", F.struct("source_file", -F.col("_pos"))).alias("new")).where("new <> old")


def collided_ids(nodes: DataFrame) -> DataFrame:
    """id, source_file, new: ids that nodes of several files share, told apart by the file's path.

    Where two paths give the same new id, digits of the path's hash follow. Nodes without a file keep their id, and so do
    modules and namespaces (column type, if there is one), which many files may share.
    """
    own = nodes.where("id <> '' AND coalesce(type, '') NOT IN ('module', 'namespace')") if "type" in nodes.columns else nodes.where("id <> ''")
    keys = own.select("id", F.coalesce("source_file", F.lit("")).alias("source_file")).distinct()
    shared = keys.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id")
    named = keys.where("source_file <> ''").join(shared, "id", "left_semi").withColumn("_plain", T.norm_id(F.concat_ws("_", "source_file", "id")))
    again = named.groupBy("id", "_plain").agg(F.count(F.lit(1)).alias("_n"))
    salt = F.substring(F.sha1(F.col("source_file").cast("binary")), 1, 6)
    return named.join(again, ["id", "_plain"]).select("id", "source_file", F.when(F.col("_n") > 1, F.concat("_plain", F.lit("_"), salt)).otherwise(F.col("_plain")).alias("new"))
