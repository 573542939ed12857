"""Queries of rows that mean the same node, and of evidence for nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import identity as I
from weft.operators import memory as M
from weft.operators import resolve as R
from weft.operators.build import global_prefix
from weft.plans.registry import query
from weft.plans.tables import EDGES_SQL, FILES_SQL, NODES_SQL, edges, files, nodes, table
from weft.runtime import materialize


def _norm(sql: str) -> str:
    return f"lower(trim(regexp_replace({sql}, '[^a-zA-Z0-9]+', '_', 'g'), '_'))"


_STEM = "regexp_replace(source_file, '([^/])\\.[^./]*$', '\\1')"


@query("doc_twins", f"""WITH {FILES_SQL}, n AS (SELECT 'd' || doc_id AS id, 'document' AS kind, path FROM files UNION ALL SELECT 'd' || doc_id || '_doc', CASE WHEN doc_id % 4 = 0 THEN 'code' ELSE 'document' END, CASE WHEN doc_id % 3 = 0 THEN 'else/' || path ELSE path END FROM files)
SELECT a.id AS old, b.id AS new FROM n a JOIN n b ON b.id = a.id || '_doc' AND a.path = b.path AND a.kind = 'document' AND b.kind = 'document'""")
def doc_twins(spark, d):
    f, n = files(spark, d), F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    short = f.select(n.alias("id"), F.lit("document").alias("file_type"), F.col("path").alias("source_file"))
    kind = F.when(F.col("doc_id") % 4 == 0, "code").otherwise("document")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("else/"), "path")).otherwise(F.col("path"))
    return I.doc_twins(short.union(f.select(F.concat(n, F.lit("_doc")), kind, path)))


@query("former_ids", f"""WITH {FILES_SQL}, p AS (SELECT doc_id, CASE WHEN doc_id % 7 < 3 THEN 'copy/' ELSE '' END || regexp_replace(path, '[0-9]+', (doc_id % 40)::varchar) AS source_file FROM files),
n AS (SELECT {_norm(_STEM)} || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '_part' END AS id, CASE WHEN doc_id % 3 = 0 THEN regexp_extract(source_file, '[^/]*$') ELSE 'Part' END AS label, source_file FROM p),
s AS (SELECT id, {_norm("id")} AS nid, {_norm(_STEM)} AS st, string_split({_STEM}, '/') AS p, label = regexp_extract(source_file, '[^/]*$') AS isf FROM n),
o AS (SELECT id, st, CASE WHEN NOT isf AND starts_with(nid, st) THEN substr(nid, length(st) + 1) ELSE '' END AS tail, unnest([CASE WHEN len(p) > 1 THEN {_norm("p[-2] || '.' || p[-1]")} END, {_norm("p[-1]")}]) AS old FROM s)
SELECT old || tail AS alias, min(id) AS id FROM o WHERE old <> '' AND old <> st AND old || tail NOT IN (SELECT nid FROM s) GROUP BY 1 HAVING count(DISTINCT id) = 1""")
def former_ids(spark, d):
    from weft.functions import text as T

    whole = F.col("doc_id") % 3 == 0
    path = F.concat(F.when(F.col("doc_id") % 7 < 3, "copy/").otherwise(""), F.regexp_replace("path", F.lit("[0-9]+"), (F.col("doc_id") % 40).cast("string")))
    f = files(spark, d).select("doc_id", path.alias("source_file"))
    node = F.concat(T.norm_id(I.without_suffix(F.col("source_file"))), F.when(whole, "").otherwise("_part"))
    return I.former_ids(f.select(node.alias("id"), F.when(whole, T.basename(F.col("source_file"))).otherwise("Part").alias("label"), "source_file"))


_DECLARED = """n AS (SELECT 'c' || k AS id, p_name AS label, 'code' AS file_type, CASE p_partkey % 3 WHEN 0 THEN 'lib/' || k || '.h' WHEN 1 THEN 'lib/' || k || CASE WHEN k % 2 = 0 THEN '+Extra' ELSE '' END || CASE WHEN k % 11 = 0 THEN '.py' ELSE '.mm' END
 ELSE CASE WHEN k % 5 = 0 THEN 'other/' ELSE 'lib/' END || k || CASE WHEN k % 7 = 0 THEN '.hpp' ELSE '.cpp' END END AS source_file FROM (SELECT *, p_partkey // 3 AS k FROM part))"""


@query("merge_declarations", f"""WITH {_DECLARED}, x AS (SELECT *, regexp_extract(source_file, '[.][a-z]+$') AS ext, regexp_replace(source_file, '[+.][^/]*$', '') AS base FROM n),
ok AS (SELECT id FROM x GROUP BY id HAVING count(*) > 1 AND count_if(ext IN ('.h', '.hpp')) = 1 AND count_if(ext = '.py') = 0 AND count(DISTINCT base) = 1)
SELECT id, label, source_file FROM x WHERE id NOT IN (SELECT id FROM ok) OR ext IN ('.h', '.hpp')""")
def merge_declarations(spark, d):
    p = table(spark, d, "part").withColumn("k", F.expr("p_partkey DIV 3"))
    k, turn = F.col("k").cast("string"), F.col("p_partkey") % 3
    first = F.concat(F.lit("lib/"), k, F.lit(".h"))
    second = F.concat(F.lit("lib/"), k, F.when(F.col("k") % 2 == 0, "+Extra").otherwise(""), F.when(F.col("k") % 11 == 0, ".py").otherwise(".mm"))
    third = F.concat(F.when(F.col("k") % 5 == 0, "other/").otherwise("lib/"), k, F.when(F.col("k") % 7 == 0, ".hpp").otherwise(".cpp"))
    n = p.select(F.concat(F.lit("c"), k).alias("id"), F.col("p_name").alias("label"), F.lit("code").alias("file_type"), F.when(turn == 0, first).when(turn == 1, second).otherwise(third).alias("source_file"))
    return I.merge_declarations(n).select("id", "label", "source_file")


@query("package_imports", """SELECT 'f' || doc_id AS source, CASE WHEN doc_id % 5 < 3 AND doc_id % 4 > 0 AND doc_id % 15 <> 1 THEN 'src_' ELSE '' END || 'pkg' || doc_id % 5 || '_mod' || doc_id AS target FROM documents""")
def package_imports(spark, d):
    n = F.col("doc_id").cast("string")
    package = F.concat(F.lit("pkg"), (F.col("doc_id") % 5).cast("string"))
    docs = table(spark, d, "documents").select("doc_id")
    tree = docs.select(F.concat(F.lit("src/"), package, F.lit("/mod"), n, F.lit(".py")).alias("path")).union(docs.where("doc_id % 5 < 3").select(F.concat(F.lit("src/"), package, F.lit("/__init__.py"))))
    target = F.concat(package, F.lit("_mod"), n)
    e = docs.select(F.concat(F.lit("f"), n).alias("source"), target.alias("target"), F.lit("imports").alias("relation"), F.when(F.col("doc_id") % 4 == 0, "x.go").otherwise("x.py").alias("source_file"))
    taken = docs.where("doc_id % 15 = 1").select(target.alias("id"))
    return I.repoint_imports(e, tree, taken).select("source", "target")


@query("merge_externals", f"""WITH {EDGES_SQL} SELECT 'shop::' || source AS source, CASE WHEN starts_with(target, 'region:') THEN target ELSE 'shop::' || target END AS target, relation FROM edges WHERE relation = 'contains' OR starts_with(source, 'supplier:')""")
def merge_externals(spark, d):
    n, e = nodes(spark, d), edges(spark, d).where("relation = 'contains' OR startswith(source, 'supplier:')")
    known = n.where("startswith(id, 'region:') OR startswith(id, 'customer:')")
    shop = global_prefix(n.where("NOT startswith(id, 'customer:')"), "shop")
    own = e.select(F.concat(F.lit("shop::"), "source").alias("source"), F.concat(F.lit("shop::"), "target").alias("target"), "relation")
    return I.merge_externals(known, shop, own)[1]


@query("uses_of_imports", """WITH c AS (SELECT 'class:' || doc_id AS id, 'f' || doc_id % 97 || '.py' AS file, 'app.m' || doc_id % 97 AS module, 'C' || doc_id % 300 AS symbol FROM documents),
i AS (SELECT DISTINCT 'f' || doc_id % 89 || '.py' AS file, 'app.m' || doc_id % 83 AS module, 'C' || doc_id % 300 AS symbol FROM documents), s AS (SELECT module, symbol, min(id) AS target FROM c GROUP BY ALL)
SELECT DISTINCT c.id AS source, s.target, 'uses' AS relation, 'INFERRED' AS confidence, 0.8::double AS weight FROM i JOIN s USING (module, symbol) JOIN c ON c.file = i.file""")
def uses_of_imports(spark, d):
    m = lambda k: (F.col("doc_id") % k).cast("string")
    docs = table(spark, d, "documents").select("doc_id")
    symbol = F.concat(F.lit("C"), m(300)).alias("symbol")
    classes = docs.select(F.concat(F.lit("class:"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("f"), m(97), F.lit(".py")).alias("file"), F.concat(F.lit("app.m"), m(97)).alias("module"), symbol)
    # every other import names the module by a path that only its last segment leads to
    above = F.when(F.col("doc_id") % 2 == 0, "app.m").otherwise("lib.m")
    return I.uses_of_imports(docs.select(F.concat(F.lit("f"), m(89), F.lit(".py")).alias("file"), F.concat(above, m(83)).alias("module"), symbol), classes)


@query("unverified_nodes", f"WITH {FILES_SQL} SELECT 'n:' || doc_id AS id FROM files WHERE doc_id % 4 <> 0 AND NOT contains(lower(text), CASE WHEN doc_id % 3 = 0 THEN 'missing_' || doc_id ELSE 'the' END)")
def unverified_nodes(spark, d):
    f, n = files(spark, d), F.col("doc_id").cast("string")
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Missing_"), n, F.lit("()"))).otherwise("The(other)")
    confidence = F.when(F.col("doc_id") % 4 == 0, "INFERRED").when(F.col("doc_id") % 4 == 1, "EXTRACTED")
    coded = f.select(F.concat(F.lit("n:"), n).alias("id"), label.alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), confidence.alias("confidence"))
    return R.unverified(coded, f.select(F.col("path").alias("source_file"), "text"))


@query("still_known", f"WITH {NODES_SQL}, c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'customer:' || user_id WHEN 1 THEN 'Order ' || event_id ELSE 'gone ' || event_id END AS cite FROM events) SELECT * FROM c WHERE cite IN (SELECT id FROM nodes) OR cite IN (SELECT label FROM nodes)")
def still_known(spark, d):
    n, turn = F.col("event_id").cast("string"), F.col("event_id") % 3
    cite = F.when(turn == 0, F.concat(F.lit("customer:"), F.col("user_id").cast("string"))).when(turn == 1, F.concat(F.lit("Order "), n)).otherwise(F.concat(F.lit("gone "), n))
    return M.still_known(table(spark, d, "events").select("event_id", cite.alias("cite")), nodes(spark, d)).select("event_id", "cite")


@query("rekeyed_ids", f"""WITH {FILES_SQL}, n AS (SELECT doc_id, path AS source_file FROM files), s AS (SELECT doc_id, {_norm(_STEM)} AS st, string_split({_STEM}, '/') AS p FROM n),
o AS (SELECT doc_id, st, {_norm("p[-2] || '.' || p[-1]")} AS two, {_norm("p[-1]")} AS one FROM s WHERE doc_id % 7 <> 0)
SELECT CASE doc_id % 4 WHEN 0 THEN two || '_run' WHEN 1 THEN one ELSE one || '_go' END AS old, st || CASE doc_id % 4 WHEN 0 THEN '_run' WHEN 1 THEN '' ELSE '_go' END AS new FROM o
WHERE doc_id % 4 < 3 AND CASE doc_id % 4 WHEN 0 THEN two ELSE one END <> st""")
def rekeyed_ids(spark, d):
    from weft.functions import text as T

    f = files(spark, d)
    parts = F.split(I.without_suffix(F.col("path")), "/")
    one, turn = F.element_at(parts, -1), F.col("doc_id") % 4
    two = F.concat(F.element_at(parts, -2), F.lit("."), one)
    node = F.when(turn == 0, F.concat(T.norm_id(two), F.lit("_run"))).when(turn == 1, T.norm_id(one)).when(turn == 2, F.concat(T.norm_id(one), F.lit("_go"))).otherwise(F.concat(T.norm_id(I.without_suffix(F.col("path"))), F.lit("_x")))
    loose = f.select(node.alias("id"), F.col("path").alias("source_file"), F.when(F.col("doc_id") % 7 == 0, "ast").otherwise("llm").alias("origin"))
    return I.rekeyed_ids(materialize(loose, "loose"))  # the made-up paths would be spelled out again in every expression


_COLLIDED = "n AS (SELECT 'p' || p_partkey % 700 AS id, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'a/b_' || p_size || '.py' ELSE 'a_b/' || p_size || '.py' END AS source_file, CASE WHEN p_partkey % 13 = 0 THEN 'module' END AS type FROM part)"


@query("collided_ids", f"""WITH {_COLLIDED}, k AS (SELECT DISTINCT id, source_file FROM n WHERE type IS NULL), m AS (SELECT *, {_norm("source_file || '_' || id")} AS plain FROM k WHERE source_file <> '' AND id IN (SELECT id FROM k GROUP BY 1 HAVING count(*) > 1))
SELECT id, source_file, plain || CASE WHEN count(*) OVER (PARTITION BY id, plain) > 1 THEN '_' || left(sha1(source_file), 6) ELSE '' END AS new FROM m""")
def collided_ids(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.when(k % 10 == 0, "").when(k % 3 == 0, F.concat(F.lit("a/b_"), size, F.lit(".py"))).otherwise(F.concat(F.lit("a_b/"), size, F.lit(".py")))
    return I.collided_ids(table(spark, d, "part").select(F.concat(F.lit("p"), (k % 700).cast("string")).alias("id"), path.alias("source_file"), F.when(k % 13 == 0, "module").alias("type")))


@query("manifest_merge", f"""WITH {FILES_SQL}, old AS (SELECT doc_id, path, 1.0::double AS mtime, md5(text) AS ast_hash, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE '' END AS semantic_hash FROM files WHERE doc_id % 5 <> 0),
now AS (SELECT f.path, 2.0::double AS mtime, md5(f.text || CASE WHEN f.doc_id % 4 = 0 THEN 'x' ELSE '' END) AS hash, o.ast_hash, o.semantic_hash FROM files f LEFT JOIN old o USING (path) WHERE f.doc_id % 3 = 0)
SELECT path, mtime, hash AS ast_hash, CASE WHEN hash = ast_hash THEN semantic_hash ELSE '' END AS semantic_hash FROM now UNION ALL
SELECT path, mtime, ast_hash, CASE WHEN doc_id % 17 = 0 THEN '' ELSE semantic_hash END FROM old WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0""")
def manifest_merge(spark, d):
    from weft.sources.files import merge_manifest

    f = files(spark, d)
    h = lambda c: F.md5(c.cast("binary"))
    old = f.where("doc_id % 5 <> 0").select("path", F.lit(1.0).alias("mtime"), h(F.col("text")).alias("ast_hash"), F.when(F.col("doc_id") % 2 == 0, h(F.col("text"))).otherwise("").alias("semantic_hash"))
    now = f.where("doc_id % 3 = 0").select("path", F.lit(2.0).alias("mtime"), h(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "x").otherwise(""))).alias("hash"))
    return merge_manifest(old, now, f.where("doc_id % 11 <> 0"), "ast", f.where("doc_id % 13 <> 0"), f.where("doc_id % 17 = 0"))
