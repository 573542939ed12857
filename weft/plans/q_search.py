"""Queries of free-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import search as S
from weft.operators import traverse as W
from weft.plans.q_graph import _DEG
from weft.plans.registry import query
from weft.plans.tables import EDGES_SQL, FILES_SQL, NODES_SQL, edges, files, nodes, table
from weft.runtime import materialize

QUESTION = "how does the blue widget depend on Brand gear?"
TERMS = ["blue", "widget", "depend", "brand", "gear"]
_N = "n AS (SELECT id, label, lower(label) AS norm, array_to_string(regexp_extract_all(lower(label), '[\\p{L}\\p{N}_]+'), ' ') AS toks, lower(source_file) AS src FROM nodes)"
_W = "w AS (SELECT " + ", ".join(f"ln(1 + count(*) / (1 + count_if(contains(norm, '{t}')))) AS w{i}" for i, t in enumerate(TERMS)) + " FROM n)"


def _whole(t: str, w: str) -> str:
    return f"CASE WHEN '{t}' IN (norm, toks, lower(id)) THEN 10000.0 * {w} WHEN starts_with(norm, '{t}') OR starts_with(toks, '{t}') THEN 1000.0 * {w} ELSE 0 END"


def _tier(t: str, i: int) -> str:
    return f"CASE WHEN norm = '{t}' THEN 1000.0 * w{i} WHEN starts_with(norm, '{t}') THEN 100.0 * w{i} ELSE 0 END"


def _flat(t: str, i: int) -> str:
    return f"CASE WHEN NOT starts_with(norm, '{t}') AND contains(norm, '{t}') THEN w{i} ELSE 0 END + CASE WHEN contains(src, '{t}') THEN 0.5 * w{i} ELSE 0 END"


_TOTAL = _whole(" ".join(TERMS), f"greatest({', '.join(f'w{i}' for i in range(len(TERMS)))})") + " + " + " + ".join(_flat(t, i) for i, t in enumerate(TERMS)) + " + (" + " + ".join(_tier(t, i) for i, t in enumerate(TERMS)) + ") * pow((" + " + ".join(f"contains(norm, '{t}')::int" for t in TERMS) + f") / {len(TERMS)}, 2)"
_SCORES = f"{NODES_SQL}, {_N}, {_W}, sc AS (SELECT id, label, norm, toks, {_TOTAL} AS score, " + ", ".join(f"{_whole(t, f'w{i}')} + {_tier(t, i)} + {_flat(t, i)} AS s{i}" for i, t in enumerate(TERMS)) + " FROM n, w)"


@query("idf", f"WITH {NODES_SQL}, {_N}, {_W} SELECT " + ", ".join(f"round(w{i}, 9) AS w{i}" for i in range(len(TERMS))) + " FROM w")
def idf(spark, d):
    return S.idf(nodes(spark, d), S.terms_of(QUESTION)).select(*[F.round(f"w{i}", 9).alias(f"w{i}") for i in range(len(TERMS))])


@query("score_query", f"WITH {_SCORES} SELECT id, label, round(score, 6) AS score FROM sc WHERE score > 0")
def score_query(spark, d):
    return S.score(nodes(spark, d), S.terms_of(QUESTION)).where("score > 0").select("id", "label", F.round("score", 6).alias("score"))


@query("search_top", f"WITH {_SCORES} SELECT id, label, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY sc.score DESC, length(label), id LIMIT 20")
def search_top(spark, d):
    return S.ranked(nodes(spark, d), S.terms_of(QUESTION)).withColumn("score", F.round("score", 6))


_BEST = "b AS (" + " UNION ALL ".join(f"SELECT '{t}' AS term, (SELECT id FROM sc LEFT JOIN deg USING (id) WHERE s{i} > 0 ORDER BY round(s{i}, 9) DESC, coalesce(degree, 0) DESC, length(label), id LIMIT 1) AS id" for i, t in enumerate(TERMS)) + ")"


@query("best_seed_per_term", f"WITH {_SCORES}, {EDGES_SQL}, {_DEG}, {_BEST} SELECT term, id FROM b WHERE id IS NOT NULL")
def best_seed_per_term(spark, d):
    return S.best_per_term(nodes(spark, d), edges(spark, d), S.terms_of(QUESTION))


_SEEDS = f"""{_SCORES}, {EDGES_SQL}, {_DEG}, {_BEST}, u AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, length(label), id) AS k FROM sc WHERE score > 0),
f AS (SELECT id, norm, score, row_number() OVER (ORDER BY score DESC, length(label), id) AS place FROM u WHERE k = 1 ORDER BY place LIMIT 3), g AS (SELECT * FROM f WHERE score >= 0.2 * (SELECT max(score) FROM f)),
e AS (SELECT term, b.id, norm, row_number() OVER (PARTITION BY norm ORDER BY term) AS k FROM b JOIN n USING (id) WHERE norm NOT IN (SELECT norm FROM g)), seeds AS (SELECT id FROM g UNION ALL SELECT id FROM e WHERE k = 1)"""


@query("pick_seeds", f"WITH {_SEEDS} SELECT id FROM seeds")
def pick_seeds(spark, d):
    return spark.createDataFrame([(s,) for s in S.pick_seeds(nodes(spark, d), edges(spark, d), S.terms_of(QUESTION))], "id string")


@query("endpoint_pick", f"WITH {NODES_SQL} SELECT min(id) AS id, 'blue widget' AS label FROM nodes WHERE label = 'blue widget'")
def endpoint_pick(spark, d):
    return S.pick_endpoint(nodes(spark, d), "widget blue")


@query("query_subgraph", f"""WITH {_SEEDS}, near AS (SELECT target AS id FROM edges WHERE source IN (FROM seeds) UNION SELECT source FROM edges WHERE target IN (FROM seeds)), h AS (SELECT id, 0 AS hop FROM seeds UNION ALL SELECT id, 1 FROM near WHERE id NOT IN (FROM seeds))
SELECT id, label, hop FROM h JOIN nodes USING (id)""")
def query_subgraph(spark, d):
    return S.query_subgraph(nodes(spark, d), edges(spark, d), QUESTION, 1)


@query("query_depth_first")
def query_depth_first(spark, d):
    return S.query_subgraph(nodes(spark, d), edges(spark, d), QUESTION, 2, deep=True)


@query("query_answer")
def query_answer(spark, d):
    return S.answer(nodes(spark, d), edges(spark, d), QUESTION, 1)


@query("answer_edges", f"""WITH {NODES_SQL}, {EDGES_SQL}, h AS (SELECT 'region:2' AS id, 0 AS hop UNION SELECT source, 1 FROM edges WHERE target = 'region:2'), n AS (SELECT h.*, label FROM h JOIN nodes USING (id)),
l AS (SELECT DISTINCT 'EDGE ' || s.label || ' --' || relation || ' [' || confidence || ' context=' || context || ']--> ' || t.label AS line FROM edges JOIN n s ON s.id = source JOIN n t ON t.id = target WHERE abs(s.hop - t.hop) = 1)
SELECT line FROM l UNION ALL SELECT 'NODE ' || label || ' [' || id || ']' FROM n""")
def answer_edges(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    near = materialize(W.bfs(n, e, spark.createDataFrame([("region:2",)], "id string"), 1).join(n.select("id", "label"), "id"), "near")
    return S.with_links(n, e, near, S.within_budget(near, e), W.hub_cutoff(n, e)).select("line")


@query("render_budget", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, h AS (SELECT 'nation:5' AS id, 0 AS hop UNION SELECT source, 1 FROM edges WHERE target = 'nation:5' UNION SELECT target, 1 FROM edges WHERE source = 'nation:5'),
l AS (SELECT id, hop, coalesce(degree, 0) AS degree, 'NODE ' || label || ' [' || id || ']' AS line FROM h JOIN nodes USING (id) LEFT JOIN deg USING (id)), r AS (SELECT *, row_number() OVER o AS place, sum(length(line) + 1) OVER o AS upto FROM l WINDOW o AS (ORDER BY hop, degree DESC, id))
SELECT place::int AS place, id, line FROM r WHERE hop = 0 OR upto <= 600""")
def render_budget(spark, d):
    n, e = nodes(spark, d), edges(spark, d)
    near = W.bfs(n, e, spark.createDataFrame([("nation:5",)], "id string"), 1)
    return S.within_budget(near.join(n.select("id", "label"), "id"), e, 200)


@query("explain", f"""WITH {NODES_SQL}, {EDGES_SQL}, {_DEG}, x AS (SELECT DISTINCT 'out' AS direction, relation, target AS id FROM edges WHERE source = 'supplier:3' UNION SELECT 'in', relation, source FROM edges WHERE target = 'supplier:3'),
r AS (SELECT direction, relation, id, label, coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0) DESC, id, direction, relation)::int AS place FROM x JOIN nodes USING (id) LEFT JOIN deg USING (id)) SELECT * FROM r WHERE place <= 20""")
def explain(spark, d):
    return S.explain(nodes(spark, d), edges(spark, d), "supplier:3")


@query("trigram_candidates", f"WITH {NODES_SQL} SELECT id FROM nodes WHERE contains(lower(label), 'wid') AND contains(lower(label), 'idg') AND contains(lower(label), 'dge') AND contains(lower(label), 'get')")
def trigram_candidates(spark, d):
    return S.trigram_candidates(nodes(spark, d), "widget")


@query("context_edges", f"WITH {EDGES_SQL} SELECT source, target, relation, count(*) AS n FROM edges WHERE context IN ('call', 'field') GROUP BY ALL")
def context_edges(spark, d):
    return edges(spark, d).where(F.col("context").isin("call", "field")).groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("token_reduction", "WITH w AS (SELECT sum(len(regexp_extract_all(text, '[^\\s]+')))::bigint AS words FROM documents) SELECT floor(words * 100 / 75)::bigint AS corpus_tokens, 1500::bigint AS answer_tokens, round(floor(words * 100 / 75) / 1500, 1) AS reduction FROM w")
def token_reduction(spark, d):
    return S.token_reduction(table(spark, d, "documents").select(T.word_count(F.col("text")).alias("words")), F.lit(6000))


@query("corpus_totals", f"WITH {FILES_SQL}, w AS (SELECT count(*) AS files, sum(len(regexp_extract_all(text, '[^\\s]+')))::bigint AS words FROM files) SELECT files, words, CASE WHEN words < 50000 THEN 'small' WHEN words >= 500000 OR files >= 500 THEN 'large' END AS warning FROM w")
def corpus_totals(spark, d):
    from weft.sources.files import corpus_totals as totals

    return totals(files(spark, d).withColumn("status", F.lit("ok")).withColumn("words", T.word_count(F.col("text"))))


@query("file_slices")
def file_slices(spark, d):
    return S.slices(table(spark, d, "documents"), 2000)


@query("chunk_pack", f"""WITH RECURSIVE {FILES_SQL}, t AS (SELECT path, greatest(1, length(text) // 4) AS tokens, regexp_replace(path, '/?[^/]*$', '') AS directory FROM files), n AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY path) AS k FROM t),
r AS (SELECT path, tokens, directory, k, tokens AS used, 0::bigint AS chunk FROM n WHERE k = 1 UNION ALL SELECT n.path, n.tokens, n.directory, n.k, CASE WHEN r.used + n.tokens > 20000 THEN n.tokens ELSE r.used + n.tokens END, r.chunk + (r.used + n.tokens > 20000)::bigint FROM r JOIN n ON n.directory = r.directory AND n.k = r.k + 1)
SELECT path, tokens, directory, chunk FROM r""")
def chunk_pack(spark, d):
    return S.pack(files(spark, d).select("path", T.token_estimate(F.col("text")).alias("tokens")), 20_000)
