"""Queries of lessons and change requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import memory as M
from weft.plans.registry import query
from weft.plans.tables import COMMUNITIES_SQL, NODES_SQL, communities, nodes, table

NOW = "2024-02-15 00:00:00"
_MEM = "mem AS (SELECT event_id AS doc_id, ts AS date, 'q' || (event_id % 700) AS question, CASE WHEN event_type IN ('click', 'purchase') THEN 'useful' WHEN event_type = 'error' THEN 'dead_end' WHEN event_type = 'signup' THEN 'corrected' ELSE 'view' END AS outcome, ['customer:' || user_id, 'nation:' || (user_id % 25), 'customer:' || user_id] AS ns FROM events)"


def _memory(spark, d):
    e = table(spark, d, "events")
    user = F.col("user_id").cast("string")
    outcome = F.when(F.col("event_type").isin("click", "purchase"), "useful").when(F.col("event_type") == "error", "dead_end").when(F.col("event_type") == "signup", "corrected").otherwise("view")
    customer = F.concat(F.lit("customer:"), user)
    cited = F.array(customer, F.concat(F.lit("nation:"), (F.col("user_id") % 25).cast("string")), customer)
    return e.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("date"), F.concat(F.lit("q"), (F.col("event_id") % 700).cast("string")).alias("question"), outcome.alias("outcome"), cited.alias("source_nodes"))


_LESSONS = f"{_MEM}, x AS (SELECT date, CASE outcome WHEN 'useful' THEN 1 ELSE -1 END AS s, round(pow(0.5, greatest(0, epoch(timestamp '{NOW}' - date) / 86400) / 30), 9) AS w, unnest(list_distinct(ns)) AS node FROM mem WHERE outcome <> 'view'), ls AS (SELECT node, round(sum(s * w), 9) AS score, count_if(s > 0) AS pos, count_if(s < 0) AS neg FROM x GROUP BY node)"


@query("lesson_scores", f"WITH {_LESSONS} SELECT * FROM ls")
def lesson_scores(spark, d):
    return M.lesson_scores(_memory(spark, d), F.lit(NOW).cast("timestamp")).drop("last")


@query("lesson_verdicts", f"WITH {_LESSONS} SELECT node, CASE WHEN pos > 0 AND neg > 0 THEN 'contested ' || CASE WHEN score > 0 THEN 'useful' WHEN score < 0 THEN 'dead end' ELSE 'even' END WHEN pos >= 2 THEN 'preferred' WHEN pos > 0 THEN 'tentative' ELSE 'dead_end' END AS status FROM ls")
def lesson_verdicts(spark, d):
    return M.verdicts(M.lesson_scores(_memory(spark, d), F.lit(NOW).cast("timestamp"))).select("node", "status")


@query("last_by_question", f"WITH {_MEM} SELECT question, max_by(doc_id, (date, doc_id)) AS doc_id, max_by(outcome, (date, doc_id)) AS outcome FROM mem GROUP BY question")
def last_by_question(spark, d):
    return M.last_by_question(_memory(spark, d)).select("question", "doc_id", "outcome")


@query("provenance_top5", f"WITH {_MEM}, x AS (SELECT doc_id, date, unnest(list_distinct(ns)) AS node FROM mem WHERE outcome IN ('useful', 'corrected')) SELECT node, string_agg(doc_id::varchar, ',' ORDER BY date DESC, doc_id DESC) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY date DESC, doc_id DESC) AS k FROM x) WHERE k <= 5 GROUP BY node")
def provenance_top5(spark, d):
    return M.provenance(_memory(spark, d)).select("node", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@query("lesson_community", f"WITH {_MEM}, {COMMUNITIES_SQL}, x AS (SELECT DISTINCT doc_id, unnest(ns) AS node_id FROM mem), v AS (SELECT doc_id, community, count(*) AS n FROM x JOIN communities USING (node_id) GROUP BY ALL) SELECT doc_id, community FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, community) = 1")
def lesson_community(spark, d):
    return M.community_of(_memory(spark, d), communities(spark, d))


_PRS = "prs AS (SELECT o_orderkey AS pr, CASE WHEN o_orderkey % 9 = 0 THEN 'dev' ELSE 'main' END AS base, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'FAILURE' END AS ci, CASE o_orderkey % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'CHANGES_REQUESTED' ELSE '' END AS review, o_orderkey % 7 = 0 AS draft, o_orderkey % 30 AS days FROM orders)"


@query("pr_status", f"WITH {_PRS} SELECT pr, CASE WHEN base <> 'main' THEN 'WRONG-BASE' WHEN ci = 'FAILURE' THEN 'CI-FAIL' WHEN review = 'CHANGES_REQUESTED' THEN 'CHANGES-REQ' WHEN draft THEN 'DRAFT' WHEN days >= 14 THEN 'STALE' WHEN review = 'APPROVED' THEN 'APPROVED' WHEN ci = 'IN_PROGRESS' THEN 'PENDING' ELSE 'READY' END AS status FROM prs")
def pr_status(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    conclusions = F.when(s == "F", F.array(F.lit("SUCCESS"))).when(s == "O", F.array().cast("array<string>")).otherwise(F.array(F.lit("FAILURE")))
    statuses = F.when(s == "O", F.array(F.lit("IN_PROGRESS"))).otherwise(F.array(F.lit("COMPLETED")))
    prs = table(spark, d, "orders").select(
        k.alias("pr"), F.when(k % 9 == 0, "dev").otherwise("main").alias("base_branch"), M.ci_state(conclusions, statuses).alias("ci"),
        F.when(k % 5 == 0, "APPROVED").when(k % 5 == 1, "CHANGES_REQUESTED").otherwise("").alias("review"), (k % 7 == 0).alias("draft"), (k % 30).alias("days_old"),
    )
    return M.pr_status(prs, "main").select("pr", "status")


@query("pr_impact", f"""WITH {NODES_SQL}, {COMMUNITIES_SQL}, f AS (SELECT p_partkey % 40 AS pr, CASE WHEN p_partkey % 2 = 0 THEN 'repo/catalog/' || p_brand || '.md' ELSE p_brand || '.md' END AS path FROM part UNION SELECT 7, 'orders.py' UNION SELECT 8, 'x/customer.py'),
b AS (SELECT source_file, id, community FROM nodes LEFT JOIN communities ON id = node_id WHERE source_file <> ''), m AS (SELECT DISTINCT pr, source_file FROM f JOIN (SELECT DISTINCT source_file FROM b) ON path = source_file OR ends_with(path, '/' || source_file) OR ends_with(source_file, '/' || path))
SELECT pr, count(*) AS nodes, count(DISTINCT community) AS communities FROM m JOIN b USING (source_file) GROUP BY pr""")
def pr_impact(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select((k % 40).alias("pr"), F.when(k % 2 == 0, F.concat(F.lit("repo/catalog/"), "p_brand", F.lit(".md"))).otherwise(F.concat("p_brand", F.lit(".md"))).alias("path"))
    more = spark.createDataFrame([(7, "orders.py"), (8, "x/customer.py")], "pr long, path string")
    return M.pr_impact(rows.union(more).distinct(), nodes(spark, d), communities(spark, d))
