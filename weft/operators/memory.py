"""Lessons from past questions, and the state of change requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T

#: Half-life in days, useful answers from which a node is preferred, digits of a score, statuses after so many days.
HALF_LIFE, CORROBORATION, DIGITS, STALE_DAYS = 30.0, 2, 9, 14
CI_FAILURES = ("FAILURE", "CANCELLED", "TIMED_OUT", "ACTION_REQUIRED", "STARTUP_FAILURE")


def lesson_scores(memory: DataFrame, now: Column) -> DataFrame:
    """node, score, pos, neg, last of memory (doc_id, date, outcome, source_nodes): decayed sums of useful (+1) and other (-1) outcomes.

    A node counts once a document. Scores are summed as whole billionths, so that the order of rows doesn't matter.
    """
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome").isin("dead_end", "corrected"), -1).otherwise(0)
    age = (F.unix_micros(now) - F.unix_micros("date")) / 86_400_000_000.0
    rows = memory.withColumn("sign", sign).where("sign <> 0").withColumn("w", F.round(T.decay(age, HALF_LIFE), DIGITS))
    rows = rows.select("date", "sign", "w", F.explode(F.array_distinct("source_nodes")).alias("node"))
    units = F.sum((F.col("sign") * F.col("w") * 10**DIGITS).cast("decimal(38,0)"))
    return rows.groupBy("node").agg((units.cast("double") / 10**DIGITS).alias("score"), F.count_if(F.col("sign") > 0).alias("pos"), F.count_if(F.col("sign") < 0).alias("neg"), F.max("date").alias("last"))


def verdicts(scores: DataFrame, least: int = CORROBORATION) -> DataFrame:
    """scores with status: contested (with which way), preferred, tentative or dead_end."""
    contested = F.concat(F.lit("contested "), F.when(F.col("score") > 0, "useful").when(F.col("score") < 0, "dead end").otherwise("even"))
    status = F.when((F.col("pos") > 0) & (F.col("neg") > 0), contested).when(F.col("pos") >= least, "preferred").when(F.col("pos") > 0, "tentative").otherwise("dead_end")
    return scores.withColumn("status", status)


def last_by_question(memory: DataFrame) -> DataFrame:
    """The latest row of each question, by date, then doc_id."""
    rest = [c for c in memory.columns if c != "question"]
    return memory.groupBy("question").agg(F.max_by(F.struct(*rest), F.struct("date", "doc_id")).alias("m")).select("question", "m.*")


def provenance(memory: DataFrame, most: int = 5) -> DataFrame:
    """node, and its latest `most` useful or corrected doc_ids, the newest first.

    Kept in two steps, so that a much-cited node's rows aren't gathered in one: the latest of each of many parts, then of all.
    """
    rows = memory.where(F.col("outcome").isin("useful", "corrected")).select("doc_id", "date", F.explode(F.array_distinct("source_nodes")).alias("node"))
    newest = lambda x: F.slice(F.sort_array(x, asc=False), 1, most)
    parts = rows.groupBy("node", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")).agg(newest(F.collect_list(F.struct("date", "doc_id"))).alias("l"))
    return parts.groupBy("node").agg(F.transform(newest(F.flatten(F.collect_list("l"))), lambda x: x["doc_id"]).alias("docs"))


def community_of(memory: DataFrame, communities: DataFrame) -> DataFrame:
    """doc_id and community of most of its nodes, ties to the lesser."""
    rows = memory.select("doc_id", F.explode(F.array_distinct("source_nodes")).alias("node_id")).join(communities, "node_id").groupBy("doc_id", "community").count()
    return rows.groupBy("doc_id").agg(F.min_by("community", F.struct(-F.col("count"), F.col("community"))).alias("community"))


def ci_state(conclusions: Column, statuses: Column) -> Column:
    """FAILURE, PENDING, SUCCESS or NONE of a request's checks."""
    has = lambda col, values: F.arrays_overlap(col, F.array(*map(F.lit, values)))
    return F.when(F.size(conclusions) + F.size(statuses) == 0, "NONE").when(has(conclusions, CI_FAILURES), "FAILURE").when(has(statuses, ("IN_PROGRESS", "QUEUED")), "PENDING").when(has(conclusions, ("SUCCESS",)), "SUCCESS").otherwise("NONE")


def pr_status(prs: DataFrame, base: str) -> DataFrame:
    """prs (base_branch, ci, review, draft, days_old) with status: the first that applies."""
    status = (
        F.when(F.col("base_branch") != base, "WRONG-BASE")
        .when(F.col("ci") == "FAILURE", "CI-FAIL")
        .when(F.col("review") == "CHANGES_REQUESTED", "CHANGES-REQ")
        .when(F.col("draft"), "DRAFT")
        .when(F.col("days_old") >= STALE_DAYS, "STALE")
        .when(F.col("review") == "APPROVED", "APPROVED")
        .when(F.col("ci") == "PENDING", "PENDING")
        .otherwise("READY")
    )
    return prs.withColumn("status", status)


def pr_impact(pr_files: DataFrame, nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """pr, nodes, communities that the files of a request (pr, path) hold, files matched by whole path segments."""
    from weft.operators.resolve import match_files

    by_file = nodes.where("source_file <> ''").join(communities, F.col("id") == F.col("node_id"), "left")
    by_file = by_file.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.collect_set("community").alias("cs"))
    match = match_files(pr_files.select(F.col("path").alias("l")).distinct(), by_file.select(F.col("source_file").alias("r")))
    rows = pr_files.distinct().join(match, F.col("path") == F.col("l")).select("pr", F.col("r").alias("source_file")).distinct().join(by_file, "source_file")
    return rows.groupBy("pr").agg(F.sum("n").alias("nodes"), F.size(F.array_distinct(F.flatten(F.collect_list("cs")))).cast("long").alias("communities"))


def still_known(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """citations (cite) of nodes that are still there, by id or by label."""
    names = nodes.select(F.explode(F.array("id", "label")).alias("cite")).where("cite IS NOT NULL").distinct()
    return citations.join(names, "cite", "left_semi")
