"""Queries of change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans.registry import query
from weft.plans.tables import table
from weft.runtime import shared_path
from weft.streaming import watch


@query("debounce_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS changes FROM s GROUP BY user_id, n""")
def debounce_sessions(spark, d):
    return watch.quiet_sessions(table(spark, d, "events"), "user_id", gap="30 minutes")


@query("incremental_rebuild", "SELECT 'user:' || user_id AS source_file, event_id, event_type FROM (SELECT DISTINCT user_id, event_id, event_type FROM events)")
def incremental_rebuild(spark, d):
    path = f"{d}/events.parquet"
    stream = watch.read_changes(spark, f"{d}/[e]vents.parquet", spark.read.parquet(path).schema)
    rows = stream.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source_file"), "event_id", "event_type")
    return watch.rebuild(spark, rows, "source_file", rows.schema)


@query("query_log_sink", "SELECT event_id, event_type AS kind, value FROM events WHERE event_type IN ('view', 'click')")
def query_log_sink(spark, d):
    path = f"{d}/events.parquet"
    stream = watch.read_changes(spark, f"{d}/[e]vents.parquet", spark.read.parquet(path).schema).where("event_type IN ('view', 'click')")
    out = shared_path(spark, "log")
    rows = stream.select("event_id", F.col("event_type").alias("kind"), "value")
    watch.append_log(rows, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).json(f"{out}/log")
