"""Change streams: quiet-gap sessions, rebuilds by micro-batch, and an append-only log."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.build import incremental_merge
from weft.runtime import shared_path

#: Fixed value: seconds without a change after which a batch of changes is complete.
QUIET = 3
#: How late a change may come in a stream; Spark needs a bound to close sessions.
LATE = "1 minute"


def quiet_sessions(changes: DataFrame, key: str, ts: str = "ts", gap: str = f"{QUIET} seconds") -> DataFrame:
    """key, first, last, changes of each run of changes with no gap of `gap` or more between them.

    Works for tables and for streams; a stream gets a watermark, so that sessions close.
    """
    rows = changes.withWatermark(ts, LATE) if changes.isStreaming else changes
    sessions = rows.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("changes"))
    return sessions.select(key, "first", "last", "changes")


def read_changes(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that a path, a folder or a glob, names. A single file is named by a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run work on every micro-batch of what is there now, then stop. A batch that fails is run again from the checkpoint."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, base: str) -> list[int]:
    """The batch numbers of the whole versions below base, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    whole = [n for n in names if re.fullmatch("v[0-9]+", n) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in whole)


def rebuild(spark: SparkSession, stream: DataFrame, key: str, schema, base: str | None = None) -> DataFrame:
    """The table that a stream of replacements makes: each batch replaces the rows of its keys.

    Each version is a table of its own below base, written by batch number: a batch that runs again writes the same version
    again. The newest version that is whole is what the next batch, and the next run with the same base, goes on from. The
    one before it stays for its readers; older ones are dropped. Without base the table begins empty, in the shared folder.
    """
    base = base or shared_path(spark, "graph")

    def at(number: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base}/v{number}")

    def merge(batch: DataFrame, number: int) -> None:
        earlier = [v for v in _versions(spark, base) if v < number]
        old = at(earlier[-1]) if earlier else spark.createDataFrame([], schema)
        new = batch.dropDuplicates()
        none = spark.createDataFrame([], f"{key} {dict(new.dtypes)[key]}")
        incremental_merge(old, new, none, key).write.mode("overwrite").parquet(f"{base}/v{number}")
        for v in earlier[:-1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/v{v}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    each_batch(stream, merge, f"{base}/checkpoint").awaitTermination()
    versions = _versions(spark, base)
    return at(versions[-1]) if versions else spark.createDataFrame([], schema)


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a log of JSON lines, exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
