"""Session helpers shared by every operator: lineage cuts, size-checked joins, session defaults."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side whose rows are a few dozen bytes may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows and bytes in an Arrow batch: bound a Python worker's memory when some texts are very long.
ARROW_ROWS, ARROW_BYTES = 1_000, 16 << 20

_own_dirs: dict[str, str] = {}


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the defaults the operators are written for; an active session is reused."""
    builder = (
        SparkSession.builder.master(master)
        .appName("weft")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset and all
    run in one process. A cluster without that setting is refused, as its executors see no common folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="weft-")
    return _own_dirs[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows; otherwise as it is, and the join shuffles.

    df should be materialized, as its rows are counted first.
    """
    return F.broadcast(df) if df.count() <= limit else df


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batches to rows and ARROW_BYTES, unless they are lower already.

    The settings stay, as plans that are run later need them too.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def power_of_two(n: float) -> int:
    """The least power of two that is n or more, and at least 1."""
    p = 1
    while p < n:
        p *= 2
    return p
