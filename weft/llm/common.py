"""What the text operators share: table access and column naming."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of code points that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Prefix of the columns that operators add for themselves.
OWN = "__weft_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator's outputs of these names replace (case doesn't matter, as in Spark)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def release() -> None:
    """Give a Python worker's free memory back: workers outlive their tasks and stand beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """run, a function of an iterator of batches, with forget() and release() at a task's end, however it ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            release()

    return whole
