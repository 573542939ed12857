"""Exact dedup with counting quotient filters.

1. Each partition puts the 64-bit fingerprints of its texts (hashed in the JVM; no text goes to
   Python) in counting quotient filters, one for each block of the fingerprint range.
2. The filters of a block merge by their sorted remainders; fingerprints counted more than once
   remain. A block holds a bounded number of fingerprints, since blocks grow in number with the rows.
3. Only the texts with such a fingerprint are compared, byte by byte, by grouping on the text itself;
   equal texts collapse before the shuffle, so a hot text is no hot group.
4. Every row finds its group by fingerprint and SHA-256; two different texts with both equal would
   stop the job rather than be merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import OWN, table, text_or_empty, without
from weft.llm.quotient_filter import CountingQuotientFilter, merged
from weft.runtime import materialize, sized_broadcast

FP, SHA, KEY = f"{OWN}fp", f"{OWN}sha", f"{OWN}key"
OUTPUTS = ["keep_id", "group_size", "kept", "text_sha256"]
#: Rows whose fingerprints one block of the merge takes on average.
ROWS_PER_BLOCK = 2_000_000
#: Fingerprints that a partition gathers before it emits filters.
FLUSH = 4_000_000


def repeated_fingerprints(rows: DataFrame, block_bits: int) -> DataFrame:
    """The fingerprints (column FP of rows, long) that occur more than once, each once."""
    bits = 64 - block_bits

    def filters(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        blocks = (prints >> np.uint64(bits)).astype(np.int64) if block_bits else np.zeros(len(prints), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        low = prints & np.uint64((1 << bits) - 1) if block_bits else prints
        made = [CountingQuotientFilter.build(p, c, bits).to_bytes() for p, c in zip(np.split(low, cuts[1:]), np.split(counts, cuts[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(blocks[cuts].astype(np.int32)), pa.array(made, pa.binary())], ["block", "filter"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= FLUSH:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    def merge(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        prints, counts = merged([CountingQuotientFilter.from_bytes(x.as_py()) for x in group.column("filter")]).items()
        high = np.uint64(block << bits) if block_bits else np.uint64(0)
        return pa.table({FP: pa.array((prints[counts > 1] | high).view(np.int64))})

    return rows.select(FP).mapInArrow(build, "block int, filter binary").groupBy("block").applyInArrow(merge, f"{FP} long")


def annotate(docs: DataFrame) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 (columns of these names are replaced).

    A null text counts as empty. Of equal texts the row with the largest doc_id is kept; a null doc_id
    is below all others. Of repeated rows (same doc_id and text) one is kept, the first by a hash of
    all their columns; of rows equal in all columns, any one. An empty table gives an empty result. Columns of any other name pass through.
    """
    spark = docs.sparkSession
    docs = without(docs, OUTPUTS)
    base = docs.withColumn(FP, F.xxhash64(text_or_empty()))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_bits = max(0, math.ceil(math.log2(max(partitions, docs.count() / ROWS_PER_BLOCK, 1))))
    repeated = materialize(repeated_fingerprints(base, block_bits), "repeated")
    held = sized_broadcast(repeated)
    candidates = base.select("doc_id", FP, text_or_empty().alias("text")).join(held, FP, "left_semi")
    texts = candidates.groupBy(FP, "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    digests = texts.select(FP, F.sha2("text", 256).alias(SHA), "keep_id", "group_size").groupBy(FP, SHA)
    one_text = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share a fingerprint and a SHA-256"))).otherwise(F.max("keep_id"))
    groups = materialize(digests.agg(one_text.cast("long").alias("keep_id"), F.sum("group_size").alias("group_size")).where("group_size > 1"), "groups")
    rows = base.withColumn(SHA, F.sha2(text_or_empty(), 256)).join(sized_broadcast(groups), [FP, SHA], "left")
    rows = rows.withColumn("kept", F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    rows = _one_kept(rows, materialize(candidates.groupBy("doc_id", FP).count().where("count > 1").select(F.col("doc_id").alias(f"{OWN}id"), F.col(FP).alias(f"{OWN}print")), "repeated-rows"))
    return (
        rows.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
        .withColumnRenamed(SHA, "text_sha256")
        .drop(FP)
    )


def _one_kept(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with kept true for one only of the rows of each doc_id and fingerprint in repeated.

    Rows that are equal in all columns are counted before they are moved, and spread out again; so the choice depends
    on no order of rows, and a row that is there very often is no hot group. Columns that hold a map are compared by
    their JSON.
    """
    if repeated.isEmpty():
        return rows
    held = sized_broadcast(repeated)
    same = F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (F.col(FP) == F.col(f"{OWN}print")) & F.col("kept")
    again = rows.join(held, same, "left_semi")
    maps = [c for c, t in rows.dtypes if "map<" in t]
    plain = [f"`{c}`" for c in rows.columns if c not in maps]
    as_json = {f"{KEY}{i}": F.to_json(F.struct(f"`{c}`")) for i, c in enumerate(maps)}
    row = F.xxhash64(*plain, *as_json)
    counted = again.withColumns(as_json).groupBy(*plain, *as_json).agg(F.count(F.lit(1)).alias(f"{OWN}rows"), *[F.first(f"`{c}`").alias(c) for c in maps])
    counted = materialize(counted.withColumn(f"{OWN}row", row).drop(*as_json), "repeated-counts")
    first = counted.groupBy(F.col("doc_id").alias(f"{OWN}id"), F.col(FP).alias(f"{OWN}print")).agg(F.min(f"{OWN}row").alias(f"{OWN}first"))
    counted = counted.join(first, F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (F.col(FP) == F.col(f"{OWN}print")))
    most = 1000  # an array is never longer
    counted = counted.withColumn(f"{OWN}thousand", F.explode(F.sequence(F.lit(0), F.floor((F.col(f"{OWN}rows") - 1) / most))))
    left = F.least(F.lit(most), F.col(f"{OWN}rows") - F.col(f"{OWN}thousand") * most)
    counted = counted.withColumn(f"{OWN}n", F.explode(F.sequence(F.lit(1).cast("long"), left.cast("long"))))
    one = (F.col(f"{OWN}row") == F.col(f"{OWN}first")) & (F.col(f"{OWN}thousand") == 0) & (F.col(f"{OWN}n") == 1)
    spread = counted.withColumn("kept", one).select([f"`{c}`" for c in rows.columns])
    return rows.join(held, same, "left_anti").union(spread)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The kept rows of docs, with the columns of docs."""
    return annotate(docs).where("kept").select([f"`{c}`" for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return annotate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
