"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.runtime import materialize

#: Rounds after which something must be wrong: each round about squares the distance covered.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of edges; component is the least node of the component.

    Large-star links each node's larger neighbours to its least neighbour, small-star its smaller ones;
    after a number of rounds about logarithmic in the diameter every node is linked to the least of its
    component. The least neighbour is a partial aggregate and comes back by a join, so a node with very
    many neighbours is never gathered in one task. Null endpoints and self-loops are ignored, except that a
    self-loop's node is a component of its own.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    stars = materialize(pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = _mark(stars)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        stars = materialize(small.select(F.col("e")["hi"].alias("hi"), F.col("e")["lo"].alias("lo")).where("hi <> lo").distinct(), "small")
        now = _mark(stars)
        if now == mark:
            break
        mark = now
    found = stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(stars.select("lo", "lo").distinct())
    return found.union(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def _mark(df: DataFrame) -> tuple:
    """What tells two edge sets apart: their number and a sum of hashes."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)
