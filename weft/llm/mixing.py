"""Mixing sources to target weights by Pareto order sampling.

Sources, ordered by code point with null last, weigh 5, 2, 1, repeating. They share `share` times all
words; no source's target exceeds `most` times its words, and the excess goes to the others by weight
until none is above (a water level, found in closed form over the sources' ceilings).

A document of a source with target t and size S words expects r + a * (q - q') copies, where r = t / S,
a = min(r, most - r), q = size / (size + the source's mean size), and q' is the word-weighted mean of
q: longer documents come more often, expected words are t exactly, and none expects more than `most`.
The whole part of that is certain. For the rest, documents are ranked by random odds divided by
inclusion odds (Pareto order sampling) and taken in that order up to the total nearest to the words
that remain, which fixes the sample's size in words.

The cut in that order is found without sorting a source: word totals are summed over 1024 coarse
bins of the rank, then over 1024 fine bins in the coarse bin of the cut, then over the ranks of one
fine bin. What remains is one cut a source, and each row decides for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import OWN, n_words, table, without
from weft.runtime import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SEED = 1.5, 2.0, 20_240_611
BINS = 1024
SIZE, SRC, RANK, WHOLE = f"{OWN}size", f"{OWN}source", f"{OWN}rank", f"{OWN}whole"
OUTPUTS = ["size", "source_size", "target", "taken", "copies"]


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """SRC, source_size, mean_size, target for each source of sizes (SRC, SIZE); one row a source."""
    sources = sizes.groupBy(SRC).agg(F.sum(SIZE).alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col(SRC).asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("w", F.element_at(pattern, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    sources = sources.withColumn("ceiling", F.lit(float(most)) * F.col("source_size"))
    all_rows = Window.partitionBy()
    sources = sources.withColumn("pool", F.lit(float(share)) * F.sum("source_size").over(all_rows))
    # sources reach their ceilings in the order of ceiling / weight; the level stands where the pool is used up
    order = Window.orderBy((F.col("ceiling") / F.col("w")).asc(), F.col(SRC).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.col("pool") - full) / left)
    fits = F.col("level") * F.col("w") <= F.col("ceiling")
    sources = sources.withColumn("level", F.min(F.when(fits, F.struct(F.col("ceiling") / F.col("w"), F.col("level")))).over(all_rows)["level"])
    target = F.least(F.col("ceiling"), F.coalesce(F.col("level") * F.col("w"), F.col("ceiling")))
    return sources.select(SRC, "source_size", (F.col("source_size") / F.col("n")).alias("mean_size"), target.alias("target"))


def _ranked(rows: DataFrame, plan: DataFrame, most: float, seed: int) -> DataFrame:
    """rows with WHOLE copies and the RANK in (0, 1) of those that may get one more (null for the others)."""
    rows = rows.join(plan, F.col(SRC).eqNullSafe(F.col(f"{SRC}_p")), "left").drop(f"{SRC}_p")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") + F.col("slope") * (_length(F.col(SIZE), F.col("mean_size")) - F.col("mean_length"))).otherwise(0.0)
    copies = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.round(copies, 9)))
    part = F.col("expects") - F.floor("expects")
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    odds = u / (1 - u) * (1 - part) / part
    return (
        rows.withColumn("expects", copies)
        .withColumn(WHOLE, F.floor("expects"))
        .withColumn(RANK, F.when(part > 0, odds / (1 + odds)))
        .drop("expects", "slope", "mean_length", "mean_size")
    )


def _length(size: Column, mean: Column) -> Column:
    return F.when(size > 0, size / (size + mean)).otherwise(0.0)


def _cut(groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each of keys, of groups (keys, value, words, room): the value at which the words in its order
    come to room, and the words below it."""
    order = Window.partitionBy(*keys).orderBy(value)
    below = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("below", below).where("below < room").groupBy(*keys).agg(F.max_by(F.struct(value, "below", "words", "room"), value).alias("cut"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target, taken (words, repeats counted) and copies; one row for each row.

    Columns of these names are replaced, all others pass through. A null or blank text has size 0 and
    is never taken. Null is a source of its own, the last. Repeated rows share one random number, and so
    are taken or left together; their words still count each. Ties in rank are taken together too. An
    empty table gives an empty result. The random number depends on doc_id and seed alone, so reruns agree.
    """
    docs = without(docs, OUTPUTS)
    narrow = docs.select("doc_id", F.col("source").alias(SRC), n_words().alias(SIZE))
    sizes = materialize(narrow, "sizes")
    plan = materialize(targets(sizes, weights, share, most).withColumnRenamed(SRC, f"{SRC}_p"), "targets")
    lengths = sizes.join(plan, F.col(SRC).eqNullSafe(F.col(f"{SRC}_p")), "left").select(SRC, SIZE, "mean_size")
    q = _length(F.col(SIZE), F.col("mean_size"))
    means = lengths.groupBy(SRC).agg((F.sum(q * F.col(SIZE)) / F.sum(SIZE)).alias("mean_length"))
    ratio = F.col("target") / F.col("source_size")
    slope = F.when(F.col("source_size") > 0, F.least(ratio, F.lit(float(most)) - ratio)).otherwise(0.0)
    plan = (
        plan.join(means, F.col(SRC).eqNullSafe(F.col(f"{SRC}_p")), "left")
        .drop(SRC)
        .withColumn("slope", slope)
        .withColumn("mean_length", F.coalesce("mean_length", F.lit(0.0)))
    )
    plan = materialize(plan, "sources")
    ranked = materialize(_ranked(sizes, plan, most, seed), "ranked")
    coarse, fine = F.floor(F.col(RANK) * BINS), F.floor(F.col(RANK) * (BINS * BINS))
    rooms = ranked.groupBy(SRC).agg(F.first("target").alias("target"), F.sum(F.col(WHOLE) * F.col(SIZE)).alias("certain"))
    rooms = materialize(rooms.select(F.col(SRC).alias("s"), (F.col("target") - F.col("certain")).alias("room")), "rooms")
    open_rows = ranked.where(F.col(RANK).isNotNull()).select(SRC, RANK, SIZE)
    words = open_rows.groupBy(SRC, coarse.alias("bin")).agg(F.sum(SIZE).alias("words"))
    cut1 = _cut(words.join(rooms, F.col(SRC).eqNullSafe(F.col("s"))).drop("s"), [SRC], "bin")
    cut1 = materialize(cut1.select(F.col(SRC).alias("s"), F.col("cut.bin").alias("bin1"), (F.col("cut.room") - F.col("cut.below")).alias("room")), "cut1")
    words = open_rows.join(cut1, F.col(SRC).eqNullSafe(F.col("s")) & (coarse == F.col("bin1"))).groupBy(SRC, "room", fine.alias("bin")).agg(F.sum(SIZE).alias("words"))
    cut2 = _cut(words, [SRC], "bin")
    cut2 = materialize(cut2.select(F.col(SRC).alias("s"), F.col("cut.bin").alias("bin2"), (F.col("cut.room") - F.col("cut.below")).alias("room")), "cut2")
    words = open_rows.join(cut2, F.col(SRC).eqNullSafe(F.col("s")) & (fine == F.col("bin2"))).groupBy(SRC, "room", RANK).agg(F.sum(SIZE).alias("words"))
    cut3 = _cut(words, [SRC], RANK)
    # the row at the cut comes in if the total is then nearer to the room
    nearer = (F.col("cut.room") - F.col("cut.below")) * 2 >= F.col("cut.words")
    cut3 = materialize(cut3.select(F.col(SRC).alias(f"{SRC}_c"), F.col(f"cut.{RANK}").alias("rank_cut"), nearer.alias("with_cut")), "cut3")
    rows = _ranked(docs.withColumn(SRC, F.col("source")).withColumn(SIZE, n_words()), plan, most, seed)
    rows = rows.join(cut3, F.col(SRC).eqNullSafe(F.col(f"{SRC}_c")), "left")
    extra = (F.col(RANK) < F.col("rank_cut")) | ((F.col(RANK) == F.col("rank_cut")) & F.col("with_cut"))
    copies = F.when(F.col(SIZE) > 0, F.col(WHOLE) + F.coalesce(extra.cast("long"), F.lit(0))).otherwise(0)
    return (
        rows.withColumn("copies", copies.cast("long"))
        .withColumn("taken", (F.col("copies") * F.col(SIZE)).cast("long"))
        .withColumn("size", F.col(SIZE))
        .select([f"`{c}`" for c in docs.columns] + OUTPUTS)
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken, with the columns of docs."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(f"{OWN}copy")
    return mix(docs, **options).where("copies > 0").select([f"`{c}`" for c in docs.columns if c.lower() not in OUTPUTS] + [times]).drop(f"{OWN}copy")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
