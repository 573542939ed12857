"""Entity resolution: equal labels, then similar ones by MinHash blocking, string similarity and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.similarity import jaro_column, jaro_winkler_column
from weft.operators.components import connected_components
from weft.runtime import materialize

#: The entropy from which labels are compared, the score from which they merge, permutations, bands and rows.
ENTROPY, MERGE, BANDS, ROWS = 2.5, 92.0, 14, 9
#: Labels shorter than this merge only if they are of one length and one edit apart, from this score.
SHORT, SHORT_MERGE, BOOST = 12, 97.0, 5.0
#: Labels of a band value in one block; those of a longer bucket are compared block by block, so that no task holds them all.
BLOCK = 50


def minhash(label: Column, permutations: int = BANDS * ROWS) -> Column:
    """The least hash of the label's 3-character pieces under each of so many hash functions."""
    pieces = T.shingles(label)
    return F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda i: F.array_min(F.transform(pieces, lambda s: F.xxhash64(s, i))))


def lsh_pairs(labels: DataFrame, split: Column | None = None) -> DataFrame:
    """a < b of all labels (id, norm) that agree in all rows of a band, and in split if there is one.

    Every pair of a bucket is listed, so the rows grow with the square of the largest bucket (of one split).
    """
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.array_join(F.transform(F.slice(F.col("_sig"), b * ROWS + 1, ROWS), lambda h: h.cast("string")), ",")).alias("value")))
    bucket = ["band", "value", "split"]
    rows = labels.withColumn("_sig", minhash(F.col("norm"))).withColumn("split", F.lit("") if split is None else split).select("id", "split", F.inline(bands))
    sizes = rows.groupBy(*bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = materialize(rows.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), "bands")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = rows.withColumn("other", other).select(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
    x, y = cells.withColumnsRenamed({"id": "a", "block": "p"}), cells.withColumnsRenamed({"id": "b", "block": "q"})
    return x.join(y, [*bucket, "i", "j"]).where("a < b AND (i = j OR p <> q)").select("a", "b").distinct()


def _one_edit(a: Column, b: Column) -> Column:
    """Whether b is a, but for one character or two neighbours swapped; for values of one length."""
    swaps = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.length(a) == F.length(b)) & ((F.levenshtein(a, b) <= 1) | swaps)


def digits(value: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))), ",")


def may_merge(a: Column, b: Column) -> Column:
    """False only for labels that can't merge: other digits, or lengths too far apart for the score.

    A score of 92 needs a Jaro similarity of 13/15 even with four equal first letters, and that lengths in proportion 3:5.
    """
    return (digits(a) == digits(b)) & (F.least(F.length(a), F.length(b)) >= F.greatest(F.length(a), F.length(b)) * 0.59)


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (na, nb: normalised labels; fa, fb: files) with score and merges.

    The score is Jaro in percent across files for labels that aren't short, else Jaro-Winkler. Labels with other
    numbers, one that begins with the other, and variants of one stem (a letter or number more) don't merge; short
    ones only with one edit.
    """
    a, b = F.col("na"), F.col("nb")
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    across = ~F.col("fa").eqNullSafe(F.col("fb"))
    rows = pairs.withColumn("jaro", jaro_column(a, b)).withColumn("jw", jaro_winkler_column(a, b))
    score = F.when(across & (longest >= SHORT), F.col("jaro")).otherwise(F.col("jw")) * 100
    variant = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
    same_stem = (longest < SHORT) & a.rlike(variant) & b.rlike(variant) & (F.regexp_extract(a, r"^(.*?)[0-9]+[a-z]*$", 1) == F.regexp_extract(b, r"^(.*?)[0-9]+[a-z]*$", 1)) & a.rlike("[0-9]") & (a != b)
    short_ok = (longest >= SHORT) | ((F.col("score") >= SHORT_MERGE) & _one_edit(a, b))
    prefix = (shortest < longest) & (a.startswith(b) | b.startswith(a))
    return rows.withColumn("score", score).withColumn("merges", (F.col("score") >= MERGE) & short_ok & ~prefix & (digits(a) == digits(b)) & ~same_stem).drop("jaro", "jw")


def exact_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes that merge by equal normalised labels, each with the least of its group.

    Code doesn't merge. Within a file all others do; across files only concepts whose label isn't too plain.
    """
    named = nodes.where("file_type <> 'code'").withColumn("norm", T.norm_label(F.col("label"))).where("norm <> ''")
    inside = named.groupBy("source_file", "norm").agg(F.min("id").alias("a"))
    first = named.join(inside, ["source_file", "norm"]).where("id <> a").select("a", F.col("id").alias("b"))
    concepts = named.where("file_type = 'concept'").withColumn("bits", T.entropy_bits(F.col("norm"))).where(F.col("bits") >= ENTROPY)
    across = concepts.groupBy("norm").agg(F.min("id").alias("a"))
    second = concepts.join(across, "norm").where("id <> a").select("a", F.col("id").alias("b"))
    return first.union(second).distinct()


def fuzzy_pairs(nodes: DataFrame) -> DataFrame:
    """a, b, score of similar labels that merge: one node a label, blocked by MinHash, scored and guarded."""
    named = nodes.where("file_type <> 'code'").withColumn("norm", T.norm_label(F.col("label"))).where("norm <> ''")
    labels = named.groupBy("norm").agg(F.min_by(F.struct("id", "source_file"), "id").alias("n")).where(T.entropy_bits(F.col("norm")) >= ENTROPY)
    labels = materialize(labels.select("n.id", "norm", F.col("n.source_file").alias("file")), "labels")
    pairs = lsh_pairs(labels, digits(F.col("norm")))
    left = labels.select(F.col("id").alias("a"), F.col("norm").alias("na"), F.col("file").alias("fa"))
    right = labels.select(F.col("id").alias("b"), F.col("norm").alias("nb"), F.col("file").alias("fb"))
    return scored(pairs.join(left, "a").join(right, "b")).where("merges").select("a", "b", "score")


def entity_dedup(nodes: DataFrame) -> DataFrame:
    """old, new: which node each merged node becomes. The winner has no chunk suffix, then the shortest id, then the least."""
    links = exact_pairs(nodes).union(fuzzy_pairs(nodes).select("a", "b"))
    groups = materialize(connected_components(links, "a", "b"), "entities")
    rank = F.struct(F.col("node").rlike(r"_c[0-9]+$").alias("chunk"), F.length("node").alias("n"), F.col("node"))
    winner = groups.groupBy("component").agg(F.min(rank).alias("w")).select("component", F.col("w.node").alias("new"))
    return groups.join(winner, "component").where("node <> new").select(F.col("node").alias("old"), "new")
