"""Quality rules learnt as gradient-boosted trees over statistics of a document.

Statistics are computed for batches of whole texts with numpy: words become numbers, repeated 8-word
windows are found exactly by doubling (equal pairs of equal halves), and no text is looked at in part.
The trees are grown on histograms with Newton steps on the logistic loss; features with a monotonic
constraint admit only splits whose children's values are in order, and the bounds pass down. The trees
are flattened to arrays (feature, threshold, left, right, value), and scoring walks all rows of a batch
down a tree at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import OWN, table, without
from weft.runtime import bound_batches

#: Words in a window of which repeats count.
WINDOW = 8
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: A text needs so many words, and at most so many of each 100 words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Labelled documents that the trees are fitted on at most, chosen by hash of doc_id.
SAMPLE = 20_000
#: Probability of good quality from which a document is kept.
KEEP_FROM = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the trees see, and the direction in which each may move the score (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "distinct_share": 0,
    "mark_share": 0,
    "line_words": 0,
}
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 63]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Code points start at bytes that are no UTF-8 continuation.
_START = np.ones(256, bool)
_START[128:192] = False


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more; words are numbers below 2**31."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # names[k]: windows of 2**k words, equal names for equal windows
    names, have, done = words.astype(np.int64), 1, None
    at, left = 0, window
    while left:
        if left & 1:
            part = names[at : at + n]
            done = part if done is None else np.unique(done * (int(part.max()) + 1) + part, return_inverse=True)[1]
            at += have
        left >>= 1
        if left:
            pair = names[:-have] * (int(names.max()) + 1) + names[have:]
            names, have = np.unique(pair, return_inverse=True)[1], have * 2
    _, inverse, count = np.unique(done, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0, 0, _symbols(data), 0, 0], [0.0] * len(FEATURES)
    numbers: dict[bytes, int] = {}
    named = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(byte[_START].sum()) - int(byte[_SPACE].sum())
    symbols = int(byte[_SYMBOL].sum())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    # a repeated window needs as many words that occur again
    repeat = repeated_words(named) if n - len(numbers) >= WINDOW else 0
    features = [
        float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), repeat / n,
        int(byte[_UPPER].sum()) / chars, int(byte[_DIGIT].sum()) / chars, len(numbers) / n,
        int(byte[_MARK].sum()) / chars, min(n / len(lines), 1e4),
    ]
    return [n, chars, symbols, dup, repeat], features


def _symbols(data: bytes) -> int:
    return int(_SYMBOL[np.frombuffer(data, np.uint8)].sum()) if data else 0


@dataclass
class Trees:
    """Flattened trees: node arrays of all trees, the roots, and the score that they add to. A leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for P(y = 1); monotone has -1, 0 or 1 for each feature. Without rows the score is 0."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    n = len(y)
    share = float(np.clip((y.sum() + 1) / (n + 2), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(len(monotone))]
    binned = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]
    score = np.full(n, base)

    def add(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = float(g[rows].sum()), float(h[rows].sum())
        value = float(np.clip(-gs / (hs + ridge), low, high))
        at = add(value * rate)
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, None)
        for j, sign in enumerate(monotone):
            if not len(cuts[j]):
                continue
            b = binned[j][rows]
            gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2) + (gs * value + 0.5 * (hs + ridge) * value**2)
            gain[(hl < 1e-3) | (hr < 1e-3) | (sign * (vr - vl) < 0)] = -1
            if gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return at
        j, k, vl, vr = best[1]
        goes = binned[j][rows] <= k
        middle = (vl + vr) / 2
        bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[monotone[j]]
        nodes["feature"][at], nodes["threshold"][at] = j, float(cuts[j][k])
        nodes["left"][at] = grow(rows[goes], g, h, level + 1, bounds[0], bounds[1])
        nodes["right"][at] = grow(rows[~goes], g, h, level + 1, bounds[2], bounds[3])
        return at

    everything = np.arange(n)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(everything, p - y, p * (1 - p), 0, -np.inf, np.inf))
        one = Trees(*_arrays(nodes), np.array(roots[-1:]), 0.0, depth)
        score += one.raw(x)
    return Trees(*_arrays(nodes), np.array(roots, np.int64), base, depth)


def _arrays(nodes: dict[str, list]) -> list[np.ndarray]:
    return [np.array(nodes["feature"], np.int64), np.array(nodes["threshold"], float), np.array(nodes["left"], np.int64), np.array(nodes["right"], np.int64), np.array(nodes["value"], float)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most `sample` labelled documents (labels: doc_id, quality), the first by a hash of doc_id.

    Labels with a null doc_id or quality are left out; of several labels of a document, the lowest counts.
    """
    bound_batches(docs.sparkSession)
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py())[1] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64())), batch.column("quality")], ["doc_id", "x", "quality"])

    # at most `sample` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, x array<double>, quality int")
    found = rows.toArrow().sort_by("doc_id")
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = (found.column("quality").to_numpy() > 0).astype(float)
    return fit(x, y, list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good and kept.

    Columns of these names are replaced, all others pass through. A null, empty or blank text has zeros,
    fails the base rules and isn't kept. Every row is judged by itself: repeated rows get equal results. An
    empty table gives an empty result. Without any labelled document only the base rules decide.
    """
    bound_batches(docs.sparkSession)
    docs = without(docs, [*COUNTS, "base_failed", "p_good", "kept"])
    learnt = len(trees.roots) > 0
    found = f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}, base_failed: boolean, p_good: double, kept: boolean>"

    @F.arrow_udf(found)
    def verdicts(texts: pa.Array) -> pa.Array:
        both = [statistics(t.as_py()) for t in texts]
        counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
        failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
        good = trees.probability(np.array([f for _, f in both], float).reshape(-1, len(FEATURES)))
        kept = ~failed & (good >= keep_from) if learnt else ~failed
        return pa.StructArray.from_arrays([*[pa.array(counts[:, j]) for j in range(len(COUNTS))], pa.array(failed), pa.array(good), pa.array(kept)], [*COUNTS, "base_failed", "p_good", "kept"])

    own = f"{OWN}verdict"
    return docs.withColumn(own, verdicts(F.coalesce("text", F.lit("")))).select([f"`{c}`" for c in docs.columns] + [f"{own}.*"])


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules and the trees keep, with the columns of docs."""
    return judge(docs, train(docs, labels)).where("kept").select([f"`{c}`" for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", *COUNTS, "base_failed", "kept", "p_good")
