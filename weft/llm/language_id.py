"""Language identification of documents in several languages at once.

A document is a mixture: each byte trigram of its lower-cased letters comes from one of its languages.
Expectation-maximisation estimates the languages' proportions from the trigram likelihoods, starting
from all languages; then the set is thinned, the least probable language at a time, as long as the
penalised likelihood (BIC: half the logarithm of the trigrams for each free proportion) gets no worse.

Trigram counts cover all training documents: each partition sums its own in arrays of fixed size, and
these sums are added by language and bucket. The model is one array of languages x BUCKETS, a bounded
size for a bounded number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import OWN, table, without
from weft.runtime import bound_batches

#: Hash buckets of trigrams.
BUCKETS = 1 << 16
#: Added to each count, so that no trigram is impossible.
SMOOTH = 0.1
#: Steps of expectation-maximisation for all languages, and after each one that goes.
STEPS, MORE_STEPS = 12, 6
UNKNOWN = "und"
#: Bytes that are no letters become one: a trigram spans the edge of a word, not what lies between words.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's trigrams, sorted, and how often each occurs."""
    b = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    b = b[(b != 32) | np.concatenate(([True], b[:-1] != 32))]  # runs of non-letters are one
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = np.sort(((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16), kind="stable")
    if not len(code):
        return code, np.zeros(0)
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.diff(np.append(first, len(code))).astype(float)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Trigram probabilities, a column a language."""

    languages: list[str]
    p: np.ndarray

    def mixture(self, text: str) -> dict[str, float]:
        """The languages of a text and their proportions, the largest first; ties by name."""
        buckets, n = trigrams(text)
        p, total = self.p[buckets], n.sum()
        if not self.languages or not total:
            return {}
        live = np.arange(len(self.languages))
        share, fit = _em(p, n, np.full(len(live), 1 / len(live)), STEPS)
        penalty = 0.5 * np.log(max(total, 2))
        while len(live) > 1:
            rest = np.delete(np.arange(len(live)), int(share.argmin()))
            fewer, worse = _em(p[:, rest], n, share[rest] / max(share[rest].sum(), 1e-300), MORE_STEPS)
            if worse + penalty < fit:
                break
            p, live, share, fit = p[:, rest], live[rest], fewer, worse
        found = sorted(zip(share, (self.languages[i] for i in live), strict=True), key=lambda x: (-x[0], x[1]))
        return {language: float(s) for s, language in found}

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """The main language, its proportion, and the mixture; `und` and 0 without a letter or a model."""
        mix = self.mixture(text) if has_letter(text) else {}
        if not mix:
            return UNKNOWN, 0.0, {}
        best = next(iter(mix))
        return best, min(1.0, mix[best]), mix


def _em(p: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions after so many steps, and the log likelihood."""
    total = n.sum()
    if len(share) == 1:
        return np.ones(1), float(n @ np.log(p[:, 0]))
    for _ in range(steps):
        share = share * (p.T @ (n / (p @ share))) / total
    return share, float(n @ np.log(p @ share))


def train(docs: DataFrame, languages: list[str] | None = None) -> Model:
    """A model of docs (text, lang): rows with a null in either are left out. Its languages are sorted by code point."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                buckets, n = trigrams(text)
                held.setdefault(lang, np.zeros(BUCKETS))[buckets] += n
        for lang, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    names = sorted(set(found.column("lang").to_pylist())) if languages is None else languages
    places = {x: i for i, x in enumerate(names)}
    p = np.full((BUCKETS, len(names)), SMOOTH)
    p[found.column("bucket").to_numpy(), [places[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    return Model(names, p / p.sum(axis=0) if names else p)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and mixture (map of language to proportion).

    Columns of these names are replaced, all others pass through. A null text, or one without a letter, is
    `und` with score 0 and no mixture; so is every text where nothing was learnt. Only the text counts, so
    repeated rows get equal results. Ties go to the language whose name is first. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = without(docs, ["lang_pred", "score", "mixture"])
    held = spark.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    @F.arrow_udf("struct<lang_pred: string, score: double, mixture: map<string, double>>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [held.value.predict(t.as_py()) for t in texts]
        names, scores, mixtures = zip(*found, strict=True) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([list(m.items()) for m in mixtures], pa.map_(pa.string(), pa.float64()))],
            ["lang_pred", "score", "mixture"],
        )

    own = f"{OWN}language"
    return docs.withColumn(own, predict(F.col("text"))).select([f"`{c}`" for c in docs.columns] + [f"{own}.*"])


def held_out(folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
