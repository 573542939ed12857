"""A hidden Markov language model, and the add-one unigram model that it is measured against.

Words are counted over all training documents (each partition sums its own first). The commonest OWN_CLASS
words are symbols of their own; every other word belongs to one of TAIL classes, by its last bytes, and
is drawn within its class in proportion to its count plus one, with one share left for unseen words. A
document is its words' symbols and the end. Latent states move by a transition matrix and emit symbols.

Baum-Welch: a bounded sample of training documents gives a start; then up to ROUNDS rounds take expected counts
over all training documents, summed within partitions and then across them, and re-estimates. Forward
and backward recursions are scaled, so that a text of any length has an exact likelihood, and run over
many documents at a time, sorted by length. Symbols are written down once and read by every round.

Counts of the commonest words are broadcast, in a table of bounded size. The others meet their words by a
join, which only sums log(count + 1): the states don't see them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import releasing, table
from weft.runtime import bound_batches, materialize

STATES, OWN_CLASS, TAIL = 8, 8192, 2048
#: Words whose counts are broadcast at most, words that a partition counts before it emits them.
HEAD, FLUSH = 1_000_000, 600_000
#: Documents of the start, their tokens at most, and its rounds. It only breaks the symmetry between states.
START_DOCS, START_TOKENS, START_ROUNDS = 256, 20_000, 12
#: Rounds over all training documents at most, and the gain in log likelihood, relative to it, from which there is another.
ROUNDS, GAIN = 3, 1e-3
#: Tokens of one pass of the recursions, and tokens that are sorted by length together.
GROUP, SORTED = 400_000, 6_000_000
#: Added to expected counts: emissions (spread as the symbols are), transitions and starts.
EMIT_PRIOR, MOVE_PRIOR = 40.0, 1.0
END = OWN_CLASS + TAIL
SYMBOLS = END + 1


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _tail(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % TAIL


# --- counts --------------------------------------------------------------------------------------


@dataclass
class Counts:
    """What is known of the training words: the broadcast part, and totals."""

    hashes: np.ndarray
    n: np.ndarray
    own: np.ndarray
    class_words: np.ndarray
    class_types: np.ndarray
    documents: int
    tokens: int
    types: int


def count(train: DataFrame) -> tuple[Counts, DataFrame]:
    """Counts of the training documents (text), and the words that aren't in their broadcast part: hash, n."""
    bound_batches(train.sparkSession)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        docs = 0

        def flush() -> pa.RecordBatch:
            rows = list(held.items())
            return pa.RecordBatch.from_arrays([pa.array([_hash(w) for w, _ in rows], pa.int64()), pa.array([_tail(w) for w, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["hash", "tail", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
                docs += 1
            if len(held) >= FLUSH:
                yield flush()
                held = Counter()
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([-1], pa.int32()), pa.array([docs], pa.int64())], ["hash", "tail", "n"])

    found = train.select("text").mapInArrow(releasing(words), "hash long, tail int, n long").groupBy("hash", "tail").agg(F.sum("n").alias("n"))
    found = materialize(found, "counts")
    documents = found.where("tail = -1").agg(F.sum("n")).first()[0] or 0
    found = found.where("tail >= 0")
    classes = found.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toArrow()  # at most TAIL rows
    scale = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.lit(1000) * F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / 1000)))))
    at_least = found.groupBy(scale.cast("long").alias("n")).count().orderBy(F.desc("n")).collect()  # about 1,000 rows at most
    least, total = None, 0
    for row in at_least:
        total += row["count"]
        if total > HEAD:
            break
        least = row["n"]
    head = found.where(F.col("n") >= least) if least is not None else found.limit(0)
    rows = head.toArrow()
    hashes, n, tail = (rows.column(c).to_numpy() for c in ("hash", "n", "tail"))
    order = np.lexsort((hashes, -n))
    own = np.full(len(n), -1, np.int32)
    own[order[:OWN_CLASS]] = np.arange(min(OWN_CLASS, len(n)))
    class_words, class_types = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    class_words[classes.column("tail").to_numpy()] = classes.column("n").to_numpy()
    class_types[classes.column("tail").to_numpy()] = classes.column("types").to_numpy()
    tokens, types = int(class_words.sum()) + documents, int(class_types.sum()) + (documents > 0)
    np.subtract.at(class_words, tail[own >= 0], n[own >= 0])
    np.subtract.at(class_types, tail[own >= 0], 1)
    by_hash = np.argsort(hashes)
    counts = Counts(hashes[by_hash], n[by_hash], own[by_hash], class_words, class_types, documents, tokens, types)
    rest = found.where(F.col("n") < least) if least is not None else found
    return counts, rest.select("hash", "n")


ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, tail_logs double, symbols binary, unseen array<long>"


def encode(docs: DataFrame, counts: Counts) -> DataFrame:
    """Symbols of each row of docs (doc_id, held_out, text), what the broadcast counts tell, and the hashes of the other words.

    logs is the sum of log10(count + 1) over the known words and the end; tail_logs is, over the words of tail
    classes, log10(count + 1) less log10 of the class's total.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        uid = TaskContext.get().partitionId() << 33
        room = np.log10(known.class_words + known.class_types + 1)
        logs = np.log10(known.n + 1)
        numbers: dict[bytes, int] = {}
        names: list[bytes] = []
        symbol = np.zeros(0, np.uint16)
        place = np.zeros(0, np.int64)
        hashes = np.zeros(0, np.int64)
        for batch in batches:
            if len(numbers) > FLUSH:
                numbers, names, symbol, place, hashes = {}, [], symbol[:0], place[:0], hashes[:0]
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            first = len(names)
            encoded = []
            for ws in texts:
                own = []
                for w in ws:
                    i = numbers.get(w)
                    if i is None:
                        i = numbers[w] = len(names)
                        names.append(w)
                    own.append(i)
                encoded.append(np.array(own, np.int64))
            if len(names) > first:
                new = np.array([_hash(w) for w in names[first:]], np.int64)
                at = np.searchsorted(known.hashes, new)
                hit = at < len(known.hashes)
                hit[hit] = known.hashes[at[hit]] == new[hit]
                at = np.where(hit, at, -1)
                tails = np.array([_tail(w) for w in names[first:]], np.int64) + OWN_CLASS
                own_class = np.where(hit, known.own[np.maximum(at, 0)], -1) if len(known.own) else np.full(len(new), -1)
                symbol = np.concatenate([symbol, np.where(own_class >= 0, own_class, tails).astype(np.uint16)])
                place, hashes = np.concatenate([place, at]), np.concatenate([hashes, new])
            rows = []
            for ids in encoded:
                symbols, at = symbol[ids], place[ids]
                seen = at >= 0
                tail = symbols >= OWN_CLASS
                value = np.zeros(len(ids))
                value[seen] = logs[at[seen]] if len(logs) else 0
                rows.append((uid, len(ids) + 1, int(seen.sum()) + (known.documents > 0), float(value.sum() + np.log10(known.documents + 1)), float(value[tail].sum() - room[symbols[tail] - OWN_CLASS].sum()), np.append(symbols, np.uint16(END)).tobytes(), hashes[ids[~seen]]))
                uid += 1
            c = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c[0], pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.binary()), pa.array(list(c[6]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "tail_logs", "symbols", "unseen"])

    return materialize(docs.select("doc_id", "held_out", "text").mapInArrow(releasing(run), ENCODED), "symbols")


# --- the model -----------------------------------------------------------------------------------


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


class _Ragged:
    """Sequences (sorted by length, the longest first) laid out by time: all first symbols, all second ones, and so on."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences longer than t
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        time = np.concatenate([np.arange(n) for n in lengths])
        self.rank = np.repeat(np.arange(len(lengths)), lengths)
        self.place = self.at[time] + self.rank
        self.before = np.full(len(time), -1)
        self.before[self.place[time > 0]] = (self.at[time - 1] + self.rank)[time > 0]
        self.symbols = np.empty(len(time), np.int64)
        self.symbols[self.place] = np.concatenate(sequences)
        self.n = len(lengths)

    def forward(self, hmm: Hmm, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Log likelihoods; with keep, the scaled forward probabilities; the scales."""
        emit = hmm.emit[self.symbols]
        alphas = np.empty_like(emit) if keep else None
        scales = np.empty(len(emit), emit.dtype)
        a = np.broadcast_to(hmm.start, (self.n, len(hmm.start)))
        for t, n in enumerate(self.active):
            own = slice(self.at[t], self.at[t + 1])
            a = (a[:n] @ hmm.move if t else a) * emit[own]
            s = a.sum(axis=1)
            a = a / s[:, None]
            scales[own] = s
            if keep:
                alphas[own] = a
        logs = np.bincount(self.rank, np.log(scales.astype(float))[self.place], self.n)
        return logs, alphas, scales

    def expected(self, hmm: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions, and the log likelihood."""
        logs, alphas, scales = self.forward(hmm, True)
        weighted = hmm.emit[self.symbols] / scales[:, None]
        betas = np.ones_like(alphas)
        back = hmm.move.T.copy()
        for t in range(len(self.active) - 1, -1, -1):
            own = slice(self.at[t], self.at[t + 1])
            weighted[own] *= betas[own]
            if t:
                n = self.active[t]
                betas[self.at[t - 1] : self.at[t - 1] + n] = weighted[own] @ back
        gamma = alphas * betas
        gamma /= gamma.sum(axis=1, keepdims=True)
        later = np.flatnonzero(self.before >= 0)
        moves = hmm.move * (alphas[self.before[later]].T @ weighted[later]).astype(float)
        emits = np.stack([np.bincount(self.symbols, gamma[:, k], SYMBOLS) for k in range(gamma.shape[1])], axis=1)
        return gamma[: self.n].sum(axis=0).astype(float), moves, emits, float(logs.sum())


def _groups(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, _Ragged]]:
    """Sequences by length, in groups of about GROUP symbols: their numbers, and the laid-out group."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + max(1, int(np.searchsorted(np.cumsum(lengths[order[at:]]), GROUP, side="right")))
        yield order[at:end], _Ragged([sequences[i] for i in order[at:end]])
        at = end


def expected(hmm: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    k = len(hmm.start)
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS, k)), 0.0
    for _, group in _groups(sequences):
        a, b, c, logs = group.expected(hmm)
        start, move, emit, total = start + a, move + b, emit + c, total + logs
    return start, move, emit, total


def log_likelihoods(hmm: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 P of each sequence of symbols."""
    out = np.zeros(len(sequences))
    for numbers, group in _groups(sequences):
        out[numbers] = group.forward(hmm, False)[0]
    return out / np.log(10)


def estimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Hmm:
    k = len(start)
    start = start + MOVE_PRIOR / k
    move = move + MOVE_PRIOR * (0.9 * np.eye(k) + 0.1 / k)
    emit = emit + EMIT_PRIOR * prior[:, None]
    return Hmm(*((x / x.sum(axis=axis, keepdims=True)).astype(np.float32) for x, axis in ((start, 0), (move, 1), (emit, 0))))


def begin(sequences: list[np.ndarray], prior: np.ndarray, states: int = STATES, rounds: int = START_ROUNDS) -> Hmm:
    """A start: states seeded by documents far from each other, then Baum-Welch over these sequences."""
    if not sequences:
        return estimate(np.zeros(states), np.zeros((states, states)), np.zeros((SYMBOLS, states)), prior)
    seen = np.stack([np.bincount(s, minlength=SYMBOLS) / len(s) for s in sequences if len(s) >= 30] or [np.bincount(s, minlength=SYMBOLS) / len(s) for s in sequences])
    unit = np.sqrt(seen)
    picked = [int((unit @ np.sqrt(prior)).argmax())]
    near = unit @ unit[picked[0]]
    while len(picked) < states:
        picked.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[picked[-1]])
    emit = 200.0 * seen[picked].T
    hmm = estimate(np.zeros(states), 20 * np.eye(states), emit, prior)
    for _ in range(rounds):
        hmm = estimate(*expected(hmm, sequences)[:3], prior)
    return hmm


def train(encoded: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over the rows of encoded that aren't held out, until a round gains less than GAIN or after `rounds`.

    Expected counts are summed from 32-bit emissions; scores use 64 bits throughout.
    """
    spark = encoded.sparkSession
    bound_batches(spark)
    symbols = np.ones(SYMBOLS)
    symbols[counts.own[counts.own >= 0]] += counts.n[counts.own >= 0]
    symbols[OWN_CLASS:END] += counts.class_words
    symbols[END] += counts.documents
    prior = symbols / symbols.sum()
    rows = encoded.where("NOT held_out")
    chosen = rows.where(F.col("n_tokens") <= START_TOKENS).select("uid", F.xxhash64("doc_id").alias("h")).orderBy("h", "uid").limit(START_DOCS)
    sample = rows.join(F.broadcast(chosen.select("uid")), "uid", "left_semi").select("uid", "symbols").toArrow().sort_by("uid")
    hmm = begin([np.frombuffer(s.as_py(), np.uint16) for s in sample.column("symbols")], prior, states)
    before = -np.inf
    for _ in range(rounds if counts.documents else 0):
        held = spark.sparkContext.broadcast(hmm)  # SYMBOLS x states numbers

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = None
            for sequences, _ in _sequences(batches):
                own = np.concatenate([np.ravel(x) for x in expected(held.value, sequences)])
                total = own if total is None else total + own
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "x"])

        found = rows.select("symbols").mapInArrow(releasing(sums), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # at most as many rows as parameters
        held.unpersist()
        flat = np.zeros(states + states * states + SYMBOLS * states + 1)  # the last is the log likelihood
        flat[found.column("at").to_numpy()] = found.column("x").to_numpy()
        hmm = estimate(flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 : -1].reshape(SYMBOLS, states), prior)
        if flat[-1] - before <= GAIN * abs(flat[-1]):
            break
        before = flat[-1]
    return hmm


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[pa.RecordBatch]]]:
    """Symbols of about SORTED tokens at a time, with the batches that they come from."""
    held, own, size = [], [], 0
    for batch in batches:
        held += [np.frombuffer(s.as_buffer(), np.uint16) for s in batch.column("symbols")]
        own.append(batch)
        size += sum(len(s) for s in held[-batch.num_rows :]) if batch.num_rows else 0
        if size >= SORTED:
            yield held, own
            held, own, size = [], [], 0
    if held:
        yield held, own


def score(encoded: DataFrame, counts: Counts, rest: DataFrame, hmm: Hmm) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of encoded."""
    spark = encoded.sparkSession
    held = spark.sparkContext.broadcast(Hmm(*(x.astype(np.float64) for x in (hmm.start, hmm.move, hmm.emit))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequences, own in _sequences(batches):
            logs, at = log_likelihoods(held.value, sequences), 0
            for batch in own:
                yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(logs[at : at + batch.num_rows])], ["uid", "states"])
                at += batch.num_rows

    states = encoded.select("uid", "symbols").mapInArrow(releasing(run), "uid long, states double")
    words = encoded.select(F.col("uid").alias("u"), F.explode("unseen").alias("hash"))
    log10 = F.log10(F.col("n") + 1)
    words = words.join(rest, "hash").groupBy("u").agg(F.sum(log10).alias("more"), F.count(F.lit(1)).alias("also"))
    rows = encoded.drop("symbols", "unseen").join(states, "uid").join(words, F.col("uid") == F.col("u"), "left")
    more, room = F.coalesce("more", F.lit(0.0)), float(np.log10(counts.tokens + counts.types + 1))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(room)).alias("base_score"),
        (F.col("states") + F.col("tail_logs") + more).alias("score"),
    )


def held_out(folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on docs (doc_id, text) that aren't held out, and score all.

    A null text counts as empty: its only token is the end. A null doc_id is never held out. Repeated rows
    each count in training, and get equal scores. Without training documents every token is unseen. An empty
    table gives an empty result; other columns of docs are dropped.
    """
    docs = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts, rest = count(docs.where("NOT held_out"))
    encoded = encode(docs, counts)
    return score(encoded, counts, rest, train(encoded, counts))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
