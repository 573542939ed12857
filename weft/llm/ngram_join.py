"""Near-duplicate documents: a self-join on the Jaccard similarity of 5-word shingle sets.

Prefix filtering with token combinations. A token is a shingle's 64-bit hash. Tokens in more than
FREQUENT documents are the frequent class, all others the rare class; the order of all tokens is rare
before frequent, the frequent ones by the logarithm of their frequency, then by hash. A set of n tokens that links to another shares all but n // 5 of its
tokens with it. So its prefix grows until, whichever n // 5 tokens are taken away, a rare token or two
frequent tokens of one group are left: a rare token covers one loss, k frequent tokens of a group cover
k - 1. What is indexed are the prefix's rare tokens and the pairs of its frequent tokens of one group.
Two linked sets thus share a signature, and no other pairs are looked at. Groups are hash classes; their
number grows with the set's size in bands, and a set near the next band is indexed in both.

The rare tokens that two prefixes have in common bound the intersection, which excludes most candidates
whose sets only share a passage. The others are verified with the whole sets. Documents with equal sets are one from the start.

Where many sets share a pair of frequent tokens, each is compared first with the one that has the fewest rare
tokens, which is the likeliest to be what the others are copies of, and the links found make components. Then
only sets of different components that share such a pair need to be compared. Those that share a rare token as
well are candidates by that token already; so what is left has nothing in common but frequent tokens, and
must agree in nearly all of these: two sets link only if their frequent parts differ in at most
n_a / 9 - r_a + n_b / 9 - r_b tokens (r: rare ones). The difference is bounded from below by the sizes of
the parts and by the bits in which two parity bitmaps of them differ. Long lists are split: members of the
largest component are dealt out, and meet copies of the others. So a large group of near copies costs its
size and not its square, and no link between components is missed.

Tokens and signatures travel as sorted blocks of 32-bit numbers, by the range of their hash; the number
of blocks grows with the bytes of text, so a block's size is bounded. The frequent class is broadcast;
its table is bounded by raising the frequency that counts as frequent (any threshold gives the same
links).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import OWN, releasing, table, text_or_empty, without
from weft.operators.components import connected_components
from weft.runtime import bound_batches, materialize, power_of_two, sized_broadcast

#: Words in a shingle; two sets link if PERCENT * |union| <= 100 * |intersection|, so a set may lose n // LOSS tokens.
WORDS, PERCENT, LOSS = 5, 80, 5
#: Documents from which a token is frequent, tokens of the frequent table, sets that the verification picks by a broadcast table.
FREQUENT, MOST_FREQUENT, MOST_PICKED = 16, 2_000_000, 2_000_000
#: Bytes of text for one block, tokens held before blocks are written, sets in a list that are all compared at once.
BLOCK_BYTES, FLUSH, SMALL_LIST = 16 << 20, 1_000_000, 3
#: Rounds at most, while they find links, in which lists of several components are compared with one member, pairs across components for each
#: member up to which all are compared at once, members of a list's largest component in one part of it.
STAR_ROUNDS, FEW_ACROSS, PART = 6, 64, 2048
#: 64-bit words of the parity bitmap of a set's frequent tokens.
PRINT_WORDS = 8
_C = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Numbers of words; `hashes` has the hash of each number."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        self.hashes[n] = xxhash.xxh3_64_intdigest(word)
        self[word] = n
        return n


#: Words that a worker remembers, until its task ends.
MOST_WORDS = 200_000
_words = _Words()


def _forget() -> None:
    global _words
    _words = _Words()


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct tokens of each whole text."""
    out = []
    for text in texts:
        if len(_words) > MOST_WORDS:
            _forget()
        known = _words
        ws = text.encode("utf-8", "surrogatepass").lower().split()
        if len(ws) >= WORDS:
            ns = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
            h = known.hashes[ns]
            n = len(h) - WORDS + 1
            s = h[:n] * _C[0]
            for k in range(1, WORDS):
                s += h[k : k + n] * _C[k]
            s = np.sort(_mix(s))
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if n > 1 else s)
        elif ws:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _grades(tokens: np.ndarray, bits: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each token 0 if it is rare, else the logarithm of its frequency."""
    table, grades = frequent
    key = tokens >> np.uint64(32 - bits)
    at = np.searchsorted(table, key)
    inside = at < len(table)
    inside[inside] = table[at[inside]] == key[inside]
    out = np.zeros(len(tokens), np.uint8)
    out[inside] = grades[at[inside]]
    return out


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit number of a set, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def signatures(tokens: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, int]:
    """What a set is indexed by, 64-bit numbers, and how many of them, the first ones, are rare tokens.

    grade: 0 for rare tokens, else how frequent a token is; the prefix takes less frequent ones first.
    """
    n = len(tokens)
    need = n // LOSS + 1
    rare = tokens[grade == 0][:need]
    out = [_mix(rare ^ np.uint64(0x5851F42D4C957F2D))]
    need -= len(rare)
    if need > 0:
        rest = tokens[grade > 0]
        rest = rest[np.argsort(grade[grade > 0], kind="stable")]
        for band in _bands(n):
            groups = 8 * 8**band if band >= 0 else 1
            group = (rest % np.uint64(groups)).astype(np.int64)
            first = np.zeros(len(rest), bool)
            first[np.unique(group, return_index=True)[1]] = True
            length = int(np.searchsorted(np.cumsum(~first), need)) + 1
            kept, group = rest[:length], group[:length]
            order = np.argsort(group, kind="stable")
            kept, group = kept[order], group[order]
            for d in range(1, len(kept)):
                same = group[d:] == group[:-d]
                if not same.any():
                    break
                out.append(_mix(kept[:-d][same] * _C[0] + kept[d:][same] * _C[1] + np.full(1, band + 2, np.uint64) * _C[2]))
    return np.concatenate(out), len(rare)


def _bands(n: int) -> list[int]:
    """The bands of set sizes, 16 * 8**band and up, in which a set of n tokens is indexed."""
    band = -1
    while n >= 16 * 8 ** (band + 1):
        band += 1
    # a linked set has up to 5 / 4 as many tokens
    return [band, band + 1] if 5 * n >= 4 * 16 * 8 ** (band + 1) else [band]


# --- blocks of numbers on their way -------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    return struct.pack(f"<{len(arrays)}I", *(len(a) for a in arrays)) + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(types)}I", data)
    out, at = [], 4 * len(types)
    for n, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _cuts(blocks: np.ndarray) -> list[tuple[int, slice]]:
    """(block, its stretch) of sorted block numbers."""
    if not len(blocks):
        return []
    at = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
    ends = np.append(at[1:], len(blocks))
    return [(int(blocks[a]), slice(a, b)) for a, b in zip(at, ends, strict=True)]


def _block(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def _within(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _token_pieces(bits: int):
    """Blocks of sorted tokens with counts, each set of a partition once."""

    def pieces(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        low, cuts, packed = _within(tokens, bits), _cuts(_block(tokens, bits)), []
        for _, own in cuts:
            more = np.flatnonzero(counts[own] > 1).astype(np.uint32)
            packed.append(_pack(low[own], more, counts[own][more].astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in cuts], pa.int32()), pa.array(packed, pa.binary())], ["block", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()
        for batch in batches:
            for s in shingle_sets(batch.column("text").to_pylist()):
                sid = set_id(s)
                if len(s) and sid not in seen:
                    seen.add(sid)
                    held.append(s)
                    size += len(s)
            if size >= FLUSH:
                yield pieces(held)
                held, size = [], 0
        if held:
            yield pieces(held)

    return run


def _frequent_tokens(least: int):
    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        values, counts = [], []
        for piece in group.column("piece"):
            low, more, many = _unpack(piece.as_py(), "<u4", "<u4", "<u4")
            n = np.ones(len(low), np.int64)
            n[more] = many
            values.append(low)
            counts.append(n)
        low, n = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        total = np.add.reduceat(n, first)
        many = total > least
        return pa.table({"token": pa.array((block << 32) + low[first][many].astype(np.int64)), "n": pa.array(total[many])})

    return run


PIECES = "doc_id long, n long, sid long, block int, piece binary"


def _signature_pieces(bits: int, frequent):
    """Rows of two kinds: doc_id, n and sid of each document; blocks of signatures with the sets that have them.

    A signature's lowest bit tells rare tokens (0) from pairs of frequent ones (1).
    """
    names = ["doc_id", "n", "sid", "block", "piece"]

    def pieces(sids: list[int], sizes: list[tuple[int, int]], held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        owner = np.repeat(np.arange(len(held)), [len(s) for s in held])
        is_pair = np.concatenate([np.arange(len(s)) >= rare for s, (_, rare) in zip(held, sizes, strict=True)])
        blocks = _block(every, bits)
        order = np.lexsort((owner, blocks))
        owner, blocks = owner[order], blocks[order]
        low = (_within(every, bits) & np.uint32(0xFFFFFFFE) | is_pair.astype(np.uint32))[order]
        ids, n = np.array(sids, np.int64), np.array(sizes, np.uint32)
        cuts, packed = _cuts(blocks), []
        for _, own in cuts:
            who, how_many = np.unique(owner[own], return_counts=True)
            packed.append(_pack(ids[who], n[who, 0], n[who, 1], how_many.astype(np.uint32), low[own]))
        none = pa.nulls(len(cuts), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array([b for b, _ in cuts], pa.int32()), pa.array(packed, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, sizes, held, size, seen = [], [], [], 0, set()
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist())
            every = [set_id(s) for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(every, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
            for tokens, sid in zip(sets, every, strict=True):
                if len(tokens) < 2 or sid in seen:  # one token: equal sets only
                    continue
                seen.add(sid)
                own, rare = signatures(tokens, _grades(tokens, bits, frequent.value))
                sids.append(sid)
                sizes.append((len(tokens), rare))
                held.append(own)
                size += len(own)
            if size >= FLUSH:
                yield pieces(sids, sizes, held)
                sids, sizes, held, size = [], [], [], 0
        if held:
            yield pieces(sids, sizes, held)

    return run


def _fits(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can link at all."""
    return 100 * np.minimum(na, nb).astype(np.int64) >= PERCENT * np.maximum(na, nb).astype(np.int64)


CANDIDATES = "a long, b long, na long, ra long, nb long, rb long, common long, name binary, list binary"


def _by_frequent(na: np.ndarray, ra: np.ndarray, nb: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Whether sets whose prefixes hold all their rare tokens can link without a rare token in common."""
    return (100 + PERCENT) * np.minimum(na.astype(np.int64) - ra, nb.astype(np.int64) - rb) >= PERCENT * (na.astype(np.int64) + nb)


def _pairs_and_lists(group: pa.Table) -> pa.Table:
    """Of a block: pairs of sets (a < b) with their sizes, rare tokens in their prefixes, and how many of those they have in
    common here; and the lists of sets that share a pair of frequent tokens, where they are too long for all pairs.

    All pairs of sets with a rare token are looked at, as it is in few. Signatures are known here by block and 31 bits.
    Where several of one set fall together each of them counts, so `common` may be too large but never too small.
    """
    parts = [_unpack(piece.as_py(), "<i8", "<u4", "<u4", "<u4", "<u4") for piece in group.column("piece")]
    who, n, r, how_many, sig = (np.concatenate([p[k] for p in parts]) for k in range(5))
    once = np.zeros(len(who), bool)  # a set comes once from each partition, each time with all its signatures of the block
    once[np.unique(who, return_index=True)[1]] = True
    sig = sig[np.repeat(once, how_many)]
    sid, size, rare = (np.repeat(v[once], how_many[once]) for v in (who, n, r))
    order = np.lexsort((sid, sig))
    sig, sid, size, rare = sig[order], sid[order], size[order], rare[order]
    same = np.concatenate(([False], (sig[1:] == sig[:-1]) & (sid[1:] == sid[:-1]) & (sig[1:] & 1).astype(bool)))
    sig, sid, size, rare = sig[~same], sid[~same], size[~same], rare[~same]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    length = np.diff(np.append(first, len(sig)))
    is_pair = (sig[first] & 1).astype(bool)
    a, b, common = [], [], []
    for k in np.unique(length[length > 1]):
        for of_pairs in (False, True):
            at = first[(length == k) & (is_pair == of_pairs)]
            if not len(at) or of_pairs and k > SMALL_LIST:
                continue
            for i in range(k - 1):
                x = np.repeat(at + i, k - 1 - i)
                y = (at[:, None] + np.arange(i + 1, k)[None, :]).ravel()
                fit = _by_frequent(size[x], rare[x], size[y], rare[y]) if of_pairs else _fits(size[x], size[y]) & (sid[x] != sid[y])
                a.append(x[fit])
                b.append(y[fit])
                common.append(np.full(int(fit.sum()), 0 if of_pairs else 1))
    lists: dict[bytes, bytes] = {}
    long = is_pair & (length > SMALL_LIST)
    for at, n in zip(first[long], length[long], strict=True):
        own = slice(at, at + n)
        key = xxhash.xxh3_128_digest(sid[own].tobytes())
        if key not in lists:
            lists[key] = _pack(sid[own], size[own], rare[own])
            center = at + int(rare[own].argmin())
            others = np.delete(np.arange(at, at + n), center - at)
            others = others[_by_frequent(size[others], rare[others], np.full(n - 1, size[center]), np.full(n - 1, rare[center]))]
            a.append(np.minimum(others, center))
            b.append(np.maximum(others, center))
            common.append(np.zeros(len(others), np.int64))
    x, y, c = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (a, b, common))
    order = np.lexsort((sid[y], sid[x]))
    x, y, c = x[order], y[order], c[order]
    start = np.flatnonzero(np.concatenate(([True], (sid[x][1:] != sid[x][:-1]) | (sid[y][1:] != sid[y][:-1])))) if len(x) else x
    c = np.add.reduceat(c, start) if len(x) else c
    x, y = x[start], y[start]
    n, m = len(x), len(lists)
    numbers = {"a": sid[x], "b": sid[y], "na": size[x], "ra": rare[x], "nb": size[y], "rb": rare[y], "common": c}
    columns = {k: pa.concat_arrays([pa.array(v.astype(np.int64)), pa.nulls(m, pa.int64())]) for k, v in numbers.items()}
    columns["name"] = pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(list(lists), pa.binary())])
    columns["list"] = pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(list(lists.values()), pa.binary())])
    return pa.table(columns)


def _possible() -> Column:
    """Whether a pair can link, by the rare tokens that its prefixes have in common.

    A set whose prefix is all rare (`full`) has its common tokens among those, as far as they are below the other's last, and
    beyond its prefix; one whose prefix isn't has all its rare tokens there. So the intersection is at most `common` and what
    lies beyond the rare part: of the larger rest if both are full, of the full one if one is, of the smaller rest if none is.
    """
    full = [F.col(r) > F.floor(F.col(n) / LOSS) for n, r in (("na", "ra"), ("nb", "rb"))]
    rest = [F.col(n) - F.col(r) for n, r in (("na", "ra"), ("nb", "rb"))]
    beyond = F.when(full[0] & full[1], F.greatest(*rest)).when(full[0], rest[0]).when(full[1], rest[1]).otherwise(F.least(*rest))
    return (100 + PERCENT) * (F.col("common") + beyond) >= PERCENT * (F.col("na") + F.col("nb"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists, one row a member."""
    for batch in batches:
        for name, data in zip(batch.column("name"), batch.column("list"), strict=True):
            sids, sizes, rares = _unpack(data.as_py(), "<i8", "<u4", "<u4")
            for at in range(0, len(sids), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(sids[part]), pa.binary()), pa.array(sids[part]), pa.array(sizes[part].astype(np.int64)), pa.array(rares[part].astype(np.int64))], ["name", "sid", "n", "r"])


def _prints(bits: int, frequent):
    """sid and the parity bitmap of the frequent tokens of each set (sid, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("tokens"):
                tokens = np.frombuffer(data.as_buffer(), np.uint64)
                place = tokens[_grades(tokens, bits, frequent.value) > 0] % np.uint64(64 * PRINT_WORDS)
                odd = np.bincount(place.astype(np.int64), minlength=64 * PRINT_WORDS) & 1
                rows.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(rows, pa.binary())], ["sid", "print"])

    return run


def _across(group: pa.Table) -> pa.Table:
    """Of a part of a list: the pairs (a, b) of members of different components that can link by their frequent tokens alone.

    A part has some members of the list's largest component, and all other members. Pairs of the others are
    taken in the part that is the home of the one with the smaller sid.
    """
    part = group.column("part")[0].as_py()
    sid, comp, n, rare, main, home = (group.column(c).to_numpy() for c in ("sid", "component", "n", "r", "main", "home"))
    bitmaps = np.frombuffer(b"".join(group.column("print").to_pylist()), np.uint64).reshape(len(sid), PRINT_WORDS)
    order = np.lexsort((sid, main))
    sid, comp, n, rare, main, home, bitmaps = (v[order] for v in (sid, comp, n, rare, main, home, bitmaps))
    apart = int(np.searchsorted(main, True))  # the others come first
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(apart):
        others = np.arange(i + 1 if home[i] == part else apart, len(sid))
        others = others[(comp[others] != comp[i]) & _by_frequent(n[others], rare[others], n[i], rare[i])]
        differ = np.bitwise_count(bitmaps[others] ^ bitmaps[i]).sum(axis=1, dtype=np.int64)
        # 2 * |frequent in common| <= what both have less what differs
        others = others[(100 + PERCENT) * (n[others] - rare[others] + n[i] - rare[i] - differ) >= 2 * PERCENT * (n[others] + n[i])]
        x.append(np.full(len(others), i))
        y.append(others)
    x, y = sid[np.concatenate(x)], sid[np.concatenate(y)]
    return pa.table({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})


def _picked_sets(picked):
    """sid and tokens of the sets in picked (a broadcast sorted array; None: of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for tokens in shingle_sets(batch.column("text").to_pylist()):
                sid = set_id(tokens)
                if sid in seen:
                    continue
                if picked is not None:
                    at = np.searchsorted(picked.value, sid)
                    if at == len(picked.value) or picked.value[at] != sid:
                        continue
                seen.add(sid)
                rows.append((sid, tokens.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["sid", "tokens"])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([s, t]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= PERCENT * (len(both) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """sid and tokens of the sets that needed (sid) names, each once."""
    spark = texts.sparkSession
    few = needed.limit(MOST_PICKED + 1).count() <= MOST_PICKED  # then a table of at most 16 MB
    picked = spark.sparkContext.broadcast(np.sort(needed.toArrow().column("sid").to_numpy())) if few else None
    return materialize(texts.mapInArrow(releasing(_picked_sets(picked), _forget), "sid long, tokens binary").dropDuplicates(["sid"]), "sets")


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Only the sets that pairs names are moved, by one exchange that both joins use."""
    needed = materialize(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "needed")
    sets = sets.join(sized_broadcast(needed), "sid", "left_semi")
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(releasing(_linked), "a long, b long")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. A null text, or one
    without words, has no shingles and is linked with nothing: its component_id is its doc_id. Fewer words
    than WORDS make one shingle of all. Rows with equal sets, repeated rows among them, are linked. A null
    doc_id is passed over where a component has others. An empty table gives an empty result; columns
    other than doc_id and text are dropped.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = power_of_two(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size / BLOCK_BYTES))
    bits = min(30, blocks.bit_length() - 1)
    tokens = texts.mapInArrow(releasing(_token_pieces(bits), _forget), "block int, piece binary").groupBy("block")
    tokens = materialize(tokens.applyInArrow(_frequent_tokens(FREQUENT), "token long, n long"), "tokens")
    by_size = tokens.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()  # at most 64 rows
    least, total = None, 0
    for row in by_size:
        total += row["count"]
        if total > MOST_FREQUENT:
            break
        least = row["size"]
    kept = tokens.where(F.floor(F.log2("n")) >= least) if least is not None else tokens.limit(0)
    kept = kept.select("token", "n").toArrow().sort_by("token")
    grades = np.floor(np.log2(kept.column("n").to_numpy())).astype(np.uint8)
    frequent = spark.sparkContext.broadcast((kept.column("token").to_numpy().astype(np.uint64), grades))
    pieces = materialize(texts.mapInArrow(releasing(_signature_pieces(bits, frequent), _forget), PIECES), "signatures")
    names = pieces.where("sid IS NOT NULL").select("doc_id", "n", "sid")
    found = pieces.where("block IS NOT NULL").select("block", "piece").groupBy("block").applyInArrow(_pairs_and_lists, CANDIDATES)
    found = materialize(found, "candidates")
    common = found.where("a IS NOT NULL").groupBy("a", "b", "na", "ra", "nb", "rb").agg(F.sum("common").alias("common"))
    pairs = materialize(common.where(_possible()).select("a", "b"), "pairs")
    lists = found.where("name IS NOT NULL").select("name", "list").dropDuplicates(["name"])
    members = materialize(lists.mapInArrow(_members, "name binary, sid long, n long, r long"), "members")
    needed = materialize(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(members.select("sid")).distinct(), "needed")
    sets = _sets(texts, needed)
    links = materialize(_verified(sets, pairs), "links")
    component = materialize(connected_components(links, "a", "b"), "components")
    turn, changed, star = 0, True, True
    while True:
        if changed:
            named = members.join(component, members["sid"] == component["node"], "left").select("name", "sid", "n", "r", F.coalesce("component", "sid").alias("component"))
            parted, lists = _of_several(materialize(named, "named"))
            members = parted.drop("component")
            if lists.isEmpty():
                break
        star = star and turn < STAR_ROUNDS and _many_across(lists)
        if star:
            across = _with_center(parted, turn)
        else:
            own = sets.join(sized_broadcast(parted.select("sid").distinct()), "sid", "left_semi")
            across = _in_parts(parted, lists, materialize(own.mapInArrow(_prints(bits, frequent), "sid long, print binary"), "prints"))
        more = materialize(_verified(sets, materialize(across, "across")), "links")
        changed = not more.isEmpty()
        if changed:
            component = materialize(_joined(component, more), "components")
        if not star:
            break
        turn, star = turn + 1, changed  # centers that find nothing are no way to fewer components
    frequent.unpersist()
    return _named(names, component)


def _of_several(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (name, sid, n, r, component) of lists of several components, and these lists: name, rows, main (the
    component with the most members) and across (pairs of members of different components)."""
    sizes = members.groupBy("name", "component").agg(F.count(F.lit(1)).alias("rows"))
    across = (F.sum("rows") * F.sum("rows") - F.sum(F.col("rows") * F.col("rows"))) / 2
    lists = sizes.groupBy("name").agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"), across.alias("across"))
    lists = materialize(lists.where("parts > 1").drop("parts"), "lists")
    return materialize(members.join(sized_broadcast(lists.select("name")), "name", "left_semi"), "members"), lists


def _many_across(lists: DataFrame) -> bool:
    """Whether all pairs across components would be many times the members."""
    row = lists.agg(F.sum("across").alias("across"), F.sum("rows").alias("rows")).first()
    return row["across"] > FEW_ACROSS * row["rows"]


def _can_link(n: str, r: str, cn: str, cr: str) -> Column:
    """_by_frequent() of columns."""
    return (100 + PERCENT) * F.least(F.col(n) - F.col(r), F.col(cn) - F.col(cr)) >= PERCENT * (F.col(n) + F.col(cn))


def _with_center(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each list's members with one of another component: the one with the fewest rare tokens of a component that
    changes with turn."""
    order = F.struct(F.xxhash64("component", F.lit(turn)), "r", "sid")
    centers = members.groupBy("name").agg(F.min_by(F.struct(F.col("sid").alias("c"), F.col("component").alias("cc"), F.col("n").alias("cn"), F.col("r").alias("cr")), order).alias("center"))
    both = members.join(sized_broadcast(materialize(centers.select("name", "center.*"), "centers")), "name").where(F.col("component") != F.col("cc"))
    return both.where(_can_link("n", "r", "cn", "cr")).select(F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b")).distinct()


def _in_parts(members: DataFrame, lists: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) that _across() finds in all lists. A part holds up to about PART members of the main component."""
    parts = F.ceil(F.col("rows") / PART).cast("int")
    rows = members.join(sized_broadcast(lists), "name").join(sized_broadcast(prints), "sid")
    own = F.pmod(F.xxhash64("sid"), parts).cast("int")
    rows = rows.select("name", "sid", "component", "n", "r", "print", (F.col("component") == F.col("main")).alias("main"), own.alias("home"), parts.alias("parts"))
    at = F.when(F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return rows.withColumn("part", F.explode(at)).drop("parts").groupBy("name", "part").applyInArrow(_across, "a long, b long").distinct()


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (node, component) after further links (a, b): only the graph of the components that they tie is solved."""
    known = component.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    ties = links
    for end in ("a", "b"):
        ties = ties.join(known, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_component", end)).drop("_node", "_component")
    merged = materialize(connected_components(ties.where("a <> b").distinct(), "a", "b").select(F.col("node").alias("_old"), F.col("component").alias("_new")), "merged")
    small = sized_broadcast(merged)
    rows = component.join(small, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("_new", "component").alias("component"))
    fresh = merged.join(component.select(F.col("node").alias("_old")), "_old", "left_anti")
    return rows.union(fresh.select("_old", "_new"))


def _named(names: DataFrame, component: DataFrame) -> DataFrame:
    """Components of sets as components of documents."""
    component = component.select(F.col("node").alias("sid"), "component")
    rows = names.join(sized_broadcast(component), "sid", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "sid")))
    rows = materialize(rows.select("doc_id", "n", "component"), "named")
    groups = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    groups = materialize(groups.where("rows > 1").drop("rows"), "groups")
    rows = rows.join(sized_broadcast(groups), "component", "left")
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.coalesce("first", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id. Columns as in docs.

    Rows without shingles stay. Of rows with the doc_id that stays, one stays if they are equal in text,
    source and language; rows with a null doc_id stay.
    """
    found = components(docs)
    losers = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(f"{OWN}loser")).distinct(), "losers")
    rows = docs.join(sized_broadcast(losers, 1_000_000), F.col("doc_id") == F.col(f"{OWN}loser"), "left_anti")
    repeated = materialize(found.where("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(f"{OWN}again")), "again")
    if repeated.isEmpty():
        return rows
    again = sized_broadcast(repeated)
    once = rows.join(again, F.col("doc_id") == F.col(f"{OWN}again"), "left_semi").dropDuplicates([c for c in ("doc_id", "text", "source", "lang") if c in docs.columns])
    return rows.join(again, F.col("doc_id") == F.col(f"{OWN}again"), "left_anti").unionByName(once)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(without(table(spark, sf_dir, "documents"), ["n_chars"]).select("doc_id", "text"))
