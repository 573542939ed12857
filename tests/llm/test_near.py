"""The n-gram join against brute force, with its edge cases."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import ngram_join as N

SCHEMA = "doc_id long, text string, source string, n long"


def brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed=5, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    passage = " ".join(r.choices(words, k=60))
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.45:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        elif kind < 0.6:
            text = passage + " " + " ".join(r.choices(words, k=r.randint(0, 15)))
        else:
            text = " ".join(r.choices(words, k=r.randint(1, 90)))
        texts.append(text)
        rows.append((i, text.upper() if r.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("frequent", [1, 4, 16])
def test_components_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(N, "FREQUENT", frequent)
    rows = corpus()
    rows += [(900, None), (901, ""), (902, " \n "), (903, "only four words here"), (904, "ONLY four\twords here"), (905, "one"), (906, "x" * 50_000), (907, "a b " * 20_000), (908, "A b " * 20_000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.components(docs).collect()}
    assert got == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "FREQUENT", 2)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(70):
        w = list(base)
        w[i] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([*base[:40], *(f"z{i}_{k}" for k in range(40))])) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.components(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize(("part", "few"), [(4, 64), (2048, 0), (3, 0)])
def test_lists_of_many_components(spark, monkeypatch, part, few):
    """Near copies at distances about the threshold: lists hold many components, in parts and by centers."""
    monkeypatch.setattr(N, "FREQUENT", 2)
    monkeypatch.setattr(N, "PART", part)
    monkeypatch.setattr(N, "FEW_ACROSS", few)
    r = random.Random(part + few)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(110):
        w = list(base)
        for at in r.sample(range(60), r.choice((0, 1, 1, 2, 3, 4))):
            w[at] = r.choice((f"own{i}", "other", "third"))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.components(docs).collect()}
    assert got == brute(rows)


def test_signatures_that_fall_together():
    """Rare tokens of one set with equal signatures in a block count each, so the bound stays an upper one."""
    low = np.array([2, 2, 8, 4, 4], np.uint32)  # two sets: rare signatures 2 (twice) and 8; a frequent pair is odd
    piece = N._pack(np.array([11, 12], np.int64), np.array([18, 18], np.uint32), np.array([3, 3], np.uint32), np.array([2, 2], np.uint32), np.concatenate([low[:2], low[:2]]))
    again = N._pack(np.array([11], np.int64), np.array([18], np.uint32), np.array([3], np.uint32), np.array([2], np.uint32), low[:2])  # the same set from another partition
    table = pa.table({"block": pa.array([0, 0], pa.int32()), "piece": pa.array([piece, again], pa.binary())})
    got = N._pairs_and_lists(table).to_pylist()
    assert [(g["a"], g["b"]) for g in got] == [(11, 12)]
    assert got[0]["common"] >= 2


def test_long_lists_by_parts():
    """_across() finds every pair of different components whose frequent parts are near enough, in one part each."""
    r = np.random.default_rng(9)
    base = np.unique(r.integers(0, 1 << 63, 90, dtype=np.uint64))
    sets = [np.sort(r.permutation(base)[r.integers(0, 14) :]) for _ in range(40)]
    component = r.integers(0, 4, 40)
    frequent = type("Held", (), {"value": (np.unique(base >> np.uint64(32)), np.ones(len(np.unique(base >> np.uint64(32))), np.uint8))})
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "tokens"])
    prints = next(N._prints(0, frequent)(iter([batch]))).column("print").to_pylist()
    found = []
    for part in range(3):
        own = [i for i in range(40) if component[i] != 0 or i % 3 == part]
        columns = {"sid": own, "component": [int(component[i]) for i in own], "n": [len(sets[i]) for i in own], "r": [0] * len(own), "main": [bool(component[i] == 0) for i in own], "home": [i % 3 for i in own], "print": [prints[i] for i in own], "part": [part] * len(own)}
        found += [(x["a"], x["b"]) for x in N._across(pa.table(columns)).to_pylist()]
    assert len(found) == len(set(found))
    for i, j in combinations(range(40), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if component[i] != component[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            assert (i, j) in found


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.components(empty).count() == 0
    assert N.one_of_each(empty).columns == ["doc_id", "text", "source", "n"]
    rows = [(3, "a b c d e f", "s", 1), (3, "a b c d e f", "s", 1), (1, "a b c d e f", "s", 2), (None, "a b c d e f", "s", 1), (5, None, "s", 1), (5, None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in N.components(docs).collect()) == [(-1, 1), (1, 1), (3, 1), (3, 1), (5, 5), (5, 5)]
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 5, 5]


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(3)
    for n in (2, 3, 5, 12, 15, 16, 20, 100, 127, 130, 700, 1100):
        for _ in range(20):
            x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            lose = n // 5
            y = np.sort(np.concatenate([r.permutation(x)[lose:], np.unique(r.integers(0, 1 << 63, r.integers(0, 2), dtype=np.uint64))]))
            common = len(np.intersect1d(x, y))
            if 100 * common < 80 * (len(x) + len(y) - common) or len(x) < 2 or len(y) < 2:
                continue
            cut = r.integers(0, 11) / 10
            frequent = lambda t, cut=cut: ((t % np.uint64(1000)) < np.uint64(int(1000 * cut))) * (1 + (t % np.uint64(3))).astype(np.uint8)
            a, b = N.signatures(x, frequent(x))[0], N.signatures(y, frequent(y))[0]
            assert len(np.intersect1d(a, b)), (n, cut)
