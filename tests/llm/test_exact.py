"""Exact dedup, quotient filters and source mixing."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import exact_dedup, mixing
from weft.llm.quotient_filter import CountingQuotientFilter, merged

DOCS = "doc_id long, text string, kept string, fp string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 2**20 - 1), st.integers(1, 9), max_size=80), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    made, total = [], defaultdict(int)
    for part in parts:
        keys = sorted(part)
        f = CountingQuotientFilter.build(np.array(keys, np.uint64), np.array([part[k] for k in keys], np.int64), 20)
        back = CountingQuotientFilter.from_bytes(f.to_bytes())
        assert dict(zip(*(x.tolist() for x in back.items()), strict=True)) == part
        for k in keys[:5]:
            assert back.count(k) == part[k]
        assert back.count(next(i for i in range(100) if i not in part)) == 0
        made.append(back)
        for k, n in part.items():
            total[k] += n
    assert dict(zip(*(x.tolist() for x in merged(made).items()), strict=True)) == total


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, "x" * 100_000), (7, "x" * 100_000), (7, "x" * 100_000), (None, "a"), (9, "é"), (10, "é")]
    docs = spark.createDataFrame([(i, t, "k", "f") for i, t in rows], DOCS)
    got = exact_dedup.annotate(docs)
    assert {"doc_id", "text", "fp", "keep_id", "group_size", "kept", "text_sha256"} == set(got.columns)
    out = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = [(i, max((x for x in groups[t or ""] if x is not None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(out, key=key) == sorted(want, key=key)
    kept = sorted(r["doc_id"] for r in got.where("kept").collect())
    assert kept == [2, 3, 5, 7, 10]
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns
    assert exact_dedup.annotate(docs.limit(0)).count() == 0


def test_one_of_repeated_rows_stays(spark):
    """Columns of any type pass through; of rows equal in doc_id and text one stays, whatever the order of rows."""
    rows = [(7, "x", [{"a": i % 2}], (1, {"k": 1})) for i in range(5)] + [(7, "x", None, None)] * 2500 + [(3, "x", [], None), (None, None, None, None), (None, "", None, None), (8, "y", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<map<string,int>>, own struct<n:int,m:map<string,int>>")
    seen = set()
    for parts in (1, 5):
        got = exact_dedup.annotate(docs.repartition(parts)).collect()
        assert len(got) == len(rows)
        kept = [r for r in got if r["kept"]]
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (7, "x"), (8, "y")]
        assert all(r["group_size"] == 2506 and r["keep_id"] == 7 for r in got if r["text"] == "x")
        assert sum(r["tags"] is None and r["text"] == "x" for r in got) == 2500
        seen.add(str(next(r["tags"] for r in kept if r["doc_id"] == 7)))
    assert len(seen) == 1


def test_mixing_meets_targets(spark):
    rows = []
    for s, n in (("a", 400), ("b", 300), ("c", 40), (None, 200), ("z", 3)):
        rows += [(len(rows) + i, " ".join(["w"] * (1 + (i * 7) % 90)), s, "x") for i in range(n)]
    rows += [(5000, None, "a", "x"), (5001, " ", None, "x"), (0, rows[0][1], "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    assert {s: rs[0]["source_size"] for s, rs in by.items()} == sizes
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s, rs in by.items():
        assert rs[0]["target"] <= 2 * sizes[s] + 1e-9
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 90
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in got)
    mixed = mixing.mixed(docs.drop("size"))
    assert mixed.columns == ["doc_id", "text", "source"]
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_by_water_level(spark):
    rows = [("a", 100), ("b", 10), ("c", 1000), ("d", 1)]
    got = {r[mixing.SRC]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, f"{mixing.SRC} string, {mixing.SIZE} long")).collect()}
    pool, weight, ceiling = 1.5 * 1111, dict(zip("abcd", (5, 2, 1, 5), strict=True)), {s: 2.0 * n for s, n in rows}
    want, open_ = {}, set("abcd")
    while open_:
        level = (pool - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > ceiling[s]}
        want |= {s: ceiling[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ = open_ - over if over else set()
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want)
