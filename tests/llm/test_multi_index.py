"""Probing finds every code in the radius; recall against brute force; ties, copies and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from dayloom.llm import multi_index as M


def test_every_code_within_the_radius():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24))
    coder = M.Coder(x[:1000], 5)
    block = M.Block(np.arange(3000), x, coder)
    for radius in (0, 3, 11, 18, 23):
        for q in range(0, 3000, 500):
            far = M._POP[block.codes ^ block.codes[q]].sum(axis=1)
            assert (block.within(block.codes[q], radius) == np.flatnonzero(far <= radius)).all()


def brute(ids, x, every, k):
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1) / (norm * norm[i])
        other = np.flatnonzero(ids != ids[i])
        order = other[np.lexsort((ids[other], -s[other]))][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_recall(spark, kind):
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 32))
    if kind == "clusters":
        x = x[r.integers(0, 60, 4000)] + 0.4 * r.normal(size=(4000, 32))
    if kind == "copies":
        x[r.random(4000) < 0.35] = x[7]
    x = x.astype(np.float32).astype(np.float64)
    ids = r.permutation(4000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0.0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score double").repartition(3)
    got: dict = {}
    for row in M.nearest(df, index_rows=1500, query_rows=30).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score, row.rank))
    want = brute(ids, x, 50, 5)
    assert got.keys() == want.keys() and all([g[2] for g in v] == [1, 2, 3, 4, 5] for v in got.values())
    assert np.mean([len({a for a, *_ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want]) >= 0.9
    score = {q: {a: s for a, s, _ in v} for q, v in got.items()}
    assert all(score[q].get(a, s) == pytest.approx(s, abs=1e-12) for q, v in want.items() for a, s in v)
    if kind == "copies":  # the smallest ids among equal vectors
        assert all([a for a, *_ in got[q]] == [a for a, _ in v] for q, v in want.items() if v[4][1] > 0.999999)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (50, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 2.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in M.nearest(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, 0.707107), (0, 3, 2, 0.0), (50, 1, 0, 0.707107), (50, 2, 1, 0.707107), (50, 3, 2, 0.707107)]
    assert M.nearest(df.limit(0)).count() == 0
    assert M.nearest(df.where("vec_id = 1")).count() == 0


def test_very_small_and_very_large_vectors(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [3e200, 3e200]), (2, [1e308, -1e308]), (3, [5e-324, 0.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in M.nearest(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 3, 0.707106781), (0, 4, 2, 0.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 3, 0.707106781), (50, 4, 2, 0.0)]
