"""State-space candidates equal a plain loop over days and parameters; stacked weights equal an exhaustive search."""

from __future__ import annotations

from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest

from dayloom.operators import smoothing as S
from dayloom.operators import stacking as K

START = date(2024, 1, 1)


def plain(values: list, base: int, cut: int, horizon: int, grid: S.Lattice):
    """Forecasts after day ``cut`` of the calendar; the series begins on day ``base``."""
    best = None
    for c in range(len(grid.alpha)):
        a, b, phi, g = grid.alpha[c], grid.beta[c], grid.phi[c], grid.gamma[c]
        seen, level, trend, season, sse = [], 0.0, 0.0, [0.0] * 7, 0.0
        for day in range(base, cut + 1):
            y = values[day - base]
            if len(seen) < S.WARM:
                if y is not None:
                    seen.append((day % 7, y))
                    if len(seen) == S.WARM:
                        level = sum(v for _, v in seen) / S.WARM
                        if grid.seasonal[c]:
                            for k in range(7):
                                own = [v for d, v in seen if d == k]
                                season[k] = sum(own) / len(own) - level if own else 0.0
                continue
            expected = level + phi * trend
            e = 0.0 if y is None else y - expected - season[day % 7]
            if y is not None:
                seen.append((day % 7, y))
            level, trend = expected + a * e, phi * trend + b * e
            season[day % 7] += g * e
            sse += e * e
        n, k = len(seen) - S.WARM, grid.size[c]
        score = n * np.log(max(sse / n, 1e-300)) + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n - k > 1 else np.inf)
        path = [level + sum(phi**j for j in range(1, h + 1)) * trend + season[(cut + h) % 7] for h in range(1, horizon + 1)]
        if best is None or score < best[0]:
            best = (score, c, path, len(seen))
    return best


@pytest.fixture(scope="module")
def panel():
    r = np.random.default_rng(7)
    out = {}
    for k, (base, n) in enumerate([(0, 120), (5, 115), (40, 80), (0, 100), (100, 20)]):
        t = np.arange(n)
        y = 0.02 * k * t + np.sin(2 * np.pi * t / 7) * (k % 2) + r.normal(0, 0.3, n)
        values = [None if r.random() < 0.05 and i > 2 else float(v) for i, v in enumerate(y)]
        out[f"e{k}"] = (base, values)
    return out


def test_candidates_equal_a_plain_loop(spark, panel):
    rows = [(e, START + timedelta(days=base + i), v, "x") for e, (base, values) in panel.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity_id string, ds date, ret double, model string").repartition(4)
    got = S.candidates(df, [0, 19, 60], 5).collect()
    grid = S.Lattice.of()
    paths, specs = {}, {}
    for r in got:
        paths.setdefault((r.entity_id, (r["cut"] - START).days, r.model), {})[r.h] = r.yhat
        specs[r.entity_id, (r["cut"] - START).days, r.model] = r.spec
        assert r.ds == r["cut"] + timedelta(days=r.h)
    for e, (base, values) in panel.items():
        for cut in (119, 100, 59):
            tail = [*values, *[None] * 200]
            known = sum(v is not None for v in tail[: max(cut - base + 1, 0)])
            if known < S.LEAST:
                assert (e, cut, "ets") not in paths
                continue
            _, c, path, _ = plain(tail, base, cut, 5, grid)
            assert [paths[e, cut, "ets"][h] for h in range(1, 6)] == pytest.approx(path)
            assert specs[e, cut, "ets"] == grid.label(c) and specs[e, cut, "theta"] == ""
    x = np.full((5, 120), np.nan)
    first = np.array([b for b, _ in panel.values()])
    for i, (base, values) in enumerate(panel.values()):
        x[i, base : base + len(values)] = [np.nan if v is None else v for v in values]
    best, ets, theta = S.run(x, first, np.array([59, 100, 119]), 5, grid)
    for i, (base, values) in enumerate(panel.values()):
        tail = [*values, *[None] * 200]
        for at, cut in enumerate((59, 100, 119)):
            if best[i, at] < 0:
                continue
            score, c, path, _ = plain(tail, base, cut, 5, grid)
            assert best[i, at] == c and ets[i, at] == pytest.approx(path)
            name = f"e{i}"
            if base == 0:
                assert [paths[name, cut, "theta"][h] for h in range(1, 6)] == pytest.approx(theta[i, at])


def test_theta_by_its_definition():
    """Simple smoothing plus half the slope of the straight line."""
    r = np.random.default_rng(2)
    y = 0.5 * np.arange(60) + r.normal(0, 1, 60)
    grid = S.Lattice.of((0.3,), ((0.0, 0.0),), (None,))
    _, _, theta = S.run(y[None], np.array([0]), np.array([59]), 3, grid)
    level = y[:7].mean()
    for v in y[7:]:
        level += 0.3 * (v - level)
    slope = np.polyfit(np.arange(60), y, 1)[0]
    want = [level + slope / 2 * (h - 1 + (1 - 0.7**60) / 0.3) for h in (1, 2, 3)]
    assert theta[0, 0] == pytest.approx(want)


def test_empty_and_short(spark):
    df = spark.createDataFrame([("a", START + timedelta(days=i), 1.0) for i in range(10)], "entity_id string, ds date, ret double")
    assert S.candidates(df, [0], 3).count() == 0 and S.candidates(df.limit(0), [0], 3).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_weights_equal_all_subsets(seed):
    r = np.random.default_rng(seed)
    p = r.normal(size=(80, 5)) + r.normal(size=(80, 1))
    y = p @ np.array([0.6, 0, 0.5, -0.4, 0]) + r.normal(0, 0.2, 80)
    gram, with_y = p.T @ p, p.T @ y
    best = (0.0, np.zeros(5))
    for n in range(1, 6):
        for s in combinations(range(5), n):
            w = np.zeros(5)
            w[list(s)] = np.linalg.solve(gram[np.ix_(s, s)], with_y[list(s)])
            if (w >= 0).all():
                best = min(best, (0.5 * w @ gram @ w - with_y @ w, w), key=lambda x: x[0])
    assert K.non_negative(gram, with_y) == pytest.approx(best[1], abs=1e-9)


def test_stacking_is_no_worse_than_its_models(spark):
    r = np.random.default_rng(1)
    y = r.normal(size=50)
    made = {"a": y + r.normal(0, 0.5, 50), "b": y + r.normal(0, 0.5, 50), "c": -y, "d": np.zeros(50)}
    rows = [(i, m, float(y[i]), float(v[i])) for m, v in made.items() for i in range(50)] + [(99, "a", 1.0, 1.0)]
    tested = spark.createDataFrame(rows, "k int, model string, y double, yhat double")
    w = K.weights(tested, ["k"], list(made))
    assert w["c"] == w["d"] == 0 and w["a"] > 0 and w["b"] > 0
    out = {x.k: x.yhat for x in K.stacked(tested, ["k"], w).collect()}
    assert 99 not in out
    error = lambda v: sum((v[i] - y[i]) ** 2 for i in range(50))
    assert error(out) < min(error(v) for v in made.values())
    assert K.weights(tested.limit(0), ["k"], ["a", "b"]) == {"a": 0.0, "b": 0.0}
