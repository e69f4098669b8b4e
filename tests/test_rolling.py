from __future__ import annotations

import math
import statistics
from datetime import date, timedelta

import numpy as np
import pytest

from dayloom.operators import rolling as R

KEYS = ["entity_id"]


def frame(spark, values, name="g"):
    start = date(2020, 1, 1)
    return spark.createDataFrame([("a", start + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], f"entity_id string, ds date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("ds").collect()]


def brute(values, period, fn):
    out = []
    for i in range(len(values)):
        part = values[max(0, i - period + 1) : i + 1]
        ok = len(part) == period and all(v is not None and math.isfinite(v) for v in part)
        out.append(fn(part) if ok else None)
    return out


def same(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if x is None or y is None:
            assert x is None and y is None
        else:
            assert x == pytest.approx(y, rel=1e-6, abs=tol)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    v = list(1 + rng.normal(0, 1e-4, 260))
    v[40:80] = [1.0] * 40
    v[100] = 2.5
    v[120] = None
    v[150] = -0.5
    v[180] = 0.0
    v[200] = float("inf")
    return v


def test_compounded_return(spark, values):
    df = R.with_pieces(frame(spark, values), KEYS, "ds", R.compounded_return("g", {"r": (15, 1), "p": (5, 2.0)}))
    same(column(df, "r"), brute(values, 15, lambda p: math.prod(p) - 1))
    same(column(df, "p"), brute(values, 5, lambda p: math.prod(p) ** 2 - 1))


def test_volatility(spark, values):
    df = R.with_pieces(frame(spark, values), KEYS, "ds", R.volatility("g", [15, 30]))
    for p in (15, 30):
        same(column(df, f"vol_{p}"), brute(values, p, lambda x: statistics.stdev([v - 1 for v in x]) * math.sqrt(365)))
    assert column(df, "vol_15")[70] == 0.0


def test_volatility_after_a_jump_keeps_digits(spark):
    rng = np.random.default_rng(3)
    v = list(1 + rng.normal(0, 1e-6, 120))
    v[5] = 101.0
    df = R.with_pieces(frame(spark, v), KEYS, "ds", R.volatility("g", [90]))
    got = column(df, "vol_90")[-1]
    assert got == pytest.approx(statistics.stdev([x - 1 for x in v[-90:]]) * math.sqrt(365), rel=1e-6)


def test_constant_series_and_cover(spark):
    from dayloom.plans.panel import with_cover

    df = R.with_pieces(
        frame(spark, [1.0] * 20), KEYS, "ds", R.compounded_return("g", {"rent_15": (15, 365 / 15)}), R.volatility("g", [15])
    )
    last = with_cover(df, [15]).orderBy("ds").collect()[-1]
    assert (last.rent_15, last.vol_15, last.cover_15) == (0.0, 0.0, None)


def test_short_frame_is_null(spark):
    df = R.with_pieces(frame(spark, [1.0] * 14), KEYS, "ds", R.compounded_return("g", {"r": (15, 1)}))
    assert set(column(df, "r")) == {None}


def ema(values, n):
    out, level = [None] * len(values), None
    first = next(i for i, v in enumerate(values) if v is not None)
    for i in range(first, len(values)):
        if values[i] is None:
            break
        if i == first + n - 1:
            level = sum(values[first : i + 1]) / n
        elif i >= first + n:
            level += 2 / (n + 1) * (values[i] - level)
        out[i] = level if i >= first + n - 1 else None
    return out


@pytest.mark.parametrize("rows", [None, 400])
def test_exponential_average(spark, rows):
    rng = np.random.default_rng(1)
    v = [None, None, *rng.normal(0, 1e-3, 300).tolist()]
    df = R.with_exponential_average(frame(spark, v), KEYS, "ds", "g", [15, 90], series_rows=rows)
    same(column(df, "ema_15"), ema(v, 15), tol=1e-15)
    same(column(df, "ema_90"), ema(v, 90), tol=1e-15)


def test_exponential_average_seed_row(spark):
    v = [float(i) for i in range(15)]
    got = column(R.with_exponential_average(frame(spark, v), KEYS, "ds", "g", [15], series_rows=15), "ema_15")
    assert got[:14] == [None] * 14 and got[14] == pytest.approx(7.0)


def test_closed_form_bound():
    assert R.closed_form_fits(15, 4000) and not R.closed_form_fits(15, 6000) and not R.closed_form_fits(15, None)


def test_exponential_average_null_inside(spark):
    v = [1.0] * 10 + [None] + [1.0] * 10
    got = column(R.with_exponential_average(frame(spark, v), KEYS, "ds", "g", [5], series_rows=30), "ema_5")
    assert got[9] == pytest.approx(1.0) and got[10:] == [None] * 11


def test_flow_ratio(spark):
    start = date(2020, 1, 1)
    rows = [("a", start + timedelta(days=i), float(i), 100.0 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id string, ds date, net_flow double, close_value double")
    got = column(R.with_pieces(df, KEYS, "ds", R.flow_ratio()), "flow_ratio_30")
    assert got[:30] == [None] * 30
    assert got[35] == pytest.approx(sum(range(6, 36)) / 105.0)


def test_lagged_mean(spark):
    got = column(R.with_pieces(frame(spark, [float(i) for i in range(10)]), KEYS, "ds", R.lagged_mean("g", 7)), "ma7")
    assert got[:7] == [None] * 7 and got[7] == pytest.approx(3.0) and got[9] == pytest.approx(5.0)


def test_centred_mean(spark):
    v = [float(i * i) for i in range(30)]
    got = column(R.centred_mean(frame(spark, v), KEYS, "ds", "g", 6), "smooth")
    want = [statistics.mean(v[max(0, i - 3) : i + 4]) for i in range(30)]
    same(got, want)


def test_drop_first_and_tail(spark):
    df = frame(spark, [1.0, 2.0, 3.0])
    assert sorted(column(R.drop_first(df, KEYS), "g")) == [2.0, 3.0]
    assert sorted(column(R.tail_rows(df, KEYS, 2), "g")) == [2.0, 3.0]


def test_volatility_keeps_digits_in_quiet_frames(spark):
    """Quiet days after busy ones and after a jump: equal to the sample deviation of the frame itself."""
    from datetime import date, timedelta

    rng = np.random.default_rng(3)
    moves = np.concatenate([rng.normal(0, 0.003, 800), [4.0], rng.normal(0, 1e-8, 60), rng.normal(0, 1e-9, 60)])
    rows = [("e", date(2000, 1, 1) + timedelta(days=i), float(1 + m)) for i, m in enumerate(moves)]
    df = spark.createDataFrame(rows, "entity_id string, ds date, growth double")
    out = R.with_pieces(df, ["entity_id"], "ds", R.volatility("growth", [15, 30])).orderBy("ds").collect()
    x = np.array([r[2] - 1 for r in rows])
    for p in (15, 30):
        for i in (500, 805, 850, 880, 918):
            want = x[i - p + 1 : i + 1].std(ddof=1) * np.sqrt(365)
            assert out[i][f"vol_{p}"] == pytest.approx(want, rel=1e-5)
