from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.operators import calendar, diagnostics, splits
from dayloom.operators.reshape import parameter_grid, stack_frames, to_series, to_wide

START = date(2023, 1, 2)


def daily(spark, values, key="a"):
    return spark.createDataFrame([(key, START + timedelta(days=i), float(v)) for i, v in enumerate(values)], "k string, ds date, v double")


def test_partial_correlation_of_an_autoregression(spark):
    rng = np.random.default_rng(2)
    x = np.zeros(3000)
    for i in range(2, 3000):
        x[i] = 0.5 * x[i - 1] + 0.2 * x[i - 2] + rng.normal()
    out = {r.lag: r for r in diagnostics.autocorrelation(daily(spark, x), ["k"], "v", range(0, 6), partial=True).collect()}
    c = x - x.mean()
    rho = np.array([c[k:] @ c[: len(c) - k] / (c @ c) for k in range(6)])
    for k in range(1, 6):
        assert out[k].acf == pytest.approx(rho[k])
        system = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert out[k].pacf == pytest.approx(np.linalg.solve(system, rho[1 : k + 1])[-1])


def test_constant_series_has_no_correlation(spark):
    assert diagnostics.autocorrelation(daily(spark, [1.0] * 20), ["k"], "v", [2, 3]).count() == 0


def test_cross_correlation_finds_the_lead(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = np.concatenate([rng.normal(size=9) * 0.1, x[:-9]])
    df = spark.createDataFrame([("a", START + timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "k string, ds date, y double, x double")
    out = diagnostics.cross_correlation(df, ["k"], "y", "x", range(0, 20))
    assert out.orderBy(F.desc("ccf")).first().lag == 9


def test_decomposition_adds_up_and_finds_the_week(spark):
    n = 400
    week = np.tile([3.0, 0, 0, -1, 0, 0, -2], n // 7 + 1)[:n]
    y = np.linspace(0, 10, n) + week
    out = diagnostics.stl(daily(spark, y), ["k"], "v").orderBy("ds").collect()
    assert all(r.observed == pytest.approx(r.season + r.trend + r.remainder) for r in out)
    inner = out[60:-60]
    assert np.allclose([r.season for r in inner], week[60:-60], atol=0.1)
    assert np.allclose([r.trend for r in inner], np.linspace(0, 10, n)[60:-60], atol=0.2)


def test_rolling_origin(spark):
    df = daily(spark, range(28 * 4))
    out = splits.rolling_origin(df, slices=3).groupBy("slice", "role").agg(F.min("ds").alias("a"), F.max("ds").alias("b"), F.count("*").alias("n")).collect()
    got = {(r.slice, r.role): (r.a, r.b, r.n) for r in out}
    end = START + timedelta(days=28 * 4 - 1)
    for s in (1, 2, 3):
        assert got[(s, "test")] == (end - timedelta(days=28 * s - 1), end - timedelta(days=28 * (s - 1)), 28)
        assert got[(s, "train")] == (START, end - timedelta(days=28 * s), 28 * (4 - s))


def test_time_split(spark):
    train, test = splits.time_split(daily(spark, range(100)), 30)
    assert (train.count(), test.count()) == (70, 30)


def test_spline_is_linear_outside_the_knots(spark):
    knots = [float((START - date(1970, 1, 1)).days + o) for o in (0, 25, 50, 75, 100)]
    cols = calendar.spline_columns("ds", knots)
    rows = daily(spark, range(160)).select("ds", *[c.alias(n) for n, c in cols.items()]).orderBy("ds").collect()
    values = np.array([[r[f"ns_{i}"] for i in range(1, 5)] for r in rows])
    assert np.allclose(np.diff(values[105:], 2, axis=0), 0, atol=1e-9)
    assert np.linalg.matrix_rank(np.column_stack([np.ones(160), values])) == 5


def test_signature_values(spark):
    r = calendar.date_signature(daily(spark, [1.0])).first()
    assert (r.year, r.half, r.quarter, r.month, r.wday, r.qday, r.yday, r.week, r.mday7, r.mweek) == (2023, 1, 1, 1, 2, 2, 2, 1, 1, 1)


def test_reshapes(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "k string, n string, v double")
    wide = {r.k: (r.x, r.y) for r in to_wide(df, ["k"], "n", "v", ["x", "y"]).collect()}
    assert wide == {"a": (1.0, 2.0), "b": (3.0, None)}
    assert to_series(df, ["k"], "n", {"v": "v"}).where("k = 'a'").first().v == [1.0, 2.0]
    assert parameter_grid(df, {"p": range(3), "q": [1, 2]}).count() == 18
    both = stack_frames(df.drop("v"), df.drop("n"))
    assert both.columns == ["k", "n", "v"] and both.where("v IS NULL").count() == 3


def test_outliers_do_not_bend_season_or_trend():
    r = np.random.default_rng(3)
    t = np.arange(210)
    truth = 0.02 * t, np.sin(2 * np.pi * t / 7)
    y = truth[0] + truth[1] + r.normal(0, 0.05, 210)
    spiked = y.copy()
    spiked[[20, 21, 90, 91, 92, 150]] += 40
    season, trend = diagnostics.decompose(spiked, 7, 31)
    plain = diagnostics.decompose(spiked, 7, 31, outer=0)
    clean = diagnostics.decompose(y, 7, 31, outer=0)
    error = lambda a, b: float(np.abs(a - b).mean())
    assert error(season, truth[1]) < 0.1 < error(plain[0], truth[1])
    assert error(trend, truth[0]) < 0.1 < error(plain[1], truth[0])
    assert error(diagnostics.decompose(y, 7, 31)[1], clean[1]) < 0.02


def test_weights_and_short_series(spark):
    w = diagnostics.robust_weights(np.array([0.0, 1.0, -1.0, 3.0, 100.0]))
    assert w[0] == 1 and w[1] == w[2] == pytest.approx((1 - 1 / 36) ** 2) and w[4] == 0 and 0 < w[3] < w[1]
    out = diagnostics.stl(daily(spark, [1.0, 2.0, 3.0, 4.0]), ["k"], "v").orderBy("ds").collect()
    assert all(x.season is None for x in out) and [x.trend + x.remainder for x in out] == pytest.approx([1, 2, 3, 4])


def test_a_series_goes_to_the_workers_as_one_row_of_values(spark, monkeypatch):
    y = [3.0, None, 1.0, float("nan"), 2.0]
    df = spark.createDataFrame([("a" if i < 4 else None, START + timedelta(days=i), v) for i, v in enumerate(y)], "k string, ds date, v double")
    out = diagnostics.stl(df.unionByName(df.where("v = 1").withColumn("ds", F.lit(None).cast("date"))).where("not isnan(v)"), ["k"], "v")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert [(r.k, r.observed, r.ds is None) for r in out.orderBy("k", F.col("ds").asc_nulls_last()).collect()] == [(None, 2.0, False), ("a", 3.0, False), ("a", 1.0, False), ("a", 1.0, True)]
    assert out.schema["ds"].dataType == df.schema["ds"].dataType and all(r.trend is not None and r.season is None for r in out.collect())
    calls, correlate = [], np.correlate
    monkeypatch.setattr(np, "correlate", lambda *a: calls.append(1) or correlate(*a))
    diagnostics.decompose(np.arange(50.0) ** 2, 7, 21, outer=0)
    assert len(calls) == 2 * 3 + 2 * 2 * 2  # moments once for each smoother, two sums for each of two rounds
