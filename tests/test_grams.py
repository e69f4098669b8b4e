"""Fits from sums of products equal fits on the rows themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.operators import grams as G

COLUMNS = ["a", "b", "c", "flat"]
FOLDS = 4


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(1)
    n = 400
    a, b = r.normal(1000, 3, n), r.normal(0, 1e-4, n)
    c = 0.5 * (a - 1000) + r.normal(0, 1, n)
    y = 2e-4 * a + 3 * b - 1e-4 * c + r.normal(0, 1e-4, n)
    rows = [(float(a[i]), float(b[i]), None if i % 7 == 0 else float(c[i]), 5.0, float(y[i]), i % FOLDS) for i in range(n)]
    rows += [(1.0, 1.0, 1.0, 1.0, None, 0)]
    return spark.createDataFrame(rows, "a double, b double, c double, flat double, y double, fold int"), np.array([[np.nan if v is None else v for v in x] for x in rows[:-1]], float)


def design(x: np.ndarray, columns: list[str], train: np.ndarray):
    """Columns with missing values filled and scaled by the training rows."""
    z = x[:, [COLUMNS.index(c) for c in columns]].copy()
    fill = np.nanmean(z[train], axis=0)
    z = np.where(np.isnan(z), fill, z)
    mean, sd = z[train].mean(axis=0), z[train].std(axis=0)
    return (z - mean) / np.where(sd > 1e-9 * np.abs(mean), sd, np.inf)


def plain(z: np.ndarray, y: np.ndarray, l: float, share: float) -> np.ndarray:
    """Coordinate descent on rows; y is centred and scaled."""
    w = np.zeros(z.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            size = (z[:, j] ** 2).mean()
            if size > 0:
                rest = (z[:, j] * (y - z @ w)).mean() + size * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - l * share, 0) / (size + l * (1 - share))
    return w


PENALTIES = [(0.0, 0.0), (0.1, 0.0), (0.05, 0.5), (0.2, 1.0), (5.0, 1.0)]


@pytest.mark.parametrize("columns", [["a", "b", "c"], ["c"], ["a", "flat"], ["flat"], COLUMNS])
def test_errors_equal_refitting(table, columns):
    df, x = table
    got = G.search(G.fold_sums(df, COLUMNS, "y", "fold", FOLDS), columns, PENALTIES)
    y, fold = x[:, 4], x[:, 5]
    for f in range(FOLDS):
        train = fold != f
        z = design(x, columns, train)
        mean, sd = y[train].mean(), y[train].std()
        for i, (l, share) in enumerate(PENALTIES):
            w = plain(z[train], (y[train] - mean) / sd, l, share)
            want = np.sqrt((((y - mean) / sd - z @ w)[~train] ** 2).mean()) * sd
            assert got[f, i] == pytest.approx(want, rel=1e-5), (f, l, share)


def test_model_predicts_as_on_rows(table):
    df, x = table
    sums = G.fold_sums(df, COLUMNS, "y", "fold", FOLDS)
    for penalty in PENALTIES:
        model = G.fit(sums, ["a", "b", "c"], penalty)
        got = np.array([r.yhat for r in model.transform(df.where("y is not null")).collect()])
        every = np.ones(len(x), bool)
        z, y = design(x, ["a", "b", "c"], every), x[:, 4]
        want = z @ plain(z, (y - y.mean()) / y.std(), *penalty) * y.std() + y.mean()
        assert got == pytest.approx(want, abs=1e-7)


def test_folds_without_rows_and_empty_tables(spark, table):
    df, _ = table
    sums = G.fold_sums(df.where("fold < 2"), COLUMNS, "y", "fold", FOLDS)
    errors = G.search(sums, ["a"], PENALTIES)
    assert np.isnan(errors[2:]).all() and not np.isnan(errors[:2]).any()
    none = G.fold_sums(df.limit(0), COLUMNS, "y", "fold", FOLDS)
    assert np.isnan(G.search(none, ["a"], PENALTIES)).all() and G.fit(none, ["a"], (0.0, 0.0)).intercept == 0.0


def test_search_over_recipes(spark):
    from datetime import date, timedelta

    from dayloom.plans import recipes as R

    r = np.random.default_rng(2)
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(120)]
    rows = [(e, d, float(0.3 * np.sin(2 * np.pi * i / 7) + r.normal(0, 0.01) + k), float(i), float(i % 5), 1.0, 0.1 * k) for k, e in enumerate("xyz") for i, d in enumerate(days)]
    frame = spark.createDataFrame(rows, "entity_id string, ds date, ret double, monthly_lag double, daily_1 double, daily_2_lag double, ma7 double")
    found = R.linear_search(R.feature_frame(frame, frame), folds=5)
    assert len(found.models) == 16 and len(found.table) == 16 * len(R.PENALTIES)
    best = {}
    for name, _, _, error in found.table:
        best[name] = min(error, best.get(name, np.inf))
    assert best["recipe_03"] < 0.3 * best["recipe_01"]  # the weekly wave needs calendar columns
    full = R.feature_frame(frame, frame)
    worst = full.withColumn("e", F.abs(F.col("ret") - found.models["recipe_03"].column())).agg(F.avg("e")).first()[0]
    assert worst < 0.05
