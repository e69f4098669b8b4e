"""Weights of stacked models: non-negative least squares on the normal equations of held-out predictions.

Held-out predictions are rows (keys, model, y, yhat). Their sums of products are one aggregate; the
driver solves a system of as many unknowns as there are models.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def products(tested: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """(a, b, s): sums of products of every two models' predictions, and of each with ``y`` (named "y"), over rows that all models predict."""
    wide = tested.where(F.col("model").isin(list(models))).groupBy(*keys).agg(
        F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(f"m{i}") for i, m in enumerate(models)]
    ).na.drop()
    cols = {**{m: f"m{i}" for i, m in enumerate(models)}, "y": "y"}
    names = list(cols)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = wide.agg(*[F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"s{k}") for k, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{k}").alias("s")) for k, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def non_negative(gram: np.ndarray, with_y: np.ndarray) -> np.ndarray:
    """The w >= 0 that minimises w'Gw/2 - r'w, by active sets: models enter by steepest gain and leave when they reach 0."""
    n = len(with_y)
    w, active = np.zeros(n), np.zeros(n, bool)
    scale = np.abs(with_y).max(initial=0.0) or 1.0
    for _ in range(10 * n + 10):
        slope = np.where(active, -np.inf, with_y - gram @ w)
        if active.all() or slope.max() <= 1e-12 * scale:
            break
        active[int(slope.argmax())] = True
        while True:
            trial = np.zeros(n)
            at = np.flatnonzero(active)
            trial[at] = np.linalg.lstsq(gram[np.ix_(at, at)], with_y[at], rcond=1e-13)[0]
            if (trial[at] > 0).all():
                w = trial
                break
            falling = at[trial[at] <= 0]
            step = min(w[j] / (w[j] - trial[j]) if w[j] > trial[j] else 0.0 for j in falling)
            w = np.maximum(w + step * (trial - w), 0.0)
            gone = active & (w <= 1e-15 * max(w.max(), 1e-300))
            gone[falling[[w[j] <= 1e-15 * max(w.max(), 1e-300) for j in falling]]] = True
            if not gone.any():
                gone[falling[0]] = True
            active &= ~gone
            w[~active] = 0.0
            if not active.any():
                break
    return w


def weights(tested: DataFrame, keys: Sequence[str], models: Sequence[str]) -> dict[str, float]:
    """Weight of each model; a model that helps nothing has 0."""
    at = {m: i for i, m in enumerate([*models, "y"])}
    full = np.zeros((len(at), len(at)))
    for r in products(tested, keys, models).collect():
        full[at[r.a], at[r.b]] = full[at[r.b], at[r.a]] = r.s or 0.0
    return dict(zip(models, map(float, non_negative(full[:-1, :-1], full[:-1, -1])), strict=True))


def stacked(tested: DataFrame, keys: Sequence[str], chosen: dict[str, float], name: str = "stacked") -> DataFrame:
    """The weighted sum of the models as a model of its own, in the columns of ``tested``."""
    table = tested.sparkSession.createDataFrame([(m, w) for m, w in chosen.items() if w > 0] or [("", 0.0)], "model string, _w double")
    rest = [c for c in tested.columns if c not in ("model", "yhat")]
    used = max(1, sum(w > 0 for w in chosen.values()))
    joint = tested.join(F.broadcast(table), "model").groupBy(*rest).agg(F.sum(F.col("yhat") * F.col("_w")).alias("yhat"), F.count(F.lit(1)).alias("_n"))
    return joint.where(F.col("_n") == used).withColumn("model", F.lit(name)).select(*tested.columns)
