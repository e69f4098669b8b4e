"""Linear models from sums of products: every recipe, fold and penalty from one pass over the rows.

``fold_sums`` adds up, for each fold, the products of all columns with each other (one row a fold and task
leaves the tasks). Whatever a linear fit needs is a part of these sums: training rows are all folds less
one, a recipe is a choice of columns, a missing value is replaced by the training mean of its column by
means of an indicator column, centring and scaling are linear maps, and the squared error on
the fold left out is a quadratic form of its own sums. So no model touches a row again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.session import in_threads

SWEEPS = 100
#: Columns of one aggregate.
WIDTH = 6
#: Columns whose variance is below this share of their size are constant.
FLAT = 1e-12


@dataclass
class Sums:
    """``products[f]``: for fold f the sums over its rows of all products of [1, columns, missing flags, target], shifted and scaled."""

    columns: list[str]
    shift: np.ndarray
    scale: np.ndarray
    products: np.ndarray

    @property
    def total(self) -> np.ndarray:
        return self.products.sum(axis=0)

    @property
    def spread(self) -> float:
        """Standard deviation of the target, 1 if it is constant."""
        t = self.total
        n = max(t[0, 0], 1.0)
        sd = float(np.sqrt(max(t[-1, -1] / n - (t[0, -1] / n) ** 2, 0.0)) * self.scale[-1])
        return sd if sd > 0 else 1.0


def moments(rows: DataFrame, columns: Sequence[str]) -> list[tuple[float, float]]:
    """Mean and standard deviation of every column, 0 without values.

    A few columns at a time: an aggregate of all of them compiles to a method too long for the JVM to optimise.
    """
    parts = [list(columns[at : at + WIDTH]) for at in range(0, len(columns), WIDTH)]

    def run(part: list[str]) -> list[tuple[float, float]]:
        found = rows.agg(*[F.struct(F.coalesce(F.avg(c), F.lit(0.0)), F.coalesce(F.stddev_pop(c), F.lit(0.0))) for c in part]).first()
        return [(float(m), float(s)) for m, s in found]

    return [x for part in in_threads(rows.sparkSession, [lambda p=p: run(p) for p in parts]) for x in part]


def fold_sums(rows: DataFrame, columns: Sequence[str], target: str, fold: Column | str, folds: int) -> Sums:
    """Sums of the rows with a target; a null in a column is a missing value."""
    columns = list(columns)
    named = [*columns, target]
    known = rows.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in named], (F.col(fold) if isinstance(fold, str) else fold).cast("int").alias("_fold"))
    stats = moments(known, named)
    shift = np.array([m for m, _ in stats])
    scale = np.array([s if s > FLAT * max(1.0, abs(m)) else 1.0 for m, s in stats])
    size = 2 * len(columns) + 2

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((folds, size, size))
        for b in batches:
            x = (b[named].to_numpy(dtype=float) - shift) / scale
            missing = np.isnan(x[:, :-1])
            z = np.hstack([np.ones((len(x), 1)), np.where(missing, 0.0, x[:, :-1]), missing, x[:, -1:]])
            which = b["_fold"].to_numpy()
            for f in np.unique(which):
                part = z[which == f]
                held[f] += part.T @ part
        yield pd.DataFrame({"fold": range(folds), "s": list(held.reshape(folds, -1))})

    summed = known.mapInPandas(add, "fold int, s array<double>").select("fold", F.posexplode("s").alias("at", "v")).groupBy("fold", "at").agg(F.sum("v").alias("v"))
    products = np.zeros((folds, size * size))
    for r in summed.collect():  # folds times the square of the columns
        products[r.fold, r["at"]] = r.v
    return Sums(columns, shift, scale, products.reshape(folds, size, size))


@dataclass
class LinearModel:
    """A fitted linear function of columns; missing values count as the training mean."""

    intercept: float
    weights: dict[str, float]
    fill: dict[str, float]
    prediction: str = "yhat"

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in self.weights.items():
            out = out + F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(self.fill[c]))
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.prediction, self.column())


def _chosen(sums: Sums, columns: Sequence[str], train: np.ndarray) -> np.ndarray:
    """Map from [1, columns, target] with missing values filled by the training mean to the columns of the sums."""
    p = len(sums.columns)
    out = np.zeros((2 * p + 2, len(columns) + 2))
    out[0, 0] = out[-1, -1] = 1.0
    for k, c in enumerate(columns, 1):
        at = sums.columns.index(c)
        known = train[0, 0] - train[0, 1 + p + at]
        out[1 + at, k] = 1.0
        out[1 + p + at, k] = train[0, 1 + at] / known if known > 0 else 0.0
    return out


def elastic_net(corr: np.ndarray, with_y: np.ndarray, penalties: np.ndarray, sweeps: int = SWEEPS, tolerance: float = 1e-8) -> np.ndarray:
    """Weights (problems, penalties, columns) minimising w'Cw/2 - r'w + l (a |w|_1 + (1 - a) |w|^2 / 2).

    ``corr`` (problems, columns, columns) and ``with_y`` (problems, columns) are of scaled columns;
    ``penalties`` holds (l, a). Without an absolute part the solution is direct, else coordinates
    descend for all problems and penalties at once.
    """
    problems, q = with_y.shape
    out = np.zeros((problems, len(penalties), q))
    smooth = np.flatnonzero(penalties[:, 0] * penalties[:, 1] == 0)
    for i in smooth:
        for b in range(problems):
            out[b, i] = np.linalg.lstsq(corr[b] + penalties[i, 0] * (1 - penalties[i, 1]) * np.eye(q), with_y[b], rcond=1e-12)[0]
    rough = np.setdiff1d(np.arange(len(penalties)), smooth)
    if len(rough):
        l1 = (penalties[rough, 0] * penalties[rough, 1])[None]
        l2 = (penalties[rough, 0] * (1 - penalties[rough, 1]))[None]
        w = np.zeros((problems, len(rough), q))
        for _ in range(sweeps):
            change = 0.0
            for j in range(q):
                diagonal = corr[:, j, j][:, None]
                rest = with_y[:, j][:, None] - (w @ corr[:, :, j][:, :, None])[..., 0] + diagonal * w[..., j]
                new = np.sign(rest) * np.maximum(np.abs(rest) - l1, 0.0) / np.maximum(diagonal + l2, 1e-300)
                new = np.where(diagonal > 0, new, 0.0)
                change = max(change, float(np.abs(new - w[..., j]).max()))
                w[..., j] = new
            if change < tolerance:
                break
        out[:, rough] = w
    return out


def _fits(sums: Sums, columns: Sequence[str], trains: Sequence[np.ndarray], penalties: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every training part its map and, for each penalty, [intercept, weights] of the mapped columns."""
    maps, corr, with_y, centres, scales = [], [], [], [], []
    for train in trains:
        to = _chosen(sums, columns, train)
        g = to.T @ train @ to
        n = max(g[0, 0], 1.0)
        mean = g[0, 1:] / n
        cov = g[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
        sd = np.where(sd > FLAT**0.5 * np.maximum(1.0, np.abs(mean)), sd, np.inf)  # a constant column gets no weight
        y = sd[-1] if np.isfinite(sd[-1]) else 1.0
        maps.append(to), centres.append(mean), scales.append((sd[:-1], y))
        corr.append(cov[:-1, :-1] / np.outer(sd[:-1], sd[:-1]))
        with_y.append(cov[:-1, -1] / (sd[:-1] * y))
    solved = elastic_net(np.array(corr), np.array(with_y), penalties)
    out = []
    for to, mean, (sd, y), w in zip(maps, centres, scales, solved, strict=True):
        raw = w * y / sd
        out.append((to, np.hstack([mean[-1] - raw @ mean[:-1][:, None], raw])))
    return out


def search(sums: Sums, columns: Sequence[str], penalties: Sequence[tuple[float, float]]) -> np.ndarray:
    """Error (root mean square, in units of the target) of every penalty on every fold, fitted on the others."""
    pen, total = np.array(penalties, dtype=float), sums.total
    used = [f for f in range(len(sums.products)) if 0 < sums.products[f][0, 0] < total[0, 0]]
    out = np.full((len(sums.products), len(pen)), np.nan)
    fits = _fits(sums, columns, [total - sums.products[f] for f in used], pen) if used else []
    for f, (to, beta) in zip(used, fits, strict=True):
        held = to.T @ sums.products[f] @ to
        v = np.hstack([-beta, np.ones((len(pen), 1))])
        out[f] = np.sqrt(np.maximum(np.einsum("pi,ij,pj->p", v, held, v), 0.0) / held[0, 0]) * sums.scale[-1]
    return out


def fit(sums: Sums, columns: Sequence[str], penalty: tuple[float, float], prediction: str = "yhat") -> LinearModel:
    """The model fitted on all folds, in units of the columns."""
    columns = list(columns)
    total = sums.total
    to, beta = _fits(sums, columns, [total], np.array([penalty], dtype=float))[0]
    at = [sums.columns.index(c) for c in columns]
    scale, shift, y = sums.scale[at], sums.shift[at], sums.scale[-1]
    weights = beta[0, 1:] * y / scale
    intercept = beta[0, 0] * y + sums.shift[-1] - float(weights @ shift)
    p = len(sums.columns)
    fill = {c: float(to[1 + p + a, k + 1] * s + m) for k, (c, a, s, m) in enumerate(zip(columns, at, scale, shift, strict=True))}
    return LinearModel(float(intercept), dict(zip(columns, map(float, weights), strict=True)), fill, prediction)
