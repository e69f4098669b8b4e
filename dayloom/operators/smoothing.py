"""Per-series state-space candidates: error-trend-season smoothing and Theta.

A series is one row; a task runs the recursions of a batch of series over a lattice of parameters,
all at once, one calendar day a step. The state after a day depends on the days before only, and
so does the sum of squared one-step errors: for every cut-off the best parameters (by the corrected
information criterion of the errors up to it) and the forecast are read off the same pass, so a
back-test over many cut-offs costs one run over the history.

Defined cases: a missing day changes nothing but the clock (its error counts as zero); a series with
fewer than ``LEAST`` known days before a cut-off has no forecast there; a series without errors takes the
first parameters of the lattice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIOD = 7
#: Known days that set the first level and season, and known days needed for a forecast.
WARM, LEAST = 7, 21
#: Lattice: level rates, trend rates as shares of them (with damping), season rates.
ALPHA = (0.01, 0.05, 0.1, 0.2, 0.4, 0.8)
TREND = ((0.0, 0.0), (0.05, 1.0), (0.2, 1.0), (0.05, 0.9), (0.2, 0.9))
GAMMA = (None, 0.01, 0.1)
BATCH = 64


@dataclass(frozen=True)
class Lattice:
    """Parameters of each candidate, one array entry a candidate."""

    alpha: np.ndarray
    beta: np.ndarray
    phi: np.ndarray
    gamma: np.ndarray
    seasonal: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(alphas: Sequence[float] = ALPHA, trends: Sequence[tuple[float, float]] = TREND, gammas: Sequence[float | None] = GAMMA) -> Lattice:
        rows = []
        for g in gammas:
            for share, phi in trends:
                for a in alphas:
                    trended = phi > 0
                    # rates and first states that are fitted
                    size = 2 + 2 * trended + (0 < phi < 1) + (0 if g is None else 1 + PERIOD)
                    rows.append((a, share * a, phi, g or 0.0, g is not None, size))
        return Lattice(*(np.array(c) for c in zip(*rows, strict=True)))

    def label(self, i: int) -> str:
        return f"a={self.alpha[i]:g} b={self.beta[i]:g} phi={self.phi[i]:g} g={self.gamma[i]:g}" + (" season" if self.seasonal[i] else "")


def run(values: np.ndarray, first: np.ndarray, cuts: np.ndarray, horizon: int, lattice: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best candidate, smoothing paths, Theta paths) of every series at every cut-off.

    ``values`` (series, days) on one calendar, NaN where unknown; a series begins on day ``first``;
    ``cuts`` are days. Paths are NaN and the candidate -1 where there is too little history.
    """
    series, days = values.shape
    shape = (series, len(lattice.alpha))
    level, trend, sse = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    season = np.zeros((*shape, PERIOD))
    known = np.zeros(series, int)
    flat = np.flatnonzero((lattice.phi == 0) & ~lattice.seasonal)
    line = np.zeros((4, series))  # sums for the straight line of Theta: day, day squared, value, day times value
    warm_sum, warm_season, warm_n = np.zeros(series), np.zeros((series, PERIOD)), np.zeros((series, PERIOD))
    best = np.full((series, len(cuts)), -1)
    ets, theta = (np.full((series, len(cuts), horizon), np.nan) for _ in range(2))
    steps = np.arange(1, horizon + 1)
    wanted = {int(c): i for i, c in enumerate(cuts)}
    for t in range(min(days, int(cuts.max(initial=-1)) + 1)):
        y = values[:, t]
        here = ~np.isnan(y)
        spot = t % PERIOD
        warming, ready = here & (known < WARM), here & (known >= WARM)
        if warming.any():
            warm_sum[warming] += y[warming]
            warm_season[warming, spot] += y[warming]
            warm_n[warming, spot] += 1
            done = warming & (known == WARM - 1)
            if done.any():
                mean = warm_sum[done] / WARM
                level[done] = mean[:, None]
                bump = np.where(warm_n[done] > 0, warm_season[done] / np.maximum(warm_n[done], 1) - mean[:, None], 0.0)
                season[done] = np.where(lattice.seasonal[None, :, None], bump[:, None, :], 0.0)
        running = known >= WARM
        expected = level + lattice.phi * trend
        e = np.where(ready[:, None], np.nan_to_num(y)[:, None] - expected - season[:, :, spot], 0.0)
        level = np.where(running[:, None], expected + lattice.alpha * e, level)
        trend = np.where(running[:, None], lattice.phi * trend + lattice.beta * e, trend)
        season[:, :, spot] += lattice.gamma * e
        sse += e * e
        x = np.where(here, t - first, 0).astype(float)
        line += np.stack([x, x * x, np.nan_to_num(y), x * np.nan_to_num(y)]) * here
        known += here
        if t in wanted:
            at = wanted[t]
            n = np.maximum(known - WARM, 1)[:, None]
            k = lattice.size[None, :]
            score = n * np.log(np.maximum(sse / n, 1e-300)) + 2 * k + np.where(n - k > 1, 2 * k * (k + 1) / np.maximum(n - k - 1, 1), np.inf)
            ok = known >= LEAST
            pick = score.argmin(axis=1)
            rows = np.arange(series)
            damp = np.cumsum(lattice.phi[pick][:, None] ** steps, axis=1)
            out = level[rows, pick][:, None] + damp * trend[rows, pick][:, None] + season[rows, pick][:, (t + steps) % PERIOD]
            ets[ok, at], best[ok, at] = out[ok], pick[ok]
            one = flat[sse[:, flat].argmin(axis=1)]
            a = lattice.alpha[one]
            m = known.astype(float)
            spread = m * line[1] - line[0] ** 2
            slope = np.where(spread > 0, (m * line[3] - line[0] * line[2]) / np.where(spread > 0, spread, 1.0), 0.0)
            lift = (steps - 1)[None, :] + ((1 - (1 - a) ** m) / a)[:, None]
            theta[ok, at] = (level[rows, one][:, None] + slope[:, None] / 2 * lift)[ok]
    return best, ets, theta


def candidates(
    history: DataFrame, cuts: Sequence[int], horizon: int, keys: Sequence[str] = ("entity_id",), value: str = "ret", date: str = "ds",
    last: str | None = None, lattice: Lattice | None = None,
) -> DataFrame:
    """(keys, cut, h, date, model, yhat, spec): forecasts of both models from each cut-off, which lies ``cuts`` days before ``last``.

    ``last`` is a date text; without it the newest day of the history. A series is one row, which the calendar bounds.
    """
    grid = lattice or Lattice.of()
    whole = history.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v")))).alias("s"))
    end = F.lit(last).cast("date") if last else history.agg(F.max(date)).scalar()
    whole = whole.withColumn("_end", F.unix_date(end)).select(*keys, F.transform("s", lambda x: F.unix_date(x["d"])).alias("_days"), F.transform("s", lambda x: x["v"]).alias("_values"), "_end")
    back = np.array(sorted(cuts, reverse=True), int)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), BATCH):
                b = whole_batch.iloc[at : at + BATCH]
                first = np.array([d[0] for d in b["_days"]])
                base, end = int(first.min()), int(b["_end"].iloc[0])
                x = np.full((len(b), max(end - base + 1, 1)), np.nan)
                for i, (d, v) in enumerate(zip(b["_days"], b["_values"], strict=True)):
                    inside = d <= end
                    x[i, d[inside] - base] = v[inside]
                days = end - base - back
                best, ets, theta = run(x, first - base, days[days >= 0], horizon, grid)
                for c, cut in enumerate(end - back[days >= 0]):
                    ok = best[:, c] >= 0
                    if not ok.any():
                        continue
                    for model, paths in (("ets", ets), ("theta", theta)):
                        spec = [grid.label(i) if model == "ets" else "" for i in best[ok, c]]
                        yield b.loc[ok, list(keys)].assign(_cut=int(cut), model=model, spec=spec, _path=list(paths[ok, c]))

    fields = [*(history.schema[k] for k in keys), T.StructField("_cut", T.IntegerType()), T.StructField("model", T.StringType()), T.StructField("spec", T.StringType()), T.StructField("_path", T.ArrayType(T.DoubleType()))]
    made = whole.mapInPandas(compute, T.StructType(fields)).select(*keys, F.date_from_unix_date("_cut").alias("cut"), "model", "spec", F.posexplode("_path").alias("_h", "yhat"))
    h = F.col("_h") + 1
    return made.select(*keys, "cut", h.alias("h"), F.date_add("cut", h).alias(date), "model", "yhat", "spec")
