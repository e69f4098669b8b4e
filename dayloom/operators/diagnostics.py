"""Series diagnostics: correlation by lag, seasonal decomposition, seasonal summaries.

Spark brings every series together as one row of arrays; a worker handles one series
at a time with a few lines of numpy. A series is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.operators.calendar import signature_columns
from dayloom.operators.reshape import to_series


def _autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    c = x - x.mean()
    base = float(c @ c)
    lags = min(lags, len(c) - 1)
    if base == 0.0:
        return np.full(lags + 1, np.nan)
    return np.array([float(c[k:] @ c[: len(c) - k]) / base for k in range(lags + 1)])


def _partial(rho: np.ndarray) -> np.ndarray:
    """Durbin-Levinson recursion on autocorrelations; entry 0 is 1."""
    out = np.ones(len(rho))
    phi = np.zeros(0)
    for k in range(1, len(rho)):
        den = 1.0 - float(phi @ rho[1:k])
        last = (rho[k] - float(phi @ rho[k - 1 : 0 : -1])) / den if den else np.nan
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def _listed(values: np.ndarray) -> list[float | None]:
    return [None if not np.isfinite(v) else float(v) for v in values]


def autocorrelation(
    df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int], date: str = "ds", partial: bool = False
) -> DataFrame:
    """Auto-correlation (and partial) per series and lag; rows with NULL are left out."""
    top = max(lags)
    result = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("acf", "pacf")])

    @F.pandas_udf(result)
    def correlate(xs: pd.Series) -> pd.DataFrame:
        rows = []
        for x in xs:
            rho = _autocorrelation(np.asarray(x, dtype=float), top)
            rows.append((_listed(rho), _listed(_partial(rho)) if partial else None))
        return pd.DataFrame(rows, columns=["acf", "pacf"])

    series = to_series(df.where(F.col(value).isNotNull()), keys, date, {"x": value})
    wanted = F.array(*[F.lit(k) for k in lags])
    per_lag = series.select(*keys, correlate("x").alias("r")).select(*keys, "r", F.explode(wanted).alias("lag"))
    out = per_lag.select(*keys, "lag", F.try_element_at("r.acf", F.col("lag") + 1).alias("acf"),
                         F.try_element_at("r.pacf", F.col("lag") + 1).alias("pacf")).where("acf IS NOT NULL")
    return out if partial else out.drop("pacf")


def cross_correlation(
    df: DataFrame, keys: Sequence[str], value: str, other: str, lags: Sequence[int], date: str = "ds"
) -> DataFrame:
    """Correlation of ``value`` with ``other`` that many rows earlier, per series and lag."""
    top = max(lags)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def correlate(ys: pd.Series, xs: pd.Series) -> pd.Series:
        out = []
        for y, x in zip(ys, xs):
            a = np.asarray(y, dtype=float)
            b = np.asarray(x, dtype=float)
            a, b = a - a.mean(), b - b.mean()
            scale = float(np.sqrt((a @ a) * (b @ b)))
            n = len(a)
            out.append(_listed(np.array(
                [float(a[k:] @ b[: n - k]) / scale if scale else np.nan for k in range(min(top, n - 1) + 1)]
            )))
        return pd.Series(out)

    complete = df.where(F.col(value).isNotNull() & F.col(other).isNotNull())
    series = to_series(complete, keys, date, {"y": value, "x": other})
    wanted = F.array(*[F.lit(k) for k in lags])
    return (
        series.select(*keys, correlate("y", "x").alias("r"))
        .select(*keys, "r", F.explode(wanted).alias("lag"))
        .select(*keys, "lag", F.try_element_at("r", F.col("lag") + 1).alias("ccf"))
        .where("ccf IS NOT NULL")
    )


class _Loess:
    """Local linear smoothing on an even grid with tricube weights of ``span`` points, times the points' own weights.

    What does not depend on the values is worked out once. Where no point of a window has weight, all count alike.
    """

    def __init__(self, n: int, span: int, weight: np.ndarray | None = None):
        self.n, self.weight, span = n, weight, max(3, span | 1)
        self.half = half = span // 2
        reach = np.arange(-half, half + 1)
        self.w = w = (1 - (np.abs(reach) / (half + 1)) ** 3) ** 3
        self.slope = w * reach
        self.inside = np.ones(n) if weight is None else weight
        self.pad = np.zeros(half)
        if n < 3:
            return
        on = np.concatenate([self.pad, self.inside, self.pad])
        # Weighted moments around every point; correlation with the kernel sums over the window.
        self.s0 = np.correlate(on, w, "valid")
        self.s1 = np.correlate(on, self.slope, "valid")
        self.s2 = np.correlate(on, w * reach * reach, "valid")
        self.den = self.s0 * self.s2 - self.s1 * self.s1
        self.alike = None if weight is None or (self.s0 > 1e-9).all() else _Loess(n, span)

    def __call__(self, y: np.ndarray) -> np.ndarray:
        if self.n < 3:
            return y.copy()
        yy = np.concatenate([self.pad, y * self.inside, self.pad])
        s0, s1, s2, den = self.s0, self.s1, self.s2, self.den
        t0 = np.correlate(yy, self.w, "valid")
        t1 = np.correlate(yy, self.slope, "valid")
        flat = t0 / np.where(s0 > 1e-9, s0, 1)
        out = np.where(np.abs(den) > 1e-12, (s2 * t0 - s1 * t1) / np.where(den == 0, 1, den), flat)
        return out if self.alike is None else np.where(s0 > 1e-9, out, self.alike(y))


def _loess(y: np.ndarray, span: int, weight: np.ndarray | None = None) -> np.ndarray:
    """``_Loess`` of one series."""
    return _Loess(len(y), span, weight)(y)


def _moving(y: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(y, np.ones(k) / k, "valid")


#: Outer rounds of the robust decomposition, which end when no weight moves by more than ``SETTLED``.
OUTER, SETTLED = 15, 0.01


def robust_weights(remainder: np.ndarray) -> np.ndarray:
    """Bisquare weights: 1 near zero, 0 beyond six times the median size."""
    size = np.abs(remainder)
    h = 6 * float(np.median(size))
    near = (1 - (size / h) ** 2) ** 2 if h > 0 else np.zeros(len(size))
    return np.where(size <= 0.001 * h, 1.0, np.where(size <= 0.999 * h, near, 0.0))


def decompose(y: np.ndarray, period: int, trend_span: int, rounds: int = 2, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """Season (a periodic pattern) and trend by alternating local smoothing; the rest is the remainder.

    After each outer round days with a large remainder weigh less (``outer`` = 0: all days alike). A series of fewer
    than two periods and a day has no season (NaN).
    """
    n = len(y)
    if n < 2 * period + 1:
        return np.full(n, np.nan), _loess(y, n)
    trend = np.zeros(n)
    season = np.zeros(n)
    weight = np.ones(n)
    # three moving averages take 2 * period off the extended cycle
    lowpass = _Loess(n, period)
    for step in range(outer + 1):
        smooth = _Loess(n, trend_span, None if step == 0 else weight)
        held = [weight[phase::period].sum() for phase in range(period)]
        for _ in range(rounds):
            detrended = y - trend
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                # every phase keeps its weighted mean, extended by one cycle each side
                sub, w = detrended[phase::period], weight[phase::period]
                cycle[phase::period] = (sub * w).sum() / held[phase] if held[phase] > 1e-9 else sub.mean()
            low = lowpass(_moving(_moving(_moving(cycle, period), period), 3))
            season = cycle[period : period + n] - low
            trend = smooth(y - season)
        if step < outer:
            fresh = robust_weights(y - season - trend)
            moved = float(np.abs(fresh - weight).max())
            weight = fresh
            if step and moved <= SETTLED:
                break
    return season, trend


def stl(
    df: DataFrame, keys: Sequence[str], value: str, date: str = "ds", period: int = 7, trend_span: int = 92
) -> DataFrame:
    """Observed value split into season, trend and remainder, series by series, by robust smoothing.

    A series too short for a season has none (NULL); its remainder is what the trend leaves.
    """
    parts = ("season", "trend", "remainder")

    @F.pandas_udf(T.StructType([T.StructField(p, T.ArrayType(T.DoubleType())) for p in parts]))
    def split(xs: pd.Series) -> pd.DataFrame:
        rows = []
        for x in xs:
            y = np.asarray(x, dtype=float)
            season, trend = decompose(y, period, trend_span)
            rows.append((season, trend, y - np.nan_to_num(season) - trend))
        return pd.DataFrame(rows, columns=list(parts))

    # A series is one row of arrays: its key does not go to the workers. Rows without a date come last.
    packed = F.array_sort(F.collect_list(F.struct(F.col(date).isNull().alias("late"), F.col(date).alias("d"), F.col(value).cast("double").alias("x"))))
    series = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(packed.alias("_p"))
    done = series.select(*keys, "_p", split("_p.x").alias("_s"))
    zipped = F.arrays_zip(F.col("_p.d").alias("d"), F.col("_p.x").alias("observed"), *[F.col(f"_s.{p}").alias(p) for p in parts])
    days = done.select(*keys, F.explode(zipped).alias("_r"))
    return days.select(*keys, F.col("_r.d").alias(date), *[F.when(~F.isnan(f"_r.{p}"), F.col(f"_r.{p}")).alias(p) for p in ("observed", *parts)])


def seasonal_summary(
    df: DataFrame, value: str, features: Sequence[str] = ("wday", "month", "year"), date: str = "ds",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Five-number summary of a daily series by calendar feature; a group is one series' days."""
    cols = signature_columns(date)
    long = df.where(F.col(value).isNotNull()).select(
        *keys, value,
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), cols[f].cast("int").alias("level")) for f in features])
        ).alias("s"),
    )
    probs = F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])
    names = ("low", "q1", "median", "q3", "high")
    agg = long.groupBy(*keys, "s.feature", "s.level").agg(
        F.count(F.lit(1)).alias("n"), F.percentile(value, probs).alias("q")
    )
    return agg.select(*keys, "feature", "level", "n", *[F.col("q")[i].alias(x) for i, x in enumerate(names)])
