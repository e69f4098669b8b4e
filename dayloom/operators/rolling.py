"""Trailing row-frame metrics on a padded daily grid.

Sliding frames are re-evaluated per row (rows x frame length). The long frames are
therefore expressed as differences of running sums: one pass of running sums, one
pass of ``lag`` for every horizon together, then plain arithmetic. All pieces share
one window specification, hence one exchange and one sort.

A metric is described by :class:`Pieces`: columns of the three passes and the
resulting expressions. :func:`with_pieces` runs any number of metrics together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.measures import YEAR_DAYS

HORIZONS = (15, 30, 90, 180, 365)
# exp() of 600 stays far inside a double; beyond it the closed-form average is not used.
_SAFE_EXPONENT = 600.0
# Running sums of large and of small moves are kept apart, so that one jump does
# not swallow the digits of the quiet days after it.
_LARGE_MOVE = 0.01
# A small move is a whole number of 2**-_UNIT, below 2**47; halves of _HALF bits keep the sums of squares
# of 80,000 rows (two centuries of days) inside 64 bits. Longer sums raise an error rather than wrap.
_UNIT, _HALF = 53, 23


@dataclass
class Pieces:
    """What a metric needs: window columns of the passes and the result expressions.

    ``first`` and ``running`` map names to window columns of the first two passes;
    ``state`` names running columns whose value some rows earlier is wanted, at the
    distances in ``lags``; ``back`` holds further columns of the third pass.
    """

    first: dict[str, Column] = field(default_factory=dict)
    running: dict[str, Column] = field(default_factory=dict)
    state: list[str] = field(default_factory=list)
    lags: list[int] = field(default_factory=list)
    back: dict[str, Column] = field(default_factory=dict)
    out: dict[str, Column] = field(default_factory=dict)


POS = "_pos"


def series_window(keys: Sequence[str], date: str = "ds") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _trailing(w: WindowSpec, period: int) -> WindowSpec:
    return w.rowsBetween(-(period - 1), 0)


def with_pieces(
    df: DataFrame, keys: Sequence[str], date: str, *makers: Callable[[WindowSpec], Pieces]
) -> DataFrame:
    """Run the passes of several metrics over one shared window specification.

    The running columns of all metrics are packed into one struct, so a distance costs one
    ``lag`` however many metrics use it.
    """
    w = series_window(keys, date)
    parts = [make(w) for make in makers]
    first: dict[str, Column] = {POS: F.row_number().over(w)}
    running: dict[str, Column] = {}
    back: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for part in parts:
        first.update(part.first)
        running.update(part.running)
        back.update(part.back)
        out.update(part.out)
    packed = F.struct(*sorted({n for part in parts for n in part.state})) if any(p.state for p in parts) else None
    for period in sorted({n for part in parts for n in part.lags}):
        back[f"_b{period}"] = F.lag(packed, period).over(w)
    staged = df
    for stage in (first, running, back):
        if stage:
            staged = staged.select("*", *[c.alias(n) for n, c in stage.items()])
    return staged.select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def _since(name: str, period: int) -> Column:
    """Difference of a running column to its value ``period`` rows earlier."""
    before = F.col(f"_b{period}").getField(name)
    return F.col(name) - F.coalesce(before, F.lit(0))


def _clear(last: str, period: int) -> Column:
    """Whether the frame is full and free of the rows whose last position is ``last``."""
    return F.col(POS) - F.coalesce(F.col(last), F.lit(0)) >= period


def _known(value: Column) -> Column:
    """The value, or NULL when it is NULL, NaN or infinite."""
    big = float("inf")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(big)), value)


def compounded_return(
    value: str, horizons: Mapping[str, tuple[int, float]], shift: float = 0.0, tag: str = "g"
) -> Callable[[WindowSpec], Pieces]:
    """``product(value + shift) ^ exponent - 1`` over the last ``period`` rows.

    ``horizons`` maps the output name to (period, exponent). The product is the
    exponential of a difference of running logarithms; the positions of zeros and the
    number of negative factors are kept apart, so it is right for every sign. NULL until
    the frame is full and whenever the frame holds a NULL.
    """

    def make(w: WindowSpec) -> Pieces:
        run = _running(w)
        x = _known(F.col(value) + F.lit(shift) if shift else F.col(value))
        gap, ln, zero, neg = (f"_{tag}_{s}" for s in ("gap", "ln", "zero", "neg"))
        p = Pieces(state=[ln, neg], lags=[period for period, _ in horizons.values()])
        p.running[gap] = F.max(F.when(x.isNull(), F.col(POS))).over(run)
        p.running[zero] = F.max(F.when(x == 0, F.col(POS))).over(run)
        p.running[ln] = F.sum(F.when((x == 0) | x.isNull(), 0.0).otherwise(F.ln(F.abs(x)))).over(run)
        p.running[neg] = F.count(F.when(x < 0, True)).over(run)
        for name, (period, exponent) in horizons.items():
            size = F.exp(_since(ln, period))
            signed = F.when(~_clear(zero, period), F.lit(0.0)).otherwise(
                F.when(_since(neg, period) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0)) * size
            )
            powered = signed if exponent == 1 else F.pow(signed, F.lit(float(exponent)))
            p.out[name] = F.when(_clear(gap, period), powered - 1)
        return p

    return make


def annualised_horizons(periods: Sequence[int] = HORIZONS, prefix: str = "rent") -> dict[str, tuple[int, float]]:
    """Exponent 365/period; the full-year horizon needs none."""
    return {f"{prefix}_{p}": (p, 1 if p == YEAR_DAYS else YEAR_DAYS / p) for p in periods}


def volatility(
    value: str, periods: Sequence[int] = HORIZONS, prefix: str = "vol", tag: str = "v"
) -> Callable[[WindowSpec], Pieces]:
    """Sample standard deviation of ``value - 1`` times sqrt(365) over trailing rows.

    A frame whose rows are all equal gives exactly 0 (found from the position of the last
    change, not by subtracting sums). NULL until the frame is full or when it holds a NULL.
    """

    def make(w: WindowSpec) -> Pieces:
        run = _running(w)
        x = _known(F.col(value))
        r = F.coalesce(x - 1, F.lit(0.0))
        large = F.abs(r) >= _LARGE_MOVE
        small = F.when(large, 0.0).otherwise(r)
        gap, s, high, mixed, low, sl, ql, jump, change = (f"_{tag}_{k}" for k in ("gap", "s", "high", "mixed", "low", "sl", "ql", "jump", "change"))
        p = Pieces(state=[s, high, mixed, low, sl, ql], lags=list(periods))
        p.first[f"_{tag}_same"] = F.lag(value).over(w).eqNullSafe(F.col(value))
        p.running[gap] = F.max(F.when(x.isNull(), F.col(POS))).over(run)
        p.running[change] = F.max(F.when(~F.col(f"_{tag}_same"), F.col(POS))).over(run)
        p.running[jump] = F.max(F.when(large, F.col(POS))).over(run)
        # Small moves are summed exactly, so that quiet frames lose no digits after busy ones;
        # sums of large moves count only in frames that hold one. A value near 1 is a multiple of
        # 2**-53, so a small move is a whole number of them; its square is summed in three parts.
        units = (small * 2.0**_UNIT).cast("long")
        whole = F.shiftright(F.abs(units), _HALF)
        rest = F.abs(units) - F.shiftleft(whole, _HALF)
        p.running[s] = F.sum(units).over(run)
        p.running[high] = F.sum(whole * whole).over(run)
        p.running[mixed] = F.sum(whole * rest).over(run)
        p.running[low] = F.sum(rest * rest).over(run)
        p.running[sl] = F.sum(F.when(large, r).otherwise(0.0)).over(run)
        p.running[ql] = F.sum(F.when(large, r * r).otherwise(0.0)).over(run)
        for period in periods:
            calm = _clear(jump, period)
            total = _since(s, period) * 2.0**-_UNIT + F.when(calm, 0.0).otherwise(_since(sl, period))
            exact = _since(high, period) * 2.0 ** (2 * _HALF - 2 * _UNIT) + _since(mixed, period) * 2.0 ** (_HALF + 1 - 2 * _UNIT) + _since(low, period) * 2.0 ** (-2 * _UNIT)
            squares = exact + F.when(calm, 0.0).otherwise(_since(ql, period))
            var = F.greatest((squares - total * total / period) / (period - 1), F.lit(0.0))
            flat = F.col(POS) - F.coalesce(F.col(change), F.lit(1)) >= period - 1
            p.out[f"{prefix}_{period}"] = F.when(
                _clear(gap, period), F.when(flat, F.lit(0.0)).otherwise(F.sqrt(var) * math.sqrt(YEAR_DAYS))
            )
        return p

    return make


def decay(n: int) -> float:
    return -math.log1p(-2.0 / (n + 1))


def closed_form_fits(n: int, series_rows: int | None) -> bool:
    """Whether the weights of the closed form stay inside a double for such a series."""
    return series_rows is not None and decay(n) * series_rows < _SAFE_EXPONENT


def exponential_average(
    value: str, periods: Sequence[int] = HORIZONS, shift: float = 0.0, prefix: str = "ema", tag: str = "e"
) -> Callable[[WindowSpec], Pieces]:
    """Exponential moving average with ratio ``2 / (n + 1)``, seeded by the mean of n rows.

    ``ema_i = (1-a)^(i-n) * (seed + sum_j a x_j (1-a)^-(j-n))`` needs one running sum per
    period. Leading NULLs are skipped; after a NULL inside the series the result is NULL.
    """

    def make(w: WindowSpec) -> Pieces:
        run = _running(w)
        x = _known(F.col(value) + F.lit(shift) if shift else F.col(value))
        n, start = f"_{tag}_n", f"_{tag}_start"
        p = Pieces()
        p.running[n] = F.count(x).over(run)
        p.running[start] = F.min(F.when(x.isNotNull(), F.col(POS))).over(run)
        whole = F.col(POS) - F.col(start) + 1 == F.col(n)
        for k in periods:
            a = 2.0 / (k + 1)
            since = (F.col(n) - k).cast("double")
            weighted = F.when(F.col(n) <= k, x / k).otherwise(a * x * F.exp(since * decay(k)))
            p.back[f"_{tag}_{k}"] = F.sum(weighted).over(run)
            p.out[f"{prefix}_{k}"] = F.when(
                whole & (F.col(n) >= k), F.exp(-since * decay(k)) * F.col(f"_{tag}_{k}")
            )
        return p

    return make


def exponential_average_array(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    good = np.isfinite(x)
    if not good.any():
        return out
    first = int(np.argmax(good))
    if len(x) - first < n:
        return out
    a = 2.0 / (n + 1)
    level = float(x[first : first + n].mean())
    out[first + n - 1] = level
    for i in range(first + n, len(x)):
        level += a * (x[i] - level)
        out[i] = level
    return out


def exponential_average_long(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    value: str,
    periods: Sequence[int],
    shift: float = 0.0,
    prefix: str = "ema",
) -> DataFrame:
    """The same average by recursion, for series too long for the closed form.

    Only keys, date and value go to the workers; a group is one series, bounded by the
    calendar, and comes back with one array of results per row.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [df.schema[date], T.StructField("_ema", T.ArrayType(T.DoubleType()))]
    )

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date, kind="stable")
        x = pdf[value].to_numpy(dtype=float) + shift
        cols = np.column_stack([exponential_average_array(x, n) for n in periods])
        out = pdf[[*keys, date]].copy()
        out["_ema"] = [[None if np.isnan(v) else float(v) for v in row] for row in cols]
        return out

    emas = df.select(*keys, date, value).groupBy(*keys).applyInPandas(per_series, schema)
    joined = df.join(emas, [*keys, date], "left")
    return joined.select(
        *df.columns, *[F.col("_ema")[i].alias(f"{prefix}_{n}") for i, n in enumerate(periods)]
    )


def with_exponential_average(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    value: str,
    periods: Sequence[int] = HORIZONS,
    shift: float = 0.0,
    prefix: str = "ema",
    series_rows: int | None = None,
) -> DataFrame:
    """Closed form where ``series_rows`` proves it safe, recursion for the other periods."""
    short = [n for n in periods if closed_form_fits(n, series_rows)]
    long = [n for n in periods if n not in short]
    out = df
    if short:
        out = with_pieces(out, keys, date, exponential_average(value, short, shift, prefix))
    if long:
        out = exponential_average_long(out, keys, date, value, long, shift, prefix)
    return out.select(*df.columns, *[f"{prefix}_{n}" for n in periods])


def flow_ratio(
    flow: str = "net_flow", level: str = "close_value", period: int = 30, name: str = "flow_ratio_30"
) -> Callable[[WindowSpec], Pieces]:
    """Sum of flows of the last rows over the level that many rows earlier."""

    def make(w: WindowSpec) -> Pieces:
        frame = _trailing(w, period)
        p = Pieces()
        p.first["_f_sum"] = F.sum(flow).over(frame)
        p.first["_f_n"] = F.count(flow).over(frame)
        p.first["_f_level"] = F.lag(level, period).over(w)
        p.out[name] = F.when(F.col("_f_n") == period, F.try_divide(F.col("_f_sum"), F.col("_f_level")))
        return p

    return make


def lagged_mean(
    value: str, period: int = 7, name: str = "ma7"
) -> Callable[[WindowSpec], Pieces]:
    """Mean of the ``period`` rows before the current one; NULL until they are all there."""

    def make(w: WindowSpec) -> Pieces:
        frame = w.rowsBetween(-period, -1)
        p = Pieces()
        p.first["_m_avg"] = F.avg(value).over(frame)
        p.first["_m_n"] = F.count(value).over(frame)
        p.out[name] = F.when(F.col("_m_n") == period, F.col("_m_avg"))
        return p

    return make


def centred_mean(
    df: DataFrame, keys: Sequence[str], date: str, value: str, period: int, name: str = "smooth"
) -> DataFrame:
    """Centred moving average over ``period`` rows, by differences of running sums.

    At the ends the frame is cut to the rows there are.
    """
    half = period // 2
    w = series_window(keys, date) if keys else Window.partitionBy(F.lit(0)).orderBy(date)
    run = _running(w)
    state = F.struct(F.sum(value).over(run).alias("s"), F.count(value).over(run).alias("n"))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    staged = df.withColumn("_c", state)
    staged = staged.withColumns(
        {
            "_hi": F.coalesce(F.lead("_c", half).over(w), F.last("_c").over(every)),
            "_lo": F.lag("_c", half + 1).over(w),
        }
    )
    total = F.coalesce(F.col("_hi.s"), F.lit(0.0)) - F.coalesce(F.col("_lo.s"), F.lit(0.0))
    count = F.col("_hi.n") - F.coalesce(F.col("_lo.n"), F.lit(0))
    return staged.select(*df.columns, F.try_divide(total, count).alias(name))


def drop_first(df: DataFrame, keys: Sequence[str], date: str = "ds") -> DataFrame:
    """Drop the first row of every series."""
    rn = F.row_number().over(series_window(keys, date))
    return df.withColumn("_rn", rn).where("_rn > 1").drop("_rn")


def tail_rows(df: DataFrame, keys: Sequence[str], n: int, date: str = "ds") -> DataFrame:
    """The last ``n`` rows of every series."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(date).desc()))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def lagged(df: DataFrame, keys: Sequence[str], date: str, value: str, steps: Sequence[int]) -> DataFrame:
    w = series_window(keys, date)
    return df.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) for k in steps})


