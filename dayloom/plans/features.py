"""Regressor calendars, lag features and the model frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.dates import non_working_flag
from dayloom.operators.padding import future_frame, pad_daily
from dayloom.operators.rolling import lagged_mean, with_pieces
from dayloom.operators.scaling import standardize

# Days by which the two slow regressors lead the target.
REGRESSOR_LAGS = {"monthly": 136, "daily_2": 117}
HORIZON_RECIPES = 30
HORIZON_QUANTILES = 28


def by_day(regressor: DataFrame, date: str = "ds") -> DataFrame:
    """Broadcast a regressor calendar: its size is bounded by the days it covers.

    The calendar is grouped by day, so it cannot hold more than one row per day.
    """
    values = [c for c in regressor.columns if c != date]
    return F.broadcast(regressor.groupBy(date).agg(*[F.max(v).alias(v) for v in values]))


def filled_calendar(regressor: DataFrame, ahead: int = 0, date: str = "ds") -> DataFrame:
    """A daily regressor without gaps: each missing day, and ``ahead`` days after the last, carries the value before.

    One row per day: the window is bounded by the calendar.
    """
    one = regressor.withColumn("_one", F.lit(1))
    padded = pad_daily(one, ["_one"], date, stop=F.date_add(date, ahead))
    run = Window.partitionBy("_one").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return padded.select(date, *[F.last(c, ignorenulls=True).over(run).alias(c) for c in regressor.columns if c != date])


def join_regressors(df: DataFrame, regressors: Sequence[DataFrame], date: str = "ds") -> DataFrame:
    """Left-join daily regressors by date."""
    out = df
    for r in regressors:
        out = out.join(by_day(r, date), date, "left")
    return out


def lagged_regressor(regressor: DataFrame, days: int, name: str, suffix: str = "_lag", date: str = "ds") -> DataFrame:
    """The regressor as known ``days`` later, lagged on its own calendar."""
    return regressor.select(F.date_add(date, days).alias(date), F.col(name).alias(name + suffix))


def with_non_working(df: DataFrame, holidays: Sequence[str], date: str = "ds", name: str = "non_working") -> DataFrame:
    """1.0 at weekends and on the listed holidays."""
    listed = F.col(date).isin(*[F.lit(h).cast("date") for h in holidays])
    return df.withColumn(name, non_working_flag(date, listed))


def recipe_frame(
    returns: DataFrame, regressors: Mapping[str, DataFrame], horizon: int = HORIZON_RECIPES,
    keys: Sequence[str] = ("entity_id",), target: str = "ret",
) -> DataFrame:
    """Target, lagged regressors and ma7 with future rows appended.

    Rows without ma7 (the first seven) or without the lagged regressors are left out, as
    future rows have no ma7 of their own they are kept.
    """
    history = with_pieces(returns, keys, "ds", lagged_mean(target)).where("ma7 IS NOT NULL")
    full = future_frame(history, keys, horizon)
    joined = join_regressors(
        full,
        [
            regressors["daily_1"],
            lagged_regressor(regressors["monthly"], REGRESSOR_LAGS["monthly"], "monthly"),
            lagged_regressor(regressors["daily_2"], REGRESSOR_LAGS["daily_2"], "daily_2"),
        ],
    )
    return joined.where("monthly_lag IS NOT NULL AND daily_2_lag IS NOT NULL").select(
        *keys, "ds", target, "monthly_lag", "daily_1", "daily_2_lag", "ma7"
    )


def quantile_frame(
    returns: DataFrame, regressors: Mapping[str, DataFrame], holidays: Sequence[str],
    horizon: int = HORIZON_QUANTILES, keys: Sequence[str] = ("entity_id",), target: str = "ret",
    train_until: Column | None = None,
) -> DataFrame:
    """Target, z-scored regressors and non-working flag with future rows appended.

    The z-scores use rows up to ``train_until`` (default: all rows, history and future).
    """
    names = ("daily_1", "daily_2", "monthly")
    full = future_frame(returns.select(*keys, "ds", target), keys, horizon)
    joined = with_non_working(join_regressors(full, [regressors[n] for n in names]), holidays)
    fit = joined if train_until is None else joined.where(F.col("ds") <= train_until)
    return standardize(joined, names, fit_on=fit).select(*keys, "ds", target, *names, "non_working")


def missing_covariates(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise when a covariate is unknown on a row that is to be predicted."""
    bad = df.agg(*[F.count(F.when(F.col(c).isNull(), True)).alias(c) for c in columns]).first()
    missing = {c: bad[c] for c in columns if bad[c]}
    if missing:
        raise ValueError(f"covariates unknown over the horizon (rows): {missing}")
