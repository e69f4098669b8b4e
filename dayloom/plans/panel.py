"""From fact rows to the panel with risk and return metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.measures import growth_factor, growth_return, with_rounded
from dayloom.operators import rolling
from dayloom.operators.padding import ALIVE_DAYS, clean_panel, days_covered, summed_panel
from dayloom.operators.select import EXACT, active_main_class, null_safe_sum
from dayloom.session import newest, spread

SERIES = ("entity_id", "class_id")
MEASURES = ("income", "pre_close", "units", "close_value", "holders", "net_flow")


def with_growth(df: DataFrame, name: str = "growth", as_return: bool = False) -> DataFrame:
    """Round income and value to one decimal, then take the daily factor or return."""
    ratio = growth_return if as_return else growth_factor
    return with_rounded(df, ["income", "pre_close"], 1).withColumn(name, ratio("pre_close", "income"))


def main_class_panel(
    facts: DataFrame,
    keys: Sequence[str] = SERIES,
    date: str = "ds",
    min_days: int = 365,
    strict: bool = True,
    alive_days: int = ALIVE_DAYS,
    as_return: bool = False,
    global_max: Column | None = None,
) -> DataFrame:
    """Daily growth of the main class of every live entity.

    The class is chosen on source rows, so only the chosen series are padded. The fact
    rows are shuffled once; join, padding and later metric windows share the exchange.
    ``global_max`` may give the newest date from a cheaper source than ``facts``.
    """
    gmax = newest(facts, date) if global_max is None else global_max
    chosen = active_main_class(facts, keys, date, min_days, strict, alive_days, global_max=gmax)
    kept = spread(facts, keys).join(chosen, list(keys), "left_semi")
    panel = clean_panel(kept, keys, date, alive_days, global_max=gmax, already_spread=True)
    return with_growth(panel, as_return=as_return).withColumn("max_ds", gmax)


def entity_panel(
    facts: DataFrame,
    keys: Sequence[str] = SERIES,
    date: str = "ds",
    min_days: int = 365,
    alive_days: int = ALIVE_DAYS,
    measures: Sequence[str] = MEASURES,
    global_max: Column | None = None,
) -> DataFrame:
    """All classes of an entity summed per day; entities with at least ``min_days`` days.

    The length test needs the first and last day of each series only, so entities are chosen
    before anything is padded; padded rows are summed where they are produced.
    """
    entity = keys[0]
    gmax = newest(facts, date) if global_max is None else global_max
    long_enough = days_covered(facts, keys, date, alive_days, gmax).where(F.col("n") >= min_days).select(entity)
    kept = facts.join(long_enough, entity, "left_semi")
    return with_growth(summed_panel(kept, keys, date, measures, null_safe_sum, EXACT, alive_days, gmax))


def calendar_rows(facts: DataFrame, date: str = "ds") -> int:
    """Days between the first and the newest date: no padded series is longer."""
    row = facts.agg(F.datediff(F.max(date), F.min(date)).alias("d")).first()
    return int(row["d"] or 0) + 1


def risk_return_metrics(
    panel: DataFrame,
    keys: Sequence[str] = SERIES,
    date: str = "ds",
    periods: Sequence[int] = rolling.HORIZONS,
    series_rows: int | None = None,
) -> DataFrame:
    """Rolling return, volatility, moving average, return to risk, and net-flow ratio.

    Every window metric runs over the same specification, in three stacked passes.
    ``series_rows`` bounds the length of a series and decides how averages are computed.
    """
    base = with_rounded(panel, ["net_flow"], 1)
    short = [n for n in periods if rolling.closed_form_fits(n, series_rows)]
    long = [n for n in periods if n not in short]
    makers = [
        rolling.compounded_return("growth", rolling.annualised_horizons(periods)),
        rolling.volatility("growth", periods),
        rolling.flow_ratio("net_flow", "close_value", 30),
    ]
    if short:
        makers.append(rolling.exponential_average("growth", short, shift=-1.0))
    out = rolling.with_pieces(base, keys, date, *makers)
    if long:
        out = rolling.exponential_average_long(out, keys, date, "growth", long, shift=-1.0)
    return with_cover(out, periods)


def with_cover(df: DataFrame, periods: Sequence[int] = rolling.HORIZONS) -> DataFrame:
    """Return over volatility; NULL where the volatility is zero."""
    return df.withColumns(
        {f"cover_{p}": F.try_divide(F.col(f"rent_{p}"), F.col(f"vol_{p}")) for p in periods}
    )


def extended_panel(
    facts: DataFrame, main_only: bool = True, keys: Sequence[str] = SERIES, date: str = "ds",
    global_max: Column | None = None, series_rows: int | None = None,
) -> DataFrame:
    """Panel with all metrics, for main classes or for entities summed over classes.

    ``global_max`` and ``series_rows`` may be given from a cheaper source than ``facts``.
    """
    rows = calendar_rows(facts, date) if series_rows is None else series_rows
    if main_only:
        return risk_return_metrics(main_class_panel(facts, keys, date, global_max=global_max), keys, date, series_rows=rows)
    return risk_return_metrics(entity_panel(facts, keys, date, global_max=global_max), keys[:1], date, series_rows=rows)


def since(df: DataFrame, start: Column, date: str = "ds") -> DataFrame:
    return df.where(F.col(date) > start)
