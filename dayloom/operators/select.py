"""Choosing live series and the main class of every entity.

The choices need only per-series facts (first and last date, last known values), so
they are made on source rows with map-side combined aggregates, before any padding.
No window runs over an entity: one entity may own a third of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators.padding import ALIVE_DAYS, extended_stop
from dayloom.session import newest

SERIES = ("entity_id", "class_id")
#: Type in which values are summed, so that the order of rows does not matter.
EXACT = "decimal(28,7)"


def last_known(value: str, date: str = "ds") -> Column:
    """Aggregate: the newest non-null value.

    Date and number are fixed-width, so the aggregate stays hash-based; a struct as the
    running maximum would make Spark sort all source rows first.
    """
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(date)))


def series_span(
    facts: DataFrame,
    keys: Sequence[str] = SERIES,
    date: str = "ds",
    alive_days: int | None = ALIVE_DAYS,
    global_max: Column | None = None,
    values: Sequence[str] = ("holders", "close_value", "units"),
) -> DataFrame:
    """One row per series: span, padded length and last known values."""
    gmax = newest(facts, date) if global_max is None else global_max
    span = facts.groupBy(*keys).agg(
        F.min(date).alias("first_ds"),
        F.max(date).alias("last_ds"),
        F.count(F.lit(1)).alias("n_rows"),
        *[last_known(v, date).alias(v) for v in values if v in facts.columns],
    )
    span = span.withColumn("_newest", gmax)  # the scalar is bound once and then used by name
    stop = F.col("last_ds") if alive_days is None else extended_stop("last_ds", F.col("_newest"), alive_days)
    return (
        span.withColumn("end_ds", stop)
        .withColumns(
            {
                "n_days": (F.datediff("end_ds", "first_ds") + 1).cast("bigint"),
                "alive": F.col("end_ds") == F.col("_newest"),
            }
        )
        .drop("_newest")
    )


def main_class(
    candidates: DataFrame,
    entity: str = "entity_id",
    klass: str = "class_id",
    holders: str = "holders",
    value: str = "close_value",
    need_holders: bool = True,
) -> DataFrame:
    """Per entity the class with most holders, then highest value, then lowest class id."""
    best = candidates.groupBy(entity).agg(
        F.min(F.struct((-F.col(holders)).alias("h"), (-F.col(value)).alias("v"), F.col(klass).alias(klass))).alias("b")
    )
    if need_holders:
        best = best.where(F.col("b.h") < 0)
    return best.select(entity, F.col(f"b.{klass}").alias(klass))


def active_entities(
    facts: DataFrame, keys: Sequence[str] = SERIES, date: str = "ds", min_days: int = 365,
    alive_days: int | None = ALIVE_DAYS,
) -> DataFrame:
    """Entities with a class at the newest date and a class longer than ``min_days``."""
    span = series_span(facts, keys, date, alive_days, values=())
    return (
        span.groupBy(keys[0])
        .agg(F.max("n_days").alias("longest"), F.max("alive").alias("alive"))
        .where(F.col("alive") & (F.col("longest") > min_days))
        .select(keys[0], "longest")
    )


def active_main_class(
    facts: DataFrame,
    keys: Sequence[str] = SERIES,
    date: str = "ds",
    min_days: int = 365,
    strict: bool = True,
    alive_days: int | None = ALIVE_DAYS,
    need_holders: bool = True,
    global_max: Column | None = None,
    length: str = "n_days",
) -> DataFrame:
    """The main class of every entity among classes that are alive and long enough.

    ``strict`` keeps series longer than ``min_days``, otherwise at least that long;
    ``length`` measures them in days of the padded grid or in source rows. A class whose carried values are still missing at the newest date is no candidate.
    """
    span = series_span(facts, keys, date, alive_days, global_max)
    long_enough = F.col(length) > min_days if strict else F.col(length) >= min_days
    known = [v for v in ("holders", "close_value", "units") if v in facts.columns]
    candidates = span.where(F.col("alive") & long_enough).na.drop(subset=known)
    return main_class(candidates, keys[0], keys[1], need_holders=need_holders)


def flag_main_class(df: DataFrame, chosen: DataFrame, keys: Sequence[str] = SERIES, name: str = "is_main") -> DataFrame:
    """1 on rows of the chosen class, else 0."""
    marked = chosen.select(*keys, F.lit(1).alias(name))
    return df.join(marked, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in a stated total order (map-side combined)."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def share_of_days(df: DataFrame, keys: Sequence[str], flag: Column, name: str = "activity") -> DataFrame:
    """Per key the share of rows on which ``flag`` holds."""
    return df.groupBy(*keys).agg(
        F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias(name), F.count(F.lit(1)).alias("n_days")
    )


def null_safe_sum(c: str) -> Column:
    """Sum that is NULL as soon as one value is NULL, in decimals so that the order of rows does not matter."""
    exact = F.sum(F.col(c).cast(EXACT)).cast("double")
    return F.when(F.count(c) == F.count(F.lit(1)), exact)
