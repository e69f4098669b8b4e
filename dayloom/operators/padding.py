"""Daily grids: padding gaps, carrying values forward, future rows.

A series is one (entity, class). After the source holds one row per series and
day, a series has at most as many rows as the calendar has days, so a window over
a series is bounded however large the panel gets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.dates import month_ceiling
from dayloom.session import newest, spread

CARRIED = ("close_value", "units", "holders")
ZEROED = ("income", "net_flow")
ALIVE_DAYS = 28
#: Days of a block: as many as a 64-bit mask has bits.
BLOCK_DAYS = 64


def _until_next(date: str, nxt: Column, stop: Column) -> Column:
    """Last day a source row stands for: the day before the next row, else ``stop``."""
    last = F.when(nxt.isNotNull(), F.date_sub(nxt, 1)).otherwise(stop)
    return F.greatest(last, F.col(date))


def extended_stop(date: Column | str, global_max: Column, alive_days: int = ALIVE_DAYS) -> Column:
    """End of a series: the newest date when it was alive in the last weeks, else its own end."""
    d = F.col(date) if isinstance(date, str) else date
    return F.when(d >= F.date_sub(global_max, alive_days), global_max).otherwise(d)


def pad_daily(
    df: DataFrame, keys: Sequence[str], date: str = "ds", stop: Column | None = None
) -> DataFrame:
    """One row per day from the first to the last date of each series; new rows hold NULL.

    ``stop`` may give a later end, evaluated on the last row of the series. Only
    source rows are shuffled; the days are produced after the exchange.
    """
    own = Window.partitionBy(*keys).orderBy(date)
    measures = [c for c in df.columns if c not in {*keys, date}]
    spanned = spread(df, keys).withColumn("_next", F.lead(date).over(own)).select(
        *df.columns,
        _until_next(date, F.col("_next"), F.col(date) if stop is None else stop).alias("_until"),
    )
    days = spanned.select(
        *df.columns, F.posexplode(F.sequence(date, "_until")).alias("_offset", "_day")
    )
    return days.select(
        *[
            F.col("_day").alias(c) if c == date
            else F.col(c) if c in keys
            else F.when(F.col("_offset") == 0, F.col(c)).alias(c)
            for c in [*keys, date, *measures]
        ]
    )


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    date: str = "ds",
    carried: Sequence[str] = CARRIED,
    zeroed: Sequence[str] = ZEROED,
    fallback: tuple[str, str] | None = ("pre_close", "close_value"),
) -> DataFrame:
    """Last known value for ``carried``, 0 for ``zeroed``, and one column filled from another."""
    run = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    present = set(df.columns)
    out = df.withColumns(
        {c: F.last(c, ignorenulls=True).over(run) for c in carried if c in present}
    ).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zeroed if c in present})
    if fallback and fallback[0] in present:
        out = out.withColumn(fallback[0], F.coalesce(F.col(fallback[0]), F.col(fallback[1])))
    return out


def _known_spans(
    facts: DataFrame, keys: Sequence[str], date: str, alive_days: int, gmax: Column, carried: Sequence[str], already_spread: bool = False
) -> DataFrame:
    """Source rows with carried values and ``_until``, the last day each of them stands for."""
    own = Window.partitionBy(*keys).orderBy(date)
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    source = facts if already_spread else spread(facts, keys)
    known = source.select(
        *[c for c in facts.columns if c not in carried],
        *[F.last(c, ignorenulls=True).over(run).alias(c) for c in carried],
        F.lead(date).over(own).alias("_next"),
        gmax.alias("_newest"),  # the scalar is bound once
    )
    until = _until_next(date, F.col("_next"), extended_stop(date, F.col("_newest"), alive_days))
    return known.select(*facts.columns, until.alias("_until"))


def _shaped(c: str, real: Column, keys: Sequence[str], date: str, carried: Sequence[str], zeroed: Sequence[str], fallback: tuple[str, str] | None, zero: Column) -> Column:
    """Column ``c`` on the day ``_day`` of a span; ``real`` holds on the day of the source row."""
    if c == date:
        return F.col("_day").alias(c)
    if c in zeroed:
        return F.when(real, F.coalesce(F.col(c), zero)).otherwise(zero).alias(c)
    if fallback and c == fallback[0]:
        return F.coalesce(F.when(real, F.col(c)), F.col(fallback[1])).alias(c)
    if c in keys or c in carried:
        return F.col(c)
    return F.when(real, F.col(c)).alias(c)


def clean_panel(
    facts: DataFrame,
    keys: Sequence[str] = ("entity_id", "class_id"),
    date: str = "ds",
    alive_days: int = ALIVE_DAYS,
    global_max: Column | None = None,
    carried: Sequence[str] = CARRIED,
    zeroed: Sequence[str] = ZEROED,
    fallback: tuple[str, str] | None = ("pre_close", "close_value"),
    already_spread: bool = False,
) -> DataFrame:
    """Padded, carried and extended panel in one pass.

    Values are carried on the source rows before the days are produced: the window
    then sorts source rows only, not the many times larger padded rows. Pass
    ``already_spread`` when ``facts`` is hashed by ``keys`` (see :func:`spread`).
    """
    gmax = newest(facts, date) if global_max is None else global_max
    present = [c for c in facts.columns if c not in {*keys, date}]
    carried = [c for c in carried if c in present]
    zeroed = [c for c in zeroed if c in present]
    spans = _known_spans(facts, keys, date, alive_days, gmax, carried, already_spread)
    days = spans.select(*facts.columns, F.posexplode(F.sequence(F.col(date), F.col("_until"))).alias("_offset", "_day"))
    real = F.col("_offset") == 0
    return days.select(*[_shaped(c, real, keys, date, carried, zeroed, fallback, F.lit(0.0)) for c in facts.columns])


def _blocks(first: Column, last: Column) -> Column:
    """Array of the numbers of the blocks of ``BLOCK_DAYS`` days from ``first`` to ``last``."""
    return F.sequence(*[F.floor(F.unix_date(d) / BLOCK_DAYS).cast("int") for d in (first, last)])


def summed_panel(
    facts: DataFrame,
    keys: Sequence[str],
    date: str,
    measures: Sequence[str],
    total: Callable[[str], Column],
    unit: str,
    alive_days: int = ALIVE_DAYS,
    global_max: Column | None = None,
) -> DataFrame:
    """``total`` of each measure over the rows of :func:`clean_panel` of all series of ``keys[0]`` on each day.

    Spans of days are cut at blocks of ``BLOCK_DAYS`` days and hashed by (entity, block) before the days are
    produced, so that no padded row is shuffled and an entity with very many rows still meets many tasks.
    Measures are cast to ``unit``, the type in which they are summed, once a source row instead of once a day.
    """
    entity = keys[0]
    gmax = newest(facts, date) if global_max is None else global_max
    facts = facts.select(*keys, date, *[c for c in facts.columns if c in measures])
    present = [c for c in facts.columns if c not in {*keys, date}]
    carried, zeroed = [c for c in CARRIED if c in present], [c for c in ZEROED if c in present]
    spans = _known_spans(facts, keys, date, alive_days, gmax, carried)
    cut = spans.select(*keys, date, "_until", *present, F.explode(_blocks(F.col(date), F.col("_until"))).alias("_block"))
    cut = spread(cut, [entity, "_block"]).withColumns({c: F.col(c).cast(unit) for c in present})
    own = F.date_from_unix_date(F.col("_block") * BLOCK_DAYS)
    in_block = F.sequence(F.greatest(F.col(date), own), F.least(F.col("_until"), F.date_add(own, BLOCK_DAYS - 1)))
    days = cut.select(*facts.columns, "_block", F.explode(in_block).alias("_day"))
    real, zero = F.col("_day") == F.col(date), F.lit(0).cast(unit)
    shaped = days.select("_block", *[_shaped(c, real, keys, date, carried, zeroed, ("pre_close", "close_value"), zero) for c in facts.columns])
    return shaped.groupBy(entity, "_block", date).agg(*[total(m).alias(m) for m in measures]).drop("_block")


def days_covered(
    facts: DataFrame, keys: Sequence[str], date: str, alive_days: int = ALIVE_DAYS, global_max: Column | None = None, name: str = "n"
) -> DataFrame:
    """Per ``keys[0]`` the number of days on which one of its padded series has a row.

    A padded series has no gaps, so its first and last day tell; a block of days of an entity is one 64-bit mask.
    """
    gmax = newest(facts, date) if global_max is None else global_max
    spans = facts.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.min(date).alias("_first"), F.max(date).alias("_last")).withColumn("_newest", gmax)
    spans = spans.withColumn("_end", F.greatest(extended_stop("_last", F.col("_newest"), alive_days), F.col("_last")))
    cut = spans.select(keys[0], "_first", "_end", F.explode(_blocks(F.col("_first"), F.col("_end"))).alias("_block"))
    own = F.col("_block") * BLOCK_DAYS
    low = F.greatest(F.unix_date("_first") - own, F.lit(0))
    high = F.least(F.unix_date("_end") - own, F.lit(BLOCK_DAYS - 1))
    # bits low to high: shifts by a column are calls by name
    mask = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(63) - (high - low)), low)
    masks = cut.select(keys[0], "_block", mask.alias("_m")).groupBy(keys[0], "_block").agg(F.bit_or("_m").alias("_m"))
    return masks.groupBy(keys[0]).agg(F.sum(F.bit_count("_m")).alias(name))


def monthly_to_daily(df: DataFrame, date: str = "ds", keys: Sequence[str] = ()) -> DataFrame:
    """Monthly rows repeated daily until the next one, up to the end after the newest month.

    The frame is a regressor calendar: without keys it has one row per month, so the
    ordering over it is bounded by the length of the calendar.
    """
    stop = month_ceiling(newest(df, date))
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    nxt = F.lead(date).over(spec.orderBy(date))
    spanned = df.withColumn("_next", nxt).select(
        *df.columns, _until_next(date, F.col("_next"), stop).alias("_until")
    )
    values = [c for c in df.columns if c != date]
    return spanned.select(*values, F.explode(F.sequence(date, "_until")).alias(date)).select(*df.columns)


def future_frame(
    df: DataFrame, keys: Sequence[str], horizon: int, date: str = "ds", bind: bool = True
) -> DataFrame:
    """The next ``horizon`` days of every series; appended to the history when ``bind``.

    Appended days are produced from the last row of a series, so the history is computed once.
    """
    if not bind:
        ends = df.groupBy(*keys).agg(F.max(date).alias("_end"))
        ahead = F.explode(F.sequence(F.date_add("_end", 1), F.date_add("_end", horizon)))
        return ends.select(*keys, ahead.alias(date))
    after = F.lead(F.lit(True)).over(Window.partitionBy(*keys).orderBy(date))  # the newest date comes last, a null one first
    last = after.isNull() & F.col(date).isNotNull()
    steps = F.when(F.col("_ends"), F.sequence(F.lit(0), F.lit(horizon))).otherwise(F.array(F.lit(0)))
    days = df.withColumn("_ends", last).select(*df.columns, F.explode(steps).alias("_ahead"))
    own = F.col("_ahead") == 0
    return days.select(
        *[
            F.col(c) if c in keys
            else F.when(own, F.col(c)).otherwise(F.date_add(date, F.col("_ahead"))).alias(c) if c == date
            else F.when(own, F.col(c)).alias(c)
            for c in df.columns
        ]
    )
