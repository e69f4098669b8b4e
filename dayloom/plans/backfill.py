"""Fill missing fact rows from a second, spreadsheet-shaped source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.dates import day_first_date, month_start, months_before
from dayloom.functions.measures import annual_percent_to_daily, category_code, clean_number, joined_text
from dayloom.functions.names import EXCLUDED_PRODUCT
from dayloom.operators.rolling import series_window

SERIES = ("entity_id", "class_id")

# Product labels of the second source and their subtype codes.
PRODUCT_CODES = {
    "FIC BURSATILES": 1,
    "FIC DE MERCADO MONETARIO": 2,
    "FIC INMOBILIARIAS": 3,
    "FIC DE TIPO GENERAL": 1,
}


def type_second_source(raw: DataFrame, codes: Mapping[str, int] = PRODUCT_CODES, excluded: str = EXCLUDED_PRODUCT) -> DataFrame:
    """Text rows to (entity, class, day, value, holders, daily factor)."""
    return raw.where(F.col("product") != excluded).select(
        day_first_date("day_text").alias("ds"),
        joined_text("entity_type", "entity_code", category_code("product", codes), "business_code", sep="_").alias("entity_id"),
        joined_text("class_type", "class_number").alias("class_id"),
        clean_number("value_text").alias("close_value"),
        F.col("holders_text").try_cast("double").alias("holders"),
        annual_percent_to_daily(F.col("rate_text").try_cast("double")).alias("factor"),
    )


def derive_income(typed: DataFrame, keys: Sequence[str] = SERIES, date: str = "ds") -> DataFrame:
    """Value before flows and income from the quoted rate and the day before; first rows dropped."""
    w = series_window(keys, date)
    before = F.col("_before")
    return (
        typed.withColumns({"_before": F.lag("close_value").over(w), "_rn": F.row_number().over(w)})
        .where("_rn > 1")
        .withColumn("pre_close", before * F.col("factor"))
        .withColumn("income", F.col("pre_close") - before)
        .select(*keys, date, "income", "pre_close", "close_value", "holders")
    )


def backfill_union(
    base: DataFrame, second_raw: DataFrame, as_of: Column, codes: Mapping[str, int] = PRODUCT_CODES,
    keys: Sequence[str] = SERIES, date: str = "ds",
) -> DataFrame:
    """Base rows plus second-source rows of live series that the base does not have."""
    cols = [*keys, date, "income", "pre_close", "close_value", "holders"]
    alive = base.where(F.col(date) >= month_start(months_before(as_of, 1))).select(*keys).distinct()
    extra = (
        derive_income(type_second_source(second_raw, codes), keys, date)
        .join(alive, list(keys), "left_semi")
        .join(base.select(*keys, date), [*keys, date], "left_anti")
    )
    return base.select(*cols).unionByName(extra.select(*cols))
