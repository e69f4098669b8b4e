"""Tabular scans with stated schemas, and the Parquet sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.dates import day_first_date


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    date_columns: Sequence[str] = (),
    day_first: bool = False,
) -> DataFrame:
    """Scan a sheet exported as CSV; date columns arrive as text and are parsed here."""
    df = spark.read.csv(path, schema=schema, header=True)
    parse = day_first_date if day_first else (lambda c: F.to_date(F.try_to_timestamp(F.col(c))))
    return df.withColumns({c: parse(c) for c in date_columns}) if date_columns else df


def write_star(facts: DataFrame, dims: DataFrame, folder: str, mode: str = "overwrite") -> dict[str, str]:
    """Write the fact and the dimension table; returns their paths."""
    paths = {"facts": f"{folder}/facts", "dims": f"{folder}/dims"}
    facts.write.mode(mode).parquet(paths["facts"])
    dims.write.mode(mode).parquet(paths["dims"])
    return paths
