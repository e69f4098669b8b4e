"""The fund feed expressed on the given order tables.

A supplier stands for an entity, the return flag for its share class, the ship date
for the day. Money is summed in whole hundredths or finer so that a sum does not
depend on the order of its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.measures import composite_key
from dayloom.session import newest

AS_OF = "2001-11-04"
CUT = "2001-06-30"
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        """The table of that name; listed and opened once."""
        if name.startswith("_"):
            raise AttributeError(name)
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        object.__setattr__(self, name, frame)
        return frame


def _whole(c: Column, scale: int) -> Column:
    return F.round(c * F.lit(float(scale))).cast("bigint")


def newest_day(t: Tables) -> Column:
    """The newest date of the panel, read from the date column of the source alone."""
    return newest(t.lineitem.select(F.col("l_shipdate").cast("date").alias("ds")))


def line_rows(t: Tables) -> DataFrame:
    """Line items with the parts of the entity key."""
    nation = t.nation.select("n_nationkey", "n_regionkey")
    supplier = t.supplier.select("s_suppkey", "s_nationkey", "s_name")
    return t.lineitem.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(
        nation, F.col("n_nationkey") == F.col("s_nationkey")
    )


def entity_key() -> Column:
    return composite_key("n_regionkey", "s_nationkey", F.col("s_suppkey") % 4, "s_suppkey")


def panel(t: Tables) -> DataFrame:
    """One row per (entity, class, day), typed and keyed like loaded facts."""
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    cents = _whole(price, 100)
    # Aggregated on the narrow supplier number; the text key is made on the result.
    daily = t.lineitem.groupBy(
        "l_suppkey", F.col("l_returnflag").alias("class_id"), F.col("l_shipdate").cast("date").alias("ds")
    ).agg(
        (F.sum(_whole(price * (disc - F.lit(0.045)), 100_000)) / F.lit(1e7)).alias("income"),
        (F.sum(cents) / F.lit(100.0)).alias("pre_close"),
        F.sum("l_quantity").alias("units"),
        (F.sum(_whole(price * (1 - tax), 10_000)) / F.lit(1e4)).alias("close_value"),
        F.sum("l_quantity").alias("holders"),
        (F.sum(F.when(F.col("l_linestatus") == "O", cents).otherwise(-cents)) / F.lit(1e5)).alias("net_flow"),
    )
    keys = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        "s_suppkey", entity_key().alias("entity_id")
    )
    # Checked: the key table is broadcast up to a row count, beyond it the join shuffles.
    # Without the hint the planner may broadcast the aggregate and stream the key table.
    if t.supplier.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return daily.join(keys, F.col("s_suppkey") == F.col("l_suppkey")).select(
        "entity_id", "class_id", "ds", "income", "pre_close", "units", "close_value", "holders", "net_flow"
    )


PANEL_SQL = """
panel AS (
  SELECT concat_ws('_', n.n_regionkey, s.s_nationkey, s.s_suppkey % 4, s.s_suppkey) AS entity_id,
         l.l_returnflag AS class_id,
         CAST(l.l_shipdate AS DATE) AS ds,
         CAST(SUM(CAST(ROUND(l.l_extendedprice * (l.l_discount - CAST(0.045 AS DOUBLE)) * CAST(100000 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / 1e7 AS income,
         CAST(SUM(CAST(ROUND(l.l_extendedprice * CAST(100 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / 100 AS pre_close,
         SUM(l.l_quantity) AS units,
         CAST(SUM(CAST(ROUND(l.l_extendedprice * (1 - l.l_tax) * CAST(10000 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / 1e4 AS close_value,
         SUM(l.l_quantity) AS holders,
         CAST(SUM(CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE -1 END
                  * CAST(ROUND(l.l_extendedprice * CAST(100 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / 1e5 AS net_flow
  FROM lineitem l
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  GROUP BY ALL
)"""

# Padded, carried and extended panel: own-range grid, then the common end for series
# alive in the last four weeks.
CLEAN_SQL = (
    PANEL_SQL
    + """,
span AS (
  SELECT entity_id, class_id, MIN(ds) AS first_ds, MAX(ds) AS last_ds
  FROM panel GROUP BY ALL
),
grid AS (
  SELECT entity_id, class_id,
         CAST(UNNEST(generate_series(first_ds,
              CASE WHEN last_ds >= (SELECT MAX(ds) FROM panel) - 28 THEN (SELECT MAX(ds) FROM panel) ELSE last_ds END,
              INTERVAL 1 DAY)) AS DATE) AS ds
  FROM span
),
filled AS (
  SELECT g.entity_id, g.class_id, g.ds, p.income, p.pre_close, p.net_flow,
         LAST_VALUE(p.units IGNORE NULLS) OVER w AS units,
         LAST_VALUE(p.close_value IGNORE NULLS) OVER w AS close_value,
         LAST_VALUE(p.holders IGNORE NULLS) OVER w AS holders
  FROM grid g LEFT JOIN panel p USING (entity_id, class_id, ds)
  WINDOW w AS (PARTITION BY g.entity_id, g.class_id ORDER BY g.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
clean AS (
  SELECT entity_id, class_id, ds, COALESCE(income, 0) AS income, COALESCE(pre_close, close_value) AS pre_close,
         units, close_value, holders, COALESCE(net_flow, 0) AS net_flow
  FROM filled
)"""
)

# Main class of every live entity longer than a year, with the daily growth factor.
MAIN_SQL = (
    CLEAN_SQL
    + """,
sized AS (
  SELECT *, COUNT(*) OVER (PARTITION BY entity_id, class_id) AS n_series,
         MAX(ds) OVER (PARTITION BY entity_id, class_id) AS series_end
  FROM clean
),
long_enough AS (
  SELECT * FROM sized WHERE series_end = (SELECT MAX(ds) FROM clean) AND n_series > 365
),
main_class AS (
  SELECT entity_id, class_id FROM (
    SELECT entity_id, class_id, holders,
           ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY holders DESC, close_value DESC, class_id) AS rn
    FROM long_enough WHERE ds = (SELECT MAX(ds) FROM clean)
  ) WHERE rn = 1 AND holders > 0
),
main_panel AS (
  SELECT entity_id, class_id, ds, ROUND(income, 1) AS income, ROUND(pre_close, 1) AS pre_close,
         units, close_value, holders, net_flow,
         CASE WHEN ROUND(pre_close, 1) - ROUND(income, 1) = 0 THEN 1.0
              ELSE ROUND(pre_close, 1) / (ROUND(pre_close, 1) - ROUND(income, 1)) END AS growth
  FROM long_enough SEMI JOIN main_class USING (entity_id, class_id)
)"""
)
