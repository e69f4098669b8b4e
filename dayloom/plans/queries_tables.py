"""Catalogue: scalar functions, joins, set operations, reshapes, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions import dates, measures
from dayloom.operators import quantiles, reshape, rolling, select
from dayloom.operators.scaling import standardize
from dayloom.plans import backfill, standins
from dayloom.plans.catalog import query, rounded, rsql
from dayloom.plans.features import by_day
from dayloom.plans.queries_panel import METRICS_SQL, SERIES, main_panel, metrics
from dayloom.plans.standins import AS_OF, MAIN_SQL, PANEL_SQL, Tables
from dayloom.session import newest, shared_path
from dayloom.sources.tables import read_csv

HOLIDAYS = [f"{y}-{d}" for y in range(1995, 2002) for d in ("01-01", "05-01", "12-25")]
_HOLIDAY_SQL = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)


@query(
    "numeric_text_clean",
    """
SELECT o_orderkey, o_totalprice AS value, CAST(NULL AS DOUBLE) AS broken FROM orders
""",
)
def numeric_text_clean(t: Tables) -> DataFrame:
    """Formatted money text back to numbers; text without digits gives NULL."""
    text = F.format_string("USD %,.2f", F.col("o_totalprice"))
    return t.orders.select(
        "o_orderkey", measures.clean_number(text).alias("value"),
        measures.clean_number(F.col("o_orderstatus")).alias("broken"),
    )


@query(
    "category_code_map",
    f"""
SELECT l_orderkey, l_linenumber,
       CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS DOUBLE) AS code,
       ROUND(pow(1 + l_discount, 1.0 / 365), 9) AS factor
FROM lineitem
""",
)
def category_code_map(t: Tables) -> DataFrame:
    """Label to code (unlisted labels NULL) and annual percent to daily factor."""
    out = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        measures.category_code("l_returnflag", {"A": 1, "R": 2}).cast("double").alias("code"),
        measures.annual_percent_to_daily(F.col("l_discount") * 100).alias("factor"),
    )
    return rounded(out, "factor", digits=9)


@query(
    "calendar_flags",
    f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds FROM orders)
SELECT o_orderkey, ds,
       CAST(date_trunc('month', ds) AS DATE) AS month_start, CAST(date_trunc('year', ds) AS DATE) AS year_start,
       CAST(date_trunc('month', ds) + INTERVAL 1 MONTH AS DATE) AS month_ceiling,
       CAST(ds - INTERVAL 13 MONTH AS DATE) AS months_13, CAST(ds - INTERVAL 28 DAY AS DATE) AS weeks_4,
       CAST(isodow(ds) AS INTEGER) AS wday,
       CASE WHEN isodow(ds) IN (6, 7) OR ds IN ({_HOLIDAY_SQL}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS non_working,
       ds AS day_first, CAST(date_trunc('month', ds) AS DATE) AS partial
FROM d
""",
)
def calendar_flags(t: Tables) -> DataFrame:
    """Parsing, truncation, date arithmetic, weekday and non-working flags of order dates."""
    d = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ds"))
    return d.select(
        "o_orderkey", "ds",
        dates.month_start("ds").alias("month_start"), dates.year_start("ds").alias("year_start"),
        dates.month_ceiling("ds").alias("month_ceiling"),
        dates.months_before("ds", 13).alias("months_13"), dates.weeks_before("ds", 4).alias("weeks_4"),
        dates.iso_weekday("ds").alias("wday"),
        dates.non_working_flag("ds", dates.in_days("ds", HOLIDAYS)).alias("non_working"),
        dates.day_first_date(F.date_format("ds", "dd/MM/yyyy")).alias("day_first"),
        dates.partial_date(F.date_format("ds", "yyyy-MM")).alias("partial"),
    )


@query(
    "project_rename",
    """
SELECT c_custkey AS holder_id, c_mktsegment AS segment, c_acctbal AS balance FROM customer
""",
)
def project_rename(t: Tables) -> DataFrame:
    """Column drop, rename and reorder."""
    out = t.customer.drop("c_name", "c_nationkey").withColumnsRenamed(
        {"c_custkey": "holder_id", "c_mktsegment": "segment", "c_acctbal": "balance"}
    )
    return out.select("holder_id", "segment", "balance")


@query(
    "as_of_window",
    f"""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds FROM orders)
SELECT o_orderkey, ds, ds BETWEEN DATE '{AS_OF}' - INTERVAL 24 MONTH AND DATE '{AS_OF}' AS in_two_years,
       ds BETWEEN DATE '1996-01-01' AND DATE '{AS_OF}' AS in_five_years
FROM d
""",
)
def as_of_window(t: Tables) -> DataFrame:
    """Membership in the default two-year and five-year windows before a stated date."""
    as_of = F.lit(AS_OF).cast("date")
    return t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ds")).select(
        "*",
        F.col("ds").between(*dates.two_year_window(as_of)).alias("in_two_years"),
        F.col("ds").between(*dates.five_year_window(as_of)).alias("in_five_years"),
    )


@query("csv_scan", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds, o_totalprice FROM orders")
def csv_scan(t: Tables) -> DataFrame:
    """A sheet written as CSV with day-first dates and scanned with a stated schema."""
    path = shared_path(t.spark, "sheet")
    t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("ds"), "o_totalprice").write.csv(path, header=True)
    schema = T.StructType(
        [T.StructField("o_orderkey", T.LongType()), T.StructField("ds", T.StringType()), T.StructField("o_totalprice", T.DoubleType())]
    )
    return read_csv(t.spark, path, schema, ["ds"], day_first=True)


@query(
    "null_fill",
    """
WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a, c_mktsegment FROM customer)
SELECT c_custkey, COALESCE(a, 0) AS zero_filled, COALESCE(a, c_custkey) AS other_filled,
       a IS NULL AS missing, COALESCE(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'none') AS label
FROM d
""",
)
def null_fill(t: Tables) -> DataFrame:
    """Missing values filled with a constant or another column, and the missing flag."""
    d = t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("label"),
    )
    return d.na.fill({"label": "none"}).select(
        "c_custkey", F.coalesce("a", F.lit(0.0)).alias("zero_filled"),
        F.coalesce("a", "c_custkey").alias("other_filled"), F.col("a").isNull().alias("missing"), "label",
    )


@query(
    "null_check",
    """
SELECT bool_or(c_custkey IS NULL) AS c_custkey, bool_or(a IS NULL) AS a, FALSE AS b
FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a FROM customer)
""",
)
def null_check(t: Tables) -> DataFrame:
    """One row telling per column whether any value is missing."""
    return reshape.any_missing(
        t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.col("c_acctbal").alias("b"))
    )


@query(
    "distinct_rows",
    """
SELECT o_orderstatus, o_orderpriority, MIN(o_orderkey) AS first_order FROM orders GROUP BY ALL
""",
)
def distinct_rows(t: Tables) -> DataFrame:
    """Distinct rows joined with the first row per key in a stated order."""
    pairs = t.orders.select("o_orderstatus", "o_orderpriority").distinct()
    first = select.first_by(
        t.orders.select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("first_order")),
        ["o_orderstatus", "o_orderpriority"], ["first_order"],
    )
    return pairs.join(first, ["o_orderstatus", "o_orderpriority"])


@query(
    "scalar_flags",
    """
SELECT o_orderkey, o_totalprice <> 0 AS moved, ROUND(sqrt(o_totalprice), 6) AS root,
       ROUND(pow(1 + o_totalprice / 1e6, 365.0 / 30) - 1, 6) AS annual,
       CASE WHEN o_orderstatus = 'O' THEN 'prediction' ELSE 'actual' END AS key,
       CAST(o_custkey AS VARCHAR) AS label
FROM orders
""",
)
def scalar_flags(t: Tables) -> DataFrame:
    """Activity flag, root and power, conditional label, id as category label."""
    out = t.orders.select(
        "o_orderkey", measures.moved("o_totalprice").alias("moved"), F.sqrt("o_totalprice").alias("root"),
        (F.pow(1 + F.col("o_totalprice") / 1e6, F.lit(365.0 / 30)) - 1).alias("annual"),
        F.when(F.col("o_orderstatus") == "O", "prediction").otherwise("actual").alias("key"),
        F.col("o_custkey").cast("string").alias("label"),
    )
    return rounded(out, "root", "annual")


@query(
    "name_cleanup",
    """
SELECT p_partkey, upper(trim(p_name)) AS name, p_brand || '_' || p_type AS label,
       trim(regexp_replace(upper(p_type), 'STEEL|BRASS|TIN', '', 'g')) AS short_type
FROM part
""",
)
def name_cleanup(t: Tables) -> DataFrame:
    """Upper case, trim, null-propagating paste, phrase removal."""
    return t.part.select(
        "p_partkey", F.upper(F.trim("p_name")).alias("name"),
        measures.joined_text("p_brand", "p_type", sep="_").alias("label"),
        F.trim(F.regexp_replace(F.upper("p_type"), "STEEL|BRASS|TIN", "")).alias("short_type"),
    )


REGRESSOR_SQL = """
daily_1 AS (
  SELECT CAST(o_orderdate AS DATE) AS ds, CAST(SUM(CAST(ROUND(o_totalprice * 100.0::DOUBLE) AS BIGINT)) AS DOUBLE) / COUNT(*) AS daily_1
  FROM orders GROUP BY 1
),
daily_2 AS (
  SELECT CAST(l_shipdate AS DATE) AS ds, CAST(SUM(CAST(ROUND(l_extendedprice * 100.0::DOUBLE) AS BIGINT)) AS DOUBLE) / COUNT(*) AS daily_2
  FROM lineitem GROUP BY 1
),
months AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(SUM(CAST(ROUND(o_totalprice * 100.0::DOUBLE) AS BIGINT)) AS DOUBLE) / COUNT(*) AS monthly
  FROM orders GROUP BY 1
),
month_end AS (SELECT ds, monthly, COALESCE(LEAD(ds) OVER (ORDER BY ds) - 1, CAST(ds + INTERVAL 1 MONTH AS DATE)) AS until FROM months),
monthly AS (SELECT CAST(UNNEST(generate_series(ds, until, INTERVAL 1 DAY)) AS DATE) AS ds, monthly FROM month_end)"""


def _daily_mean(df: DataFrame, date: str, value: str, name: str) -> DataFrame:
    cents = F.round(F.col(value) * 100.0).cast("bigint")
    return df.groupBy(F.col(date).cast("date").alias("ds")).agg((F.sum(cents) / F.count(F.lit(1))).alias(name))


def monthly_rows(t: Tables) -> DataFrame:
    months = t.orders.withColumn("m", dates.month_start("o_orderdate"))
    return _daily_mean(months, "m", "o_totalprice", "monthly")


def regressors(t: Tables) -> dict[str, DataFrame]:
    from dayloom.operators.padding import monthly_to_daily

    return {
        "daily_1": _daily_mean(t.orders, "o_orderdate", "o_totalprice", "daily_1"),
        "daily_2": _daily_mean(t.lineitem, "l_shipdate", "l_extendedprice", "daily_2"),
        "monthly": monthly_to_daily(monthly_rows(t)),
    }


@query(
    "regressor_join",
    f"""
WITH {PANEL_SQL}, {REGRESSOR_SQL}
SELECT p.entity_id, p.class_id, p.ds, {rsql('daily_1', 'daily_2', 'monthly')}
FROM panel p LEFT JOIN daily_1 USING (ds) LEFT JOIN daily_2 USING (ds) LEFT JOIN monthly USING (ds)
""",
)
def regressor_join(t: Tables) -> DataFrame:
    """Facts left-joined with three regressor calendars."""
    out = standins.panel(t).select(*SERIES, "ds")
    for r in regressors(t).values():
        out = out.join(by_day(r), "ds", "left")
    return rounded(out, "daily_1", "daily_2", "monthly")


def fixed_clusters(t: Tables) -> DataFrame:
    """A given assignment table: supplier number modulo five."""
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return s.select(standins.entity_key().alias("entity_id"), (F.col("s_suppkey") % 5).cast("int").alias("cluster"))


CLUSTER_SQL = """
clusters AS (
  SELECT concat_ws('_', n_regionkey, s_nationkey, s_suppkey % 4, s_suppkey) AS entity_id, CAST(s_suppkey % 5 AS INTEGER) AS cluster
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
)"""


@query(
    "common_key_join",
    f"WITH {PANEL_SQL}, {CLUSTER_SQL} SELECT entity_id, class_id, ds, cluster FROM panel LEFT JOIN clusters USING (entity_id)",
)
def common_key_join(t: Tables) -> DataFrame:
    """Left join on the common columns, named explicitly."""
    return standins.panel(t).select(*SERIES, "ds").join(fixed_clusters(t), "entity_id", "left")


@query("cluster_sizes", f"WITH {CLUSTER_SQL} SELECT cluster, COUNT(*) AS n FROM clusters GROUP BY cluster")
def cluster_sizes(t: Tables) -> DataFrame:
    """Entities per cluster of an assignment."""
    return fixed_clusters(t).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    "actual_vs_pred",
    f"""
WITH {MAIN_SQL},
pred AS (SELECT entity_id, CAST(ds + INTERVAL 7 DAY AS DATE) AS ds, growth - 1 AS pred FROM main_panel)
SELECT m.entity_id, m.ds, ROUND(m.growth - 1, 9) + 0.0 AS actual, ROUND(pred, 9) + 0.0 AS pred
FROM main_panel m JOIN pred USING (entity_id, ds)
""",
)
def actual_vs_pred(t: Tables) -> DataFrame:
    """Inner join of actual values with predictions made for the same day."""
    actual = main_panel(t).select("entity_id", "ds", (F.col("growth") - 1).alias("actual"))
    pred = actual.select("entity_id", F.date_add("ds", 7).alias("ds"), F.col("actual").alias("pred"))
    return rounded(actual.join(pred, ["entity_id", "ds"]), "actual", "pred", digits=9)


@query(
    "param_grid",
    f"""
WITH {CLUSTER_SQL}
SELECT entity_id, CAST(a.subset AS INTEGER) AS subset, CAST(b.k AS INTEGER) AS k
FROM clusters, (SELECT UNNEST(range(1, 256)) AS subset) a, (SELECT UNNEST(range(5, 10)) AS k) b
""",
)
def param_grid(t: Tables) -> DataFrame:
    """Algorithm subset times cluster count for every entity, by exploding the two lists."""
    ids = fixed_clusters(t).select("entity_id")
    return reshape.parameter_grid(ids, {"subset": range(1, 256), "k": range(5, 10)})


@query("keyed_bind", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def keyed_bind(t: Tables) -> DataFrame:
    """Two frames bound by key, never by position."""
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality", "toxic"), "doc_id")


@query(
    "lag_k",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, class_id, ds, {", ".join(f"ROUND(LAG(close_value, {k}) OVER w, 8) + 0.0 AS close_value_lag_{k}" for k in (1, 30, 117, 136))}
FROM panel WINDOW w AS (PARTITION BY entity_id, class_id ORDER BY ds)
""",
)
def lag_k(t: Tables) -> DataFrame:
    """Values 1, 30, 117 and 136 rows earlier."""
    steps = (1, 30, 117, 136)
    names = [f"close_value_lag_{k}" for k in steps]
    out = rolling.lagged(standins.panel(t), SERIES, "ds", "close_value", steps)
    return rounded(out.select(*SERIES, "ds", *names), *names, digits=8)


@query(
    "series_tail",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, class_id, ds, holders FROM panel
QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_id, class_id ORDER BY ds DESC) <= 30
""",
)
def series_tail(t: Tables) -> DataFrame:
    """The last thirty rows of every series."""
    return rolling.tail_rows(standins.panel(t).select(*SERIES, "ds", "holders"), SERIES, 30)


@query(
    "best_config",
    """
WITH m AS (SELECT p_brand, p_partkey AS id, p_size AS metric FROM part)
SELECT p_brand, MAX(metric) AS metric, arg_max(id, metric * 1e12 + id) AS id FROM m GROUP BY p_brand
""",
)
def best_config(t: Tables) -> DataFrame:
    """Per group the greatest metric and, among ties, the last id."""
    m = t.part.select("p_brand", F.col("p_partkey").alias("id"), F.col("p_size").alias("metric"))
    best = m.groupBy("p_brand").agg(F.max(F.struct("metric", "id")).alias("b"))
    return best.select("p_brand", "b.metric", "b.id")


@query(
    "rank_aggregate",
    """
WITH m AS (SELECT l_suppkey, SUM(l_quantity) AS up, MIN(l_discount) + MIN(l_tax) AS down, AVG(l_linenumber) AS mid FROM lineitem GROUP BY 1),
r AS (SELECT l_suppkey, DENSE_RANK() OVER (ORDER BY up DESC) AS r1, DENSE_RANK() OVER (ORDER BY down) AS r2 FROM m)
SELECT l_suppkey, CAST(r1 AS INTEGER) AS r1, CAST(r2 AS INTEGER) AS r2, (r1 + r2) / 2.0::DOUBLE AS mean_rank FROM r
""",
)
def rank_aggregate(t: Tables) -> DataFrame:
    """Dense ranks of several metrics, higher or lower being better, and their mean."""
    m = t.lineitem.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("up"), (F.min("l_discount") + F.min("l_tax")).alias("down")
    )
    ranked = quantiles.global_dense_rank(m, "up", "r1")
    ranked = quantiles.global_dense_rank(ranked, "down", "r2", descending=False)
    return ranked.select("l_suppkey", "r1", "r2", ((F.col("r1") + F.col("r2")) / 2.0).alias("mean_rank"))


@query(
    "recent_split",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, class_id, ds, CASE WHEN ds >= (SELECT MAX(ds) FROM panel) - 28 THEN 'recent' ELSE 'history' END AS part FROM panel
""",
)
def recent_split(t: Tables) -> DataFrame:
    """History and the last four weeks taken apart and stacked again."""
    src = standins.panel(t).select(*SERIES, "ds")
    cut = F.date_sub(newest(src), 28)
    return reshape.stack_frames(
        src.where(F.col("ds") < cut).withColumn("part", F.lit("history")),
        src.where(F.col("ds") >= cut).withColumn("part", F.lit("recent")),
    )


@query(
    "sorted_output",
    "SELECT o_custkey, CAST(o_orderdate AS DATE) AS ds, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_custkey, ds, o_orderkey",
)
def sorted_output(t: Tables) -> DataFrame:
    """Rows ordered by several keys, one of them descending."""
    return t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("ds"), "o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), "o_custkey", "ds", "o_orderkey"
    )


SECOND_CODES = {"FIC GENERAL": 0, "FIC BURSATILES": 1, "FIC DE MERCADO MONETARIO": 2, "FIC INMOBILIARIAS": 3}


def second_source(t: Tables) -> DataFrame:
    """All panel rows as text, the way the second source delivers them."""
    parts = F.split("entity_id", "_")
    label = None
    for name, code in SECOND_CODES.items():
        hit = parts[2] == str(code)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return standins.panel(t).select(
        F.date_format("ds", "dd/MM/yyyy").alias("day_text"),
        parts[0].alias("entity_type"), parts[1].alias("entity_code"), parts[3].alias("business_code"),
        label.alias("product"), F.col("class_id").alias("class_type"), F.lit("").alias("class_number"),
        F.format_string("$ %,.4f", F.col("close_value")).alias("value_text"),
        F.col("holders").cast("string").alias("holders_text"),
        (F.col("holders") % 10).cast("string").alias("rate_text"),
    )


@query(
    "backfill_union",
    f"""
WITH {PANEL_SQL},
base AS (SELECT * FROM panel WHERE day(ds) % 10 <> 0),
second AS (
  SELECT entity_id, class_id, ds, close_value, holders, pow(1 + (holders % 10) / 100, 1.0 / 365) AS factor,
         LAG(close_value) OVER w AS prev, ROW_NUMBER() OVER w AS rn
  FROM panel WINDOW w AS (PARTITION BY entity_id, class_id ORDER BY ds)
),
derived AS (SELECT entity_id, class_id, ds, prev * factor - prev AS income, prev * factor AS pre_close, close_value, holders FROM second WHERE rn > 1),
alive AS (SELECT DISTINCT entity_id, class_id FROM base WHERE ds >= DATE '2001-10-01'),
extra AS (SELECT * FROM derived SEMI JOIN alive USING (entity_id, class_id) ANTI JOIN base USING (entity_id, class_id, ds))
SELECT entity_id, class_id, ds, {rsql('income', 'pre_close', 'close_value', digits=8)}, holders FROM base
UNION ALL
SELECT entity_id, class_id, ds, {rsql('income', 'pre_close', 'close_value', digits=8)}, holders FROM extra
""",
)
def backfill_union(t: Tables) -> DataFrame:
    """Missing days of live series taken from the second source."""
    base = standins.panel(t).where(F.dayofmonth("ds") % 10 != 0)
    out = backfill.backfill_union(base, second_source(t), F.lit(AS_OF).cast("date"), SECOND_CODES)
    return rounded(out, "income", "pre_close", "close_value", digits=8)


def entity_bound(t: Tables) -> int:
    """Number of suppliers: no day holds more main-class rows than that."""
    return t.supplier.count()


@query(
    "cross_section_quartiles",
    f"""
WITH {MAIN_SQL}
SELECT ds, ROUND(quantile_cont(growth - 1, 0.25), 9) + 0.0 AS q1, ROUND(quantile_cont(growth - 1, 0.5), 9) + 0.0 AS q2,
       ROUND(quantile_cont(growth - 1, 0.75), 9) + 0.0 AS q3
FROM main_panel GROUP BY ds
""",
)
def cross_section_quartiles(t: Tables) -> DataFrame:
    """Quartiles of the daily return over entities, per day."""
    out = quantiles.grouped_quantiles(
        main_panel(t).select("ds", (F.col("growth") - 1).alias("ret")), ["ds"], "ret",
        {"q1": 0.25, "q2": 0.5, "q3": 0.75}, group_rows=entity_bound(t),
    )
    return rounded(out, "q1", "q2", "q3", digits=9)


@query(
    "cluster_bands",
    f"""
WITH {METRICS_SQL}, {CLUSTER_SQL}
SELECT cluster, ds, ROUND(quantile_cont(rent_30, 0.25), 6) + 0.0 AS q1, ROUND(quantile_cont(rent_30, 0.5), 6) + 0.0 AS q2,
       ROUND(quantile_cont(rent_30, 0.75), 6) + 0.0 AS q3
FROM metrics JOIN clusters USING (entity_id)
WHERE rent_365 IS NOT NULL AND flow_ratio_30 IS NOT NULL
GROUP BY cluster, ds
""",
)
def cluster_bands(t: Tables) -> DataFrame:
    """Quartile bands of the thirty-day return per cluster and day."""
    m = metrics(t).select("entity_id", "ds", "rent_30", "rent_365", "flow_ratio_30").na.drop()
    joined = m.join(fixed_clusters(t), "entity_id")
    out = quantiles.grouped_quantiles(
        joined, ["cluster", "ds"], "rent_30", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, group_rows=entity_bound(t)
    )
    return rounded(out, "q1", "q2", "q3")


@query(
    "event_quartiles",
    """
SELECT event_type, ROUND(quantile_cont(value, 0.25), 6) AS q1, ROUND(quantile_cont(value, 0.5), 6) AS q2,
       ROUND(quantile_cont(value, 0.75), 6) AS q3
FROM events GROUP BY event_type
""",
)
def event_quartiles(t: Tables) -> DataFrame:
    """Exact quartiles of groups without a size bound: five event types hold all rows."""
    out = quantiles.grouped_quantiles(t.events, ["event_type"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return rounded(out, "q1", "q2", "q3")


@query(
    "standardize",
    f"""
WITH {MAIN_SQL}
SELECT entity_id, ds, ROUND((growth - (SELECT AVG(growth) FROM main_panel)) / (SELECT stddev_samp(growth) FROM main_panel), 4) + 0.0 AS z
FROM main_panel
""",
)
def standardize_query(t: Tables) -> DataFrame:
    """Growth standardised over the whole panel."""
    src = main_panel(t).select("entity_id", "ds", "growth")
    return rounded(standardize(src, ["growth"], outputs={"growth": "z"}).select("entity_id", "ds", "z"), "z", digits=4)


@query(
    "unpivot_long",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, class_id, ds, name, ROUND(value, 8) + 0.0 AS value
FROM (SELECT entity_id, class_id, ds, close_value, net_flow, holders FROM panel)
UNPIVOT (value FOR name IN (close_value, net_flow, holders))
""",
)
def unpivot_long(t: Tables) -> DataFrame:
    """Three measures as (name, value) rows."""
    src = standins.panel(t).select(*SERIES, "ds", "close_value", "net_flow", "holders")
    return rounded(reshape.to_long(src, [*SERIES, "ds"], ["close_value", "net_flow", "holders"]), "value", digits=8)


@query(
    "pivot_wide",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, {", ".join(f"SUM(holders) FILTER (WHERE year(ds) = {y}) AS y{y}" for y in range(1995, 2002))}
FROM panel GROUP BY entity_id
""",
)
def pivot_wide(t: Tables) -> DataFrame:
    """One row per entity, one column per listed year."""
    src = standins.panel(t).select("entity_id", F.concat(F.lit("y"), F.year("ds").cast("string")).alias("y"), "holders")
    return reshape.to_wide(src, ["entity_id"], "y", "holders", [f"y{y}" for y in range(1995, 2002)])


@query(
    "keyed_reshape",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, class_id, ds, holders, CAST(ROW_NUMBER() OVER (PARTITION BY entity_id, class_id ORDER BY ds) - 1 AS INTEGER) AS pos,
       COUNT(*) OVER (PARTITION BY entity_id, class_id) AS n
FROM panel
""",
)
def keyed_reshape(t: Tables) -> DataFrame:
    """Rows to one array row per series and back, the key carried along."""
    wide = reshape.to_series(standins.panel(t).select(*SERIES, "ds", "holders"), SERIES, "ds", {"x": "holders"})
    return wide.select(
        *SERIES, F.size("x").cast("bigint").alias("n"), F.posexplode(F.arrays_zip("days", "x")).alias("pos", "p")
    ).select(*SERIES, F.col("p.days").alias("ds"), F.col("p.x").alias("holders"), "pos", "n")


@query(
    "key_check",
    f"WITH {PANEL_SQL} SELECT entity_id, ds, COUNT(*) AS count FROM panel GROUP BY ALL HAVING COUNT(*) > 1",
)
def key_check(t: Tables) -> DataFrame:
    """Entity and day pairs that are not unique before classes are chosen."""
    return reshape.duplicate_keys(standins.panel(t).select("entity_id", "ds"), ["entity_id", "ds"])
