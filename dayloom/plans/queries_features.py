"""Catalogue: time grids, calendar features, splits, diagnostics, model frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators import calendar, diagnostics, padding, quantiles, rolling, splits
from dayloom.operators.reshape import to_long
from dayloom.operators.scaling import standardize
from dayloom.plans import clustering, features, panel as P, standins
from dayloom.plans.catalog import query, rounded, rsql
from dayloom.plans.queries_panel import SERIES, main_panel
from dayloom.plans.queries_tables import (
    HOLIDAYS, REGRESSOR_SQL, _HOLIDAY_SQL, entity_bound, monthly_rows, regressors,
)
from dayloom.plans.standins import CUT, MAIN_SQL, PANEL_SQL, Tables
from dayloom.session import materialise


def returns(t: Tables) -> DataFrame:
    """Daily return of every main-class series."""
    return main_panel(t).select("entity_id", "ds", (F.col("growth") - 1).alias("ret"))


def known_returns(t: Tables) -> DataFrame:
    """Returns up to the cut, so that every horizon stays inside the regressors."""
    return returns(t).where(F.col("ds") <= F.lit(CUT).cast("date"))


RETURNS_SQL = MAIN_SQL + """,
returns AS (SELECT entity_id, ds, growth - 1 AS ret FROM main_panel)"""
KNOWN_SQL = RETURNS_SQL + f""",
known AS (SELECT * FROM returns WHERE ds <= DATE '{CUT}')"""
MEDIAN_SQL = RETURNS_SQL + """,
median AS (SELECT ds, quantile_cont(ret, 0.5) AS med FROM returns GROUP BY ds)"""


def median_series(t: Tables) -> DataFrame:
    """Cross-section median return per day."""
    return quantiles.grouped_quantiles(returns(t), ["ds"], "ret", {"med": 0.5}, group_rows=entity_bound(t))


@query("monthly_to_daily", f"WITH {REGRESSOR_SQL.strip()} SELECT ds, {rsql('monthly')} FROM monthly")
def monthly_to_daily(t: Tables) -> DataFrame:
    """Monthly regressor repeated daily up to the end after its newest month."""
    return rounded(padding.monthly_to_daily(monthly_rows(t)), "monthly")


@query(
    "future_frame",
    f"""
WITH {RETURNS_SQL},
ends AS (SELECT entity_id, MAX(ds) AS m FROM returns GROUP BY entity_id)
SELECT entity_id, ds, ROUND(ret, 9) + 0.0 AS ret FROM returns
UNION ALL
SELECT entity_id, CAST(UNNEST(generate_series(m + 1, m + 28, INTERVAL 1 DAY)) AS DATE) AS ds, NULL FROM ends
""",
)
def future_frame(t: Tables) -> DataFrame:
    """Every series with its next 28 days appended."""
    return rounded(padding.future_frame(returns(t), ["entity_id"], 28), "ret", digits=9)


@query(
    "time_split",
    f"WITH {RETURNS_SQL} SELECT entity_id, ds, CASE WHEN ds > (SELECT MAX(ds) FROM returns) - 30 THEN 'test' ELSE 'train' END AS role FROM returns",
)
def time_split(t: Tables) -> DataFrame:
    """Last thirty days of the panel as test rows, all earlier rows as train rows."""
    train, test = splits.time_split(returns(t).select("entity_id", "ds"), 30, last=standins.newest_day(t))
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))


@query(
    "split_plan",
    f"WITH {RETURNS_SQL}, l AS (SELECT ds, CASE WHEN ds > (SELECT MAX(ds) FROM returns) - 28 THEN 'test' ELSE 'train' END AS role FROM returns) "
    "SELECT role, MIN(ds) AS first_ds, MAX(ds) AS last_ds, COUNT(*) AS n FROM l GROUP BY role",
)
def split_plan(t: Tables) -> DataFrame:
    """The split as a table of ranges and sizes."""
    plan = splits.split_plan(returns(t).select("ds"), 28, last=standins.newest_day(t))
    return plan.groupBy("role").agg(F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"))


@query(
    "rolling_origin",
    f"""
WITH {RETURNS_SQL},
two AS (SELECT entity_id, ds FROM returns WHERE ds >= (SELECT MAX(ds) FROM returns) - INTERVAL 24 MONTH),
slices AS (SELECT UNNEST(range(1, 14)) AS slice),
labelled AS (
  SELECT entity_id, ds, slice, (SELECT MAX(ds) FROM two) - ds AS age FROM two, slices
)
SELECT entity_id, ds, CAST(slice AS INTEGER) AS slice, CASE WHEN age >= slice * 28 THEN 'train' ELSE 'test' END AS role
FROM labelled WHERE age >= (slice - 1) * 28
""",
)
def rolling_origin(t: Tables) -> DataFrame:
    """Thirteen expanding back-test slices over the last two years."""
    newest = standins.newest_day(t)
    two = returns(t).select("entity_id", "ds").where(F.col("ds") >= F.add_months(newest, -24))
    return splits.rolling_origin(two, last=newest)


@query(
    "date_signature",
    """
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds FROM orders)
SELECT o_orderkey, ds, (ds - DATE '1970-01-01') * 86400.0::DOUBLE AS index_num, CAST(year(ds) AS INTEGER) AS year,
  CAST(CASE WHEN month(ds) <= 6 THEN 1 ELSE 2 END AS INTEGER) AS half, CAST(quarter(ds) AS INTEGER) AS quarter,
  CAST(month(ds) AS INTEGER) AS month, CAST(day(ds) AS INTEGER) AS day, CAST(dayofweek(ds) + 1 AS INTEGER) AS wday,
  CAST(day(ds) AS INTEGER) AS mday, CAST(ds - CAST(date_trunc('quarter', ds) AS DATE) + 1 AS INTEGER) AS qday,
  CAST(dayofyear(ds) AS INTEGER) AS yday,
  CAST((5 + day(ds) + dayofweek(CAST(date_trunc('month', ds) AS DATE)) + 1) // 7 AS INTEGER) AS mweek,
  CAST((dayofyear(ds) - 1) // 7 + 1 AS INTEGER) AS week, CAST(((dayofyear(ds) - 1) // 7 + 1) % 2 AS INTEGER) AS week2,
  CAST(((dayofyear(ds) - 1) // 7 + 1) % 3 AS INTEGER) AS week3, CAST(((dayofyear(ds) - 1) // 7 + 1) % 4 AS INTEGER) AS week4,
  CAST((day(ds) - 1) // 7 + 1 AS INTEGER) AS mday7, strftime(ds, '%b') AS month_lbl, strftime(ds, '%a') AS wday_lbl
FROM d
""",
)
def date_signature(t: Tables) -> DataFrame:
    """Calendar signature of order dates."""
    return calendar.date_signature(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ds")))


_FOURIER = [(p, k) for p in (7, 365) for k in (1, 2)]


@query(
    "fourier",
    "WITH d AS (SELECT o_orderkey, (CAST(o_orderdate AS DATE) - DATE '1970-01-01')::DOUBLE AS x FROM orders) SELECT o_orderkey, "
    + ", ".join(
        f"ROUND({fn}(x * {2 * math.pi * k / p!r}::DOUBLE), 6) + 0.0 AS {fn}{p}_k{k}" for p, k in _FOURIER for fn in ("sin", "cos")
    )
    + " FROM d",
)
def fourier(t: Tables) -> DataFrame:
    """Two harmonics of the week and of the year."""
    cols = calendar.fourier_columns(F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query(
    "ns_basis",
    """
WITH d AS (SELECT o_orderkey, (CAST(o_orderdate AS DATE) - DATE '1970-01-01')::DOUBLE AS x FROM orders),
q AS (SELECT quantile_cont(x, 0) AS k0, quantile_cont(x, 0.25) AS k1, quantile_cont(x, 0.5) AS k2, quantile_cont(x, 0.75) AS k3, quantile_cont(x, 1) AS k4 FROM d),
s AS (SELECT o_orderkey, (x - k0) / (k4 - k0) AS x, (k1 - k0) / (k4 - k0) AS a1, (k2 - k0) / (k4 - k0) AS a2, (k3 - k0) / (k4 - k0) AS a3 FROM d, q),
p AS (
  SELECT o_orderkey, x,
    (pow(greatest(x, 0), 3) - pow(greatest(x - 1, 0), 3)) AS d0,
    (pow(greatest(x - a1, 0), 3) - pow(greatest(x - 1, 0), 3)) / (1 - a1) AS d1,
    (pow(greatest(x - a2, 0), 3) - pow(greatest(x - 1, 0), 3)) / (1 - a2) AS d2,
    (pow(greatest(x - a3, 0), 3) - pow(greatest(x - 1, 0), 3)) / (1 - a3) AS d3
  FROM s)
SELECT o_orderkey, ROUND(x, 6) AS ns_1, ROUND(d0 - d3, 6) + 0.0 AS ns_2, ROUND(d1 - d3, 6) + 0.0 AS ns_3, ROUND(d2 - d3, 6) + 0.0 AS ns_4 FROM p
""",
)
def ns_basis(t: Tables) -> DataFrame:
    """Natural cubic spline basis of the day number, knots at its quartiles."""
    d = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ds"))
    cols = calendar.spline_columns("ds", calendar.spline_knots(d))
    return d.select("o_orderkey", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query(
    "lag_features",
    f"""
WITH {RETURNS_SQL}, {REGRESSOR_SQL}
SELECT entity_id, k.ds, ROUND(m.monthly, 6) AS monthly_lag, ROUND(d.daily_2, 6) AS daily_2_lag
FROM returns k LEFT JOIN monthly m ON m.ds = k.ds - 136 LEFT JOIN daily_2 d ON d.ds = k.ds - 117
""",
)
def lag_features(t: Tables) -> DataFrame:
    """Two regressors lagged on their own calendars and joined by day."""
    r = regressors(t)
    out = features.join_regressors(
        returns(t).select("entity_id", "ds"),
        [features.lagged_regressor(r["monthly"], 136, "monthly"), features.lagged_regressor(r["daily_2"], 117, "daily_2")],
    )
    return rounded(out, "monthly_lag", "daily_2_lag")


_MA7_SQL = "CASE WHEN COUNT(ret) OVER w = 7 THEN AVG(ret) OVER w END"
_MA7_WINDOW = "WINDOW w AS (PARTITION BY entity_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


@query("ma7", f"WITH {RETURNS_SQL} SELECT entity_id, ds, ROUND({_MA7_SQL}, 9) + 0.0 AS ma7 FROM returns {_MA7_WINDOW}")
def ma7(t: Tables) -> DataFrame:
    """Mean return of the seven days before."""
    out = rolling.with_pieces(returns(t), ["entity_id"], "ds", rolling.lagged_mean("ret"))
    return rounded(out.select("entity_id", "ds", "ma7"), "ma7", digits=9)


@query(
    "model_frame",
    f"""
WITH {KNOWN_SQL}, {REGRESSOR_SQL},
history AS (SELECT * FROM (SELECT entity_id, ds, ret, {_MA7_SQL} AS ma7 FROM known {_MA7_WINDOW}) WHERE ma7 IS NOT NULL),
ends AS (SELECT entity_id, MAX(ds) AS m FROM history GROUP BY entity_id),
full_rows AS (
  SELECT * FROM history UNION ALL
  SELECT entity_id, CAST(UNNEST(generate_series(m + 1, m + 30, INTERVAL 1 DAY)) AS DATE), NULL, NULL FROM ends)
SELECT entity_id, f.ds, ROUND(ret, 9) + 0.0 AS ret, ROUND(m.monthly, 6) AS monthly_lag, ROUND(d.daily_1, 6) AS daily_1,
       ROUND(e.daily_2, 6) AS daily_2_lag, ROUND(ma7, 9) + 0.0 AS ma7
FROM full_rows f LEFT JOIN daily_1 d USING (ds) LEFT JOIN monthly m ON m.ds = f.ds - 136 LEFT JOIN daily_2 e ON e.ds = f.ds - 117
WHERE m.monthly IS NOT NULL AND e.daily_2 IS NOT NULL
""",
)
def model_frame(t: Tables) -> DataFrame:
    """Target, lagged regressors and ma7 with thirty future rows per entity."""
    out = features.recipe_frame(known_returns(t), regressors(t))
    return rounded(rounded(out, "ret", "ma7", digits=9), "monthly_lag", "daily_1", "daily_2_lag")


@query(
    "quantile_model_frame",
    f"""
WITH {KNOWN_SQL}, {REGRESSOR_SQL},
ends AS (SELECT entity_id, MAX(ds) AS m FROM known GROUP BY entity_id),
full_rows AS (
  SELECT * FROM known UNION ALL
  SELECT entity_id, CAST(UNNEST(generate_series(m + 1, m + 28, INTERVAL 1 DAY)) AS DATE), NULL FROM ends),
j AS (SELECT entity_id, f.ds, ret, daily_1, daily_2, monthly FROM full_rows f LEFT JOIN daily_1 USING (ds) LEFT JOIN daily_2 USING (ds) LEFT JOIN monthly USING (ds)),
s AS (SELECT AVG(daily_1) AS m1, stddev_samp(daily_1) AS s1, AVG(daily_2) AS m2, stddev_samp(daily_2) AS s2, AVG(monthly) AS m3, stddev_samp(monthly) AS s3
      FROM j WHERE ds <= DATE '{CUT}' - 28)
SELECT entity_id, ds, ROUND(ret, 9) + 0.0 AS ret, ROUND((daily_1 - m1) / s1, 5) + 0.0 AS daily_1, ROUND((daily_2 - m2) / s2, 5) + 0.0 AS daily_2,
       ROUND((monthly - m3) / s3, 5) + 0.0 AS monthly,
       CASE WHEN isodow(ds) IN (6, 7) OR ds IN ({_HOLIDAY_SQL}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS non_working
FROM j, s
""",
)
def quantile_model_frame(t: Tables) -> DataFrame:
    """Target, train-scaled regressors and non-working flag with 28 future rows per entity."""
    until = F.date_sub(F.lit(CUT).cast("date"), 28)
    out = features.quantile_frame(known_returns(t), regressors(t), HOLIDAYS, train_until=until)
    return rounded(rounded(out, "ret", digits=9), "daily_1", "daily_2", "monthly", digits=5)


@query(
    "normalize_on_train",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, class_id, ds,
       ROUND((holders - (SELECT AVG(holders) FROM panel WHERE ds <= DATE '{CUT}')) / (SELECT stddev_samp(holders) FROM panel WHERE ds <= DATE '{CUT}'), 5) + 0.0 AS z
FROM panel
""",
)
def normalize_on_train(t: Tables) -> DataFrame:
    """Standardised with the mean and deviation of the training rows only."""
    src = standins.panel(t).select(*SERIES, "ds", "holders")
    out = standardize(src, ["holders"], src.where(F.col("ds") <= F.lit(CUT).cast("date")), {"holders": "z"})
    return rounded(out.select(*SERIES, "ds", "z"), "z", digits=5)


@query(
    "smooth_trend",
    f"""
WITH {MEDIAN_SQL}
SELECT ds, ROUND(AVG(med) OVER (ORDER BY ds ROWS BETWEEN 365 PRECEDING AND 365 FOLLOWING), 9) + 0.0 AS smooth FROM median
""",
)
def smooth_trend(t: Tables) -> DataFrame:
    """Centred two-year mean of the cross-section median."""
    return rounded(rolling.centred_mean(median_series(t), [], "ds", "med", 730).select("ds", "smooth"), "smooth", digits=9)


@query(
    "acf",
    f"""
WITH {RETURNS_SQL},
c AS (SELECT entity_id, ret - AVG(ret) OVER (PARTITION BY entity_id) AS c, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY ds) AS rn FROM returns),
base AS (SELECT entity_id, SUM(c * c) AS b FROM c GROUP BY entity_id),
pairs AS (SELECT a.entity_id, l.lag, SUM(a.c * b.c) AS s FROM c a, (SELECT UNNEST(range(2, 31)) AS lag) l JOIN c b ON b.entity_id = a.entity_id AND b.rn = a.rn + l.lag GROUP BY ALL)
SELECT entity_id, CAST(lag AS INTEGER) AS lag, ROUND(s / b, 6) + 0.0 AS acf FROM pairs JOIN base USING (entity_id)
""",
)
def acf(t: Tables) -> DataFrame:
    """Auto-correlation of every series at lags 2 to 30."""
    return rounded(diagnostics.autocorrelation(returns(t), ["entity_id"], "ret", range(2, 31)), "acf")


@query("pacf")
def pacf(t: Tables) -> DataFrame:
    """Auto- and partial auto-correlation of every series at lags 2 to 365, one month left out."""
    kept = returns(t).where((F.col("ds") <= F.lit("1999-03-01").cast("date")) | (F.col("ds") >= F.lit("1999-04-01").cast("date")))
    return diagnostics.autocorrelation(kept, ["entity_id"], "ret", range(2, 366), partial=True)


@query(
    "ccf",
    f"""
WITH {MEDIAN_SQL}, {REGRESSOR_SQL},
wide AS (SELECT ds, med, daily_1, daily_2, monthly FROM median LEFT JOIN daily_1 USING (ds) LEFT JOIN daily_2 USING (ds) LEFT JOIN monthly USING (ds)
         WHERE daily_1 IS NOT NULL AND daily_2 IS NOT NULL AND monthly IS NOT NULL AND (ds <= DATE '1999-03-01' OR ds >= DATE '1999-04-01')),
long AS (SELECT ds, med, name, value FROM wide UNPIVOT (value FOR name IN (daily_1, daily_2, monthly))),
c AS (SELECT name, med - AVG(med) OVER (PARTITION BY name) AS y, value - AVG(value) OVER (PARTITION BY name) AS x,
             ROW_NUMBER() OVER (PARTITION BY name ORDER BY ds) AS rn FROM long),
base AS (SELECT name, sqrt(SUM(x * x) * SUM(y * y)) AS b FROM c GROUP BY name),
pairs AS (SELECT a.name, l.lag, SUM(a.x * b.y) AS s FROM c a, (SELECT UNNEST(range(0, 366)) AS lag) l JOIN c b ON b.name = a.name AND b.rn = a.rn + l.lag GROUP BY ALL)
SELECT name, CAST(lag AS INTEGER) AS lag, ROUND(s / b, 6) + 0.0 AS ccf FROM pairs JOIN base USING (name)
""",
)
def ccf(t: Tables) -> DataFrame:
    """Correlation of the median return with three regressors up to a year earlier."""
    wide = features.join_regressors(median_series(t), list(regressors(t).values())).na.drop()
    kept = wide.where((F.col("ds") <= F.lit("1999-03-01").cast("date")) | (F.col("ds") >= F.lit("1999-04-01").cast("date")))
    long = to_long(kept, ["ds", "med"], ["daily_1", "daily_2", "monthly"])
    return rounded(diagnostics.cross_correlation(long, ["name"], "med", "value", range(0, 366)), "ccf")


@query(
    "seasonal_summary",
    f"""
WITH {MEDIAN_SQL},
long AS (
  SELECT 'wday' AS feature, dayofweek(ds) + 1 AS level, med FROM median UNION ALL
  SELECT 'month', month(ds), med FROM median UNION ALL
  SELECT 'year', year(ds), med FROM median)
SELECT feature, CAST(level AS INTEGER) AS level, COUNT(*) AS n, ROUND(MIN(med), 9) + 0.0 AS low, ROUND(quantile_cont(med, 0.25), 9) + 0.0 AS q1,
       ROUND(quantile_cont(med, 0.5), 9) + 0.0 AS median, ROUND(quantile_cont(med, 0.75), 9) + 0.0 AS q3, ROUND(MAX(med), 9) + 0.0 AS high
FROM long GROUP BY ALL
""",
)
def seasonal_summary(t: Tables) -> DataFrame:
    """Five-number summaries of the median return by weekday, month and year."""
    return rounded(diagnostics.seasonal_summary(median_series(t), "med"), "low", "q1", "median", "q3", "high", digits=9)


@query("stl")
def stl(t: Tables) -> DataFrame:
    """Season, trend and remainder of every series."""
    return diagnostics.stl(returns(t), ["entity_id"], "ret")


@query("trend_vs_regressors")
def trend_vs_regressors(t: Tables) -> DataFrame:
    """Trend of the median return next to three regressors, all standardised, long form."""
    one = median_series(t).withColumn("series", F.lit("median"))
    trend = diagnostics.stl(one, ["series"], "med").select("ds", "trend")
    names = ["trend", "daily_1", "daily_2", "monthly"]
    wide = features.join_regressors(trend, list(regressors(t).values()))
    return to_long(standardize(wide, names), ["ds"], names)


def series_rows(t: Tables, min_activity: float = 0.02) -> DataFrame:
    """Standardised growth of the moving, full-length series of the last two years."""
    recent = P.since(main_panel(t), F.add_months(F.lit(standins.AS_OF).cast("date"), -24))
    # counts, the full length, the standardisation and its rows all read it
    recent = materialise(recent.select("entity_id", "ds", "growth", "net_flow"), "recent")
    return clustering.series_matrix(recent, min_activity)


@query(
    "series_matrix",
    f"""
WITH {MAIN_SQL},
recent AS (SELECT * FROM main_panel WHERE ds > DATE '1999-11-04'),
activity AS (SELECT entity_id, COUNT(*) AS n, AVG(CASE WHEN ROUND(net_flow, 1) <> 0 THEN 1.0 ELSE 0.0 END) AS share FROM recent GROUP BY entity_id),
busy AS (SELECT * FROM activity WHERE share >= 0.02),
kept AS (SELECT entity_id, ds, growth FROM recent SEMI JOIN (SELECT * FROM busy WHERE n = (SELECT MAX(n) FROM busy)) USING (entity_id))
SELECT entity_id, ds, ROUND((growth - (SELECT AVG(growth) FROM kept)) / (SELECT stddev_samp(growth) FROM kept), 4) + 0.0 AS z FROM kept
""",
)
def series_matrix(t: Tables) -> DataFrame:
    """Cluster input: moving and full-length series, growth standardised over the panel."""
    return rounded(series_rows(t), "z", digits=4)
