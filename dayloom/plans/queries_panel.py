"""Catalogue: facts, dimensions, cleaned panel, metrics, export, screener."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions import measures, names
from dayloom.functions.dates import outside_range
from dayloom.operators import padding, rolling, select
from dayloom.plans import panel as P
from dayloom.plans import screener, standins, star
from dayloom.plans.catalog import query, rounded, rsql
from dayloom.plans.standins import CLEAN_SQL, MAIN_SQL, PANEL_SQL, Tables
from dayloom.session import materialise, newest, shared_path
from dayloom.sources import facts as FS
from dayloom.sources.tables import write_star

SERIES = ["entity_id", "class_id"]
MEASURES = list(P.MEASURES)


def raw_feed(t: Tables) -> DataFrame:
    """Line items in the shape of the landed feed: everything is text."""
    price = F.col("l_extendedprice")
    return standins.line_rows(t).select(
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00.000")).alias("stamp"),
        F.col("n_regionkey").cast("string").alias("entity_type"),
        F.col("s_nationkey").cast("string").alias("entity_code"),
        (F.col("s_suppkey") % 4).cast("string").alias("subtype"),
        F.col("s_suppkey").cast("string").alias("business_code"),
        F.col("l_returnflag").alias("class_id"),
        (price * F.col("l_discount")).cast("string").alias("income"),
        price.cast("string").alias("pre_close"),
        F.col("l_quantity").cast("string").alias("units"),
        F.when(F.col("l_linestatus") == "O", price).otherwise(0.0).cast("string").alias("paid_in"),
        F.when(F.col("l_linestatus") != "O", price).otherwise(0.0).cast("string").alias("paid_out"),
        F.when(F.col("l_linenumber") == 1, F.lit("n/a")).otherwise(F.col("l_tax").cast("string")).alias("cancelled"),
        (price * (1 - F.col("l_tax"))).cast("string").alias("close_value"),
        F.col("l_quantity").cast("string").alias("holders"),
    )


_TYPED_SQL = """
SELECT CAST(l_shipdate AS DATE) AS ds,
       concat_ws('_', n_regionkey, s_nationkey, s_suppkey % 4, s_suppkey) AS entity_id,
       l_returnflag AS class_id,
       ROUND(l_extendedprice * l_discount, 6) AS income, ROUND(l_extendedprice, 6) AS pre_close,
       l_quantity AS units, ROUND(l_extendedprice * (1 - l_tax), 6) AS close_value, l_quantity AS holders,
       ROUND(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END
             + CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END, 6) AS net_flow
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
WHERE s_suppkey % 4 <> 3 AND CAST(l_shipdate AS DATE) BETWEEN DATE '1999-11-04' AND DATE '2001-11-04'
"""


def _typed(raw: DataFrame) -> DataFrame:
    as_of = F.lit(standins.AS_OF).cast("date")
    out = FS.load_facts(raw, F.add_months(as_of, -24), as_of, excluded_subtypes=("3",))
    return rounded(out, "income", "pre_close", "close_value", "net_flow")


@query("fact_load_typed", _TYPED_SQL)
def fact_load_typed(t: Tables) -> DataFrame:
    """Text feed to typed facts of the last two years, one subtype left out."""
    return _typed(raw_feed(t))


@query("fact_scan_landed", _TYPED_SQL)
def fact_scan_landed(t: Tables) -> DataFrame:
    """The feed landed as JSON in the shared folder, scanned by its text schema and typed."""
    path = shared_path(t.spark, "feed")
    feed = raw_feed(t)
    feed.select(*[F.col(n).alias(landed) for landed, n in FS.FEED_COLUMNS.items()]).write.json(path)
    return _typed(FS.read_feed(t.spark, path))


@query(
    "predicates",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, class_id, ds, {rsql('pre_close', 'net_flow')} FROM panel
WHERE class_id IN ('A', 'N') AND net_flow <> 0 AND pre_close > 100
  AND (ds <= DATE '1999-03-01' OR ds >= DATE '1999-04-01')
  AND ds > DATE '1996-11-04'
  AND entity_id IN (SELECT concat_ws('_', n_regionkey, s_nationkey, s_suppkey % 4, s_suppkey)
                    FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0)
  AND income IS NOT NULL AND pre_close IS NOT NULL
""",
)
def predicates(t: Tables) -> DataFrame:
    """Comparison, membership in a list and in a table, date exclusion, relative date, complete rows."""
    rich = (
        t.supplier.where("s_acctbal > 0")
        .join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
        .select(standins.entity_key().alias("entity_id"))
    )
    as_of = F.lit(standins.AS_OF).cast("date")
    out = (
        standins.panel(t)
        .where(F.col("class_id").isin("A", "N"))
        .where((F.col("net_flow") != 0) & (F.col("pre_close") > 100))
        .where(outside_range("ds", "1999-03-01", "1999-04-01"))
        .where(F.col("ds") > F.add_months(as_of, -60))
        .join(rich, "entity_id", "left_semi")
        .na.drop()
    )
    return rounded(out.select(*SERIES, "ds", "pre_close", "net_flow"), "pre_close", "net_flow")


@query(
    "parquet_roundtrip",
    f"WITH {PANEL_SQL} SELECT entity_id, class_id, ds, {rsql('income', 'close_value', digits=8)}, holders FROM panel "
    "WHERE ds BETWEEN DATE '1998-01-15' AND DATE '1999-02-10'",
)
def parquet_roundtrip(t: Tables) -> DataFrame:
    """Facts landed by month in the shared folder and read back for a date range."""
    path = shared_path(t.spark, "facts")
    FS.land_facts(standins.panel(t), path)
    back = FS.read_facts(t.spark, path, "1998-01-15", "1999-02-10")
    return rounded(back.select(*SERIES, "ds", "income", "close_value", "holders"), "income", "close_value", digits=8)


def _dim_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(
        t.region, F.col("r_regionkey") == F.col("n_regionkey")
    )
    code = F.col("s_suppkey") % 4
    damaged = (
        F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("acci??n valores "), F.col("n_name")))
        .when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit("fid. bogot? de alianza "), F.col("r_name")))
        .otherwise(F.concat(F.col("r_name"), F.lit(" global y "), F.col("n_name")))
    )
    rows = s.select(
        F.col("n_regionkey").cast("string").alias("entity_type"),
        F.col("s_nationkey").cast("string").alias("entity_code"),
        code.cast("string").alias("subtype"),
        F.col("s_suppkey").cast("string").alias("business_code"),
        damaged.alias("entity_name"),
        F.when(code == 3, F.lit(names.EXCLUDED_PRODUCT)).otherwise(F.concat(F.lit("TYPE "), code.cast("string"))).alias("product_name"),
        F.concat(
            F.when(code == 0, F.lit("Fondo de inversi?n colectiva ")).when(code == 1, F.lit("Cartera colectiva ")).otherwise(F.lit("FIC ")),
            F.col("s_name"), F.lit(" F.I.C."),
        ).alias("business_name"),
    )
    return (
        rows.select(*star.KEY_PARTS),
        rows.select("entity_type", "entity_code", "entity_name").distinct(),
        rows.select("subtype", "product_name").distinct(),
        rows.select("entity_type", "entity_code", "business_code", "business_name").distinct(),
    )


def dims(t: Tables) -> DataFrame:
    return star.load_dims(*_dim_inputs(t))


_ALLOWED_SQL = ", ".join(f"'{w}'" for w in names.ALLOWED_TOKENS)
DIMS_SQL = f"""
raw_dim AS (
  SELECT DISTINCT concat_ws('_', n_regionkey, s_nationkey, s_suppkey % 4, s_suppkey) AS entity_id,
         upper(CASE WHEN s_nationkey % 3 = 0 THEN 'acci??n valores ' || n_name
                    WHEN s_nationkey % 3 = 1 THEN 'fid. bogot? de alianza ' || r_name
                    ELSE r_name || ' global y ' || n_name END) AS e,
         upper(CASE s_suppkey % 4 WHEN 0 THEN 'Fondo de inversi?n colectiva ' WHEN 1 THEN 'Cartera colectiva ' ELSE 'FIC ' END
               || s_name || ' F.I.C.') AS b
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE s_suppkey % 4 <> 3
),
dims AS (
  SELECT entity_id,
         array_to_string(list_filter(string_split(
           regexp_replace(regexp_replace(regexp_replace(e, '\\bACCI.*?N\\b', 'ACCION', 'g'), '\\bBOGOT.* ', 'BOGOTA ', 'g'), '\\bITA.* ', 'ITAU ', 'g'),
           ' '), lambda w: list_contains([{_ALLOWED_SQL}], w)), ' ') AS entity_name,
         trim(regexp_replace(b, '{names.BOILERPLATE}', '', 'g')) AS business_name
  FROM raw_dim
)"""


@query("dim_build", f"WITH {DIMS_SQL} SELECT entity_id, entity_name, business_name FROM dims")
def dim_build(t: Tables) -> DataFrame:
    """Distinct dimension scans, star join, name repair, token filter, boiler-plate removal."""
    return dims(t)


@query(
    "pad_daily",
    f"""
WITH {CLEAN_SQL},
own AS (SELECT entity_id, class_id, CAST(UNNEST(generate_series(first_ds, last_ds, INTERVAL 1 DAY)) AS DATE) AS ds FROM span)
SELECT o.entity_id, o.class_id, o.ds, {rsql('p.close_value').replace('AS p.', 'AS ')}, p.holders
FROM own o LEFT JOIN panel p USING (entity_id, class_id, ds)
""",
)
def pad_daily(t: Tables) -> DataFrame:
    """Every series on its own daily range, new days NULL."""
    src = standins.panel(t).select(*SERIES, "ds", "close_value", "holders")
    return rounded(padding.pad_daily(src, SERIES), "close_value")


@query(
    "pad_recent_to_max",
    f"WITH {CLEAN_SQL} SELECT g.entity_id, g.class_id, g.ds, p.holders FROM grid g LEFT JOIN panel p USING (entity_id, class_id, ds)",
)
def pad_recent_to_max(t: Tables) -> DataFrame:
    """Daily ranges, extended to the newest date for series alive in the last four weeks."""
    src = standins.panel(t).select(*SERIES, "ds", "holders")
    return padding.pad_daily(src, SERIES, stop=padding.extended_stop("ds", newest(src)))


@query(
    "carry_forward",
    f"WITH {CLEAN_SQL} SELECT entity_id, class_id, ds, {rsql('income', 'pre_close', 'close_value', 'net_flow', digits=8)}, units, holders FROM clean",
)
def carry_forward(t: Tables) -> DataFrame:
    """The cleaned panel: gaps padded, levels carried, income and flow zero."""
    out = padding.clean_panel(standins.panel(t), SERIES)
    return rounded(out.select(*SERIES, "ds", *MEASURES), "income", "pre_close", "close_value", "net_flow", digits=8)


@query(
    "growth_factor",
    f"""
WITH {PANEL_SQL}
SELECT entity_id, class_id, ds,
       ROUND(CASE WHEN ROUND(pre_close,1)-ROUND(income,1)=0 THEN 1 ELSE ROUND(pre_close,1)/(ROUND(pre_close,1)-ROUND(income,1)) END, 9) AS growth,
       ROUND(CASE WHEN ROUND(pre_close,1)-ROUND(income,1)=0 THEN 0 ELSE ROUND(pre_close,1)/(ROUND(pre_close,1)-ROUND(income,1)) - 1 END, 9) + 0.0 AS ret
FROM panel
""",
)
def growth_factor(t: Tables) -> DataFrame:
    """Rounded daily growth factor and daily return with the divide guards."""
    out = P.with_growth(standins.panel(t)).withColumn("ret", measures.growth_return("pre_close", "income"))
    return rounded(out.select(*SERIES, "ds", "growth", "ret"), "growth", "ret", digits=9)


@query(
    "active_entities",
    f"""
WITH {CLEAN_SQL},
per_class AS (SELECT entity_id, class_id, COUNT(*) AS n, MAX(ds) AS m FROM clean GROUP BY ALL)
SELECT entity_id, MAX(n) AS longest FROM per_class GROUP BY entity_id
HAVING MAX(n) > 365 AND MAX(m) = (SELECT MAX(ds) FROM clean)
""",
)
def active_entities(t: Tables) -> DataFrame:
    """Entities alive at the newest date whose longest class exceeds a year."""
    return select.active_entities(standins.panel(t).select(*SERIES, "ds"), SERIES)


@query("main_class", f"WITH {MAIN_SQL} SELECT * FROM main_class")
def main_class(t: Tables) -> DataFrame:
    """Main class per live entity: most holders, then value, then class id."""
    return select.active_main_class(standins.panel(t), SERIES)


@query(
    "main_class_flag",
    f"""
WITH {MAIN_SQL}
SELECT p.entity_id, p.class_id, p.ds, CAST(COALESCE(m.f, 0) AS INTEGER) AS is_main
FROM panel p LEFT JOIN (SELECT *, 1 AS f FROM main_class) m USING (entity_id, class_id)
""",
)
def main_class_flag(t: Tables) -> DataFrame:
    """Main class marked instead of filtered."""
    src = standins.panel(t)
    chosen = select.active_main_class(src, SERIES)
    return select.flag_main_class(src.select(*SERIES, "ds"), chosen, SERIES)


@query(
    "entity_sum_panel",
    f"""
WITH {CLEAN_SQL},
daily AS (SELECT entity_id, ds, """
    + ", ".join(f"CAST(SUM(CAST({c} AS DECIMAL(28, 7))) AS DOUBLE) AS {c}" for c in MEASURES)
    + f"""
          FROM clean GROUP BY ALL),
sized AS (SELECT *, COUNT(*) OVER (PARTITION BY entity_id) AS n FROM daily)
SELECT entity_id, ds, {rsql('units', 'close_value', 'holders', 'net_flow', digits=6)},
       ROUND(CASE WHEN ROUND(pre_close,1)-ROUND(income,1)=0 THEN 1
             ELSE ROUND(pre_close,1)/(ROUND(pre_close,1)-ROUND(income,1)) END, 6) AS growth
FROM sized WHERE n >= 365
""",
)
def entity_sum_panel(t: Tables) -> DataFrame:
    """Classes summed into their entity per day, entities of at least a year."""
    out = P.entity_panel(standins.panel(t), SERIES, global_max=standins.newest_day(t))
    cols = ["units", "close_value", "holders", "net_flow", "growth"]
    return rounded(out.select("entity_id", "ds", *cols), *cols)


def main_panel(t: Tables) -> DataFrame:
    return P.main_class_panel(standins.panel(t), SERIES, global_max=standins.newest_day(t))


def calendar_rows(t: Tables) -> int:
    """Length of the ship-date calendar: one aggregate over the date column, when the query is built."""
    return P.calendar_rows(t.lineitem.select(F.col("l_shipdate").alias("ds")))


def _frame(p: int) -> str:
    return f"OVER (PARTITION BY entity_id, class_id ORDER BY ds ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def _full(p: int, col: str = "growth") -> str:
    return f"COUNT({col}) {_frame(p)} = {p}"


def rent_sql(p: int) -> str:
    power = "" if p == 365 else f" ^ (365.0 / {p})"
    return f"CASE WHEN {_full(p)} THEN CAST(product(growth) {_frame(p)} AS DOUBLE){power} - 1 END AS rent_{p}"


def vol_sql(p: int) -> str:
    return f"CASE WHEN {_full(p)} THEN stddev_samp(growth - 1) {_frame(p)} * sqrt(365) END AS vol_{p}"


def ema_sql(p: int) -> str:
    """Closed form of the recursion, weights kept in logarithms of the decay."""
    a = f"(2.0::DOUBLE / {p + 1})"
    return (
        f"CASE WHEN rn >= {p} THEN pow(1 - {a}, rn - {p}) * SUM(CASE WHEN rn <= {p} THEN (growth - 1) / {p} "
        f"ELSE {a} * (growth - 1) * pow(1 - {a}, {p} - rn) END) OVER (PARTITION BY entity_id, class_id ORDER BY ds) END AS ema_{p}"
    )


FLOW_SQL = (
    f"CASE WHEN COUNT(net_flow) {_frame(30)} = 30 THEN SUM(ROUND(net_flow, 1)) {_frame(30)} "
    "/ NULLIF(LAG(close_value, 30) OVER (PARTITION BY entity_id, class_id ORDER BY ds), 0) END AS flow_ratio_30"
)
PERIODS = rolling.HORIZONS
METRICS_SQL = (
    MAIN_SQL
    + f""",
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, class_id ORDER BY ds) AS rn FROM main_panel),
metrics AS (
  SELECT entity_id, class_id, ds, units, close_value, holders, ROUND(net_flow, 1) AS net_flow, growth,
         {", ".join(rent_sql(p) for p in PERIODS)},
         {", ".join(vol_sql(p) for p in PERIODS)},
         {", ".join(ema_sql(p) for p in PERIODS)},
         {FLOW_SQL}
  FROM numbered
)"""
)


def _names(prefix: str) -> list[str]:
    return [f"{prefix}_{p}" for p in PERIODS]


@query("rolling_return", f"WITH {MAIN_SQL}, m AS (SELECT *, {', '.join(rent_sql(p) for p in PERIODS)} FROM main_panel) SELECT entity_id, class_id, ds, {rsql(*_names('rent'))} FROM m")
def rolling_return(t: Tables) -> DataFrame:
    """Compounded trailing return for five horizons, annualised below a year."""
    out = rolling.with_pieces(
        main_panel(t), SERIES, "ds", rolling.compounded_return("growth", rolling.annualised_horizons())
    )
    return rounded(out.select(*SERIES, "ds", *_names("rent")), *_names("rent"))


@query("rolling_vol", f"WITH {MAIN_SQL}, m AS (SELECT *, {', '.join(vol_sql(p) for p in PERIODS)} FROM main_panel) SELECT entity_id, class_id, ds, {rsql(*_names('vol'))} FROM m")
def rolling_vol(t: Tables) -> DataFrame:
    """Annualised trailing volatility for five horizons."""
    out = rolling.with_pieces(main_panel(t), SERIES, "ds", rolling.volatility("growth"))
    return rounded(out.select(*SERIES, "ds", *_names("vol")), *_names("vol"))


@query(
    "ema",
    f"WITH {MAIN_SQL}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, class_id ORDER BY ds) AS rn FROM main_panel), "
    f"m AS (SELECT *, {', '.join(ema_sql(p) for p in PERIODS)} FROM n) SELECT entity_id, class_id, ds, {rsql(*_names('ema'), digits=9)} FROM m",
)
def ema(t: Tables) -> DataFrame:
    """Exponential average of the daily return for five lengths."""
    out = rolling.with_exponential_average(
        main_panel(t), SERIES, "ds", "growth", shift=-1.0, series_rows=calendar_rows(t)
    )
    return rounded(out.select(*SERIES, "ds", *_names("ema")), *_names("ema"), digits=9)


def metrics(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """All metrics of main classes; ``only`` keeps some entities before anything is padded."""
    facts = standins.panel(t)
    if only is not None:
        facts = facts.join(only, "entity_id", "left_semi")
    return P.extended_panel(facts, True, SERIES, global_max=standins.newest_day(t), series_rows=calendar_rows(t))


@query(
    "risk_cover",
    f"WITH {METRICS_SQL} SELECT entity_id, class_id, ds, "
    + ", ".join(f"ROUND(rent_{p} / NULLIF(vol_{p}, 0), 6) + 0.0 AS cover_{p}" for p in PERIODS)
    + " FROM metrics",
)
def risk_cover(t: Tables) -> DataFrame:
    """Return over volatility for five horizons."""
    out = rolling.with_pieces(
        main_panel(t), SERIES, "ds",
        rolling.compounded_return("growth", rolling.annualised_horizons()),
        rolling.volatility("growth"),
    )
    return rounded(P.with_cover(out).select(*SERIES, "ds", *_names("cover")), *_names("cover"))


@query("flow_ratio", f"WITH {MAIN_SQL}, m AS (SELECT *, {FLOW_SQL} FROM main_panel) SELECT entity_id, class_id, ds, {rsql('flow_ratio_30')} FROM m")
def flow_ratio(t: Tables) -> DataFrame:
    """Thirty-day net flow over the value thirty days before."""
    base = measures.with_rounded(main_panel(t), ["net_flow"], 1)
    out = rolling.with_pieces(base, SERIES, "ds", rolling.flow_ratio())
    return rounded(out.select(*SERIES, "ds", "flow_ratio_30"), "flow_ratio_30")


_ALL = [*_names("rent"), *_names("vol"), "flow_ratio_30"]


@query(
    "risk_return_panel",
    f"WITH {METRICS_SQL} SELECT entity_id, class_id, ds, units, holders, {rsql('close_value', 'net_flow', *_ALL)}, {rsql('growth', *_names('ema'), digits=9)}, "
    + ", ".join(f"ROUND(rent_{p} / NULLIF(vol_{p}, 0), 6) + 0.0 AS cover_{p}" for p in PERIODS)
    + " FROM metrics",
)
def risk_return_panel(t: Tables) -> DataFrame:
    """All twenty-one metrics of the main-class panel in one plan."""
    out = metrics(t)
    cols = [*SERIES, "ds", "units", "holders", "close_value", "net_flow", "growth", *_ALL, *_names("ema"), *_names("cover")]
    out = rounded(out.select(*cols), "close_value", "net_flow", *_ALL, *_names("cover"))
    return rounded(out, "growth", *_names("ema"), digits=9)


ENTITY_METRICS_SQL = (
    CLEAN_SQL
    + f""",
daily AS (SELECT entity_id, '' AS class_id, ds, ROUND(CAST(SUM(CAST(income AS DECIMAL(28, 7))) AS DOUBLE), 1) AS income,
                 ROUND(CAST(SUM(CAST(pre_close AS DECIMAL(28, 7))) AS DOUBLE), 1) AS pre_close,
                 CAST(SUM(CAST(close_value AS DECIMAL(28, 7))) AS DOUBLE) AS close_value,
                 ROUND(CAST(SUM(CAST(net_flow AS DECIMAL(28, 7))) AS DOUBLE), 1) AS net_flow
          FROM clean GROUP BY ALL),
numbered AS (
  SELECT *, CASE WHEN pre_close - income = 0 THEN 1.0 ELSE pre_close / (pre_close - income) END AS growth,
         ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY ds) AS rn
  FROM daily QUALIFY COUNT(*) OVER (PARTITION BY entity_id) >= 365
),
metrics AS (
  SELECT entity_id, ds, {", ".join(rent_sql(p) for p in PERIODS)}, {", ".join(vol_sql(p) for p in PERIODS)},
         {", ".join(ema_sql(p) for p in PERIODS)}, {FLOW_SQL}
  FROM numbered
)"""
)


@query(
    "entity_risk_panel",
    f"WITH {ENTITY_METRICS_SQL} SELECT entity_id, ds, {rsql(*_ALL)}, {rsql(*_names('ema'), digits=9)} FROM metrics",
)
def entity_risk_panel(t: Tables) -> DataFrame:
    """The same metrics on entities summed over their classes."""
    out = P.extended_panel(standins.panel(t), False, SERIES, global_max=standins.newest_day(t), series_rows=calendar_rows(t))
    out = rounded(out.select("entity_id", "ds", *_ALL, *_names("ema")), *_ALL)
    return rounded(out, *_names("ema"), digits=9)


@query(
    "star_facts",
    f"""
WITH {CLEAN_SQL},
sized AS (SELECT *, COUNT(*) OVER (PARTITION BY entity_id, class_id) AS n,
                 MAX(ds) OVER (PARTITION BY entity_id, class_id) AS m FROM clean),
kept AS (SELECT * FROM sized WHERE m = (SELECT MAX(ds) FROM clean) AND n >= 365),
top AS (SELECT entity_id, class_id FROM (
  SELECT entity_id, class_id, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY holders DESC, close_value DESC, class_id) AS rn
  FROM kept WHERE ds = (SELECT MAX(ds) FROM clean)) WHERE rn = 1)
SELECT k.entity_id, k.class_id, k.ds, {rsql('income', 'close_value', 'net_flow', digits=8)}, holders,
       CAST(CASE WHEN t.entity_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_main
FROM kept k LEFT JOIN top t USING (entity_id, class_id)
""",
)
def star_facts(t: Tables) -> DataFrame:
    """Export facts, written as a star and read back: live series of at least a year with the main-class flag."""
    facts = star.padded_star_facts(standins.panel(t), SERIES, global_max=standins.newest_day(t))
    paths = write_star(facts, star.star_dims(dims(t), facts), shared_path(t.spark, "star"))
    cols = [*SERIES, "ds", "income", "close_value", "net_flow", "holders", "is_main"]
    return rounded(t.spark.read.parquet(paths["facts"]).select(*cols), "income", "close_value", "net_flow", digits=8)


@query(
    "star_dims",
    f"WITH {MAIN_SQL}, {DIMS_SQL} SELECT entity_id, entity_name, business_name FROM dims WHERE entity_id IN (SELECT entity_id FROM main_class)",
)
def star_dims(t: Tables) -> DataFrame:
    """Dimension rows of exported entities, written as a star and read back."""
    chosen = select.active_main_class(standins.panel(t), SERIES)
    paths = write_star(chosen, star.star_dims(dims(t), chosen), shared_path(t.spark, "star"))
    return t.spark.read.parquet(paths["dims"])


SCREEN_SQL = (
    METRICS_SQL
    + """,
segment AS (
  SELECT concat_ws('_', n_regionkey, s_nationkey, s_suppkey % 4, s_suppkey) AS entity_id
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE r_name IN ('AFRICA', 'ASIA', 'EUROPE')
),
seg AS (SELECT * FROM metrics SEMI JOIN segment USING (entity_id)),
activity AS (SELECT entity_id, AVG(CASE WHEN net_flow <> 0 THEN 1.0 ELSE 0.0 END) AS activity, MAX(ds) AS last_ds FROM seg GROUP BY entity_id),
recent AS (SELECT entity_id, MIN(rent_365) AS min_rent, MIN(ema_30) AS min_ema FROM seg WHERE ds > DATE '2000-10-04' GROUP BY entity_id),
survivors AS (
  SELECT a.entity_id, activity, min_rent, min_ema FROM activity a JOIN recent r USING (entity_id)
  WHERE last_ds = (SELECT MAX(ds) FROM seg) AND min_rent > 0 AND min_ema > -0.0002 AND activity > 0.02
)"""
)


def _segment(t: Tables) -> DataFrame:
    return (
        t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
        .join(t.region.where(F.col("r_name").isin("AFRICA", "ASIA", "EUROPE")), F.col("r_regionkey") == F.col("n_regionkey"))
        .select(standins.entity_key().alias("entity_id"))
    )


def _screen(t: Tables, m: DataFrame) -> DataFrame:
    """``m`` holds the entities of the segment."""
    as_of = F.lit(standins.AS_OF).cast("date")
    return screener.screen(m, as_of, min_activity=0.02, newest_day=standins.newest_day(t))


@query("screener", f"WITH {SCREEN_SQL} SELECT entity_id, {rsql('activity', 'min_rent')}, {rsql('min_ema', digits=9)} FROM survivors")
def screener_query(t: Tables) -> DataFrame:
    """Segment, thirteen months, never a negative year, average and activity thresholds."""
    out = rounded(_screen(t, metrics(t, _segment(t))), "activity", "min_rent")
    return rounded(out, "min_ema", digits=9)


@query(
    "screen_rank",
    f"""
WITH {SCREEN_SQL}, {DIMS_SQL},
complete AS (
  SELECT * FROM metrics SEMI JOIN survivors USING (entity_id)
  WHERE rent_365 IS NOT NULL AND vol_365 IS NOT NULL AND ema_365 IS NOT NULL AND flow_ratio_30 IS NOT NULL
    AND {" AND ".join(f"rent_{p} / NULLIF(vol_{p}, 0) IS NOT NULL" for p in PERIODS)}
),
latest AS (SELECT entity_id, max_by(rent_365, ds) AS last_rent FROM complete GROUP BY entity_id),
ranked AS (SELECT *, DENSE_RANK() OVER (ORDER BY last_rent DESC) AS rank FROM latest)
SELECT c.entity_id, ds, {rsql('ema_30', 'last_rent', digits=9)}, CAST(rank AS INTEGER) AS rank, business_name
FROM complete c JOIN ranked USING (entity_id) LEFT JOIN dims USING (entity_id)
""",
)
def screen_rank(t: Tables) -> DataFrame:
    """Complete series of the survivors, dense-ranked by their latest yearly return."""
    m = materialise(metrics(t, _segment(t)), "metrics")
    out = screener.ranked_series(m, _screen(t, m), dims(t))
    return rounded(out.select("entity_id", "ds", "ema_30", "last_rent", "rank", "business_name"), "ema_30", "last_rent", digits=9)
