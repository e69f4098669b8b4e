from __future__ import annotations

import random
import re
from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayloom.operators.padding import carry_forward, clean_panel, days_covered, extended_stop, future_frame, monthly_to_daily, pad_daily
from dayloom.operators.select import null_safe_sum
from dayloom.plans.panel import MEASURES, entity_panel, with_growth
from dayloom.session import newest

KEYS = ["entity_id", "class_id"]
SCHEMA = "entity_id string, class_id string, ds date, income double, pre_close double, units double, close_value double, holders double, net_flow double"


def d(n: int) -> date:
    return date(2024, 1, 1) + timedelta(days=n)


def row(e, c, day, income=1.0, pre=10.0, units=5.0, close=11.0, holders=3.0, flow=1.0):
    return (e, c, d(day), income, pre, units, close, holders, flow)


def by_day(df, e="a"):
    return {r.ds: r for r in df.where(F.col("entity_id") == e).collect()}


def test_gap_is_padded_and_carried(spark):
    out = by_day(clean_panel(spark.createDataFrame([row("a", "x", 0), row("a", "x", 3, close=20.0)], SCHEMA), KEYS))
    assert sorted(out) == [d(i) for i in range(4)]
    assert out[d(1)].close_value == 11.0 and out[d(2)].units == 5.0 and out[d(2)].holders == 3.0
    assert out[d(1)].income == 0.0 and out[d(1)].net_flow == 0.0 and out[d(1)].pre_close == 11.0
    assert out[d(3)].pre_close == 10.0 and out[d(3)].close_value == 20.0


def test_single_row(spark):
    assert clean_panel(spark.createDataFrame([row("a", "x", 0)], SCHEMA), KEYS).count() == 1


def test_extension_edges(spark):
    rows = [row("late", "x", 100), row("edge", "x", 72), row("dead", "x", 71)]
    out = clean_panel(spark.createDataFrame(rows, SCHEMA), KEYS)
    n = {r.entity_id: r["count"] for r in out.groupBy("entity_id").count().collect()}
    assert n == {"late": 1, "edge": 29, "dead": 1}


def test_null_in_source_row(spark):
    rows = [row("a", "x", 0), row("a", "x", 1, income=None, pre=None, close=None, holders=None, flow=None)]
    r = by_day(clean_panel(spark.createDataFrame(rows, SCHEMA), KEYS))[d(1)]
    assert (r.income, r.net_flow, r.close_value, r.pre_close, r.holders) == (0.0, 0.0, 11.0, 11.0, 3.0)


def test_duplicate_days_stay_single(spark):
    rows = [row("a", "x", 0), row("a", "x", 0), row("a", "x", 2)]
    assert pad_daily(spark.createDataFrame(rows, SCHEMA), KEYS).count() == 4


def test_fused_panel_equals_separate_steps(spark):
    rows = [row("a", "x", 0), row("a", "x", 5, close=None), row("b", "y", 2), row("b", "z", 30, flow=None)]
    src = spark.createDataFrame(rows, SCHEMA)
    apart = carry_forward(pad_daily(src, KEYS, stop=extended_stop("ds", newest(src))), KEYS)
    fused = clean_panel(src, KEYS)
    assert sorted(map(tuple, apart.select(fused.columns).collect())) == sorted(map(tuple, fused.collect()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcd"), st.sets(st.integers(0, 60), min_size=1, max_size=6), min_size=1))
def test_pad_properties(spark, series):
    rows = [row(e, "x", day) for e, days in series.items() for day in days]
    src = spark.createDataFrame(rows, SCHEMA)
    out = pad_daily(src, KEYS)
    assert out.count() == sum(max(v) - min(v) + 1 for v in series.values())
    again = pad_daily(out, KEYS)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_monthly_to_daily_runs_to_next_month(spark):
    src = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 2, 1), 2.0)], "ds date, v double")
    out = {r.ds: r.v for r in monthly_to_daily(src).collect()}
    assert out[date(2024, 1, 31)] == 1.0 and out[date(2024, 2, 29)] == 2.0 and out[date(2024, 3, 1)] == 2.0
    assert len(out) == 61


def test_future_frame(spark):
    src = spark.createDataFrame([("a", d(0), 1.0), ("a", d(1), 2.0), ("b", d(5), 3.0)], "entity_id string, ds date, v double")
    out = future_frame(src, ["entity_id"], 3)
    ahead = sorted((r.entity_id, r.ds) for r in out.where("v IS NULL").collect())
    assert ahead == [("a", d(2)), ("a", d(3)), ("a", d(4)), ("b", d(6)), ("b", d(7)), ("b", d(8))]


def test_future_frame_computes_the_history_once(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    src = spark.range(7).select((F.col("id") % 2).alias("entity_id"), F.when(F.col("id") > 0, day).alias("ds"), F.col("id").cast("double").alias("v"))
    out = future_frame(src, ["entity_id"], 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    rows = sorted(((r.entity_id, r.ds, r.v) for r in out.where("ds is not null").collect()), key=lambda r: r[:2])
    assert rows == [(0, d(2), 2.0), (0, d(4), 4.0), (0, d(6), 6.0), (0, d(7), None), (0, d(8), None),
                    (1, d(1), 1.0), (1, d(3), 3.0), (1, d(5), 5.0), (1, d(6), None), (1, d(7), None)]
    assert out.where("ds is null").count() == 1


def test_entity_sums_shuffle_no_padded_rows(spark):
    """Sums and lengths equal those over the padded panel, with repeated and null days, keys and values."""
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        e, c, day = rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.choice([0, 1, 63, 64, 65, 127, 200, 231, 232])
        r = list(row(e, c, day + (300 if e == "c" and c == "x" else 0), *[rng.choice([None, rng.randint(-500, 500) / 8]) for _ in range(6)]))
        rows.append((*r[:2], None if rng.random() < 0.05 else r[2], *r[3:]))
    facts = spark.createDataFrame(rows, SCHEMA)
    padded = clean_panel(facts, KEYS).groupBy("entity_id", "ds").agg(*[null_safe_sum(m).alias(m) for m in MEASURES])
    length = {r.entity_id: r["count"] for r in padded.groupBy("entity_id").count().collect()}
    least = sorted(n for e, n in length.items() if e)[1]
    assert {r.entity_id: r.n for r in days_covered(facts, KEYS, "ds").collect()} == length
    got = entity_panel(facts, KEYS, min_days=least)
    want = with_growth(padded.where(F.col("entity_id").isin([e for e, n in length.items() if e and n >= least])))
    assert got.count() == want.count() > 0
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity_id#" in plan and not re.search(r"hashpartitioning\(entity_id#\d+, ds#", plan)
