from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.operators import quantiles as Q
from dayloom.operators import select as S

KEYS = ["entity_id", "class_id"]
SCHEMA = "entity_id string, class_id string, ds date, close_value double, holders double, units double"


def facts(spark, rows):
    start = date(2020, 1, 1)
    return spark.createDataFrame([(e, c, start + timedelta(days=n), v, h, 1.0) for e, c, n, v, h in rows], SCHEMA)


def chosen(df, **kw):
    return {r.entity_id: r.class_id for r in S.active_main_class(df, KEYS, **kw).collect()}


def test_main_class_rules(spark):
    rows = []
    for e, c, value, holders in [
        ("tie", "b", 10.0, 5.0), ("tie", "a", 10.0, 5.0),
        ("value", "a", 1.0, 5.0), ("value", "b", 2.0, 5.0),
        ("holders", "a", 9.0, 1.0), ("holders", "b", 1.0, 2.0),
        ("none", "a", 9.0, 0.0),
    ]:
        rows += [(e, c, 0, value, holders), (e, c, 400, value, holders)]
    df = facts(spark, rows)
    assert chosen(df) == {"tie": "a", "value": "b", "holders": "b"}
    assert chosen(df, need_holders=False)["none"] == "a"


def test_length_and_liveness(spark):
    rows = [("long", "a", 0, 1.0, 1.0), ("long", "a", 400, 1.0, 1.0), ("dead", "a", 0, 1.0, 1.0), ("dead", "a", 370, 1.0, 1.0),
            ("kept", "a", 0, 1.0, 1.0), ("kept", "a", 372, 1.0, 1.0), ("year", "a", 36, 1.0, 1.0), ("year", "a", 400, 1.0, 1.0)]
    df = facts(spark, rows)
    assert set(chosen(df)) == {"long", "kept"}
    assert set(chosen(df, strict=False)) == {"long", "kept", "year"}


def test_flag_and_first_by(spark):
    df = facts(spark, [("a", "x", 0, 1.0, 1.0), ("a", "y", 0, 2.0, 1.0)])
    flagged = S.flag_main_class(df, spark.createDataFrame([("a", "y")], "entity_id string, class_id string"), KEYS)
    assert {r.class_id: r.is_main for r in flagged.collect()} == {"x": 0, "y": 1}
    assert S.first_by(df, ["entity_id"], ["class_id"]).first().class_id == "x"


def test_null_poisons_the_sum(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0)], "k string, v double")
    out = {r.k: r.s for r in df.groupBy("k").agg(S.null_safe_sum("v").alias("s")).collect()}
    assert out == {"a": None, "b": 1.0}


@pytest.mark.parametrize("rows", [7, 25_000])
def test_bracketed_quantiles_match_the_builtin(spark, rows):
    rng = np.random.default_rng(11)
    hot = rng.normal(size=rows).round(2 if rows > 100 else 6)
    data = [("hot", float(v)) for v in hot] + [("small", 1.0), ("small", 4.0), ("one", 2.0), ("void", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "hi": 0.999, "top": 1.0}
    a = {r.k: r for r in Q.bracketed_quantiles(df, ["k"], "v", probs).collect()}
    b = {r.k: r for r in Q.grouped_quantiles(df, ["k"], "v", probs, group_rows=rows).collect()}
    assert set(a) == set(b) == {"hot", "small", "one", "void"}
    for k in a:
        for q in probs:
            assert a[k][q] == (pytest.approx(b[k][q]) if b[k][q] is not None else None), (k, q)


@pytest.mark.parametrize("descending", [True, False])
def test_global_dense_rank(spark, descending):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 700, 3000) / 7.0
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    order = sorted(set(v), reverse=descending)
    want = {x: i + 1 for i, x in enumerate(order)}
    out = Q.global_dense_rank(df, "v", "r", descending).collect()
    assert len(out) == 3000 and all(r.r == want[r.v] for r in out)


def test_no_window_over_an_entity(spark):
    df = facts(spark, [("a", "x", 0, 1.0, 1.0), ("a", "x", 400, 1.0, 1.0)])
    plan = S.active_main_class(df, KEYS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_series_summary_is_hash_aggregated(spark):
    df = facts(spark, [("a", "x", 0, 1.0, 1.0), ("a", "x", 1, None, 7.0), ("a", "x", 2, None, None)])
    span = S.series_span(df, KEYS)
    r = span.first()
    assert (r.close_value, r.holders, r.n_rows, r.n_days) == (1.0, 7.0, 3, 3)
    assert "SortAggregate" not in span._jdf.queryExecution().executedPlan().toString()


def test_share_of_days(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", None), ("a", 2.0)], "k string, v double")
    assert S.share_of_days(df, ["k"], F.col("v") != 0).first().activity == 0.5


def test_quantiles_without_broadcast(spark, monkeypatch):
    """More sketches than may be broadcast: groups are joined in parts, with the same result."""
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g, v in zip(rng.choice(4, 30_000, p=[0.9, 0.05, 0.03, 0.02]), rng.normal(size=30_000))]
    df = spark.createDataFrame(rows, "g int, v double")
    monkeypatch.setattr(Q, "SKETCHES", 1)
    got = {r.g: (r.a, r.b) for r in Q.bracketed_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5}).collect()}
    for g in range(4):
        x = np.array([v for k, v in rows if k == g])
        assert got[g] == pytest.approx(tuple(np.quantile(x, [0.25, 0.5])))


def test_no_exchange_of_raw_rows_by_group(spark):
    """With few sketches, rows are counted before any exchange by the group key alone."""
    df = spark.range(100_000).selectExpr("id % 3 AS g", "rand(1) AS v")
    plan = Q.bracketed_quantiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [g" not in plan.split("HashAggregate")[-1]


def test_sums_do_not_depend_on_order(spark):
    from dayloom.operators.select import null_safe_sum

    rng = np.random.default_rng(1)
    rows = [(float(v),) for v in rng.integers(-(10**12), 10**12, 4000) / 1e5]
    totals = {spark.createDataFrame(rng.permutation(rows).tolist(), "x double").repartition(p).agg(null_safe_sum("x")).first()[0] for p in (1, 3, 7)}
    assert len(totals) == 1
