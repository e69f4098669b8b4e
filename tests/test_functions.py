from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions import dates, measures, names
from dayloom.operators.reshape import any_missing
from dayloom.operators.scaling import standardize
from dayloom.sources import facts as FS
from dayloom.sources.tables import read_csv


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("r")).first().r


def test_composite_key_shows_missing_parts(spark):
    assert one(spark, measures.composite_key("a", "b", "c", "d"), "a string, b string, c string, d string", "a", None, "c", "d") == "a_NA_c_d"
    assert one(spark, measures.joined_text("a", "b"), "a string, b string", "x", None) is None


@pytest.mark.parametrize("pre, inc, factor, ret", [(5.0, 5.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0), (101.0, 1.0, 1.01, 0.01), (None, 1.0, None, None)])
def test_growth(spark, pre, inc, factor, ret):
    schema = "p double, i double"
    got = one(spark, measures.growth_factor("p", "i"), schema, pre, inc), one(spark, measures.growth_return("p", "i"), schema, pre, inc)
    assert got == (pytest.approx(factor) if factor is not None else None, pytest.approx(ret) if ret is not None else None)


def test_number_and_code(spark):
    assert one(spark, measures.clean_number("t"), "t string", "$ -1,234.50") == 1234.5
    assert one(spark, measures.clean_number("t"), "t string", "n/a") is None
    assert one(spark, measures.category_code("t", {"x": 1}), "t string", "y") is None
    assert one(spark, measures.annual_percent_to_daily("v"), "v double", 10.0) == pytest.approx(1.1 ** (1 / 365))


def test_name_cleanup(spark):
    assert one(spark, names.keep_tokens("t"), "t string", "X ALIANZA Y Z") == "ALIANZA Y"
    assert one(spark, names.keep_tokens("t"), "t string", None) is None
    assert one(spark, names.repair("t"), "t string", "FIDUCIARIA BOGOT? SA") == "FIDUCIARIA BOGOTA SA"
    assert one(spark, names.repair("t"), "t string", "ACCI??N UNO") == "ACCION UNO"
    assert one(spark, names.strip_phrases("t"), "t string", "FONDO DE INVERSI?N COLECTIVA ABC F.I.C.") == "ABC"


def test_dates(spark):
    assert one(spark, dates.months_before("d", 1), "d date", date(2024, 3, 31)) == date(2024, 2, 29)
    assert one(spark, dates.month_ceiling("d"), "d date", date(2024, 3, 1)) == date(2024, 4, 1)
    assert one(spark, dates.day_first_date("t"), "t string", "05/11/2023") == date(2023, 11, 5)
    assert one(spark, dates.day_first_date("t"), "t string", "oops") is None
    assert one(spark, dates.partial_date("t"), "t string", "2023-11") == date(2023, 11, 1)
    assert one(spark, dates.iso_weekday("d"), "d date", date(2024, 1, 7)) == 7
    lo, hi = dates.five_year_window(F.lit(date(2024, 5, 6)))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (r.lo, r.hi) == (date(2019, 1, 1), date(2024, 5, 6))


def test_non_working(spark):
    rows = [(date(2024, 1, 6), False), (date(2024, 1, 8), True), (date(2024, 1, 9), None)]
    df = spark.createDataFrame(rows, "d date, h boolean").select(dates.non_working_flag("d", "h").alias("f"))
    assert [r.f for r in df.collect()] == [1.0, 1.0, 0.0]


def feed_row(**kw):
    base = {k: "1" for k in FS.FEED_COLUMNS}
    return {**base, "fecha_corte": "2024-01-02T00:00:00.000", "tipo_entidad": "5", "codigo_entidad": "16",
            "subtipo_negocio": "1", "codigo_negocio": "77", "tipo_participacion": "800", **kw}


def test_landed_feed(spark, tmp_path):
    src = tmp_path / "feed"
    src.mkdir()
    lines = [
        feed_row(), feed_row(subtipo_negocio="7"), feed_row(fecha_corte="2023-01-01T00:00:00.000"),
        feed_row(rendimientos_abonados="bad", aportes_recibidos="10", retiros_redenciones="4", anulaciones="1"),
    ]
    (src / "p.json").write_text("\n".join(json.dumps(x) for x in lines))
    out = FS.load_facts(FS.read_feed(spark, str(src)), "2024-01-01", "2024-12-31").orderBy("net_flow").collect()
    assert [r.entity_id for r in out] == ["5_16_1_77", "5_16_1_77"]
    assert [r.income for r in out] == [1.0, None] and [r.net_flow for r in out] == [1.0, 7.0]
    facts = spark.createDataFrame(out, FS.load_facts(FS.read_feed(spark, str(src))).schema)
    FS.land_facts(facts, str(tmp_path / "landed"))
    back = FS.read_facts(spark, str(tmp_path / "landed"), "2024-01-01", "2024-01-31")
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().executedPlan().toString()


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("k,d,v\na,31/12/2023,1.5\nb,bad,2\n")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("d", T.StringType()), T.StructField("v", T.DoubleType())])
    rows = read_csv(spark, str(tmp_path / "s.csv"), schema, ["d"], day_first=True).orderBy("k").collect()
    assert [r.d for r in rows] == [date(2023, 12, 31), None]


def test_missing_check_and_scaling(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "y")], "a double, b string")
    r = any_missing(df).first()
    assert (r.a, r.b) == (True, False)
    z = standardize(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).orderBy("a").collect()
    assert z[0].a == pytest.approx(-(0.5**0.5)) and z[0].b is None


def test_rounding_without_decimals_gives_the_same_bits(spark):
    import random
    import struct

    r = random.Random(5)
    values = [0.0, -0.0, 0.5, -0.5, 2.5e-7, 1.0000005, 1.15, -1.15, 0.05, 1e300, -1e300, 5e-324, 1e12, 1.5e12 + 0.25, float("nan"), float("inf"), -float("inf"), None]
    values += [r.choice((-1, 1)) * r.random() * 10.0 ** r.randrange(-10, 16) for _ in range(20_000)]
    values += [r.randrange(-(10**7), 10**7) / 2 / 10**d for d in (0, 1, 6, 9) for _ in range(2_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    bits = lambda v: None if v is None else struct.pack(">d", v)
    for digits in (1, 6, 9):
        rows = df.select(measures.round_double(F.col("x"), digits).alias("a"), F.round("x", digits).alias("b"), "x").collect()
        assert [x.x for x in rows if bits(x.a) != bits(x.b)] == []


def test_only_doubles_are_rounded_without_decimals(spark):
    df = spark.sql("SELECT CAST(1.25 AS DECIMAL(10,4)) AS d, 7L AS n, 0.12345678D AS x")
    out = measures.with_rounded(df, ["d", "n", "x"], 1)
    assert out.dtypes == df.select(F.round("d", 1).alias("d"), F.round("n", 1).alias("n"), F.round("x", 1).alias("x")).dtypes
    assert [float(v) for v in out.first()] == [1.3, 7.0, 0.1]
