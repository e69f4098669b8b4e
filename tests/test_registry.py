"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as registry  # noqa: E402
from tools.check_oracle import TABLES, compare  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, small, name):
    got = registry.queries()[name](spark, small).toPandas()
    assert compare(got, con.execute(registry.oracle_sql()[name]).df()) == "ok"


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    out = registry.entry(spark)
    assert "rent_30" in out.columns and out.count() > 0


def test_sorted_output_is_ordered(spark, small):
    rows = registry.queries()["sorted_output"](spark, small).collect()
    prices = [r.o_totalprice for r in rows]
    assert prices == sorted(prices, reverse=True)


def test_entry_works_without_the_optional_parts(monkeypatch):
    """Parts that were taken out are left out; the other queries stay. An error inside a part is raised."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "dayloom.llm.queries", None)
    names = set(registry.queries())
    assert "risk_return_panel" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(registry.oracle_sql()) <= names


def test_risk_return_panel_reads_its_source_few_times(spark, small):
    for name, most in (("risk_return_panel", 5), ("rolling_origin", 8), ("standardize", 14)):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") <= most, name
