"""Lines on many sites go, exactly as DuckDB's distinct counts say; copies of pages stay."""

from __future__ import annotations

import random

import duckdb
import pytest

from dayloom.llm import line_dedup


def both(spark, rows):
    schema = "doc_id long, text string, source string"
    df = spark.createDataFrame(rows, schema)
    got = line_dedup.clean(df).select("doc_id", "n_lines", "n_removed", "text").collect()
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.execute(line_dedup.SQL).fetchall()
    return sorted(map(tuple, got), key=str), sorted(want, key=str)


def test_equals_sql(spark):
    r = random.Random(2)
    pool = [f"line {i}" for i in range(40)]
    rows = [(None, None, None), (1, "", "s0"), (2, " \n\t\n", "s0"), (3, "line 1\r", None), (3, "line 1\r", None)]
    for i in range(400):
        text = "\n".join(r.choice(["", " "]) + (r.choice(pool[: 3 + i % 38]) if r.random() < 0.4 else f"own {r.random()}") for _ in range(r.randrange(1, 14)))
        rows.append((r.randrange(50, 380), text, f"s{r.randrange(3 + i % 7)}" if r.random() < 0.95 else None))
    rows.append((9000, "\n".join(["line 0"] * 4000 + ["only here"] * 5000), "s1"))
    got, want = both(spark, rows)
    assert got == want
    assert sum(g[2] > 0 for g in got) > 50


def test_near_threshold_is_exact(spark):
    """Lines on exactly one site fewer than needed stay, at any repetition; a page copied everywhere stays."""
    rows = [(i, f"almost\nall\na {i}\nb {i}\nc {i}\nd {i}", f"s{i % 4}") for i in range(300)]
    rows += [(1000 + i, f"all\nx {i}\ny {i}", f"t{i}") for i in range(3)]
    rows += [(2000 + i, "copied page\nwhole", f"u{i}") for i in range(9)]
    got = {x.doc_id: x for x in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].n_removed == 1 and got[i].text.startswith("almost\na ") for i in range(300))
    assert all(got[2000 + i].text == "copied page\nwhole" for i in range(9))


def test_boilerplate_goes_wherever_it_stands(spark):
    """Short pages lose header and footer however few lines are their own; texts of boilerplate alone become blank."""
    rows = [(i, f"head\nown {i}\nfoot", f"s{i}") for i in range(6)] + [(10, "head\n\nfoot", "s1"), (11, "head", "s2"), (12, "head", None)]
    rows += [(20 + i, "copied\nown 0\npage", f"s{i}") for i in range(30)]
    got, want = both(spark, rows)
    assert got == want
    texts = {g[0]: g[3] for g in got}
    assert texts[3] == "own 3" and texts[10] == "" and texts[11] == texts[12] == "" and texts[25] == "copied\nown 0\npage"


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", "s", "k", 7)], "doc_id long, text string, source string, n_lines string, pos int")
    out = line_dedup.clean(df)
    assert out.columns == ["doc_id", "text", "source", "pos", "n_lines", "n_removed"] and (out.first().n_lines, out.first().pos) == (2, 7)
    assert line_dedup.clean(df.limit(0)).count() == 0


@pytest.mark.parametrize("lg_k", [4, 10])
def test_coarse_sketches_change_nothing(spark, lg_k):
    rows = [(i * 10 + j, f"l{i}\nown {i} {j}", f"s{j}") for i in range(40) for j in range(3 + i % 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = line_dedup.boilerplate(df, 5, lg_k).count()
    assert bad == sum(3 + i % 5 >= 5 for i in range(40))
