"""Ranks equal those of a plain loop over all documents and items."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from dayloom.llm import lexical_search
from dayloom.llm.queries import read

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    held = [(i, Counter(TERM.findall(t.translate(UPPER)))) for i, t in docs if t]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            terms = set(TERM.findall((text or "").translate(UPPER))) & c.keys()
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


DOCS = [
    (1, "The cat sat on the mat, the MAT."), (2, None), (3, ""), (4, "... --- !!!"), (5, "cat"), (6, "cat"), (7, "Über naïve cafés 日本語"), (8, "über NAÏVE"),
    (9, "x " * 30_000 + "dog"), (10, "dog_cat dog-cat"), (None, "cat"), (5, "cat"), (12, "a1 1a a1"),
]
ITEMS = [("q1", "the cat"), ("q2", None), ("q3", "!!"), ("q4", "Über 日本語 ÜBER"), ("q1", "dog x a1 unknown"), (None, "cat mat"), ("q5", "unknown")]


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("docs", "terms", "k"), [(1024, 2048, 10), (2, 2, 3), (1, 1, 2)])
def test_equals_plain_loop(spark, monkeypatch, docs, terms, k):
    monkeypatch.setattr(lexical_search, "DOC_TILE", docs)
    monkeypatch.setattr(lexical_search, "TERM_TILE", terms)
    monkeypatch.setattr(lexical_search, "ITEM_TILE", terms)
    d = spark.createDataFrame([(i, t, "score", 7) for i, t in DOCS], "doc_id long, text string, item_id string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id string, text string, rank int")
    got = lexical_search.search(d, q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == plain(DOCS, ITEMS, k)


def test_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", 3)
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert rows(lexical_search.search(d, q)) == plain(DOCS, ITEMS)


def test_empty_tables(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    q = spark.createDataFrame(ITEMS, "item_id string, text string")
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("doc_id in (2, 3, 4)"), q)):
        assert lexical_search.search(a, b).collect() == []


def test_sums_stay_below_two_to_the_53():
    """With the largest weights a tile is narrow enough, and lengths beyond 64 bits do not overflow."""
    q = lexical_search.Queries(None, np.array([0, 500_000]), np.arange(500_000), np.arange(500_000))
    q.ids, q.weight = [0], np.full(500_000, 44_000.0)
    assert all(len(c) * 44_000 * lexical_search.MOST_IMPACT < 1 << 53 for _, _, parts in q.tiles() for c, _ in parts)
    got = lexical_search.impacts(np.array([1 << 40, 5]), np.array([3, 1 << 32]), np.array([0, 1]), 1 << 40, 1 << 60)
    assert got.tolist() == [10**9 * 3 // (3000 + 8 * (10 + 90 * (1 << 80) // (1 << 60))), 10**9 * (1 << 32) // (1000 * (1 << 32) + 80)]
    assert (got < lexical_search.MOST_IMPACT).all()


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = rows(lexical_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark")))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    assert got == sorted(con.sql(lexical_search.SQL).fetchall(), key=str) and len(got) > 100
