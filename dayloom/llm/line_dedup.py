"""Removal of boilerplate lines: lines that spread over many sites.

A HyperLogLog sketch of the sites of each line is built and merged by aggregation. Lines whose
estimate lies clearly above the threshold are boilerplate, clearly below are not; lines near
the threshold get an exact distinct count. Sites are counted over distinct texts: however often a whole text is
copied, it stands for one site (its least), so that a copied page does not lose the lines
that are its own. Boilerplate goes wherever it stands.

Lines are cut at line feeds and compared without blanks, tabs and carriage returns at their
ends; blank lines are kept and never count. Lines and texts are named by two 64-bit hashes.

Defined cases: a null text stays null, an empty one empty; a null site counts as no site;
a text of boilerplate alone keeps its blank lines only; repeated rows and equal doc_ids stay separate rows; an
empty table gives an empty result; other columns are kept, and columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.corpus import written

MIN_SITES = 5
LG_K = 10
#: A line with at least this share of all lines is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4
_KEY = ["line_a", "line_b"]
_ROW = ["__row_a", "__row_b"]
_TEXT = ["text_a", "text_b"]


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _row_key(docs: DataFrame) -> DataFrame:
    """Equal rows share a key, which is harmless: they lose the same lines."""
    return docs.withColumn("__row_a", F.xxhash64("doc_id", "text")).withColumn("__row_b", F.xxhash64("text", F.lit(1), "doc_id"))


def _lines(docs: DataFrame, *columns: str) -> DataFrame:
    """One row a non-blank line: the given columns, its position and its key."""
    cut = docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    bare = cut.select(*columns, "pos", _bare(F.col("raw")).alias("line")).where("line <> ''")
    return bare.select(*columns, "pos", F.xxhash64("line").alias("line_a"), F.xxhash64("line", F.lit(1)).alias("line_b"))


def _sites(docs: DataFrame) -> DataFrame:
    """One row for each line and distinct text that holds it: the least site of that text, and how often the line occurs."""
    named = docs.select("source", "text", F.xxhash64("text").alias("text_a"), F.xxhash64("text", F.lit(1)).alias("text_b"))
    return _lines(named, "source", *_TEXT).groupBy(*_KEY, *_TEXT).agg(F.min("source").alias("site"), F.count(F.lit(1)).alias("n"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """line_a, line_b and the number of occurrences of every line on at least ``min_sites`` sites."""
    sketched = _sites(docs).groupBy(*_KEY).agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.sum("n").alias("n"))
    estimated = sketched.select(*_KEY, "n", F.hll_sketch_estimate("sites").alias("estimate"))
    margin = max(1, math.ceil(min_sites * 4 * 1.04 / math.sqrt(2**lg_k)))
    spread = written(estimated.where(F.col("estimate") >= min_sites - margin), "spread")
    sure = spread.where(F.col("estimate") >= min_sites + margin).select(*_KEY, "n")
    near = spread.where(F.col("estimate") < min_sites + margin).select(*_KEY, F.col("n").alias("total"))
    exact = (
        _sites(docs).join(near, _KEY).groupBy(*_KEY, "total", "site").agg(F.lit(1).alias("one"))
        .groupBy(*_KEY, "total").agg(F.count("site").alias("exact")).where(F.col("exact") >= min_sites)
    )
    return written(sure.unionByName(exact.select(*_KEY, F.col("total").alias("n"))), "boilerplate")


def clean(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """All columns with boilerplate lines taken out of ``text``, and n_lines, n_removed."""
    bad = boilerplate(docs, min_sites, lg_k)
    lines = _lines(_row_key(docs.select("doc_id", "text")), *_ROW)
    # Lines in very many rows would meet in one task: there are at most 1 / HOT_SHARE of them,
    # which are broadcast; all others are joined by their key.
    total = docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n")))).first()[0] or 0
    floor = max(1, math.ceil(total * HOT_SHARE))
    hot = F.broadcast(bad.where(F.col("n") >= floor).select(*_KEY))
    rest = bad.where(F.col("n") < floor).select(*_KEY)
    found = lines.join(hot, _KEY, "left_semi").unionByName(lines.join(hot, _KEY, "left_anti").join(rest, _KEY, "left_semi"))
    by_row = found.groupBy(*_ROW).agg(F.collect_set("pos").alias("__lost"))
    parts = F.split("text", "\n")
    kept = _row_key(docs.drop("n_lines", "n_removed")).join(by_row, _ROW, "left").drop(*_ROW)
    kept = kept.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"))
    kept = kept.withColumn("n_removed", F.when(F.col("__lost").isNull(), 0).otherwise(F.size("__lost")).cast("long"))
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__lost", i)), "\n")
    return kept.withColumn("text", F.when(F.col("n_removed") > 0, left).otherwise(F.col("text"))).drop("__lost")


SQL = f"""
WITH w AS MATERIALIZED (SELECT text, min(source) AS site FROM documents GROUP BY text),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, site, string_split(text, chr(10)) AS parts FROM documents LEFT JOIN w USING (text)),
l AS MATERIALIZED (
  SELECT rid, site, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT rid, site, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos FROM d)
),
b AS MATERIALIZED (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
f AS MATERIALIZED (SELECT l.rid, l.pos, l.raw, b.line IS NOT NULL AS bad FROM l LEFT JOIN b USING (line)),
k AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_removed FROM f GROUP BY rid),
t AS (
  SELECT f.rid, string_agg(f.raw, chr(10) ORDER BY f.pos) AS kept
  FROM f JOIN k USING (rid) WHERE k.n_removed > 0 AND NOT f.bad GROUP BY f.rid
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN coalesce(k.n_removed, 0) = 0 THEN d.text ELSE coalesce(t.kept, '') END AS text
FROM d LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)
"""
