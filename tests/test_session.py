"""Written results can be removed from a mark on, with their tables."""

from __future__ import annotations

import os

from dayloom import session


def test_discard_since_a_mark(spark):
    first = session.shared_path(spark, "first")
    spark.range(3).write.parquet(first)
    mark = session.written_so_far()
    second, third = (session.shared_path(spark, n) for n in ("second", "third"))
    spark.range(4).write.parquet(second)
    spark.range(5).write.option("path", third).saveAsTable("held_for_a_while")
    session.remember_table("held_for_a_while")
    assert session.discard_written(spark, mark, keep=[second]) == 1
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 4
    assert not spark.catalog.tableExists("held_for_a_while") and not os.path.exists(third.removeprefix("file:"))
    assert session.discard_written(spark, mark) == 1 and not os.path.exists(second)
