"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "dayloom", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches, with a shared folder of its own; clusters bring theirs."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Wide metric projections compile to methods the JVM would not optimise; beyond
        # this size operators are generated one by one, in methods that are.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="dayloom-"))
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, which the session must name."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return folder


_given: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/dayloom-{uuid.uuid4().hex}"
    _given.append(folder)
    return f"{folder}/{name}"


_tables: list[str] = []


def remember_table(name: str) -> None:
    """A catalog table whose files lie in the shared folder; it goes with them."""
    _tables.append(name)


def written_so_far() -> tuple[int, int]:
    """A mark for ``discard_written``: what is written later can be removed alone."""
    return len(_given), len(_tables)


def discard_written(spark: SparkSession, since: tuple[int, int] = (0, 0), keep: Sequence[str] = ()) -> int:
    """Remove what this session wrote to the shared folder since a mark, once its results have been used; the number of folders.

    Folders that hold one of the paths in ``keep`` stay.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in _tables[since[1] :]:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    del _tables[since[1] :]
    gone, stay = 0, []
    for folder in _given[since[0] :]:
        if any(k.startswith(f"{folder}/") for k in keep):
            stay.append(folder)
        else:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            gone += bool(path.getFileSystem(conf).delete(path, True))
    _given[since[0] :] = stay
    return gone


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def newest(df: DataFrame, date: str = "ds") -> Column:
    """The greatest date of ``df`` as a scalar subquery (one row, no join)."""
    return df.agg(F.max(date)).scalar()


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash rows by ``keys`` over the configured number of shuffle partitions.

    Used before rows are multiplied: adaptive execution sizes partitions by the bytes
    that were shuffled and would pack the few source rows of many series into one task.
    Windows and joins on the same keys reuse this exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and scan it from there.

    For a result with several consumers: it is computed once, survives the loss of
    executors, and every consumer reads only its columns.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_threads(spark: SparkSession, jobs: Sequence[Callable[[], object]], threads: int = 4) -> list:
    """Submit independent Spark jobs from a few driver threads, as parallel tuning does."""
    pool = ThreadPool(min(threads, max(1, len(jobs))))
    run = inheritable_thread_target(spark)(lambda job: job())
    try:
        return pool.map(run, jobs)
    finally:
        pool.close()
