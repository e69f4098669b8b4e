"""Token ids of a corpus as files of Re-Pair grammars, in ascending document order.

``write`` deals rows into ranges of document ids, encodes whole texts, appends an end id to each,
and writes shards of about ``SHARD_IDS`` ids: a row of Parquet with the documents' ids and one
grammar (see ``grammar.py``). Spark's committer writes the files, so a lost or repeated task
leaves one copy of a shard. ``shards.parquet`` holds the shards, ``index.parquet`` the number of ids
before each of them. ``read`` gives back all documents, ``fetch`` opens only the shards that can
hold the wanted documents and expands only the wanted part.

Defined cases: a null text is an empty one (its ids are the end id alone); rows with equal
ids stay separate and stand in the order of their texts' hashes; a null id comes first; a document is never
cut, so one of more than ``SHARD_IDS`` ids is a shard of its own; an empty table gives
no documents; other columns are not used, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.llm import byte_bpe
from dayloom.llm.bpe import _source
from dayloom.llm.grammar import Grammar
from dayloom.llm.words import blob, steps
from dayloom.session import shared_path

SHARD_IDS = 1 << 20
END_ID = 0
#: Partitions whose shards are added up together in the first of two steps.
INDEX_BLOCK = 512


def write(docs: DataFrame, vocabulary: str, out: str, column: str = "text", id_column: str = "doc_id") -> None:
    spark = docs.sparkSession
    source = _source(docs, vocabulary)
    classes = spark.sparkContext.broadcast(byte_bpe.character_classes().tobytes())
    kind = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(column).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    fields = [("shard", T.LongType()), ("least", kind), ("most", kind), ("n_docs", T.LongType()), ("n_tokens", T.LongType()), ("doc_ids", T.ArrayType(kind)), ("grammar", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def shards(batches):
        coder = byte_bpe.coder(source.value, classes.value)
        base, made = TaskContext.get().partitionId() << 24, 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal made, held
            names_now, size = pa.concat_arrays(names), np.concatenate(sizes)
            grammar = Grammar.of(np.concatenate(ids), size, coder.size)
            ends = pc.min_max(names_now)
            row = [base + made, ends["min"].as_py(), ends["max"].as_py(), len(size), int(size.sum()), names_now, grammar.dump()]
            made, held = made + 1, 0
            ids.clear(), sizes.clear(), names.clear()
            arrays = [pa.ListArray.from_arrays([0, len(v)], v) if isinstance(v, pa.Array) else pa.array([v], names_now.type if n in ("least", "most") else None) for (n, _), v in zip(fields, row, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])

        for b in steps(batches):
            flat, n = coder.encode(b.column("text"))
            flat, n = np.insert(flat, np.cumsum(n), END_ID), n + 1
            ends, lo = np.cumsum(n), 0
            while lo < len(n):
                gone = int(ends[lo - 1]) if lo else 0
                hi = max(lo + (held == 0), int(np.searchsorted(ends, gone + SHARD_IDS - held, "right")))
                if hi > lo:
                    ids.append(flat[gone : ends[hi - 1]])
                    sizes.append(n[lo:hi])
                    names.append(b.column("doc_id").slice(lo, hi - lo))
                    held += int(ends[hi - 1]) - gone
                    lo = hi
                if lo < len(n) or held >= SHARD_IDS:
                    yield shard()
        if held:
            yield shard()

    rows.mapInArrow(shards, schema).write.option("compression", "zstd").parquet(f"{out}/shards.parquet")
    _number(spark, out)


def _number(spark: SparkSession, out: str) -> None:
    """Ids before each shard: running sums inside blocks of partitions, then over the blocks' totals."""
    shards = spark.read.parquet(f"{out}/shards.parquet").select("shard", "n_tokens", F.shiftright("shard", 24 + INDEX_BLOCK.bit_length() - 1).alias("block"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = shards.withColumn("start", before(Window.partitionBy("block").orderBy("shard")))
    blocks = shards.groupBy("block").agg(F.sum("n_tokens").alias("n_tokens"))
    blocks = blocks.select("block", before(Window.orderBy("block")).alias("gone"))
    index = inside.join(blocks, "block").select("shard", (F.col("start") + F.col("gone")).alias("shard_start"))
    index.write.parquet(f"{out}/index.parquet")


def _opened(shards: DataFrame, make: Callable[[pa.Array, Grammar], dict[str, pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """make(document ids, grammar) of every shard, as rows with ``shard``."""
    schema = T.StructType([T.StructField("shard", T.LongType(), False), *fields])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                made = make(row.column("doc_ids").flatten(), Grammar.load(row.column("grammar")[0].as_py()))
                n = len(next(iter(made.values())))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(n, row.column("shard")[0].as_py()), pa.int64()), **made})

    return shards.select("shard", "doc_ids", "grammar").mapInArrow(run, schema)


def _placed(spark: SparkSession, out: str, rows: DataFrame) -> DataFrame:
    """Rows with ``start`` counted from the beginning of the corpus instead of the shard's."""
    index = spark.read.parquet(f"{out}/index.parquet")
    names = [c for c in rows.columns if c != "shard"]
    return rows.join(index, "shard").select(*(F.col("start") + F.col("shard_start") if c == "start" else F.col(c) for c in names)).toDF(*names)


def _kind(shards: DataFrame) -> T.StructField:
    return T.StructField("doc_id", shards.schema["doc_ids"].dataType.elementType)


def _starts(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.cumsum(sizes) - sizes, pa.int64())


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, ids of every document in the files."""
    shards = spark.read.parquet(f"{out}/shards.parquet")

    def documents(doc_ids, grammar):
        sizes = grammar.sizes
        off = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return {"doc_id": doc_ids, "start": _starts(sizes), "ids": pa.ListArray.from_arrays(off, pa.array(grammar.ids(), pa.int32()))}

    fields = [_kind(shards), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return _placed(spark, out, _opened(shards, documents, fields))


def fetch(spark: SparkSession, out: str, doc_id, lo: int = 0, hi: int | None = None) -> DataFrame:
    """doc_id and ids lo..hi of the documents with one id: shards are chosen by their statistics."""
    shards = spark.read.parquet(f"{out}/shards.parquet").where((F.col("least") <= F.lit(doc_id)) & (F.col("most") >= F.lit(doc_id)))

    def part(doc_ids, grammar):
        found = [d for d, name in enumerate(doc_ids.to_pylist()) if name == doc_id]
        ids = [grammar.document(d, lo, hi) for d in found]
        return {"doc_id": doc_ids.take(pa.array(found, pa.int64())), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return _opened(shards, part, [_kind(shards), T.StructField("ids", T.ArrayType(T.IntegerType()))]).drop("shard")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from files written and read back."""
    spark = docs.sparkSession
    out = shared_path(spark, "token_files")
    write(docs, vocabulary, out)
    shards = spark.read.parquet(f"{out}/shards.parquet")

    def sums(doc_ids, grammar):
        sizes = grammar.sizes
        ends, raw = 4 * np.cumsum(sizes), memoryview(blob(grammar.ids().astype("<u4")))
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)]
        return {"doc_id": doc_ids, "start": _starts(sizes), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

    fields = [_kind(shards), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))]
    return _placed(spark, out, _opened(shards, sums, fields))
