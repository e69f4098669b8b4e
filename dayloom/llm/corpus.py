"""A corpus cut into chunks of bounded size, and questions that chunks ask of all the others.

``cut`` writes whole texts once, as a table bucketed by chunk in the shared folder; later
steps group it by chunk without another shuffle of the texts. ``ask`` lets every chunk send
its own distinct keys (64 bits, with a weight) to the bucket a key hashes to; a bucket adds
the weights of equal keys and answers each chunk in the order of its keys. A pair of chunk and
bucket travels as one row of packed numbers, so rows never outnumber the keys, and equal keys
meet already reduced to one a chunk: a key that holds a third of the corpus costs its bucket
no more than one entry a chunk.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.llm.words import blob
from dayloom.session import remember_table, shared_path

CHUNK_BYTES = 8 << 20
KEYS_A_BUCKET = 1 << 20
#: What a row counts besides its text, so that rows without text fill chunks too (131,072 rows at most).
ROW_BYTES = 64
ANSWER = "chunk long, bucket int, n binary"
REQUEST = "chunk long, bucket int, keys binary, n binary"


@dataclass
class Corpus:
    """``texts`` (chunk, columns..., text); ``size`` is the number of text bytes."""

    texts: DataFrame
    size: int
    parts: int

    def buckets(self, keys_per_byte: float = 0.15) -> int:
        return max(self.parts, math.ceil(self.size * keys_per_byte / KEYS_A_BUCKET))

    def each(self, fn: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
        """Apply fn(chunk, rows) to every chunk."""
        return self.texts.groupBy("chunk").applyInArrow(lambda key, rows: fn(key[0].as_py(), rows), schema)

    def with_answers(self, answers: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """Apply fn(chunk, rows, answers of the chunk) to every chunk."""

        def both(key, rows, more):
            return fn(key[0].as_py(), rows, more)

        return self.texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, schema)


def cut(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), chunk_bytes: int = CHUNK_BYTES) -> Corpus:
    """Write ``columns`` of all rows, cut into chunks of about ``chunk_bytes`` of text.

    A chunk is a run of rows of one input partition; its id comes from the partition that
    wrote it, and only the written table is ever read, so a retried task cannot change it.
    """
    spark = docs.sparkSession
    docs = docs.select(*columns)
    schema = T.StructType([T.StructField("chunk", T.LongType()), *docs.schema.fields])

    def chunks(batches):
        base, k, held = TaskContext.get().partitionId() << 22, 0, 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
            ends = np.cumsum(sizes) + held
            ids = base + k + ends // chunk_bytes
            held = int(ends[-1]) % chunk_bytes if len(ends) else held
            k += int(ends[-1]) // chunk_bytes if len(ends) else 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *b.columns], names=["chunk", *b.schema.names])

    path, name = shared_path(spark, "chunks"), f"chunks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut_up = docs.mapInArrow(chunks, schema)
    cut_up.write.bucketBy(parts, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    remember_table(name)
    texts = spark.table(name)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return Corpus(texts, int(size), parts)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, computed once and read back from the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits of a mixed 64-bit key (keys sorted by value are sorted by bucket)."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def request(chunk: int, keys: np.ndarray, weights: np.ndarray, buckets: int, put: Callable[[np.ndarray], bytes] = blob) -> pa.Table:
    """Rows of REQUEST for sorted distinct ``keys``; weights are unsigned 32-bit; ``put`` writes a bucket's keys."""
    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    w = pack(weights)
    return pa.table(
        {
            "chunk": pa.array(np.full(len(used), chunk), pa.int64()),
            "bucket": pa.array(used, pa.int32()),
            "keys": pa.array([put(keys[edges[u] : edges[u + 1]]) for u in used], pa.binary()),
            "n": pa.array([blob(w[edges[u] : edges[u + 1]]) for u in used], pa.binary()),
        }
    )


def pack(n: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes: the dtype is told from the length of the packed value."""
    top = int(n.max()) if len(n) else 0
    return n.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def unpack(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // count]).astype(np.int64) if count else np.zeros(0, np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the steps to the next, in the fewest bytes a step, byte by byte."""
    steps = np.diff(keys)
    width = -(-int(steps.max()).bit_length() // 8) if len(steps) else 0
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return blob(keys[:1]) + bytes([width]) + blob(planes)


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[8]
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(width, -1) if width else np.zeros((0, 0), np.uint8)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.uint64, 1), steps.view("<u8").ravel()]), dtype=np.uint64)


def plain_keys(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _added(rows: pa.Table, get: Callable[[bytes], np.ndarray] = plain_keys) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    chunks = rows.column("chunk").to_pylist()
    keys = [get(k) for k in rows.column("keys").to_pylist()]
    ns = [unpack(n, len(k)) for n, k in zip(rows.column("n").to_pylist(), keys, strict=True)]
    flat, n = np.concatenate(keys), np.concatenate(ns)
    uniq, inverse = np.unique(flat, return_inverse=True)
    return chunks, keys, uniq, inverse, np.bincount(inverse, weights=n, minlength=len(uniq)).astype(np.int64)


def answer(requests: DataFrame, get: Callable[[bytes], np.ndarray] = plain_keys) -> DataFrame:
    """Each chunk's keys (read by ``get``) answered, in its own order, with the sum of the weights over all chunks."""

    def add(key, rows):
        chunks, keys, _, inverse, total = _added(rows, get)
        edges = np.cumsum([0, *map(len, keys)])
        back = total[inverse]
        return pa.table(
            {
                "chunk": pa.array(chunks, pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(chunks), pa.int32()),
                "n": pa.array([blob(pack(back[edges[i] : edges[i + 1]])) for i in range(len(chunks))], pa.binary()),
            }
        )

    return requests.groupBy("bucket").applyInArrow(add, ANSWER)


def answers_for(keys: np.ndarray, rows: pa.Table, buckets: int) -> np.ndarray:
    """The answers (``rows`` of ANSWER for one chunk) put beside the sorted distinct ``keys`` that were asked."""
    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    out = np.zeros(len(keys), np.int64)
    for b, n in zip(rows.column("bucket").to_pylist(), rows.column("n").to_pylist(), strict=True):
        lo, hi = edges[b], edges[b + 1]
        out[lo:hi] = unpack(n, hi - lo)
    return out
