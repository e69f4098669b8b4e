"""Nearest vectors by multi-index hashing of learned binary codes.

Codes have ``BITS`` bits: principal axes of a bounded sample, turned by the rotation that
fits their signs best (iterative quantisation). A code is split into ``PARTS`` substrings and
each block of the index keeps a table for each substring. Two codes within Hamming radius r
have a substring within a quarter of r, so probing every table with all substrings that near
gives every code within r; these are compared in full and reranked by the cosine of
the original vectors in double precision. r is learned on the sample, so that it holds
``REACH`` of its true neighbours; a block in which a query finds fewer than k codes within r
is ranked whole, so that no query returns less than it could.

Queries and index rows are dealt out in bounded blocks, and each block of queries meets each
block of the index in one group. Each group gives k rows a query at most, which are ranked again.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another length than the most common one; a null id takes no part; the
candidates of a query are all rows with another id; ties go to the smaller id; equal vectors
are all ranked; rows of one id are one candidate (the nearest); vectors of any size, from the smallest
double to the largest, are compared by direction; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, PARTS = 64, 4
#: Rows the codes and the radius are learned from, and rows a block.
SAMPLE, INDEX_ROWS, QUERY_ROWS = 16_000, 32_768, 8_192
REACH = 0.985
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # a power of two takes the largest component near 1: no square under- or overflows, and no digit changes
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


class Coder:
    """Maps vectors to codes; holds the radius within which to search."""

    def __init__(self, sample: np.ndarray, k: int):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        dim = x.shape[1]
        _, _, axes = np.linalg.svd(x, full_matrices=False) if len(x) >= dim else (0, 0, np.eye(dim))
        axes = axes[:BITS]
        y, rng, turns = x @ axes.T, np.random.default_rng(4981), []
        for _ in range(math.ceil(BITS / len(axes))):
            turn = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0]
            for _ in range(25):
                u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
                turn = (u @ v).T
            turns.append(turn)
        self.project = (axes.T @ np.concatenate(turns, axis=1))[:, :BITS]
        self.radius = self._radius(sample, k)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, PARTS) substrings of 16 bits."""
        bits = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.mean) @ self.project > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")

    def _radius(self, sample: np.ndarray, k: int) -> int:
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        c, far = self.codes(sample), []
        for i in range(0, len(x), max(1, len(x) // 400)):
            s = x @ x[i]
            s[i] = -2
            near = np.argpartition(-s, min(k, len(s) - 1))[:k]
            far.append(_POP[c[near] ^ c[i]].sum(axis=1))
        return int(np.quantile(np.concatenate(far), REACH)) if far else BITS


@lru_cache(maxsize=32)
def _masks(radius: int) -> np.ndarray:
    return np.flatnonzero(_POP <= radius).astype(np.uint16)


def part_radii(radius: int) -> list[int]:
    """Pigeonhole: codes within ``radius`` are within one of these in their substring."""
    a, b = divmod(radius, PARTS)
    return [a if j <= b else a - 1 for j in range(PARTS)]


class Block:
    """A block of the index: a table for each substring."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.ids, self.vectors, self.coder = ids, vectors, coder
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.codes = coder.codes(vectors)
        self.rows = [np.argsort(self.codes[:, j], kind="stable") for j in range(PARTS)]
        self.starts = [np.searchsorted(self.codes[r, j], np.arange((1 << 16) + 1)) for j, r in enumerate(self.rows)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius."""
        hit = np.zeros(len(self.ids), bool)
        for j, r in enumerate(part_radii(radius)):
            if r < 0:
                continue
            value = (_masks(r) ^ code[j]).astype(np.int64)
            lo, n = self.starts[j][value], self.starts[j][value + 1] - self.starts[j][value]
            lo, n = lo[n > 0], n[n > 0]
            slot = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            hit[self.rows[j][slot]] = True
        near = np.flatnonzero(hit)
        return near[_POP[self.codes[near] ^ code].sum(axis=1) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest other rows found."""
        near = self.within(code, self.coder.radius)
        near = near[self.ids[near] != query_id]
        if len(near) < k:
            near = np.flatnonzero(self.ids != query_id)
        score = (self.vectors[near] * vector).sum(axis=1) / (self.norms[near] * math.sqrt((vector * vector).sum()))
        ids = self.ids[near]
        if len(np.unique(ids)) < len(ids):
            order = np.lexsort((-score, ids))
            order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
            ids, score = ids[order], score[order]
        if len(ids) > 8 * k:
            edge = -np.partition(-score, k - 1)[k - 1]
            ids, score = ids[score >= edge], score[score >= edge]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def _usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v (array of double) of the rows that take part."""
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    df = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return df.where(F.col("id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda e: e != 0))


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usable = _usable(vectors, id_column, vector)
    sizes = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n, q = sizes
    usable = usable.where(F.size("v") == dim)
    picked = usable if n <= sample else usable.where(F.shiftrightunsigned(F.xxhash64("id"), 1) < ((1 << 63) - 1) * sample // n)
    held = spark.sparkContext.broadcast(Coder(_matrix(picked.limit(2 * sample).toArrow().column("v"), dim), k))  # about ``sample`` rows

    # the index is copied once for each block of queries: few large ones, but enough groups for all cores
    index_blocks = math.ceil(n / index_rows)
    query_blocks = max(1, math.ceil(q / query_rows), min(math.ceil(q / 64), math.ceil(spark.sparkContext.defaultParallelism / index_blocks)))
    deal = lambda blocks, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")
    # each row goes to the groups of its own block and of every block of the other side
    rows = usable.select("id", "v", deal(index_blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("a"))
    asked = usable.where(F.col("id") % every == 0).select("id", "v", deal(query_blocks, 2).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("b"))

    def search(_, queries, index):
        if not queries.num_rows or not index.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        coder = held.value
        block = Block(index.column("id").to_numpy(), _matrix(index.column("v"), dim), coder)
        wanted = _matrix(queries.column("v"), dim)
        found = [(i, *block.nearest(i, v, c, k)) for i, v, c in zip(queries.column("id").to_pylist(), wanted, coder.codes(wanted), strict=True)]
        return pa.table(
            {
                "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                "vec_id": pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                "score": pa.array(np.concatenate([f[2] for f in found]), pa.float64()),
            }
        )

    def search_group(key, queries, index):
        return search(key, queries, index)

    found = asked.groupBy("a", "b").cogroup(rows.groupBy("a", "b")).applyInArrow(search_group, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
