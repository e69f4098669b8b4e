"""Ranked lexical search by dense products: item weights times document impacts, tile by tile.

A first pass over whole texts keeps, for each document, its number of terms and how often it
holds each term of the items (nothing else is needed for scores); document frequencies are added
up from one count a term and task. Then documents are taken ``DOC_TILE`` at a time: for ``ITEM_TILE`` items and up
to ``TERM_TILE`` terms of those items' own vocabulary, weights (items x terms) and impacts
(terms x documents) are dense float64 matrices, multiplied by BLAS. All numbers are whole, and a tile is never so wide
that a sum could reach 2**53, so each product is exact; sums over tiles are 64-bit integers.
A task keeps the ``k`` best documents of each item: whatever equals the k-th score stays until
ties are settled by document id.

Items are handled in groups of bounded size (``GROUP_TERMS``): a group's vocabulary and weights are
broadcast; more items make more groups, each of which reads the documents once.

Defined cases: a text that is null or has no term takes no part (it counts neither in N nor as a
result) and an item without terms has no rows; rows with equal document ids are ranked separately; a null
document id comes after all others; items with equal ids are answered separately; empty tables give no rows; other
columns are not used, whatever their names. Ids of documents are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.llm.corpus import written
from dayloom.llm.words import find_words, steps, text_bytes, word_hashes

DOC_TILE, ITEM_TILE, TERM_TILE = 1024, 256, 2048
#: Distinct terms of the items of a group, summed over its items (8 bytes each are broadcast).
GROUP_TERMS = 4 << 20
#: An impact is below 1e9 tf / (1000 tf).
MOST_IMPACT = 1_000_000
#: Lists of k that the tasks give for an item are merged in so many parts first.
MERGE_PARTS = 64

TERM = np.ones(256, bool)
TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def terms(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, first term of each row) of a string column."""
    data, off = text_bytes(column)
    starts, ends, first = find_words(data, off, TERM)
    return word_hashes(data, starts, ends, lower=True), first


@dataclass
class Queries:
    """Items of a group: ``term[first[i]:first[i + 1]]`` are item i's places in ``vocabulary``."""

    ids: pa.Array
    first: np.ndarray
    term: np.ndarray
    vocabulary: np.ndarray
    weight: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    def tiles(self) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
        """(first item, item after the last, [(terms, weights items x terms)])."""
        width = max(1, min(TERM_TILE, (1 << 53) // (MOST_IMPACT * int(self.weight.max(initial=1) + 1))))
        for lo in range(0, len(self.ids), ITEM_TILE):
            hi = min(lo + ITEM_TILE, len(self.ids))
            item = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))
            term = self.term[self.first[lo] : self.first[hi]]
            used = np.unique(term)
            parts = []
            for at in range(0, len(used), width):
                columns = used[at : at + width]
                mine = (term >= columns[0]) & (term <= columns[-1])
                w = np.zeros((hi - lo, len(columns)))
                w[item[mine], np.searchsorted(columns, term[mine])] = self.weight[term[mine]]
                parts.append((columns, w))
            yield lo, hi, parts


def _item_groups(items: DataFrame) -> Iterator[Queries]:
    """Items with their distinct terms, a bounded group at a time."""

    def distinct(batches):
        for b in batches:
            h, first = terms(b.column("text"))
            sets = [np.unique(h[a:z]).astype(np.int64) for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "terms"])

    schema = T.StructType([items.schema["item_id"], T.StructField("terms", T.ArrayType(T.LongType()))])
    cut = written(items.select("item_id", "text").mapInArrow(distinct, schema).where(F.size("terms") > 0), "item_terms")
    total = cut.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    groups = math.ceil(total / GROUP_TERMS)
    for g in range(groups):
        rows = cut.where(F.pmod(F.xxhash64("terms"), F.lit(groups)) == g).toArrow()
        lists = rows.column("terms").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        if len(lists):
            vocabulary, term = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
            sizes = lists.value_lengths().to_numpy()
            ids = rows.column("item_id").combine_chunks()
            yield Queries(ids, np.concatenate([[0], np.cumsum(sizes)]), term, vocabulary)


def _binary(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """values[off[i]:off[i + 1]] as the bytes of row i."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


COUNTS = "doc_id long, n long, terms binary, tf binary"


def _counted(docs: DataFrame, queries: Queries) -> DataFrame:
    """Every document with terms: how many, and how often each term of the vocabulary occurs."""
    held = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches):
        vocabulary = held.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(vocabulary >> np.uint64(42)).astype(np.int64)] = True
        for b in steps(batches):
            h, first = terms(b.column("text"))
            n = np.diff(first)
            at = np.flatnonzero(maybe[(h >> np.uint64(42)).astype(np.int64)])
            place = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
            mine = vocabulary[place] == h[at]
            row = np.repeat(np.arange(len(n)), n)[at[mine]]
            key, tf = np.unique(row * len(vocabulary) + place[mine], return_counts=True)
            keep = np.flatnonzero(n > 0)
            off = np.searchsorted(key, np.append(keep, len(n)) * len(vocabulary))
            parts = [b.column("doc_id").take(pa.array(keep)), pa.array(n[keep], pa.int64()), _binary((key % len(vocabulary)).astype("<i4"), off), _binary(tf.astype("<i4"), off)]
            yield pa.RecordBatch.from_arrays(parts, names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, from one count a term and task."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            for raw in b.column("terms"):
                df[np.frombuffer(raw.as_buffer(), "<i4")] += 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[used], pa.int64())], names=["term", "df"])

    rows = counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return df


def impacts(n: np.ndarray, tf: np.ndarray, row: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole-number impact of each (row, term); lengths in Python integers, which do not overflow."""
    m = np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m[row])


class Best:
    """The k best documents of each item so far; whatever ties with the k-th is kept until ids decide."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)
        self.item, self.score, self.no_id, self.doc = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, lo: int, scores: np.ndarray, no_id: np.ndarray, doc: np.ndarray) -> None:
        """Scores of items lo.. (rows) and documents (columns)."""
        i, d = np.nonzero(scores >= self.floor[lo : lo + len(scores), None])
        self.item = np.concatenate([self.item, i + lo])
        self.score = np.concatenate([self.score, scores[i, d]])
        self.no_id, self.doc = np.concatenate([self.no_id, no_id[d]]), np.concatenate([self.doc, doc[d]])

    def settle(self) -> None:
        order = np.lexsort((self.doc, self.no_id, -self.score, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.floor[item[rank == self.k - 1]] = self.score[order][rank == self.k - 1]
        keep = order[rank < self.k]
        self.item, self.score, self.no_id, self.doc = (x[keep] for x in (self.item, self.score, self.no_id, self.doc))


def _ranked(counted: DataFrame, queries: Queries, k: int) -> DataFrame:
    """The k best documents of each item in each task's share of the documents."""
    held = counted.sparkSession.sparkContext.broadcast(queries)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches):
        q = held.value
        best = Best(len(q.ids), k)
        for whole in batches:
            for at in range(0, whole.num_rows, DOC_TILE):
                b = whole.slice(at, DOC_TILE)
                raw = b.column("terms")
                term = np.frombuffer(b"".join(raw.to_pylist()), "<i4")
                tf = np.frombuffer(b"".join(b.column("tf").to_pylist()), "<i4").astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), np.array([len(x) for x in raw.to_pylist()], np.int64) // 4)
                impact = impacts(b.column("n").to_numpy(), tf, row, q.n_docs, q.n_terms)
                ids = b.column("doc_id")
                no_id, doc = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
                for lo, hi, parts in q.tiles():
                    total = np.zeros((hi - lo, b.num_rows), np.int64)
                    for columns, w in parts:
                        place = np.minimum(np.searchsorted(columns, term), len(columns) - 1)
                        mine = columns[place] == term
                        dense = np.zeros((len(columns), b.num_rows))
                        dense[place[mine], row[mine]] = impact[mine]
                        total += (w @ dense).astype(np.int64)
                    best.add(lo, total, no_id, doc)
                best.settle()
        part = TaskContext.get().partitionId() % MERGE_PARTS
        arrays = [pa.array(np.full(len(best.item), part), pa.int32()), pa.array(best.item, pa.int64()), pa.array(best.doc, pa.int64(), mask=best.no_id), pa.array(best.score, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    found = counted.mapInArrow(run, schema)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "part"], ["item"]):  # lists of one item meet in parts first
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = counted.sparkSession.createDataFrame(pa.table({"item": pa.array(np.arange(len(queries.ids)), pa.int64()), "item_id": queries.ids}))
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for queries in _item_groups(items):
        counted = written(_counted(docs, queries), "term_counts")
        queries.n_docs, queries.n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if queries.n_docs:
            df = _frequencies(counted, len(queries.vocabulary)).tolist()
            queries.weight = np.array([math.floor(1000 * math.log((2 * queries.n_docs + 2) / (2 * d + 1))) for d in df], float)
            out = out.unionByName(_ranked(counted, queries, k))
    return out


#: DuckDB SQL giving the rows of ``search`` with ten documents an item.
SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sizes AS MATERIALIZED (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), corpus AS (SELECT count(*) AS total, sum(n) AS length FROM sizes
), items AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), tf AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT total FROM corpus) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term
), impact AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + CAST((90 * n * (SELECT total FROM corpus)) // (SELECT length FROM corpus) AS BIGINT)))) AS part
  FROM tf JOIN sizes USING (doc_id) JOIN weights USING (term)
), scores AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM items JOIN impact USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
