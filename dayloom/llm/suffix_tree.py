"""Probabilistic suffix tree over words: contexts of variable length, kept where they diverge.

A context is a run of 1 to ``depth`` words before a token; it is considered if it was seen
``MIN_COUNT`` times in training, whatever the size of the corpus, and its suffix was kept. Its next-token distribution is the
counts smoothed towards the distribution of its suffix, (n(c, w) + m P(w | suffix)) / (n(c) + m).
The divergence test sums, over the training tokens after the context, the logarithm of that
probability, with the token itself taken out of the counts, over the probability the suffix
gives: an estimate of n(c) times the divergence of the two distributions without the bias of
testing on the training counts. m is the one of ``MASSES`` with the largest sum, and the
context is kept if that reaches ``MIN_GAIN`` nats. A token is scored by the longest kept
context before it. The root gives unseen tokens the share of tokens seen once.

Counts cover all training rows: each level asks for the counts of (context, token) pairs and
then for the test sums of contexts, chunk by chunk (see ``corpus``); no table of contexts is
ever collected or broadcast, and a frequent word costs its bucket one entry a chunk.

Defined cases: a null text is the end token alone; a null doc_id is neither held out nor
learned from; without training tokens every token has probability 1; equal rows are scored
and counted row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm import corpus as C
from dayloom.llm import words as W

DEPTH = 2
MIN_COUNT = 8
MIN_GAIN = 8.0
MASSES = np.array([2.0, 16.0, 128.0, 1024.0])
_END = np.uint64(0x243F6A8885A308D3)


class _Stream:
    """Tokens of a chunk's rows (words, then one end), and what earlier answers tell about them."""

    def __init__(self, rows: pa.Table, more: pa.Table | None, levels: int, tested: int, totals: tuple | None, buckets: int, min_count: int = MIN_COUNT):
        self.rows, self.more, self.buckets = rows, more, buckets
        data, off = W.text_bytes(rows.column("text"))
        starts, ends, first = W.find_words(data, off)
        words = W.word_hashes(data, starts, ends, lower=True)
        count = rows.num_rows
        self.first = first + np.arange(count + 1)
        self.row = np.repeat(np.arange(count), np.diff(self.first))
        self.tokens = np.empty(len(words) + count, np.uint64)
        ended = self.first[1:] - 1
        word = np.ones(len(self.tokens), bool)
        word[ended] = False
        self.tokens[word], self.tokens[ended] = words, _END
        self.pos = np.arange(len(self.tokens)) - self.first[self.row]
        self.train = rows.column("train").to_numpy().astype(bool)[self.row]
        self.keys, self.at = np.unique(self.tokens, return_inverse=True)
        if totals is None:
            return
        self.total, self.kinds, singles = totals
        self.seen = self._answers(0, self.keys)[self.at]
        unseen = (singles + 0.5) / (self.total + 1) if self.total else 1.0
        self.prob = np.where(self.seen > 0, (1 - unseen) * self.seen / max(self.total, 1), unseen)
        self.depth = np.zeros(len(self.tokens), np.int8)
        before = np.zeros(len(self.tokens), np.int64)  # how often the words up to here, as a context, were seen
        before[1:] = self.seen[:-1]
        context = np.full(len(self.tokens), np.uint64(1))
        for level in range(1, levels + 1):
            reach = np.flatnonzero((self.pos >= level) & (self.depth == level - 1) & (before >= min_count))
            context[reach] = W.mix(context[reach] * np.uint64(3) + self.tokens[reach - level])
            self.reach, self.context, self.n_context = reach, context[reach], before[reach]
            self.pair_keys, self.pair_at = np.unique(W.mix(self.context * np.uint64(5) + self.tokens[reach]), return_inverse=True)
            if level > tested // 2 + tested % 2:
                return
            self.n_pair = self._answers(2 * level - 1, self.pair_keys)[self.pair_at]
            self.context_keys, self.context_at = np.unique(self.context, return_inverse=True)
            if level > tested // 2:
                return
            code = self._answers(2 * level, self.context_keys)[self.context_at]
            kept = code > 0
            m = MASSES[np.maximum(code - 1, 0)]
            self.prob[reach[kept]] = ((self.n_pair + m * self.prob[reach]) / (self.n_context + m))[kept]
            self.depth[reach[kept]] = level
            longer = np.zeros(len(self.tokens), np.int64)
            longer[reach] = self.n_pair
            before = np.zeros(len(self.tokens), np.int64)
            before[1:] = longer[:-1]

    def _answers(self, part: int, keys: np.ndarray) -> np.ndarray:
        return C.answers_for(keys, self.more.filter(pc.equal(self.more.column("part"), part)), self.buckets)

    def gains(self) -> np.ndarray:
        """For each context, the test sum for each mass over this chunk's training tokens."""
        use = self.train[self.reach]
        at, n, c = self.context_at[use], self.n_pair[use][:, None] - 1.0, self.n_context[use][:, None] - 1.0
        p = self.prob[self.reach[use]][:, None]
        each = np.log((n / p + MASSES) / (c + MASSES))
        return np.stack([np.bincount(at, weights=each[:, k], minlength=len(self.context_keys)) for k in range(len(MASSES))], axis=1)


def _gain_request(chunk: int, keys: np.ndarray, gains: np.ndarray, buckets: int) -> pa.Table:
    edges = np.searchsorted(C.bucket_of(keys, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    g = gains.astype(np.float32)
    return pa.table(
        {
            "chunk": pa.array(np.full(len(used), chunk), pa.int64()),
            "bucket": pa.array(used, pa.int32()),
            "keys": pa.array([C.pack_keys(keys[edges[u] : edges[u + 1]]) for u in used], pa.binary()),
            "n": pa.array([W.blob(g[edges[u] : edges[u + 1]]) for u in used], pa.binary()),
        }
    )


def _tested(requests: DataFrame, min_gain: float) -> DataFrame:
    """For each context 0, or 1 + the index of the mass it is kept with. Sums are in the order of chunks."""

    def add(key, rows):
        rows = rows.sort_by("chunk")
        keys = [C.unpack_keys(k) for k in rows.column("keys").to_pylist()]
        gains = np.concatenate([np.frombuffer(g, np.float32).reshape(-1, len(MASSES)) for g in rows.column("n").to_pylist()]).astype(np.float64)
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.stack([np.bincount(inverse, weights=gains[:, k]) for k in range(len(MASSES))], axis=1)
        code = np.where(total.max(axis=1) > min_gain, total.argmax(axis=1) + 1, 0).astype(np.uint8)[inverse]
        edges = np.cumsum([0, *map(len, keys)])
        return pa.table(
            {
                "chunk": rows.column("chunk").cast(pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(keys), pa.int32()),
                "n": pa.array([W.blob(code[edges[i] : edges[i + 1]]) for i in range(len(keys))], pa.binary()),
            }
        )

    return requests.groupBy("bucket").applyInArrow(add, C.ANSWER)


def _counted(requests: DataFrame) -> DataFrame:
    """The answers of ``corpus.answer``, and for each bucket a row with its tokens, kinds and kinds seen once."""

    def add(key, rows):
        chunks, keys, _, inverse, total = C._added(rows, C.unpack_keys)
        edges = np.cumsum([0, *map(len, keys)])
        back = total[inverse]
        k = len(chunks)
        return pa.table(
            {
                "chunk": pa.array([*chunks, None], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * (k + 1), pa.int32()),
                "n": pa.array([*(W.blob(C.pack(back[edges[i] : edges[i + 1]])) for i in range(k)), None], pa.binary()),
                "total": pa.array([None] * k + [int(total.sum())], pa.int64()),
                "kinds": pa.array([None] * k + [int((total > 0).sum())], pa.int64()),
                "singles": pa.array([None] * k + [int((total == 1).sum())], pa.int64()),
            }
        )

    return requests.groupBy("bucket").applyInArrow(add, C.ANSWER + ", total long, kinds long, singles long")


def score(docs: DataFrame, train: Column, depth: int = DEPTH, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, mean_depth of every row.

    ``train`` says which rows to learn from. ``base_score`` is the smoothed word frequency
    model over the same tokens; scores are base 10 logarithms.
    """
    picked = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    chunks = C.cut(picked, ("doc_id", "text", "train"))
    buckets = chunks.buckets(0.12)

    def ask_words(chunk, rows):
        s = _Stream(rows, None, 0, 0, None, buckets)
        return C.request(chunk, s.keys, np.bincount(s.at, weights=s.train, minlength=len(s.keys)).astype(np.int64), buckets, C.pack_keys)

    first = C.written(_counted(chunks.each(ask_words, C.REQUEST)), "tokens")
    totals = tuple(int(x or 0) for x in first.agg(F.sum("total"), F.sum("kinds"), F.sum("singles")).first())
    known = first.where("chunk is not null").select("chunk", "bucket", "n", F.lit(0).alias("part"))
    for level in range(1, depth + 1):

        def ask_pairs(chunk, rows, more, level=level):
            s = _Stream(rows, more, level, 2 * level - 2, totals, buckets, min_count)
            n = np.bincount(s.pair_at, weights=s.train[s.reach], minlength=len(s.pair_keys)).astype(np.int64)
            return C.request(chunk, s.pair_keys, n, buckets, C.pack_keys)

        def ask_contexts(chunk, rows, more, level=level):
            s = _Stream(rows, more, level, 2 * level - 1, totals, buckets, min_count)
            return _gain_request(chunk, s.context_keys, s.gains(), buckets)

        pairs = C.written(C.answer(chunks.with_answers(known, ask_pairs, C.REQUEST), C.unpack_keys), f"pairs_{level}")
        known = known.unionByName(pairs.withColumn("part", F.lit(2 * level - 1)))
        contexts = C.written(_tested(chunks.with_answers(known, ask_contexts, C.REQUEST), min_gain), f"contexts_{level}")
        known = known.unionByName(contexts.withColumn("part", F.lit(2 * level)))

    def scored(chunk, rows, more):
        s = _Stream(rows, more, depth, 2 * depth, totals, buckets, min_count)
        count = rows.num_rows
        base = np.log10((s.seen + 0.5) / (s.total + 0.5 * (s.kinds + 1)))
        n = np.diff(s.first)
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(np.bincount(s.row, weights=s.seen > 0, minlength=count).astype(np.int64), pa.int64()),
                "train_tokens": pa.array(np.full(count, s.total), pa.int64()),
                "base_score": pa.array(np.bincount(s.row, weights=base, minlength=count), pa.float64()),
                "score": pa.array(np.bincount(s.row, weights=np.log10(s.prob), minlength=count), pa.float64()),
                "mean_depth": pa.array(np.bincount(s.row, weights=s.depth, minlength=count) / n, pa.float64()),
            }
        )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_depth double"
    return chunks.with_answers(known, scored, schema)
