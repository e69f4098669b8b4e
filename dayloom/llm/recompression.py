"""Repeated passages by recompression: runs and pairs of tokens are named, level by level.

A level first names pairs (x, y) where x falls into the left and y into the right half of the
names, then maximal runs of one name; halves are drawn anew for each level from the name's
own hash. Names are hashes of what they stand for, so the same pair has the same name in every
task and no dictionary has to be exchanged to agree on names. What Spark's rounds exchange is
how often the names of high levels occur in the whole corpus.

Each name also carries the span of words that alone decides that it is formed: its own words
and the neighbours that it, or its parts, might otherwise have merged with. An equal passage
anywhere else forms the same names inside such spans. So a window of consecutive words that
holds the span of a name which occurs once in the corpus occurs once itself. The windows that
are left are verified by 128-bit fingerprints of their words.

Defined cases: a null or blank text has no words; a repeat may lie in the same document and
may overlap; equal rows repeat each other; windows are judged on the input; rows with the same
doc_id stay separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm import corpus as C
from dayloom.llm import words as W

#: Levels whose new names are counted, a round of Spark for each group.
ROUNDS = ((3, 4), (5, 6))
_FAR = np.int64(1 << 40)
_PAIR, _RUN = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _name(x: np.ndarray, y: np.ndarray, kind: np.uint64) -> np.ndarray:
    return W.mix(W.mix(x + kind) * np.uint64(3) + y)


def _half(x: np.ndarray, level: int) -> np.ndarray:
    """Whether a name falls into the left half at this level."""
    return (W.mix(x + np.uint64(level * 2 + 1)) >> np.uint64(63)).astype(bool)


def names(hashes: np.ndarray, first: np.ndarray, levels: int):
    """Yield (level, name, lo, hi): the names formed at each level and the words that decide them.

    ``first`` has the index of each row's first word. lo, hi bound the words that decide a
    name; they lie outside the row when a row's edge takes part in the decision.
    """
    sym = hashes
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lo = np.arange(len(sym), dtype=np.int64)
    hi = lo + 1
    for level in range(1, levels + 1):
        if not len(sym):
            return
        n = len(sym)
        left = _half(sym, level)
        near = np.zeros(n + 1, bool)  # near[i]: i-1 and i are in one row
        near[1:-1] = row[1:] == row[:-1]
        starts = np.zeros(n, bool)
        starts[:-1] = near[1:-1] & left[:-1] & ~left[1:]
        at = np.flatnonzero(starts)
        # What stays alone was not met by a partner: the neighbour on its open side decides too.
        low, high = lo.copy(), hi.copy()
        after = np.where(near[1:], np.append(hi[1:], 0), _FAR)
        before = np.where(near[:-1], np.insert(lo[:-1], 0, 0), -_FAR)
        np.maximum(high, after, out=high, where=left)
        np.minimum(low, before, out=low, where=~left)
        low[at], high[at] = lo[at], hi[at + 1]
        new = sym.copy()
        new[at] = _name(sym[at], sym[at + 1], _PAIR)
        fresh = starts
        keep = np.ones(n, bool)
        keep[at + 1] = False
        sym, row, lo, hi, fresh = new[keep], row[keep], low[keep], high[keep], fresh[keep]
        # Maximal runs; that a name is no part of a longer run is decided by both neighbours.
        n = len(sym)
        same = np.zeros(n + 1, bool)
        same[1:-1] = (row[1:] == row[:-1]) & (sym[1:] == sym[:-1])
        near = np.zeros(n + 1, bool)
        near[1:-1] = row[1:] == row[:-1]
        head = np.flatnonzero(~same[:-1])
        tail = np.append(head[1:], n) - 1
        length = tail - head + 1
        many = length > 1
        before = np.where(near[head], lo[head - 1], -_FAR)
        after = np.where(near[tail + 1], np.append(hi, 0)[tail + 1], _FAR)
        made, made_lo, made_hi = sym[fresh], lo[fresh], hi[fresh]
        new = np.where(many, _name(sym[head], length.astype(np.uint64), _RUN), sym[head])
        lo, hi = np.minimum(lo[head], before), np.maximum(hi[tail], after)
        sym, row = new, row[head]
        yield level, np.concatenate([made, sym[many]]), np.concatenate([made_lo, lo[many]]), np.concatenate([made_hi, hi[many]])


class _Passages:
    """Windows of one chunk and what is known about them."""

    def __init__(self, rows: pa.Table, size: int):
        self.rows, self.size = rows, size
        self.data, self.off = W.text_bytes(rows.column("text"))
        self.starts, self.ends, self.first = W.find_words(self.data, self.off)
        self.words = W.word_hashes(self.data, self.starts, self.ends)
        self.begin, _ = W.windows(self.first, size)
        self.open = np.zeros(len(self.words), bool)  # by first word: may still be a repeat
        self.open[self.begin] = True
        self.levels: dict[int, tuple] = {}

    def counted(self, group: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of a group of levels that lie in an open window, with their spans."""
        if not self.levels:
            self.levels = {level: x for level, *x in names(self.words, self.first, max(map(max, ROUNDS)))}
        got = [self.levels[k] for k in group if k in self.levels]
        if not got:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        name, lo, hi = (np.concatenate([g[i] for g in got]) for i in range(3))
        fit = (lo >= 0) & (hi - lo <= self.size) & (hi <= len(self.words))
        name, lo, hi = name[fit], lo[fit], hi[fit]
        opens = np.concatenate([[0], np.cumsum(self.open)])
        live = opens[lo + 1] > opens[np.maximum(hi - self.size, 0)]
        return name[live], lo[live], hi[live]

    def close(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """No window that holds one of these spans is a repeat."""
        n = len(self.words)
        delta = np.bincount(np.maximum(hi - self.size, 0), minlength=n + 2) - np.bincount(lo + 1, minlength=n + 2)
        self.open &= np.cumsum(delta)[:n] == 0

    def prints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, fingerprint a, b) of the open windows."""
        at = np.flatnonzero(self.open)
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        other = W.word_hashes(self.data, self.starts, self.ends, seed=1)
        return at, W.span_hashes(self.words, at, at + self.size, 2), W.span_hashes(other, at, at + self.size, 3)

    def covered(self, at: np.ndarray) -> np.ndarray:
        n = len(self.words)
        return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + self.size, minlength=n + 1 + self.size)[: n + 1])[:n] > 0


def _wide_request(chunk: int, a: np.ndarray, b: np.ndarray, buckets: int) -> tuple[pa.Table, np.ndarray]:
    """REQUEST rows for 128-bit keys (sorted by a, b), and for each window the index of its key."""
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    ka, kb = sa[new], sb[new]
    count = np.minimum(np.bincount(at, minlength=len(ka)), 2).astype(np.uint8)
    edges = np.searchsorted(C.bucket_of(ka, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    pairs = np.stack([ka, kb], axis=1)
    out = pa.table(
        {
            "chunk": pa.array(np.full(len(used), chunk), pa.int64()),
            "bucket": pa.array(used, pa.int32()),
            "keys": pa.array([W.blob(pairs[edges[u] : edges[u + 1]]) for u in used], pa.binary()),
            "n": pa.array([W.blob(count[edges[u] : edges[u + 1]]) for u in used], pa.binary()),
        }
    )
    return out, at


def _wide_answer(requests: DataFrame) -> DataFrame:
    """For each chunk's 128-bit keys, 1 where a key occurs more than once in the corpus."""

    def add(key, rows):
        keys = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in rows.column("keys").to_pylist()]
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("n").to_pylist()]).astype(np.int64)
        flat = np.concatenate(keys)
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        s = flat[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        many = (np.bincount(group, weights=n[order]) > 1).astype(np.uint8)
        back = np.empty(len(s), np.uint8)
        back[order] = many[group]
        edges = np.cumsum([0, *map(len, keys)])
        return pa.table(
            {
                "chunk": rows.column("chunk").cast(pa.int64()),
                "bucket": pa.array([key[0].as_py()] * len(keys), pa.int32()),
                "n": pa.array([W.blob(back[edges[i] : edges[i + 1]]) for i in range(len(keys))], pa.binary()),
            }
        )

    return requests.groupBy("bucket").applyInArrow(add, C.ANSWER)


def _known(rows: pa.Table, more: pa.Table, size: int, rounds: int, buckets: int) -> _Passages:
    """The windows of a chunk after the answers of ``rounds`` rounds."""
    p = _Passages(rows, size)
    for r in range(rounds):
        name, lo, hi = p.counted(ROUNDS[r])
        keys, at = np.unique(name, return_inverse=True)
        once = C.answers_for(keys, more.filter(pc.equal(more.column("part"), r)), buckets)[at] == 1
        p.close(lo[once], hi[once])
    return p


def _edited(docs: DataFrame, size: int, finish, schema: str) -> DataFrame:
    chunks = C.cut(docs)
    buckets = chunks.buckets(0.06)
    known: DataFrame | None = None

    def add(answers: DataFrame, part: int) -> DataFrame:
        one = answers.withColumn("part", F.lit(part))
        return one if known is None else known.unionByName(one)

    for r in range(len(ROUNDS)):

        def ask(chunk, rows, more, r=r):
            name, _, _ = _known(rows, more, size, r, buckets).counted(ROUNDS[r])
            keys, n = np.unique(name, return_counts=True)
            return C.request(chunk, keys, np.minimum(n, 2), buckets)

        asked = chunks.each(lambda chunk, rows: ask(chunk, rows, None), C.REQUEST) if known is None else chunks.with_answers(known, ask, C.REQUEST)
        known = add(C.written(C.answer(asked), f"names_{r}"), r)

    def ask_windows(chunk, rows, more):
        _, a, b = _known(rows, more, size, len(ROUNDS), buckets).prints()
        return _wide_request(chunk, a, b, buckets)[0]

    known = add(C.written(_wide_answer(chunks.with_answers(known, ask_windows, C.REQUEST)), "windows"), len(ROUNDS))

    def last(chunk, rows, more):
        p = _known(rows, more, size, len(ROUNDS), buckets)
        at, a, b = p.prints()
        _, key = _wide_request(chunk, a, b, buckets)
        ka = np.zeros(int(key.max()) + 1 if len(key) else 0, np.uint64)
        ka[key] = a
        many = C.answers_for(ka, more.filter(pc.equal(more.column("part"), len(ROUNDS))), buckets)
        return finish(p, p.covered(at[many[key] > 0]))

    return chunks.with_answers(known, last, schema)


def _kept(p: _Passages, gone: np.ndarray, i: int) -> bytes:
    """The kept words of row i, joined by one space."""
    found = p.data[p.off[i] : p.off[i + 1]].tobytes().split()
    lost = gone[p.first[i] : p.first[i + 1]]
    return b" ".join([w for w, g in zip(found, lost, strict=True) if not g] if lost.any() else found)


def digests(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of every row."""

    def finish(p: _Passages, gone: np.ndarray) -> pa.Table:
        lost = np.concatenate([[0], np.cumsum(gone)])
        return pa.table(
            {
                "doc_id": p.rows.column("doc_id").cast(pa.int64()),
                "n_words": pa.array(np.diff(p.first), pa.int64()),
                "n_removed": pa.array(lost[p.first[1:]] - lost[p.first[:-1]], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(_kept(p, gone, i)).hexdigest() for i in range(p.rows.num_rows)], pa.string()),
            }
        )

    return _edited(docs.select("doc_id", "text"), size, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, size: int = 35) -> DataFrame:
    """doc_id, kept text, and the removed spans as (first word, end) pairs of every row."""

    def finish(p: _Passages, gone: np.ndarray) -> pa.Table:
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        spans = []
        for i in range(p.rows.num_rows):
            part = np.concatenate([[0], gone[p.first[i] : p.first[i + 1]].astype(np.int8), [0]])
            turn = np.flatnonzero(np.diff(part)) if edge.any() else np.zeros(0, np.int64)
            spans.append([{"first": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
        return pa.table(
            {
                "doc_id": p.rows.column("doc_id").cast(pa.int64()),
                "text": pa.array([_kept(p, gone, i).decode() for i in range(p.rows.num_rows)], pa.string()),
                "removed": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            }
        )

    return _edited(docs.select("doc_id", "text"), size, finish, "doc_id long, text string, removed array<struct<first: bigint, end: bigint>>")
