"""Benchmark passages in texts, found through an embedding of edit distance into Hamming distance.

The CGK embedding walks over a window of words: each step writes the word under the pointer
and moves on or not, by a random bit of that word and step. Windows at a small edit distance
give walks that agree at most steps, so keys made of the words at a few sampled steps collide
often; ``REPEATS`` independent walks are used. Walks of strings that are far apart drift from
each other (with the square of the edits), so long items are looked up by pieces of ``PIECE``
words: of the edits that an item may hold, few fall into one of its pieces, and any piece that is
met leads to the whole item. Each candidate is verified by the exact edit distance of the
whole item to the text around it. Equal passages are found always, those at the largest allowed distance with a
probability of over 0.95, whatever the length of the item and the kind of edits (tests measure both).

Windows that cannot match are not walked: d edits of an item of m words leave at least
m - 1 - 2 d of its word pairs, so a stretch with fewer pairs known to the benchmark is passed
over. A word is a run of letters, digits or bytes over 0x7F, with A-Z in lower case. An item
of m words matches up to m // 4 edits (none under 12 words). An item under ``MIN_WORDS`` words
is too short to tell a leak inside a text: it is found where a whole text equals it.

The benchmark is broadcast in slices of at most ``SLICE_WORDS`` words, one pass for each.

Defined cases: null or blank texts and items match nothing; every row is judged alone, so
repeated rows and equal doc_ids give repeated results; texts are read whole; an empty table
gives an empty result; a clean text keeps its row and all its columns. Of hits of an item that overlap
the nearest is kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dayloom.llm import words as W

REPEATS = 16
SAMPLES = 3
PIECE = 10
MIN_WORDS = 5
SLICE_WORDS = 1 << 20
PIECE_BYTES = 4 << 20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def allowed(m: int) -> int:
    return m // 4 if m >= 12 else 0


def _pairs(h: np.ndarray) -> np.ndarray:
    return W.mix(h[:-1] * np.uint64(3) + h[1:])


def normalised(column) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, index of each row's first word)."""
    data, off = W.text_bytes(column)
    starts, ends, first = W.find_words(data, off, _INSIDE)
    return W.word_hashes(data, starts, ends, lower=True), first


def keys(bits: list[np.ndarray], words: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, repeat: int) -> np.ndarray:
    """LSH key, in one of the repeats, of windows of ``size`` words (ascending) of which ``length`` are there (a row may end earlier)."""
    pos, key = start.copy(), W.mix(size.astype(np.uint64) + np.uint64(repeat << 20))
    end = start + length
    # windows of one size are sampled at the same steps; they stand together
    sizes, begin = np.unique(size, return_index=True)
    parts = [slice(a, b) for a, b in zip(begin, [*begin[1:], len(size)], strict=True)]
    wanted: dict[int, list[slice]] = {}
    for u in np.random.default_rng(500 + repeat).random(SAMPLES):
        for m, part in zip(sizes.tolist(), parts, strict=True):
            wanted.setdefault(int(m * 8 // 5 * u), []).append(part)
    alive = {t: min(p.start for s, ps in wanted.items() if s >= t for p in ps) for t in range(max(wanted, default=-1) + 1)}
    for t, lo in alive.items():  # sizes that need no further step are left behind
        for part in wanted.get(t, ()):
            inside = pos[part] < end[part]
            out = np.where(inside, words[np.where(inside, pos[part], 0)], np.uint64(0))
            key[part] = W.mix(key[part] * np.uint64(5) + out)
        inside = pos[lo:] < end[lo:]
        move = bits[repeat * 4 + (t >> 6) % 4][np.where(inside, pos[lo:], 0)] >> np.uint64(t & 63) & np.uint64(1)
        pos[lo:] += np.where(inside, move.astype(np.int64), 0)
    return key


def walks(words: np.ndarray) -> list[np.ndarray]:
    """Random bits of each word: 256 steps for each repeat."""
    return [W.mix(words ^ W.mix(np.full(1, 77 + k, np.uint64))) for k in range(REPEATS * 4)]


def _offsets(m: int) -> np.ndarray:
    """Where an item's pieces begin: enough of them to cover it."""
    return np.linspace(0, m - PIECE, -(-m // PIECE)).round().astype(np.int64)


class Table:
    """Keys of windows of one size, in each of the repeats, with the item and the offset they stand for."""

    def __init__(self, bits: list[np.ndarray], words: np.ndarray, start: np.ndarray, size: int, repeats: int, item: np.ndarray, offset: np.ndarray):
        self.size, self.item, self.offset, self.keys = size, item, offset, []
        sizes = np.full(len(start), size)
        for r in range(repeats):
            k = keys(bits, words, start, sizes, sizes, r)
            order = np.argsort(k, kind="stable")
            self.keys.append((k[order], order))

    def met(self, bits: list[np.ndarray], words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) of every key that a window shares with an entry in some repeat."""
        found, sizes = [np.zeros((2, 0), np.int64)], np.full(len(start), self.size)
        for r, (k, order) in enumerate(self.keys):
            mine = keys(bits, words, start, sizes, length, r)
            lo, hi = np.searchsorted(k, mine, "left"), np.searchsorted(k, mine, "right")
            some = np.flatnonzero(hi > lo)
            reps = (hi - lo)[some]
            slot = np.repeat(lo[some], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            found.append(np.stack([np.repeat(some, reps), order[slot]]))
        window, entry = np.unique(np.concatenate(found, axis=1), axis=1)
        return window, entry


class Items:
    """A slice of the benchmark, ready for lookups."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        h, first = normalised(pa.array(texts, pa.string()))
        size = np.diff(first)
        use = np.flatnonzero(size > 0)
        self.ids = [ids[i] for i in use]
        self.words = [h[first[i] : first[i + 1]] for i in use]
        self.size, start = size[use], first[:-1][use]
        searched = [(i, _pairs(w)) for i, w in enumerate(self.words) if len(w) >= MIN_WORDS]
        none = np.zeros(0, np.uint64)
        self.pairs = np.unique(np.concatenate([none, *(p for _, p in searched)]))
        self.pairs_of = np.unique(np.concatenate([none, *(p ^ W.mix(np.full(1, i + 1, np.uint64)) for i, p in searched)]))
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.pairs & np.uint64((1 << 22) - 1)] = True
        self.whole: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(self.size < MIN_WORDS):
            self.whole.setdefault(W.blob(self.words[i]), []).append(int(i))
        bits = walks(h)
        edited = np.flatnonzero(self.size >= 12)
        # ranges of lengths within a fifth of each other share a sieve
        lengths = np.unique(self.size[edited])
        rung = np.floor(np.log(lengths) / np.log(1.2))
        self.ranges = [lengths[rung == r] for r in np.unique(rung)]
        offsets = [_offsets(int(self.size[i])) for i in edited]
        self.tables = []
        if len(edited):
            item, offset = np.repeat(edited, [len(o) for o in offsets]), np.concatenate(offsets)
            self.tables.append(Table(bits, h, start[item] + offset, PIECE, REPEATS, item, offset))
        for m in range(MIN_WORDS, 12):  # no edits: equal windows have equal keys in any repeat
            if len(equal := np.flatnonzero(self.size == m)):
                self.tables.append(Table(bits, h, start[equal], m, 1, equal, np.zeros(len(equal), np.int64)))

    def windows(self, words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each table the starts of windows among enough pairs of the benchmark."""
        n = len(words)
        pairs = _pairs(words)
        known = self.sieve[pairs & np.uint64((1 << 22) - 1)]
        at = np.flatnonzero(known)
        known[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs[at]), len(self.pairs) - 1)] == pairs[at]
        known[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)] - 1] = False
        total = np.zeros(n + 1, np.int32)
        np.cumsum(known, out=total[1:n])
        total[n] = total[n - 1]
        row_end = np.repeat(first[1:], np.diff(first))
        out = []
        for table in self.tables:
            if table.size >= 12 or table.size == PIECE and len(table.keys) > 1:
                out.append(self._near(total, row_end))
            else:
                here = np.flatnonzero(row_end - np.arange(n) >= table.size)
                out.append(here[total[here + table.size - 1] - total[here] == table.size - 1])
        return out

    def _near(self, total: np.ndarray, row_end: np.ndarray) -> np.ndarray:
        """Starts of piece windows inside stretches that hold what an item of some length needs."""
        n = len(row_end)
        cover = np.zeros(n + 1, np.int64)
        for lengths in self.ranges:
            # first what any length of the range needs, at every word; then each length where that holds
            low, high = int(lengths[0]), int(lengths[-1])
            least, wide = min(int(m) - 1 - 2 * allowed(int(m)) for m in lengths), high + allowed(high)
            short = min(int(m) - allowed(int(m)) for m in lengths)
            ahead = np.full(n, total[n], np.int32)
            ahead[: max(0, n - wide + 1)] = total[wide - 1 : n] if n >= wide else 0
            some = np.flatnonzero(ahead - total[:n] >= least)
            some = some[row_end[some] - some >= short]
            for m in lengths.tolist():
                d = allowed(m)
                # a stretch can be taken to start at a word that takes part in a match, with up to d words more than the item
                here = some[row_end[some] - some >= m - d]
                stop = np.minimum(row_end[here], here + m + d)
                here, stop = (x[total[stop - 1] - total[here] >= m - 1 - 2 * d] for x in (here, stop))
                np.add.at(cover, np.maximum(here - d, 0), 1)
                np.add.at(cover, stop, -1)
        here = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        # a piece with few edits keeps word pairs of its own
        stop = np.minimum(row_end[here], here + PIECE + allowed(12))
        return here[total[np.maximum(stop - 1, here)] - total[here] >= PIECE - 1 - 2 * allowed(12)]

    def hits(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item index, first word, end, distance), words counted in the row; overlapping hits of an item keep the nearest."""
        out = []
        if self.whole:
            for row in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < MIN_WORDS)).tolist():
                found = self.whole.get(W.blob(words[first[row] : first[row + 1]]), ())
                out += [(row, i, 0, int(first[row + 1] - first[row]), 0) for i in found]
        if self.tables and len(words) >= 2:
            for table, start in zip(self.tables, self.windows(words, first), strict=True):
                if len(start):
                    out += self._met(table, words, first, start)
        return out

    def _met(self, table: Table, words: np.ndarray, first: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        row = np.searchsorted(first, start, "right") - 1
        # only the words that windows touch are given random bits
        touched = np.zeros(len(words) + 1, np.int64)
        end = np.minimum(start + table.size, first[row + 1])
        np.add.at(touched, start, 1)
        np.add.at(touched, end, -1)
        use = np.cumsum(touched)[:-1] > 0
        near = words[use]
        window, entry = table.met(walks(near), near, (np.cumsum(use) - 1)[start], end - start)
        # where the whole item may stand, joined where such stretches of a row and item overlap
        item, row = table.item[entry], row[window]
        slack = np.where(self.size[item] >= 12, self.size[item] // 4, 0)
        begin = np.maximum(start[window] - table.offset[entry] - slack, first[row])
        stop = np.minimum(start[window] - table.offset[entry] + self.size[item] + slack, first[row + 1])
        order = np.lexsort((begin, item, row))
        row, item, begin, stop = (x[order] for x in (row, item, begin, stop))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > stop[:-1])  # of one item, stops ascend with starts
        lead = np.flatnonzero(new)
        row, item, begin = row[lead], item[lead], begin[lead]
        stop = stop[np.append(lead[1:], len(stop))[: len(lead)] - 1]
        # the item's own pairs in the stretch, before the costly distance
        count = np.maximum(stop - begin - 1, 0)
        of = np.repeat(np.arange(len(lead)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[of]
        own = self._own(_pairs(words)[at], item[of])
        held = np.bincount(of, weights=own, minlength=len(lead))
        size = self.size[item]
        bound = np.where(size >= 12, size // 4, 0)
        good = (held >= size - 1 - 2 * bound) & (stop - begin >= size - bound)
        out = []
        for r, i, a, z in zip(row[good].tolist(), item[good].tolist(), begin[good].tolist(), stop[good].tolist(), strict=True):
            base = int(first[r])
            out += [(r, i, x - base, y - base, d) for x, y, d in self._verified(i, words, a, z)]
        return out

    def _own(self, pairs: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether each pair is one of its item's."""
        key = pairs ^ W.mix(item.astype(np.uint64) + np.uint64(1))
        return self.pairs_of[np.minimum(np.searchsorted(self.pairs_of, key), len(self.pairs_of) - 1)] == key

    def _verified(self, item: int, words: np.ndarray, a: int, z: int) -> list[tuple[int, int, int]]:
        """(first word, end, distance) of matches of the whole item in words a..z, nearest first, none overlapping."""
        w = self.words[item]
        d, text = allowed(len(w)), words[a:z]
        if len(text) < len(w) - d:
            return []
        to = _ends(w, text, d)
        if to is None or to.min() > d:
            return []
        stop, dist = int(to.argmin()), int(to.min())
        back = _ends(w[::-1], text[:stop][::-1], d, anchored=True)
        begin = stop - int(np.flatnonzero(back == dist)[0])
        left, right = (self._verified(item, words, x, y) for x, y in ((a, a + begin), (a + stop, z)))
        return sorted([*left, (a + begin, a + stop, dist), *right])


def _ends(w: np.ndarray, text: np.ndarray, d: int, anchored: bool = False) -> np.ndarray | None:
    """Least edit distance of ``w`` to a part of the text that ends at each place (begins at the front, if anchored); None if all exceed ``d``."""
    ramp = np.arange(len(text) + 1)
    dist = ramp.copy() if anchored else np.zeros(len(text) + 1, np.int64)
    for j, x in enumerate(w, 1):
        step = np.concatenate([[j], np.minimum(dist[:-1] + (text != x), dist[1:] + 1)])
        dist = np.minimum.accumulate(step - ramp) + ramp
        if dist.min() > d:
            return None
    return dist


@lru_cache(maxsize=1)
def _items(ids: tuple, texts: tuple) -> Items:
    return Items(list(ids), list(texts))


def _slices(benchmark: DataFrame):
    """Broadcasts of the benchmark, each of at most SLICE_WORDS words (or one item)."""
    context = benchmark.sparkSession.sparkContext
    ids, texts, held = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        n = len(r.text.split())
        if ids and held + n > SLICE_WORDS:
            yield context.broadcast((tuple(ids), tuple(texts)))
            ids, texts, held = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        held += n
    yield context.broadcast((tuple(ids), tuple(texts)))


def _pieces(batch: pa.RecordBatch):
    """Runs of rows with about PIECE_BYTES of text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, end_word, distance, similarity of every benchmark passage found."""
    schema = "doc_id long, item_id long, first_word long, end_word long, distance long, similarity double"
    out: DataFrame | None = None
    for held in _slices(benchmark):

        def run(batches, held=held):
            items = _items(*held.value)
            for batch in batches:
                for b in _pieces(batch):
                    found = items.hits(*normalised(b.column("text")))
                    ids = b.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[r] for r, *_ in found], pa.int64()),
                            pa.array([items.ids[i] for _, i, *_ in found], pa.int64()),
                            *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)),
                            pa.array([1 - f[4] / len(items.words[f[1]]) for f in found], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "first_word", "end_word", "distance", "similarity"],
                    )

        one = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any benchmark passage, with all their columns."""
    for held in _slices(benchmark):

        def run(batches, held=held):
            items = _items(*held.value)
            for batch in batches:
                for b in _pieces(batch):
                    keep = np.ones(b.num_rows, bool)
                    keep[[f[0] for f in items.hits(*normalised(b.column("text")))]] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
