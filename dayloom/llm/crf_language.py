"""Language of words in code-switched text: a linear-chain conditional random field.

A word's features are its byte n-grams with marks at both ends (so those that touch a mark are
its affixes) and, for words of the training lexicon, the word itself; all are hashed.
Weights of features and of transitions between languages are learned together by the gradient of the
log-likelihood. Labels come from whole documents, so training sequences are made of pieces of
several documents of the sample; where a piece ends the language may switch. Prediction runs
forward-backward over all words of a text and sums the words' posteriors.

The field is fitted on a bounded sample: for each language at most ``DOCS`` documents, picked
by a hash of doc_id; of a document over ``DOC_BYTES`` bytes a piece of a quarter as many characters,
at a place picked by the hash, is learned. A document's last words train as its last whole piece, and
one of fewer than ``PIECE`` words as a piece that repeats them. Every text is predicted whole.

A word is a run of letters or of bytes over 0x7F, in lower case.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing can be learned; ties go to the language first in the alphabet; each row is
predicted alone, so repeated rows and equal doc_ids give equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm import words as W

DOCS, DOC_BYTES = 500, 12_000
HASH_BITS = 17
GRAMS = (1, 2, 3, 4)
PIECE, PIECES = 16, 4
EPOCHS, BATCH, RATE = 3, 128, 0.15
LEXICON_COUNT = 3
PIECE_BYTES = 4 << 20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """Distinct words with their hashed features, and the texts as sequences of them."""

    seq: np.ndarray  # distinct word of each token
    first: np.ndarray  # first token of each row
    hashes: np.ndarray  # of distinct words, sorted
    features: np.ndarray  # buckets, word after word
    offsets: np.ndarray


def read_words(column, lexicon: np.ndarray | None = None) -> Words:
    """``lexicon`` has the sorted hashes of known words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, off = W.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, first = W.find_words(data, off, _INSIDE)
    hashes, where, seq = np.unique(W.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, n = starts[where], (ends - starts)[where]
    # each word with a mark at both ends
    size = n + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    marked = np.empty(int(begin[-1]), np.uint64)
    inner = np.ones(len(marked), bool)
    marked[begin[:-1]], marked[begin[1:] - 1] = 1, 2
    inner[begin[:-1]] = inner[begin[1:] - 1] = False
    marked[inner] = data[np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    parts, owners = [], []
    for g in GRAMS:
        count = np.maximum(size - g + 1, 0)
        at = np.repeat(begin[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        h = np.full(len(at), g, np.uint64)
        for k in range(g):
            h = h * np.uint64(263) + marked[at + k]
        parts.append(W.mix(h) >> np.uint64(64 - HASH_BITS))
        owners.append(np.repeat(np.arange(len(n)), count))
    if lexicon is not None and len(lexicon):
        known = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)] == hashes)
        parts.append(W.mix(hashes[known] + np.uint64(11)) >> np.uint64(64 - HASH_BITS))
        owners.append(known)
    owner = np.concatenate(owners) if len(n) else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    features = np.concatenate(parts)[order].astype(np.int64) if len(n) else np.zeros(0, np.int64)
    return Words(seq, first, hashes, features, np.searchsorted(owner[order], np.arange(len(n) + 1)))


@dataclass
class Field:
    """A fitted field: weights of hashed features and transitions, by language."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Score of each distinct word for each language."""
        if not len(words.hashes):
            return np.zeros((0, len(self.langs)))
        return np.add.reduceat(self.weights[words.features], words.offsets[:-1], axis=0).astype(np.float64)


def posteriors(emission: np.ndarray, seq: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior of each token's language by forward-backward; all rows advance together, longest first."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    langs = moves.shape[0]
    out = np.empty((len(seq), langs))
    if not len(order):
        return out
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(moves - moves.max())
    begin, sizes = first[:-1][order], length[order]
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # rows with more than t words
    ahead = None
    for t in range(int(sizes[0])):
        at = begin[: live[t]] + t
        a = e[seq[at]] if ahead is None else (ahead[: live[t]] @ step) * e[seq[at]]
        ahead = a / a.sum(axis=1, keepdims=True)
        out[at] = ahead
    back = np.ones((len(order), langs))
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        p = out[at] * back[:n]
        out[at] = p / p.sum(axis=1, keepdims=True)
        b = (e[seq[at]] * back[:n]) @ step.T
        back[:n] = b / b.sum(axis=1, keepdims=True)
    return out


def _pair_sums(emission: np.ndarray, seq: np.ndarray, width: int, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of tokens and summed posteriors of transitions, for sequences of one width."""
    e = np.exp(emission - emission.max(axis=1, keepdims=True))[seq.reshape(-1, width)]
    step = np.exp(moves - moves.max())
    n, langs = len(e), moves.shape[0]
    ahead, back = np.empty((width, n, langs)), np.ones((width, n, langs))
    for t in range(width):
        a = e[:, t] if t == 0 else (ahead[t - 1] @ step) * e[:, t]
        ahead[t] = a / a.sum(axis=1, keepdims=True)
    for t in range(width - 2, -1, -1):
        b = (e[:, t + 1] * back[t + 1]) @ step.T
        back[t] = b / b.sum(axis=1, keepdims=True)
    token = ahead * back
    token /= token.sum(axis=2, keepdims=True)
    pairs = np.zeros((langs, langs))
    for t in range(width - 1):
        p = ahead[t][:, :, None] * step * (e[:, t + 1] * back[t + 1])[:, None, :]
        pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return token.transpose(1, 0, 2).reshape(-1, langs), pairs


def _pieces(lo: int, hi: int) -> list[np.ndarray]:
    """Tokens lo to hi as pieces of ``PIECE``: the last one ends at hi, and fewer tokens are repeated."""
    if hi - lo < PIECE:
        return [lo + np.arange(PIECE) % (hi - lo)] if hi > lo else []
    starts = [*range(lo, hi - PIECE + 1, PIECE)]
    return [np.arange(a, a + PIECE) for a in (starts if starts[-1] == hi - PIECE else [*starts, hi - PIECE])]


def fit(texts: list[str], labels: list[str]) -> Field:
    """Adaptive gradient steps over shuffled sequences of pieces."""
    langs = sorted(set(labels))
    column = pa.array(texts, pa.large_string())
    plain = read_words(column)
    lexicon = plain.hashes[np.bincount(plain.seq, minlength=len(plain.hashes)) >= LEXICON_COUNT]
    words = read_words(column, lexicon)
    truth = np.repeat(np.searchsorted(langs, labels), np.diff(words.first))
    pieces = [p for lo, hi in zip(words.first, words.first[1:], strict=False) for p in _pieces(int(lo), int(hi))]
    field = Field(langs, np.zeros((1 << HASH_BITS, len(langs)), np.float32), np.zeros((len(langs), len(langs))), lexicon)
    if not pieces or len(langs) == 1:
        return field
    pieces = np.array(pieces)
    rng = np.random.default_rng(4981)
    # sequences of pieces: each next piece is of the same document half of the time
    seen, seen_moves = np.full(field.weights.shape, 1e-6, np.float32), np.full(field.moves.shape, 1e-6)
    for _ in range(EPOCHS):
        start = rng.permutation(len(pieces))
        chain = [start]
        for _ in range(PIECES - 1):
            stay = rng.random(len(pieces)) < 0.5
            nearby = np.minimum(chain[-1] + 1, len(pieces) - 1)
            chain.append(np.where(stay, nearby, rng.integers(0, len(pieces), len(pieces))))
        order = np.concatenate([pieces[c] for c in chain], axis=1)
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            width = at.shape[1]
            used, seq = np.unique(words.seq[at].ravel(), return_inverse=True)
            begin, size = words.offsets[used], np.diff(words.offsets)[used]
            feats = words.features[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            edges = np.cumsum(size) - size
            emission = np.add.reduceat(field.weights[feats], edges, axis=0).astype(np.float64)
            token, pairs = _pair_sums(emission, seq, width, field.moves)
            y = truth[at].ravel()
            token[np.arange(len(y)), y] -= 1
            by_word = np.stack([np.bincount(seq, weights=token[:, k], minlength=len(used)) for k in range(len(langs))], axis=1) / len(at)
            kinds, slot = np.unique(feats, return_inverse=True)
            spread = np.repeat(by_word, size, axis=0)
            grad = np.stack([np.bincount(slot, weights=spread[:, k], minlength=len(kinds)) for k in range(len(langs))], axis=1).astype(np.float32)
            seen[kinds] += grad * grad
            field.weights[kinds] -= RATE * grad / np.sqrt(seen[kinds])
            told = np.zeros_like(pairs)
            np.add.at(told, (truth[at[:, :-1]].ravel(), truth[at[:, 1:]].ravel()), 1)
            g = (pairs - told) / len(at) + 1e-3 * field.moves
            seen_moves += g * g
            field.moves -= RATE * g / np.sqrt(seen_moves)
    return field


def sample_bound(n: int, docs_each: int) -> int:
    """The greatest 63-bit hash that is sampled so that about ``docs_each`` of ``n`` rows are, at most all."""
    top = (1 << 63) - 1
    return top if n <= docs_each else top * 95 * docs_each // (100 * n)


def train(docs: DataFrame, learn: Column, docs_each: int = DOCS) -> Field | None:
    """A field fitted on a sample of the rows where ``learn`` holds; None if there is nothing to learn from."""
    part = DOC_BYTES // 4  # characters, of at most four bytes
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.length("text") - part + 1, F.lit(1)).cast("long")).cast("int")
    text = F.when(F.octet_length("text") <= DOC_BYTES, F.col("text")).otherwise(F.col("text").substr(start, F.lit(part)))
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", text.alias("text"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 1)  # 63 bits: a share of any size is more than nothing
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(sample_bound(n, docs_each))) for k, n in counts.items()])
    sample = sorted((r.lang, r.doc_id or 0, r.text) for r in rows.where(place <= bound).toLocalIterator())  # bounded, see above
    return fit([s[2] for s in sample], [s[0] for s in sample])


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _row_pieces(batch: pa.RecordBatch):
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PIECE_BYTES)) + 1), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _read(b: pa.RecordBatch, field: Field) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, posteriors of tokens, rows with a letter)."""
    words = read_words(b.column("text"), field.lexicon)
    p = posteriors(field.emissions(words), words.seq, words.first, field.moves)
    some = np.diff(words.first) > 0
    ascii_letter = pc.fill_null(pc.match_substring_regex(b.column("text"), "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(some & ~ascii_letter):
        some[i] = _has_letter(b.column("text")[i].as_py())
    return words, p, some


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred and score (the mean posterior of that language over the words) of every row."""
    if field is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(field)  # 2**HASH_BITS weights a language

    def run(batches):
        for batch in batches:
            for b in _row_pieces(batch):
                words, p, some = _read(b, held.value)
                run_sum = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
                share = (run_sum[words.first[1:]] - run_sum[words.first[:-1]]) / np.maximum(np.diff(words.first), 1)[:, None]
                best = share.round(12).argmax(axis=1)
                names = [held.value.langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
                score = np.where(some, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans (first word, end, lang) of words in one language, for every row."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for b in _row_pieces(batch):
                words, p, _ = _read(b, held.value)
                best, spans = p.argmax(axis=1), []
                for lo, hi in zip(words.first, words.first[1:], strict=False):
                    turn = np.flatnonzero(np.diff(best[lo:hi])) + 1
                    edges = [0, *turn.tolist(), int(hi - lo)] if hi > lo else []
                    spans.append([{"first": x, "end": y, "lang": held.value.langs[best[lo + x]]} for x, y in zip(edges, edges[1:], strict=False)])
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<first: bigint, end: bigint, lang: string>>")
