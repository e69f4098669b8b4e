"""BPE encoding and decoding by speculation: propose greedily, verify pairs, merge only what fails.

A sequence of tokens is the BPE result of a word if every token is the result of its own
string and no adjacent pair could have been merged across its border. ``Speculator`` proposes
tokens by greedy longest match, tests all distinct adjacent pairs of a batch at once by
undoing merges along the border, and merges exactly only the words with a failing pair.

Defined cases: a null text is an empty text; rows with equal ids stay separate rows; texts are
taken whole whatever their length; special tokens written in a text become their own ids; an
empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words kept in one Python worker; the cache is emptied when it holds more.
CACHE_WORDS = 200_000
#: Rows of a batch whose new words are verified together.
BATCH_ROWS = 512
END = "</w>"


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Speculator:
    """Encoder and decoder for a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.text = {i: t for t, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text.update({i: t for t, i in self.special.items()})
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.longest = max(map(len, self.vocab)) + 1
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.plain = {chr(b): letters[b] for b in range(128)}
        self._tables(merges)
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.stands: dict[int, bool] = {}

    def _tables(self, merges: list[tuple[str, str]]) -> None:
        """Parts of each token, and for each pair that merges the rank at which it does; by token id."""
        size = max(self.vocab.values()) + 1
        self.size = size
        self.left, self.right = np.arange(size), np.arange(size)
        self.born = np.full(size, -1)
        pairs = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            pairs[r] = i * size + j
            if self.born[k] < 0:
                self.left[k], self.right[k], self.born[k] = i, j, r
        order = np.argsort(pairs, kind="stable")
        self.pair_keys, self.pair_ranks = pairs[order], order

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay apart when their strings are encoded together; all pairs at once.

        The later of the two border tokens is undone first. A merge across the border that
        comes before the step just undone would have happened: the pair fails.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            fails = self._merge_rank(x, y) < limit[live]
            good[live[fails]] = False
            live, x, y = live[~fails], x[~fails], y[~fails]
            undo_x = self.born[x] > self.born[y]  # of equal tokens the right one: merging goes from the left
            limit[live] = np.where(undo_x, self.born[x], self.born[y] + 1)
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x, y, self.left[y])
            live = live[(self.born[x] >= 0) | (self.born[y] >= 0)]
        return good

    def symbols(self, word: str) -> list[str]:
        if word.isascii():
            out = [self.plain[c] for c in word]
        else:
            out = [self.letters[b] for b in word.encode()]
        out[-1] += END
        return out

    def merged(self, parts: list[str]) -> list[str]:
        """Exact merging, lowest rank first and leftmost among equals, in n log n steps."""
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in rank]
        heapq.heapify(heap)
        parts = list(parts)
        while heap:
            _, i, (x, y) = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = x + y, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (parts[i], parts[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [p for p in parts if p]

    def _stands(self, token: int) -> bool:
        """Whether a token is the result of its own string."""
        known = self.stands.get(token)
        if known is None:
            text = self.text[token]
            body = list(text.removesuffix(END)) if text.endswith(END) else list(text)
            if text.endswith(END) and body:
                body[-1] += END
            known = self.stands[token] = self.merged(body or [text]) == [text]
        return known

    def propose(self, word: list[str]) -> list[int] | None:
        """Greedy longest match over the word's letters; the last letter carries the end mark."""
        flat, vocab, out, i, n = "".join(word), self.vocab, [], 0, len(word)
        while i < n:
            top = min(n, i + self.longest)
            if top == n and (t := vocab.get(flat[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(top, n - 1), i, -1):
                if (t := vocab.get(flat[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return None
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new words together and remember them."""
        letters = [self.symbols(w) for w in words]
        guesses = [self.propose(x) for x in letters]
        sizes = np.array([len(g) if g else 0 for g in guesses])
        flat = np.array([t for g in guesses if g for t in g], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        good = sizes > 0
        if len(flat):
            used, where = np.unique(flat, return_inverse=True)
            alone = np.array([self._stands(int(t)) for t in used])
            good[owner[~alone[where]]] = False
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, at = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            fine = self.compatible(pairs // self.size, pairs % self.size)
            good[owner[inner[~fine[at]]]] = False
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        for w, x, g, ok in zip(words, letters, guesses, good, strict=True):
            ids = g if ok else [self.vocab[p] for p in self.merged(x)]
            self.cache[w] = (np.array(ids, "<u4").tobytes(), " ".join(map(self.text.__getitem__, ids)))

    def words(self, text: str) -> list[str]:
        """Normalised words; a special token keeps its spelling and starts with a NUL mark."""
        parts = self.cut_special.split(text) if self.cut_special and "<|" in text else [text]
        out: list[str] = []
        for p in parts:
            if p in self.special:
                out.append("\0" + p)
            elif p:
                p = p if p.isascii() else unicodedata.normalize("NFC", p).replace("Σ", "σ")
                out += self.split.findall(p.lower())
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit, decoded text) of each text."""
        split = [self.words(t or "") for t in texts]
        new = {w for s in split for w in s if w not in self.cache}
        held = {w: (np.array([self.special[w[1:]]], "<u4").tobytes(), w[1:]) for w in new if w[0] == "\0" and w[1:] in self.special}
        fresh = sorted(new - held.keys())
        if len(self.cache) + len(fresh) > CACHE_WORDS:  # emptied: the batch's other words are new again
            fresh = sorted({w for s in split for w in s} - held.keys())
        self.learn(fresh) if fresh else None
        look = {**held} if held else None
        for s in split:
            got = [look.get(w) or self.cache[w] for w in s] if look else list(map(self.cache.__getitem__, s))
            yield b"".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def decode(self, ids) -> str:
        return " ".join(self.text[int(i)] for i in ids)


@lru_cache(maxsize=2)
def _speculator(source: str) -> Speculator:
    return Speculator(source)


def _source(df: DataFrame, path: str):
    """The vocabulary file, read by Spark from any store, as a broadcast of its fixed size."""
    rows = df.sparkSession.read.text(path, wholetext=True).collect()
    return df.sparkSession.sparkContext.broadcast(rows[0][0])


def _per_text(df: DataFrame, path: str, column: str, fields: list[T.StructField], make, names: list[str] | None = None) -> DataFrame:
    """``names`` (all columns if not given) and the made fields, which replace columns of their names."""
    made_names = {f.name for f in fields}
    names = [n for n in (df.columns if names is None else names) if n not in made_names]
    source, keep = _source(df, path), [df.schema[n] for n in names]

    def run(batches):
        coder = _speculator(source.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(lo, BATCH_ROWS)
                made = [make(ids, text) for ids, text in coder.encode_batch(b.column(column).to_pylist())]
                more = [pa.array([m[i] for m in made], t) for i, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *more], names=[*names, *(f.name for f in fields)])

    arrow = [{"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[f.dataType.simpleString()] for f in fields]
    return df.select(*dict.fromkeys([*names, column])).mapInArrow(run, T.StructType([*keep, *fields]))


def encode(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """All columns, ``n_tokens`` and ``ids`` (array of int) of ``column``."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return _per_text(df, path, column, fields, lambda ids, _: (len(ids) // 4, np.frombuffer(ids, "<i4")))


def decode(df: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``: the text of the ids in ``column`` (null for null)."""
    source = _source(df, path)

    def run(batches):
        coder = _speculator(source.value)
        for b in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def digests(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def make(ids: bytes, text: str):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _per_text(df, path, column, fields, make, ["doc_id"])
