"""Ids of whole texts under a byte-level BPE vocabulary, for use inside Arrow tasks.

Texts are cut into pieces (contractions, words, numbers, signs, blanks) for a whole batch at
once: every byte gets the class of its character, and piece borders follow from classes
of neighbours. Pieces are looked up by 64-bit hash in a direct-mapped table; only pieces not
seen before go through the merges. Pieces of over ``LONG`` bytes are always merged anew, so a
hash stands for short strings only. A special token in a text is a piece of its own.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from dayloom.llm.bpe import _byte_letters
from dayloom.llm.words import text_bytes, word_hashes

BLANK, LETTER, NUMBER, SIGN = range(4)
#: Slots of the table of known pieces, and ids kept in one worker before the table is emptied.
SLOTS, CACHE_IDS = 1 << 20, 1 << 22
LONG = 64
#: How text is cut where no run of one class does it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Endings that stay with their apostrophe, as byte pairs (0: no second byte).
ENDINGS = [("s", ""), ("t", ""), ("m", ""), ("d", ""), ("r", "e"), ("v", "e"), ("l", "l")]


def character_classes() -> np.ndarray:
    """Class of each code point, by the character properties of the tokenizers library (1.1 MB)."""
    from tokenizers import Regex
    from tokenizers.normalizers import Replace

    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, SIGN, np.uint8)
    for pattern, kind in ((r"\s+", BLANK), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        left = Replace(Regex(pattern), "").normalize_str(text)
        hit = np.ones(len(out), bool)
        hit[0xD800:0xE000] = False
        hit[np.frombuffer(left.encode("utf-32-le"), np.uint32)] = False
        out[hit] = kind
    return out


class ByteCoder:
    def __init__(self, source: str, classes: np.ndarray):
        import tiktoken

        spec = json.loads(source)
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.special = {t.encode(): i for t, i in added.items()}
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.merge = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)._core_bpe.encode_single_piece
        self.classes = classes
        self._empty()

    def _empty(self) -> None:
        self.keys, self.slot = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int64)
        self.flat, self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _classes(self, data: np.ndarray) -> np.ndarray:
        """Class of each byte's character; ``data`` ends with three padding bytes."""
        kind = self.classes[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b0 = data[lead].astype(np.int64)
            b1, b2, b3 = (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3))
            two, three = b0 < 0xE0, b0 < 0xF0
            point = np.where(two, (b0 & 0x1F) << 6 | b1, np.where(three, (b0 & 0xF) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
            c = self.classes[np.minimum(point, 0x10FFFF)]
            kind[lead] = c
            kind[lead + 1] = c
            kind[lead[~two] + 2] = c[~two]
            kind[lead[~three] + 3] = c[~three]
        return kind

    def _specials(self, raw: bytes, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of special tokens inside rows, leftmost first, longest among equals."""
        found = []
        for t, i in self.special.items():
            at = raw.find(t)
            while at >= 0:
                if np.searchsorted(off, at, "right") == np.searchsorted(off, at + len(t) - 1, "right"):
                    found.append((at, at + len(t), i))
                at = raw.find(t, at + 1)
        kept, end = [], 0
        for a, b, i in sorted(found, key=lambda x: (x[0], -x[1])):
            if a >= end:
                kept.append((a, b, i))
                end = b
        return kept

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """First byte of every piece (pieces cover all bytes), and the special tokens."""
        n = len(data)
        raw = np.concatenate([data, np.zeros(3, np.uint8)])
        kind = self._classes(raw)[:n]
        specials = self._specials(data.tobytes(), off)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        for a, b, _ in specials:
            edge[a] = edge[b] = True
        start = np.empty(n + 1, bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        blank = kind == BLANK
        after = np.flatnonzero(start[1:n] & blank[:-1] & ~edge[1:n]) + 1  # first byte after a run of blanks
        last = after - 1
        for _ in range(3):
            last = last - ((data[last] & 0xC0) == 0x80)
        start[last] = True
        start[after[data[after - 1] == 0x20]] = False
        start |= edge
        q = np.flatnonzero(data == 0x27)
        if len(q):
            before = raw[q - 1]
            q = q[edge[q] | ((kind[q - 1] != SIGN) & (before != 0x20))]
            one, two = raw[q + 1], raw[q + 2]
            for a, b in ENDINGS:
                hit = (one == ord(a)) & ~edge[q + 1]
                if b:
                    hit &= (two == ord(b)) & ~edge[np.minimum(q + 2, n)]
                start[q[hit] + 1] = False
                start[q[hit] + 1 + len(a + b)] = True
        for a, b, _ in specials:
            start[a + 1 : b] = False
        return np.flatnonzero(start[:n]), specials

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row) of a string column; a null is an empty text."""
        data, off = text_bytes(column)
        rows = len(off) - 1
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        starts, specials = self.pieces(data, off)
        ends = np.append(starts[1:], len(data))
        which = self._lookup(data, starts, ends, {a: i for a, _, i in specials})
        lens = self.length[which]
        at = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.arange(at[-1]) + np.repeat(self.begin[which] - at[:-1], lens)]
        return ids, np.diff(at[np.searchsorted(starts, off)])

    def _lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, specials: dict[int, int]) -> np.ndarray:
        if len(self.flat) > CACHE_IDS:
            self._empty()
        h = word_hashes(data, starts, ends)
        slot = (h >> np.uint64(44)).astype(np.int64)
        which = np.where(self.keys[slot] == h, self.slot[slot], -1)
        own = np.flatnonzero(ends - starts > LONG)
        if specials:
            own = np.union1d(own, np.searchsorted(starts, sorted(specials)))
        which[own] = -2
        miss = np.flatnonzero(which == -1)
        keys, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
        todo = np.concatenate([miss[first], own])
        raw = data.tobytes()
        new = [[specials[a]] if a in specials else self.merge(raw[a:b]) for a, b in zip(starts[todo].tolist(), ends[todo].tolist(), strict=True)]
        known, sizes = len(self.length), np.array([len(x) for x in new], np.int64)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.flat = np.concatenate([self.flat, np.array([i for x in new for i in x], np.int32)])
        which[miss] = known + inverse
        which[own] = known + len(keys) + np.arange(len(own))
        slot = (keys >> np.uint64(44)).astype(np.int64)
        self.keys[slot], self.slot[slot] = keys, known + np.arange(len(keys))
        return which


@lru_cache(maxsize=1)
def coder(source: str, classes: bytes) -> ByteCoder:
    return ByteCoder(source, np.frombuffer(classes, np.uint8))
