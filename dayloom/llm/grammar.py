"""Re-Pair grammars: a shard of ids written as rules and a short sequence, read back in parts.

``Grammar.of`` repeatedly counts all adjacent pairs of a shard and replaces the most frequent
ones by new symbols, a round at a time, until pairs become rare or symbols run out. Every rule
keeps the number of ids it stands for, so ids lo..hi of a document are found by
adding lengths and only the symbols that overlap them are expanded. No rule crosses the end of
a document.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: A pair gets a rule if it is seen so often in the shard.
LEAST = 4
#: Rules added in one round, and the share of a sequence that a round must save for another one to follow.
ROUND_RULES, ROUND_SAVES = 4096, 0.01
#: Slots of the table that tells which pairs are replaced; of two pairs on one slot the rarer waits for a later round.
SLOT_BITS = 18
MAGIC = b"DLRP\x01"
HEAD = struct.Struct("<5sBIIQQ")


def _replaced(seq: np.ndarray, last: np.ndarray, base: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: (rules, sequence, last flags) after replacing the most frequent pairs."""
    none = np.zeros((0, 2), seq.dtype), seq, last
    if len(seq) < 2 or room <= 0:
        return none
    wide, bits = (np.uint32, 16) if seq.dtype == np.uint16 else (np.uint64, 32)
    empty, apart = np.array([-1, -2]).astype(wide)  # no pair has these keys: the two highest symbols stay unused
    keys = seq[:-1].astype(wide)
    keys <<= wide(bits)
    keys |= seq[1:]
    keys[last[:-1]] = apart
    ranked = np.sort(keys)
    ranked = ranked[: len(ranked) - int(np.count_nonzero(last[:-1]))]
    often = np.flatnonzero(ranked[LEAST - 1 :] == ranked[: len(ranked) - LEAST + 1]) if len(ranked) >= LEAST else np.zeros(0, np.int64)
    pairs, counts = np.unique(ranked[often], return_counts=True)
    pairs = pairs[np.argsort(-counts, kind="stable")[: min(room, ROUND_RULES)]]
    if not len(pairs):
        return none
    odd, shift = wide(0x9E3779B1 if wide is np.uint32 else 0x9E3779B97F4A7C15), wide(2 * bits - SLOT_BITS)
    _, own = np.unique(pairs * odd >> shift, return_index=True)  # the first, that is the most frequent, of each slot
    pairs = pairs[np.sort(own)]
    held, name = np.full(1 << SLOT_BITS, empty), np.zeros(1 << SLOT_BITS, np.int32)
    held[pairs * odd >> shift], name[pairs * odd >> shift] = pairs, np.arange(len(pairs))
    slots = (keys * odd >> shift).astype(np.int64)
    hit = np.flatnonzero(held.take(slots) == keys)
    # Of pairs that overlap, every other one from the left is replaced.
    new_run = np.empty(len(hit), bool)
    new_run[0] = True
    np.not_equal(hit[1:], hit[:-1] + 1, out=new_run[1:])
    lead = np.flatnonzero(new_run)
    if len(lead) < len(hit):
        hit = hit[(hit - np.repeat(hit[lead], np.diff(lead, append=len(hit)))) & 1 == 0]
    rule = name[slots[hit]]
    used = np.bincount(rule, minlength=len(pairs)) >= 2
    if not used.all():
        hit, rule = hit[used[rule]], rule[used[rule]]
        if not len(hit):
            return none
    number = np.cumsum(used) - 1
    seq, last = seq.copy(), last.copy()
    seq[hit] = base + number[rule]
    last[hit] = last[hit + 1]
    keep = np.ones(len(seq), bool)
    keep[hit + 1] = False
    kept = pairs[used]
    return np.stack([kept >> wide(bits), kept & wide((1 << bits) - 1)], 1).astype(seq.dtype), seq[keep], last[keep]


@dataclass
class Grammar:
    """``rules[i]`` is what symbol ``base + i`` stands for; ``first`` holds where each document starts in ``sequence``."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, sizes: np.ndarray, base: int) -> Grammar:
        """Grammar of documents of ``sizes`` ids each; all ids are below ``base``."""
        narrow = base < 65_000
        limit = (1 << 16 if narrow else 1 << 32) - 1
        seq = ids.astype(np.uint16 if narrow else np.uint32)
        ends = np.cumsum(sizes)
        last = np.zeros(len(seq), bool)
        last[ends[sizes > 0] - 1] = True
        found, top = [], base
        while True:
            rules, shorter, last = _replaced(seq, last, top, limit - top)
            saved = len(seq) - len(shorter)
            seq = shorter
            found.append(rules)
            top += len(rules)
            if not len(rules) or saved < ROUND_SAVES * len(seq):
                break
        rules = np.concatenate(found)
        lengths = np.ones(top, np.int64)
        for a, b, at in _levels(found, base):
            lengths[at] = lengths[a] + lengths[b]
        covered = np.concatenate([[0], np.cumsum(lengths[seq])])
        first = np.searchsorted(covered, np.concatenate([[0], ends]))
        return Grammar(base, rules, lengths[base:], seq, first)

    @property
    def sizes(self) -> np.ndarray:
        """Ids of every document, from expansion lengths alone."""
        return np.diff(self._covered()[self.first])

    def _all_lengths(self) -> np.ndarray:
        return np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])

    def _covered(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self._all_lengths()[self.sequence[lo:hi]])])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: all of one depth are opened together."""
        out = symbols
        while True:
            opened = np.flatnonzero(out >= self.base)
            if not len(opened):
                return out
            rule = out[opened] - out.dtype.type(self.base)
            grown = np.ones(len(out), np.int8)
            grown[opened] = 2
            out = np.repeat(out, grown)
            at = opened + np.arange(len(opened))
            out[at], out[at + 1] = self.rules[rule, 0], self.rules[rule, 1]

    def document(self, d: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo..hi of document d; only symbols that hold some of them are expanded."""
        a, b = self.first[d], self.first[d + 1]
        covered = self._covered(a, b)
        hi = int(covered[-1]) if hi is None else min(hi, int(covered[-1]))
        if lo >= hi:
            return self.sequence[:0]
        x = int(np.searchsorted(covered, lo, "right")) - 1
        y = int(np.searchsorted(covered, hi))
        return self.expand(self.sequence[a + x : a + y])[lo - covered[x] : hi - covered[x]]

    def ids(self) -> np.ndarray:
        return self.expand(self.sequence)

    def dump(self) -> bytes:
        """Header, then rules, expansion lengths, sequence and document starts, all little-endian."""
        width = self.sequence.dtype.itemsize
        head = HEAD.pack(MAGIC, width, self.base, len(self.rules), len(self.sequence), len(self.first))
        kind = f"<u{width}"
        parts = (self.rules.astype(kind), self.lengths.astype("<u4"), self.sequence.astype(kind), self.first.astype("<u8"))
        return head + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    @staticmethod
    def load(raw: bytes) -> Grammar:
        magic, width, base, rules, symbols, firsts = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        at, out = HEAD.size, []
        for kind, n in ((f"<u{width}", 2 * rules), ("<u4", rules), (f"<u{width}", symbols), ("<u8", firsts)):
            out.append(np.frombuffer(raw, kind, n, at))
            at += out[-1].nbytes
        return Grammar(base, out[0].reshape(-1, 2), out[1], out[2], out[3].astype(np.int64))


def _levels(found: list[np.ndarray], base: int):
    """(left, right, symbols) of the rules of each round; a round's rules name symbols of earlier rounds only."""
    for rules in found:
        yield rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64), np.arange(base, base + len(rules))
        base += len(rules)
