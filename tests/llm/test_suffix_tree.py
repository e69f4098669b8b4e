"""Scores equal a plain dictionary implementation of the same tree, and beat word frequencies."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.llm import corpus as C
from dayloom.llm import suffix_tree as S

WORD = re.compile(r"[^ \t-\r]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def brute(rows, train, depth, min_count, min_gain):
    docs = [tokens(t) for _, t in rows]
    counts = Counter(w for d, on in zip(docs, train, strict=True) if on for w in d)
    total, kinds, singles = sum(counts.values()), len(counts), sum(c == 1 for c in counts.values())
    unseen = (singles + 0.5) / (total + 1) if total else 1.0
    grams = defaultdict(Counter)
    for d, on in zip(docs, train, strict=True):
        if on:
            for i, w in enumerate(d):
                for k in range(1, depth + 1):
                    if i >= k:
                        grams[tuple(d[i - k : i])][w] += 1
    prob = {}
    depth_at = {}
    for r, d in enumerate(docs):
        for i, w in enumerate(d):
            prob[r, i] = (1 - unseen) * counts[w] / max(total, 1) if counts[w] else unseen
            depth_at[r, i] = 0
    for k in range(1, depth + 1):
        places = [(r, i, tuple(d[i - k : i])) for r, d in enumerate(docs) for i in range(k, len(d)) if depth_at[r, i] == k - 1]
        places = [(r, i, c) for r, i, c in places if sum(grams[c].values()) >= min_count]
        gain = defaultdict(lambda: [0.0] * len(S.MASSES))
        for r, i, c in places:
            if train[r]:
                n, nc = grams[c][docs[r][i]], sum(grams[c].values())
                for m, mass in enumerate(S.MASSES):
                    gain[c][m] += math.log(((n - 1) / prob[r, i] + mass) / (nc - 1 + mass))
        kept = {c: S.MASSES[max(range(len(g)), key=g.__getitem__)] for c, g in gain.items() if max(g) > min_gain}
        for r, i, c in places:
            if c in kept:
                prob[r, i] = (grams[c][docs[r][i]] + kept[c] * prob[r, i]) / (sum(grams[c].values()) + kept[c])
                depth_at[r, i] = k
    base = {w: math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for d in docs for w in d}
    return [
        (len(d), sum(counts[w] > 0 for w in d), total, sum(base[w] for w in d), sum(math.log10(prob[r, i]) for i in range(len(d))), sum(depth_at[r, i] for i in range(len(d))) / len(d))
        for r, d in enumerate(docs)
    ]


def fixture():
    r = random.Random(3)
    lines = ["the Cat sat on the mat", "a dog ran in the park today", "THE cat ran on the mat and sat", "ünder the bridge a dog sat"]
    texts = [None, "", " \t"]
    for _ in range(160):
        texts.append(" ".join(r.choice(lines) if r.random() < 0.7 else f"w{r.randrange(300)} w{r.randrange(9)}" for _ in range(r.randrange(1, 12))))
    texts += ["word " * 3000, texts[5], texts[5]]
    return list(enumerate(texts))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_equals_brute_force(spark, depth):
    rows = fixture()
    train = [i % 4 != 1 for i, _ in rows]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, score string").repartition(3)
    got = S.score(df, F.col("doc_id") % 4 != 1, depth, 5, 1.0).orderBy("doc_id").collect()
    want = brute(rows, train, depth, 5, 1.0)
    assert len(got) == len(rows)
    for g, w in zip(got, want, strict=True):
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert (g.base_score, g.score, g.mean_depth) == pytest.approx(w[3:], abs=1e-6, rel=1e-6)
    held = [(g.base_score, g.score) for g in got if g.doc_id % 4 == 1]
    assert sum(s for _, s in held) > sum(b for b, _ in held)
    assert max(g.mean_depth for g in got) > min(depth - 1, 1.5)


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = S.score(df, F.lit(False)).collect()
    assert {(g.n_known, g.train_tokens, g.score) for g in got} == {(0, 0, 0.0)}
    assert S.score(df.limit(0), F.lit(True)).count() == 0


def test_rare_contexts_count_in_a_large_corpus(spark):
    """A context seen MIN_COUNT times is kept among 24 million training tokens as well."""
    frequent = spark.range(24, numPartitions=8).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', 1000000)").alias("text"))
    rare = spark.createDataFrame([(100 + i, "left right") for i in range(S.MIN_COUNT)], "doc_id long, text string")
    got = S.score(frequent.unionByName(rare), F.lit(True)).where("doc_id >= 100").collect()
    assert len(got) == S.MIN_COUNT and all(g.train_tokens > 24_000_000 for g in got)
    assert {g.mean_depth for g in got} == {2 / 3}  # right after left, the end after right


@pytest.mark.parametrize("n", [1, 2, 1000, 200_000])
def test_packed_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
    for k in (keys, keys[:1], np.array([0, 2**64 - 1], np.uint64), np.arange(n, dtype=np.uint64)):
        raw = C.pack_keys(k)
        assert C.unpack_keys(raw).tolist() == k.tolist()
    assert n < 10_000 or len(C.pack_keys(keys)) < 8 * len(keys)
