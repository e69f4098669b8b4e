"""Removed words equal brute force; spans that decide a name hold wherever they occur."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from dayloom.llm import recompression as R

WORD = re.compile(r"[^ \t-\r]+")


def brute(rows, size):
    docs = [WORD.findall(t or "") for _, t in rows]
    seen: dict = {}
    for w in docs:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (i, _), w in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if seen[tuple(w[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture(seed: int, size: int):
    r = random.Random(seed)
    few, many = [f"a{i}" for i in range(3)], [f"é{i}" for i in range(40)]
    shared = [[r.choice(many) for _ in range(r.choice((size - 1, size, size + 1, 3 * size)))] for _ in range(6)]
    texts: list[str | None] = [None, "", "  \n", "x"]
    for _ in range(60):
        w: list[str] = []
        for _ in range(r.randrange(1, 5)):
            kind = r.random()
            if kind < 0.35:
                w += r.choice(shared)
            elif kind < 0.5:
                w += [r.choice(few)] * r.randrange(1, 3 * size)  # runs
            elif kind < 0.6:
                w += [r.choice(few), r.choice(many)] * r.randrange(1, 2 * size)  # periods
            else:
                w += [r.choice(many if r.random() < 0.7 else few) for _ in range(r.randrange(0, 2 * size))]
        texts.append((" " if r.random() < 0.5 else "\n").join(w))
    texts += texts[10:13]
    ids: list[int | None] = list(range(len(texts)))
    ids[7], ids[0] = ids[8], None
    return list(zip(ids, texts, strict=True))


def test_equals_brute_force(spark):
    for seed, size in ((1, 35), (2, 35), (3, 12), (4, 50)):
        rows = fixture(seed, size)
        df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, n_words int").repartition(3)
        got = sorted((tuple(x) for x in R.digests(df, size).collect()), key=str)
        assert got == brute(rows, size)
        assert any(x[2] for x in got)


def test_deciding_spans():
    """A name formed in a row is formed in every row that holds the words of its span."""
    r = np.random.default_rng(5)
    checked = 0
    for _ in range(200):
        a = r.integers(0, 4, 80).astype(np.uint64)
        for _, name, lo, hi in R.names(a, np.array([0, 80]), 5):
            for n, x, y in list(zip(name, lo, hi, strict=True))[:6]:
                if x < 0 or y > 80:
                    continue
                b = np.concatenate([r.integers(0, 4, 7).astype(np.uint64), a[x:y], r.integers(0, 4, 5).astype(np.uint64)])
                there = {int(v) for _, m, p, q in R.names(b, np.array([0, len(b)]), 5) for v in m}
                assert int(n) in there
                checked += 1
    assert checked > 500


def test_texts_and_spans(spark):
    line = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, "start " + line), (2, line + " end"), (3, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in R.deduplicated(df).collect()}
    assert got[1].text == "start" and got[2].text == "end" and got[3].text == ""
    assert [tuple(s) for s in got[1].removed] == [(1, 41)] and got[3].removed == []
    assert R.digests(df.limit(0)).count() == 0
