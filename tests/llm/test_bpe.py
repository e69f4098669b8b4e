"""Ids and texts equal those of the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from dayloom.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "It's I'LL we'd", "a" * 5000, "ab" * 3000, "x1234 5.6", "ÀÉÎ é ﬁ ΣΑΣ İstanbul", "日本語 テキスト", "<|endoftext|> a<|startoftext|>b",
    "tab\tnew\nline\x0b\x0c\r\x85\xa0 end", "\x1c\x1d\x1e\x1f a\x00b", "😀🏽👨‍👩‍👧 !!??##", "don't DON'T 'tis", "<|END|>", "<|endoftext|", "​zero﻿",
]


def fuzz(n: int) -> list[str]:
    r = random.Random(4)
    letters = "abcdeinorst" * 4 + "AÉñß'ΣЖ1٣²!?.,&*# \t\n ́😀漢"
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def peer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("texts", [ODD, fuzz(3000)], ids=["odd", "fuzz"])
def test_equal_ids_and_text(peer, texts):
    coder = bpe.Speculator(open(PATH, encoding="utf-8").read())
    for text, (ids, decoded) in zip(texts, coder.encode_batch(texts), strict=True):
        want = peer.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(ids, "<u4")) == want, text[:60]
        assert decoded == peer.decode(want, skip_special_tokens=False), text[:60]


def test_pair_check_is_needed_and_exact():
    """Some words fail the greedy proposal; the pair check finds exactly those."""
    coder = bpe.Speculator(open(PATH, encoding="utf-8").read())
    words = sorted({w for t in fuzz(4000) for w in coder.words(t)})
    failing = 0
    for w in words:
        x = coder.symbols(w)
        exact = [coder.vocab[p] for p in coder.merged(x)]
        g = np.array(coder.propose(x))
        fine = all(coder._stands(int(t)) for t in g) and bool(coder.compatible(g[:-1], g[1:]).all())
        assert fine == (list(g) == exact), w
        failing += not fine
    assert 0 < failing < len(words)


def test_rows(spark, peer):
    rows = [(1, None, "z"), (2, "", "z"), (2, "The the", None), (2, "The the", None), (None, "ü " * 40_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.digests(df, PATH).collect()
    assert len(got) == 5
    want = {}
    for i, t, _ in rows:
        ids = peer.encode(t or "", add_special_tokens=False).ids
        want[(i, len(t or ""))] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(peer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert sorted(map(str, (tuple(r[1:]) for r in got))) == sorted(map(str, (want[(i, len(t or ""))] for i, t, _ in rows)))
    whole = bpe.decode(bpe.encode(df, PATH), PATH)
    assert whole.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"] and whole.count() == 5
    assert bpe.digests(df.limit(0), PATH).count() == 0
