"""Ids equal those of the tokenizers library; grammars give back every id, whole or in part."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from dayloom.llm import byte_bpe, token_files  # noqa: E402
from dayloom.llm.grammar import LEAST, Grammar  # noqa: E402
from dayloom.session import shared_path  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", "'s", "x's's", "''s", " 's", "\t's", "don't we'll I'VE 'tis 'llama", "a" * 5000, "ab" * 3000, "x1234 5.6", "日本語　テキスト", "  two\n\n lines\n",
    "<|endoftext|>", "a<|endoftext|>'s <|endoftext|> <|endoftext", "😀🏽👨‍👩‍👧 !!??##", "  x", " x 　", "ﬁ ΣΑΣ İ", "\x1c\x1d\x85 \x00b", "y" * 64 + " " + "z" * 65, "Ⅷ²½ ٣4",
]


@pytest.fixture(scope="module")
def peer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteCoder(open(PATH, encoding="utf-8").read(), byte_bpe.character_classes())


def fuzz(n: int) -> list[str]:
    r = random.Random(4)
    letters = [*("abcdeinorstvelm" * 3 + "AÉñß'''  Ж1٣²!?.,&*# \t\n 　́😀漢"), "'s", "'ll", "'re", "<|endoftext|>", "<|end", " '"]
    return ["".join(r.choice(letters) for _ in range(r.randrange(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("texts", [ODD, fuzz(4000), [None, "x"], []], ids=["odd", "fuzz", "null", "none"])
def test_equal_ids(peer, coder, texts):
    ids, sizes = coder.encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == peer.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_every_character(peer, coder):
    """Each code point between a letter and a digit, so that its class decides the pieces."""
    texts = ["".join(f"a{chr(p)} {chr(p)}1" for p in range(lo, lo + 2048) if not 0xD800 <= p < 0xE000) for lo in range(0, 0x20000, 2048)]
    ids, sizes = coder.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == peer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("base", [300, 70_000])
def test_grammar_round_trip(base):
    r = np.random.default_rng(3)
    phrases = [r.integers(0, base, 6) for _ in range(40)]
    docs = [np.concatenate([phrases[k] for k in r.integers(0, 40, n)]) if n else np.zeros(0, np.int64) for n in r.integers(0, 60, 50)]
    docs += [np.zeros(301, np.int64), np.zeros(1, np.int64), np.tile([1, 2, 1], 50)]
    ids, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    g = Grammar.load(Grammar.of(ids, sizes, base).dump())
    assert len(g.sequence) < 0.5 * len(ids) and len(g.rules) > 0
    assert (g.ids() == ids).all() and (g.sizes == sizes).all()
    for d, want in enumerate(docs):
        n = len(want)
        for lo, hi in ((0, None), (0, n), (n // 3, 2 * n // 3), (n // 2, n // 2 + 1), (n, n + 5), (5, 2)):
            assert g.document(d, lo, hi).tolist() == want[lo:hi].tolist()


def test_rules_are_frequent_pairs_and_lengths_add_up():
    ids = np.tile([7, 8, 9, 10], LEAST + 1)
    g = Grammar.of(ids, np.array([len(ids)]), 50)
    lengths = np.concatenate([np.ones(50, int), g.lengths])
    assert (g.lengths == lengths[g.rules.astype(int)].sum(1)).all()
    rare = Grammar.of(np.arange(40), np.array([20, 20]), 50)
    assert len(rare.rules) == 0 and len(rare.sequence) == 40
    apart = Grammar.of(np.tile([1, 2], 20), np.full(40, 1), 50)  # pairs across documents are no pairs
    assert len(apart.rules) == 0
    empty = Grammar.load(Grammar.of(np.zeros(0, int), np.zeros(0, int), 50).dump())
    assert len(empty.ids()) == 0 and len(empty.sizes) == 0


def test_files(spark, peer, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 300)
    texts = {9: "the end of it. " * 40, 3: None, 5: "", 4: "<|endoftext|> x's", 8: "very long " * 5000, 7: "Ça va", 6: "again and again"}
    rows = [(i, t, "shard", i) for i, t in texts.items()] + [(6, "again and again", None, None), (None, "no id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, start int").repartition(3)
    got = token_files.digests(df, PATH)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    start, want = 0, []
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0])):
        ids = [*peer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    out = shared_path(spark, "files")
    token_files.write(df, PATH, out)
    assert spark.read.parquet(f"{out}/shards.parquet").count() > 2
    for r in token_files.read(spark, out).where("doc_id is not null").collect():
        assert r.ids == [*peer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
    assert [r.ids for r in token_files.fetch(spark, out, 8, 4000, 4010).collect()] == [peer.encode(texts[8], add_special_tokens=False).ids[4000:4010]]
    assert token_files.fetch(spark, out, 6).count() == 2 and token_files.fetch(spark, out, 100).count() == 0
    assert token_files.digests(df.limit(0), PATH).collect() == []
