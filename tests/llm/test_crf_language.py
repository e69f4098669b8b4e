"""Forward-backward equals brute force over all labellings; held-out and code-switched text is labelled right."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.llm import crf_language as L


def test_posteriors_equal_enumeration():
    r = np.random.default_rng(1)
    emission, moves = r.normal(size=(5, 3)), r.normal(size=(3, 3))
    seq, first = np.array([0, 3, 1, 1, 4, 2, 2]), np.array([0, 4, 4, 5, 7])
    got = L.posteriors(emission, seq, first, moves)
    for lo, hi in zip(first, first[1:]):
        if hi == lo:
            continue
        want, total = np.zeros((hi - lo, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(hi - lo)):
            p = np.exp(sum(emission[seq[lo + i], s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, s in enumerate(path):
                want[i, s] += p
        assert got[lo:hi] == pytest.approx(want / total, abs=1e-12)
    token, pairs = L._pair_sums(emission, seq[:6], 3, moves)
    assert token == pytest.approx(L.posteriors(emission, seq[:6], np.array([0, 3, 6]), moves))
    assert pairs.sum() == pytest.approx(4)


SYLLABLES = {"aa": ["tor", "ing", "the", "ble", "wh"], "bb": ["ció", "ñas", "que", "llo", "rr"], "cc": ["sch", "ung", "ü", "ein", "tz"]}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    r = random.Random(3)
    rows = [(i, sentence(r, lang, r.randrange(3, 120)), lang) for i, lang in enumerate(r.choices(list(SYLLABLES), [6, 2, 1], k=400))]
    rows += [(1000, None, "aa"), (1001, "x", None), (None, "y", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return rows, df, L.train(df, F.col("doc_id") % 4 != 2)


def test_held_out(trained):
    rows, df, field = trained
    assert field.langs == ["aa", "bb", "cc"]  # zz has no doc_id to tell that it may be learned from
    truth = {i: lang for i, t, lang in rows if i is not None and i < 1000}
    got = L.predict(df, field).collect()
    held = [x for x in got if x.doc_id in truth and x.doc_id % 4 == 2]
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.98
    assert all(0 <= x.score <= 1 for x in got)


def test_code_switching(spark, trained):
    _, _, field = trained
    r = random.Random(4)
    parts = [("aa", 30), ("cc", 25), ("bb", 40)]
    text = "\n".join(sentence(r, lang, n) for lang, n in parts)
    spans = L.label_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), field).orderBy("doc_id").collect()
    labels = [s.lang for s in spans[0].spans for _ in range(s.first, s.end)]
    want = [lang for lang, n in parts for _ in range(n)]
    assert np.mean([a == b for a, b in zip(labels, want, strict=True)]) > 0.95
    assert spans[1].spans == []


def test_rows(spark, trained):
    _, _, field = trained
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "— 😀 ٣"), (5, "ü"), (5, "ü"), (6, "the " * 60_000), (None, "que")]
    df = spark.createDataFrame([(*x, "l") for x in rows], "doc_id long, text string, lang_pred string")
    got = L.predict(df, field).collect()
    assert len(got) == 8
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append((x.lang_pred, x.score))
    assert all(by[i] == [("und", 0.0)] for i in (1, 2, 3, 4))
    assert by[5][0] == by[5][1] and by[5][0][0] == "cc" and by[6][0][0] == "aa" and by[None][0][0] == "bb"
    assert L.predict(df.limit(0), field).count() == 0
    assert {x.lang_pred for x in L.predict(df, None).collect()} == {"und"}


def test_long_and_short_texts_are_learned(spark):
    """A language of long documents alone and one of texts of few words are learned like any other."""
    r = random.Random(8)
    rows = [(i, sentence(r, "aa", 60), "aa") for i in range(60)]
    rows += [(100 + i, sentence(r, "bb", 3000), "bb") for i in range(8)]
    rows += [(200 + i, sentence(r, "cc", r.randrange(1, 5)), "cc") for i in range(200)]
    assert all(len(t.encode()) > L.DOC_BYTES for i, t, _ in rows if 100 <= i < 200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = L.train(df, F.lit(True))
    assert field.langs == ["aa", "bb", "cc"]
    asked = [(i, sentence(r, lang, 20), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    got = {x.doc_id: x.lang_pred for x in L.predict(spark.createDataFrame(asked, df.schema), field).collect()}
    assert np.mean([got[i] == lang for i, _, lang in asked]) > 0.95


def test_pieces_cover_all_tokens():
    for n in range(0, 40):
        pieces = L._pieces(5, 5 + n)
        assert all(len(p) == L.PIECE for p in pieces)
        assert sorted({int(x) for p in pieces for x in p}) == list(range(5, 5 + n))


@pytest.mark.parametrize("n", [10, 500, 501, 10**6, 475 * 10**6, 10**12])
def test_sample_of_any_number_of_documents(n):
    """The share of hashes below the bound gives about 500 documents, never none."""
    share = L.sample_bound(n, 500) / ((1 << 63) - 1)
    assert share == 1 if n <= 500 else 0.94 * 500 <= share * n <= 0.96 * 500


def test_ties_go_to_the_first_language_and_repeats_are_alike(spark):
    docs = spark.createDataFrame([(i, "aaa bbb", k) for i, k in enumerate(["yy", "xx"] * 6)], "doc_id long, text string, lang string")
    got = L.predict(docs, L.train(docs, F.lit(True))).collect()
    assert len(got) == 12 and len({r.lang_pred for r in got}) == 1 and {r.lang_pred for r in got} <= {"xx", "yy"}
