"""Held-out accuracy on both kinds of bad documents, and the defined cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dayloom.llm import cotraining as Q


def make(seed: int, n: int):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeginorst") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    common = words[:40]
    bad = ["zorg", "blat", "snerf", "quux"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(common if r.random() < 0.6 else words) for _ in range(r.randrange(20, 150))]
        kind = r.choices(["good", "junk", "toxic"], [7, 2, 2])[0]
        if kind == "junk":
            w = [x.upper() + "!!" for x in w] if r.random() < 0.5 else [w[0]] * len(w)
        if kind == "toxic":
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(bad)
        text = " ".join(w).capitalize() if kind != "junk" else " ".join(w)
        docs.append((i, text, r.choice(["en", "de"]), "spam" if kind != "good" and r.random() < 0.5 else f"s{r.randrange(5)}", len(text)))
        labels.append((i, 0 if kind == "junk" else 1, int(kind == "toxic")))
    return docs, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = make(1, 2400)
    truth = {i: q == 1 and t == 0 for i, q, t in labels}
    known = [x for x in labels if x[0] % 2] + [(None, 1, 0), (3, None, 0), (999_999, 1, 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    return df, truth, Q.train(df, spark.createDataFrame(known, LABELS), labelled=1000, pseudo=600)


def test_held_out_accuracy(fitted):
    df, truth, model = fitted
    rows = [r for r in model.score(df).collect() if r.doc_id % 2 == 0]
    kept_good = [r.keep for r in rows if truth[r.doc_id]]
    kept_bad = [r.keep for r in rows if not truth[r.doc_id]]
    assert sum(kept_good) >= 0.97 * len(kept_good) and sum(kept_bad) <= 0.1 * len(kept_bad)
    assert all(0 <= r.score <= 1 for r in rows)
    # the combination is no worse than either view alone
    hits = {c: sum((r[c] >= 0.5) == truth[r.doc_id] for r in rows) for c in ("score", "text_score", "meta_score")}
    assert hits["score"] >= max(hits["text_score"], hits["meta_score"]) - 3


def test_rows(spark, fitted):
    _, _, model = fitted
    rows = [(1, None, None, None, None, "k"), (2, "", "en", "s0", 0, "k"), (2, " -- ", "en", "s0", 4, "k"), (3, "word " * 50_000, "xx", "new", 250_000, "k"), (None, "a b", "en", "s1", 3, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", keep string")
    got = model.score(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "text_score", "meta_score", "keep"]
    assert [(r.score, r.keep) for r in got.where("trim(coalesce(text, '')) in ('', '--')").collect()] == [(0.0, False)] * 3
    assert got.count() == 5 and model.score(df.limit(0)).count() == 0


def test_one_kind_or_no_labels(spark):
    df = spark.createDataFrame(make(2, 30)[0], SCHEMA)
    bad = spark.createDataFrame([(i, 0, 0) for i in range(9)], LABELS)
    assert not any(r.keep for r in Q.classify(df, bad).collect())
    assert all(r.keep for r in Q.classify(df, bad.limit(0)).collect())


def test_vocabulary_counts_documents_of_the_whole_table(spark):
    df = Q.features(spark.createDataFrame([(i, f"all{' odd odd' if i % 2 else ''} one{i}" + (" four" if i < 4 else ""), "en", "s", 9) for i in range(20)], SCHEMA))
    assert Q.vocabulary(df, 10) == ["all", "odd", "four"] and Q.vocabulary(df, 2) == ["all", "odd"]


@pytest.mark.parametrize("bound", [10, 100, 4000])
def test_most_confident_rows_of_each_kind(spark, bound):
    r = random.Random(3)
    rows = [(i, r.choice([0.0, 0.9999, 0.99991, 0.98, 0.02, 0.5, r.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, p double").withColumns({"good": F.lit(None).cast("double"), "weight": F.lit(1.0)})
    shares = {1.0: 0.75, 0.0: 0.25}
    got = {(x.doc_id, x.good) for x in Q.pseudo_labels(df, F.col("p"), shares, bound).collect()}
    tie = {x.doc_id: x.h for x in df.select("doc_id", Q._place().alias("h")).collect()}
    want = set()
    for good in (1.0, 0.0):
        sure = sorted((-round((p if good else 1 - p) * 1000), tie[i], i) for i, p in rows if (p if good else 1 - p) >= Q.CONFIDENT)
        want |= {(i, good) for *_, i in sure[: max(1, int(bound * shares[good]))]}
    assert got == want


def test_rounds_equal_a_plain_loop(spark):
    """The same rounds with pseudo-labels chosen by sorting in Python give the same scores."""
    docs, labels = make(5, 400)
    df = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], LABELS)
    model = Q.train(df, known, pseudo=60)
    view = Q.features(df)
    text, meta = Q._views(Q.vocabulary(view))
    tie, part = Q._place().alias("tie"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0).alias("part")
    rows = meta.transform(text.transform(view)).select("doc_id", "_text_features", "_meta_features", tie, part).collect()
    truth = {i: float(q == 1 and t == 0) for i, q, t in labels if i % 2}
    schema = "doc_id long, good double, weight double"
    base = meta.transform(text.transform(view)).select("doc_id", "_text_features", "_meta_features")
    seed = [(x.doc_id, truth[x.doc_id], 1.0) for x in rows if x.doc_id in truth and not x.part]
    share = sum(truth.values()) / len(truth)

    def fit(told, which):
        return Q._fit(base.join(spark.createDataFrame(told, schema), "doc_id").coalesce(1), which)

    fits = {v: fit(seed, v) for v in ("text", "meta")}
    for _ in range(Q.ROUNDS):
        told = {}
        for mine, other in (("text", "meta"), ("meta", "text")):
            p = {x.doc_id: x[f"_{mine}_probability"][1] for x in fits[mine].transform(base).collect()}
            more = []
            for good, part_of in ((1.0, share), (0.0, 1 - share)):
                sure = sorted((-round((p[x.doc_id] if good else 1 - p[x.doc_id]) * 1000), x.tie, x.doc_id) for x in rows if x.doc_id not in truth and (p[x.doc_id] if good else 1 - p[x.doc_id]) >= Q.CONFIDENT)
                more += [(i, good, Q.PSEUDO_WEIGHT) for *_, i in sure[: max(1, int(60 * part_of))]]
            told[other] = seed + more
        fits = {v: fit(told[v], v) for v in told}
    got = {x.doc_id: (x.text_score, x.meta_score) for x in model.score(df).collect()}
    both = {v: {x.doc_id: x[f"_{v}_probability"][1] for x in fits[v].transform(base).collect()} for v in fits}
    for i, (a, b) in got.items():
        assert a == pytest.approx(both["text"][i], abs=1e-3) and b == pytest.approx(both["meta"][i], abs=1e-3)


def test_repeated_rows_and_several_labels(spark):
    docs, labels = make(6, 200)
    df = spark.createDataFrame(docs + docs[:20], SCHEMA)
    several = spark.createDataFrame(labels + [(i, 0, 1) for i, _, _ in labels[:20]], LABELS)
    assert Q.train(df, several, pseudo=40).only is None
    got = Q.classify(df, several).collect()
    assert len(got) == 220
    scores = {}
    for x in got:
        assert scores.setdefault(x.doc_id, x.score) == x.score


def test_nth_hash_takes_few_queries(spark, monkeypatch):
    """The n-th smallest of hashes with copies, by as few queries as the values left allow."""
    r = random.Random(8)
    values = [r.getrandbits(63) for _ in range(300)] + [5 << 51 | 7] * 40 + [(5 << 51) + k for k in range(30)]
    df = spark.createDataFrame([(v,) for v in values], "place long")
    asked, plain = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: asked.append(1) or plain(self))
    for n in (1, 60, 200, len(values)):
        asked.clear()
        assert Q._nth(df, n) == sorted(values)[n - 1] and len(asked) == 2
    assert Q._nth(df, 60, few=1) == sorted(values)[59]


def test_written_vectors_name_no_elements(spark, monkeypatch):
    docs, labels = make(4, 400)
    seen = {}
    monkeypatch.setattr(Q, "written", lambda df, name: seen.setdefault(name, df).localCheckpoint())
    Q.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels[::2], LABELS), labelled=100, pseudo=60, rounds=1)
    size = seen["views"].schema["_text_features"].metadata["ml_attr"]["num_attrs"]
    assert size == len(Q.vocabulary(Q.features(spark.createDataFrame(docs, SCHEMA)))) + len(Q._STYLE)
    assert all(len(f.json()) < 2000 for df in seen.values() for f in df.schema)


def test_repeated_words_are_counted_once(spark):
    row = Q.features(spark.createDataFrame([(1, "A b a, B c", "en", "s", 10)], SCHEMA)).first()
    assert row._words == ["a", "b", "a", "b", "c"] and row._kinds == ["a", "b", "c"]
