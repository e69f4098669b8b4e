"""Planted passages are found exactly, edited ones with the stated recall, clean texts are left alone."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from dayloom.llm import decontamination as D


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(r, item, edits, pool):
    w = list(item)
    for _ in range(edits):
        k, i = r.random(), r.randrange(len(w))
        if k < 0.4:
            w[i] = r.choice(pool)
        elif k < 0.7:
            w.insert(i, r.choice(pool))
        elif len(w) > 1:
            del w[i]
    return w


@pytest.fixture(scope="module")
def data():
    r = random.Random(8)
    pool = [f"w{i}" for i in range(4000)] + ["the", "of", "and"] * 700
    items = [[r.choice(pool) for _ in range(r.randrange(12, 60))] for _ in range(60)]
    return r, pool, items


def test_edited_passages(data):
    r, pool, items = data
    found = D.Items(list(range(len(items))), [" ".join(w) for w in items])
    for share, least in ((0, 1.0), (0.5, 0.99), (1, 0.95)):
        texts, planted = [], []
        for i, w in enumerate(items * 4):
            edits = int(D.allowed(len(w)) * share)
            planted.append(i % len(items))
            texts.append([*(r.choice(pool) for _ in range(50)), *edited(r, w, edits, pool), *(r.choice(pool) for _ in range(50))])
        hits = found.hits(*D.normalised(pa.array([" ".join(t) for t in texts])))
        got = {(row, item) for row, item, *_ in hits}
        recall = np.mean([(row, item) in got for row, item in enumerate(planted)])
        assert recall >= least, (share, recall)
        assert len(got) == len({row for row, _ in got})  # no item but the planted one
        for row, item, a, b, d in hits[::4]:
            assert distance(items[item], texts[row][a:b]) == d <= D.allowed(len(items[item]))


KINDS = {"substitutions": (1.0, 1.0), "insertions": (0.0, 1.0), "deletions": (0.0, 0.0), "mixed": (0.4, 0.7)}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("size", [5, 8, 11, 12, 13, 16, 20, 27, 40, 60, 100, 200, 400])
def test_recall_by_length_and_kind_of_edit(size, kind):
    """As many edits as are allowed, all of one kind: at least 0.95 of the copies are found, with their distance."""
    r = random.Random(size)
    pool = [f"w{i}" for i in range(4000)] + ["the", "of", "and"] * 700
    items = [[r.choice(pool) for _ in range(size)] for _ in range(40)]
    found = D.Items(list(range(len(items))), [" ".join(w) for w in items])
    texts = []
    for w in items * 2:
        for _ in range(D.allowed(size)):
            w, i = list(w), r.randrange(len(w))
            if kind == "substitutions" or kind == "mixed" and r.random() < 0.4:
                w[i] = r.choice(pool)
            elif kind == "insertions" or kind == "mixed" and r.random() < 0.5:
                w.insert(i, r.choice(pool))
            else:
                del w[i]
        texts.append([*(r.choice(pool) for _ in range(r.choice([0, 30]))), *w, *(r.choice(pool) for _ in range(r.choice([0, 30])))])
    words, first = D.normalised(pa.array([" ".join(t) for t in texts]))
    hits = found.hits(words, first)
    got = {(row, item) for row, item, *_ in hits}
    assert np.mean([(k, k % 40) in got for k in range(len(texts))]) >= 0.95
    for row, item, a, b, d in hits[::9]:
        assert distance(items[item], texts[row][a:b]) == d <= D.allowed(size)


def test_lengths_do_not_hide_each_other():
    """Items of 11 and 12 words stand side by side; a shortened passage may end its text."""
    r = random.Random(3)
    pool = [f"w{i}" for i in range(2000)]
    items = [[r.choice(pool) for _ in range(m)] for m in (5, 11, 12, 13, 14) * 20]
    found = D.Items(list(range(len(items))), [" ".join(w) for w in items])
    texts = [[*(r.choice(pool) for _ in range(20)), *(w if len(w) < 12 else w[: len(w) // 2] + w[len(w) // 2 + D.allowed(len(w)) :])] for w in items]
    got = {(row, item) for row, item, *_ in found.hits(*D.normalised(pa.array([" ".join(t) for t in texts])))}
    assert {(i, i) for i in range(len(items))} <= got


def test_items_of_few_words_equal_whole_texts():
    found = D.Items([7, 8, 9], ["Yes, it is.", "no", "no"])
    texts = pa.array(["yes it is", "yes it is so", "NO!", "no no", None, ""])
    got = sorted((row, found.ids[item], a, b, d) for row, item, a, b, d in found.hits(*D.normalised(texts)))
    assert got == [(0, 7, 0, 3, 0), (2, 8, 0, 1, 0), (2, 9, 0, 1, 0)]


def test_several_hits_of_an_item():
    """Each copy in a long text is found once, the nearest of overlapping ones."""
    r = random.Random(4)
    pool = [f"w{i}" for i in range(900)]
    item = [r.choice(pool) for _ in range(30)]
    changed = item[:10] + ["new"] + item[11:]
    text = [*(r.choice(pool) for _ in range(200)), *item, *changed, *(r.choice(pool) for _ in range(5000)), *item]
    found = D.Items([1], [" ".join(item)])
    assert [(a, b, d) for _, _, a, b, d in found.hits(*D.normalised(pa.array([" ".join(text)])))] == [(200, 230, 0), (230, 260, 1), (5260, 5290, 0)]


def test_rows(spark, data):
    r, pool, items = data
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (900, None), (901, ""), (902, "w1 w2")], "item_id long, text string")
    odd = "Start. " + ", ".join(w.upper() for w in items[3]) + "!! end"
    rows = [
        (1, odd, "x"), (2, None, "x"), (3, " ".join(r.choice(pool) for _ in range(900)), None), (4, "", "x"), (4, odd, "x"),
        (5, " ".join([*(r.choice(pool) for _ in range(30_000)), *items[4], *items[4], *items[5]]), "x"), (6, " ".join(items[6][: len(items[6]) // 2]), "x"), (7, "w1 w2 w1 w2", "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted((x.doc_id, x.item_id, x.distance) for x in D.leaks(docs, bench).collect())
    assert got == [(1, 3, 0), (4, 3, 0), (5, 4, 0), (5, 4, 0), (5, 5, 0)]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [2, 3, 4, 6, 7]
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.clean(docs, bench.limit(0)).count() == len(rows)


def test_slices_of_the_benchmark(spark, data, monkeypatch):
    _, _, items = data
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "doc_id long, text string")
    monkeypatch.setattr(D, "SLICE_WORDS", 300)
    assert len(list(D._slices(bench))) > 3
    assert sorted((x.doc_id, x.item_id) for x in D.leaks(docs, bench).collect()) == [(i, i) for i in range(len(items))]
    assert D.clean(docs, bench).count() == 0
