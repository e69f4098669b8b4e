"""Near words, forms and roots equal those of a comparison of all pairs."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
import regex

from dayloom.llm import queries, spelling

UPPER = {c: c + 32 for c in range(65, 91)}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def plain(n: dict[str, int]) -> list[tuple]:
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out)


def result(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def table(spark, n: dict[str, int]):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def edited(word: str, r: random.Random, letters: str) -> str:
    p, c = r.randrange(len(word) + 1), r.choice(letters)
    return r.choice([word[:p] + c + word[p:], word[:p] + word[p + 1 :], word[:p] + c + word[p + 1 :]])


@pytest.mark.parametrize("hot", [1 << 16, 3], ids=["plain", "hot"])
@pytest.mark.parametrize("letters", ["ab", "abcdeé日"])
def test_equals_all_pairs(spark, monkeypatch, hot, letters):
    monkeypatch.setattr(spelling, "HOT_PAIRS", hot)
    r = random.Random(5)
    n: dict[str, int] = {}
    for _ in range(40):
        w = "".join(r.choice(letters) for _ in range(r.randrange(1, 19)))
        for k in range(4):
            n.setdefault(w, 10 ** r.randrange(0, 6) + r.randrange(3))
            w = edited(w, r, letters) or w
    assert result(spelling.groups(table(spark, n))) == plain(n)


def test_chain_ties_and_long_words(spark):
    long = "q" * 3000
    n = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10**4, "aabbbbb": 10**5, "abbbbbb": 10**6}
    n |= {"zzzzzzzz": 5, "zzzzzzzé": 50, "zzzzzzzb": 50, "zzzzzzzz2"[:7] + "aa": 49, long: 3, long + "q": 30, long[1:] + "r": 2}
    got = result(spelling.groups(table(spark, n)))
    assert got == plain(n)
    roots = {r[0]: r[5] for r in got}
    assert roots["aaaaaaa"] == "abbbbbb" and roots["zzzzzzzz"] == "zzzzzzzb" and roots[long] == long + "q"


def test_every_place_of_an_edit(spark):
    """One edit at each place of words of 7 to 12 letters is found."""
    n = {}
    for size in range(7, 13):
        w = "".join(chr(97 + (i * size) % 26) for i in range(size))
        n |= {w: 100} | {w[:p] + "é" + w[p:]: 1 for p in range(size + 1)} | {w[:p] + w[p + 1 :]: 1 for p in range(size)} | {w[:p] + "é" + w[p + 1 :]: 1 for p in range(size)}
    assert result(spelling.groups(table(spark, n))) == plain(n)


def test_query_equals_plain(spark, tmp_path):
    r = random.Random(2)
    base = ["international", "Straßenbahn", "naïveté×÷", "wonderful", "ÉCLAIRcissement", "short", "tension"]
    rows = [(i, " ".join(r.choice(base) for _ in range(60)) + r.choice([". ", "_", "1", "日"]) + r.choice(base), "word", 1) for i in range(120)]
    rows += [(500, None, "n", 2), (501, "", None, None), (None, "wonderful wonderful", "x", 1), (3, "tension " * 5000, "y", 0), (3, "tension " * 5000, "y", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    n: Counter[str] = Counter()
    for i, text, *_ in rows:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            p = h % len(run)
            n[run[:p] + run[p + 1 :] if h % 31 == 0 else run] += 1
    got = result(queries.op11_spelling_variants(spark, str(tmp_path)))
    assert got == plain({w: c for w, c in n.items() if len(w) >= 7 and c >= 2}) and any(g[3] for g in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.groups(spelling.counted(spelling.runs(docs), "run")).collect() == []
