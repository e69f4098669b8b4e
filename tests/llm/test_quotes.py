"""Threads and contents equal a plain walk over each conversation."""

from __future__ import annotations

import random
import re

from dayloom.llm import quotes


def split(line):
    m = re.match(r"^[ \t]*((?:>[ \t]*)*)", line)
    return m.group(1).count(">"), " ".join(line[m.end() :].lower().split())


def brute(rows):
    said = {}
    for c, t, _, x in rows:
        for line in re.split("\r?\n", x or ""):
            lv, s = split(line)
            if s and lv == 0 and c is not None and t is not None:
                said[c, s] = min(t, said.get((c, s), t))
    parent = {}
    for c, t, _, x in rows:
        votes = {}
        for line in re.split("\r?\n", x or ""):
            lv, s = split(line)
            o = said.get((c, s))
            if lv and s and o is not None and t is not None and o < t:
                votes[lv, o] = votes.get((lv, o), 0) + len(s)
        if votes:
            best = max(votes, key=lambda k: (-k[0], votes[k], k[1]))[1]
            parent[c, t] = min(best, parent.get((c, t), best))
    out = []
    for c, t, role, x in rows:
        top, depth = t, 0
        while (c, top) in parent:
            top, depth = parent[c, top], depth + 1
        lines = re.split("\r?\n", x or "")
        own = [a for i, a in enumerate(lines) if not split(a)[0] and not (a.rstrip(" ").endswith("wrote:") and i + 1 < len(lines) and split(lines[i + 1])[0])]
        out.append((c, t, role, top, depth, "\n".join(own).strip("\n")))
    return sorted(out, key=str)


def fixture():
    r = random.Random(6)
    rows = []
    for c in range(30):
        said = []
        for t in range(r.randrange(1, 20)):
            text = []
            if said and r.random() < 0.7:
                old = r.choice(said)
                text.append("On Monday A wrote:" if r.random() < 0.5 else "hm")
                for line in old[: r.randrange(1, 4)]:
                    text.append(("> " if r.random() < 0.8 else ">> ") + line.upper() + "  ")
                text.append("> never said" if r.random() < 0.2 else "")
            mine = [f"c{c} t{t} line {k}" if r.random() < 0.8 else "thanks" for k in range(r.randrange(0, 4))]
            said.append([x for x in mine] or ["thanks"])
            rows.append((c, t, r.choice(["user", "assistant"]), "\n".join(text + mine)))
    chain = [(99, t, "user", (f"> says {t - 1}\r\n" if t else "") + f"says {t}") for t in range(70)]
    return rows + chain + [(5, 3, "user", None), (None, 1, "user", "> x"), (7, None, "user", "a\n> b"), (8, 0, "user", ""), chain[9]]


def test_equals_plain_walk(spark):
    rows = fixture()
    df = spark.createDataFrame([(*x, 1, i) for i, x in enumerate(rows)], "conv_id long, turn long, role string, text string, depth int, top int").repartition(3)
    out = quotes.threaded(df)
    assert out.columns == ["conv_id", "turn", "role", "top", "thread_turn", "depth", "parent_turn", "content", "n_quoted", "n_linked"]
    got = sorted(((x.conv_id, x.turn, x.role, x.thread_turn, x.depth, x.content) for x in out.collect()), key=str)
    # rows of one (conv_id, turn) share its thread: their own row decides only the parent they show
    assert got == brute(rows)
    assert max(x[4] for x in got) == 69


def test_empty(spark):
    assert quotes.threaded(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
