"""The stages after the classifier equal brute force on what it kept; every stage keeps the columns."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from dayloom.llm import decontamination, line_dedup  # noqa: E402
from dayloom.llm.corpus import written  # noqa: E402
from test_jaccard_join import brute  # noqa: E402


def nearest_part(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of the item to any part of the text."""
    dist, ramp = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for j, x in enumerate(item, 1):
        step = np.concatenate([[j], np.minimum(dist[:-1] + (text != x), dist[1:] + 1)])
        dist = np.minimum.accumulate(step - ramp) + ramp
    return int(dist.min())


def test_stages_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = written(P.STAGES[0][1](spark, docs, small), "first")
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    out = first
    for name, stage in P.STAGES[1:]:
        out = written(stage(spark, out, small), name)
        assert out.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: (r.text, r.n_tokens, r.ids, r.n_chars) for r in out.collect()}

    con = duckdb.connect()
    con.register("documents", first.toArrow())
    cleaned = [(i, t) for i, _, _, t in con.execute(line_dedup.SQL).fetchall()]
    kept = {i for i, n, c in brute(cleaned) if n == 0 or i == c}
    texts = dict(cleaned)
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    split = lambda t: decontamination.normalised(pa.array([t], pa.string()))[0]
    bench = [split(b.text) for b in items]
    clean = set()
    for i in kept:
        words = split(texts[i])
        if all(nearest_part(b, words) > decontamination.allowed(len(b)) for b in bench if len(b) >= decontamination.MIN_WORDS):
            clean.add(i)
    assert got.keys() == clean and len(clean) < len(kept)
    peer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    peer.no_truncation()
    for i, (text, n, ids, chars) in got.items():
        assert text == texts[i] and chars == len(text)
        assert ids == peer.encode(text, add_special_tokens=False).ids and n == len(ids)


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, small).count() == 0
