"""Phrase mining against brute force and SQL."""

import os
import random

import brute
import numpy as np
import pytest
from compare import connect, differences
from conftest import SF_DIR

from emberlog.llm import catalog, collocations

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def _same(frame, rows, **more):
    got = collocations.top_phrases(frame, **more).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute.phrases(rows, **more))


def _texts(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["\u00c9t\u00e9", "A", "a", "x\x1cy", "\U0001f600"]
    fixed = ["one two three four five six", "New York", "a a a a a a a"]
    out = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary[: 3 + i % 60]) for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", "!"]) for p in parts)
        out.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text, text, text, None, ""])))
    return out


def test_equals_sql(spark):
    name = "op11_pair_tiles"
    assert differences(catalog.QUERIES[name](spark, SF_DIR), connect(SF_DIR), catalog.SQL[name]) == ""


@pytest.mark.parametrize("slices", [1 << 20, 7])
def test_random_texts(spark, monkeypatch, slices):
    """With a slice of 7 ids, words and pairs take several passes."""
    monkeypatch.setattr(collocations, "SLICE", slices)
    monkeypatch.setattr(collocations, "CHUNK", 500)
    monkeypatch.setattr(collocations, "PAIRS", 1000)
    monkeypatch.setattr(collocations, "WORDS", 50)
    rows = _texts(1)
    frame = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "lang string, text string, word string, ids string, n int")
    _same(frame.repartition(3), rows)


def test_few_are_asked_for(spark):
    rows = _texts(2)
    _same(spark.createDataFrame(rows, "lang string, text string"), rows, top=3)


def test_edges(edge, no_rows, spark):
    _same(edge, [(r.lang, r.text) for r in edge.collect()])
    assert collocations.top_phrases(no_rows).count() == 0
    long = [(None, "the cat sat " * 40_000), (None, None)]
    _same(spark.createDataFrame(long, "lang string, text string"), long)


def test_tiles_dense_and_sparse(monkeypatch):
    monkeypatch.setattr(collocations, "TILE", 8)
    monkeypatch.setattr(collocations, "DENSE", 40)
    rng = np.random.default_rng(1)
    left, right = (rng.geometric(0.05, 3000).astype(np.int64) for _ in range(2))
    got = {(int(p), int(q)): int(n) for p, q, n in zip(*collocations.tile_counts(left, right), strict=True)}
    assert got == dict(brute.Counter(zip(left.tolist(), right.tolist(), strict=True)))


def test_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**15, 9 * 10**16, 10**15 + 1, 10**15 + 3)], "a long, n long, l long, r long")
    cut = collocations._cut_scores(2, row.a, row.n, collocations.F.array("l"), collocations.F.array("r"))
    assert row.select(cut.score).first()[0] == 1000 * 10**15 * 9 * 10**16 // ((10**15 + 1) * (10**15 + 3))


def test_pairs_are_sent_in_small_batches(monkeypatch):
    monkeypatch.setattr(collocations, "SENT", 100)
    ids = np.arange(1_000, dtype="<i4")
    rows = collocations._ids_frame([ids, ids])
    counted = list(collocations._pair_counts(iter([rows])))
    assert max(batch.num_rows for batch in counted) <= 100
    got = {(p, q): n for batch in counted for p, q, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    assert got.pop((999, 0)) == 1 and got == {(i, i + 1): 2 for i in range(999)}
