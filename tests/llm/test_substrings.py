"""Removal of repeated strings against brute force."""

import os

import brute
import numpy as np
import pytest
from conftest import SF_DIR

from emberlog.llm import substrings

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def _same(frame, rows):
    want = brute.repeats([t for _, t in rows])
    got = substrings.repeat_report(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, *w)) for (d, _), w in zip(rows, want, strict=True))
    passages = substrings.repeat_report(frame).select("doc_id", "n_passages").collect()
    long, short = (brute.passage_words([t for _, t in rows], n) for n in (substrings.PASSAGE, substrings.SHARED))
    ids = [d for d, _ in rows]
    if len(set(ids)) == len(ids):
        seen = {r.doc_id: r.n_passages for r in passages}
        assert all(seen[d] > 0 for d, n in zip(ids, long, strict=True) if n)
        assert not any(seen[d] for d, n in zip(ids, short, strict=True) if not n)


def test_documents(docs, rows):
    _same(docs, rows)


def test_edges(edge, no_rows):
    _same(edge, [(r.doc_id, r.text) for r in edge.collect()])
    assert substrings.repeat_report(no_rows).count() == 0


def test_copied_passages(spark):
    rng = np.random.default_rng(5)
    pool = ["".join(chr(x) for x in rng.integers(97, 122, n)) for n in (399, 400, 401, 450, 527, 528, 700, 1500, 4000)]
    pool += ["é" * 150 + "ab" * 60, "x" * 500, "abc" * 300, "x" * 399]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(int(rng.integers(0, 4))):
            text = pool[int(rng.integers(0, len(pool)))]
            cut = sorted(rng.integers(0, len(text) + 1, 2)) if rng.random() < 0.6 else (0, len(text))
            parts += [text[cut[0] : cut[1]], "".join(chr(x) for x in rng.integers(97, 122, int(rng.integers(0, 300))))]
        rows.append((i, "".join(parts)))
    _same(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), rows)


def test_copied_word_passages(spark):
    rng = np.random.default_rng(8)
    pool = [[f"{chr(97 + int(x) % 26)}{int(x)}" for x in rng.integers(0, 400, n)] for n in (49, 50, 51, 60, 84, 85, 86, 130, 400)]
    pool += [["x"] * 120, ["a", "b"] * 60, ["same"] * 49]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(int(rng.integers(0, 4))):
            passage = pool[int(rng.integers(0, len(pool)))]
            cut = sorted(rng.integers(0, len(passage) + 1, 2)) if rng.random() < 0.6 else (0, len(passage))
            parts += [*passage[cut[0] : cut[1]], *[f"own{int(x)}" for x in rng.integers(0, 10**6, int(rng.integers(0, 40)))]]
        rows.append((i, [" ", "\n", "\x0b "][i % 3].join(parts)))
    _same(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), rows)
