"""The Jaccard join against a brute-force join."""

import os

import brute
import numpy as np
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import near_join
from emberlog.llm.components import components

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def _classes(frame, texts, width, percent):
    roots, sizes = brute.linked([t for _, t in texts], width, percent)
    names = {}
    for (doc, _), root in zip(texts, roots, strict=True):
        if doc is not None:
            names[root] = min(doc, names.get(root, doc))
    want = [
        (d, n, d if n == 0 else names.get(r)) for (d, _), n, r in zip(texts, sizes, roots, strict=True)
    ]
    got = near_join.near_classes(frame, width, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_classes(docs, rows, width, percent):
    _classes(docs, rows, width, percent)


def test_edges(spark, edge, no_rows):
    _classes(edge, [(r.doc_id, r.text) for r in edge.collect()], 3, 90)
    assert near_join.near_classes(no_rows).count() == 0
    kept = near_join.one_of_each_group(edge)
    assert kept.columns == edge.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, None]))
    assert near_join.one_of_each_group(no_rows).count() == 0


def test_copies_with_edits(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        base = [f"w{x}" for x in np.random.default_rng(i % 6).integers(0, 400, 5 + 40 * (i % 6))]
        for _ in range(int(rng.integers(0, 4))):
            base[int(rng.integers(0, len(base)))] = f"new{i}"
        rows.append((i, " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    _classes(frame, rows, 3, 90)
    _classes(frame, rows, 5, 80)


@given(st.integers(1, 3000), st.integers(0, 400), st.sampled_from([80, 90]), st.integers(0, 2**32))
@settings(max_examples=200, deadline=None)
def test_linked_sets_share_a_word(common, apart, percent, seed):
    rng = np.random.default_rng(seed)
    values = np.unique(rng.integers(0, 2**64, common + apart, np.uint64))
    cut = rng.integers(0, apart + 1)
    one, two = np.sort(np.delete(values, slice(0, cut))), np.sort(np.delete(values, slice(cut, apart)))
    both = len(np.intersect1d(one, two))
    if both and 100 * both >= percent * (len(one) + len(two) - both):
        starts = near_join.band_starts(percent)
        assert len(np.intersect1d(near_join.sketch_keys(one, percent, starts), near_join.sketch_keys(two, percent, starts)))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 7), (7, 8), *[(100 + i, 101 + i) for i in range(40)], (50, 50)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(1, 6), 1), 7: 7, 8: 7, 9: 7, **dict.fromkeys(range(100, 141), 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_an_empty_word_can_be_the_only_equal_one():
    import numpy as np

    from emberlog.llm import near_join

    count, starts = 14, near_join.band_starts(80)
    shingles = [np.uint64((((k % 13) * 2**32 // count + 1 + k) << 32) + k) for k in range(65)]
    common, only = shingles[:52], shingles[52:]
    left, right = (np.sort(np.array(common + part, np.uint64)) for part in (only[:7], only[7:]))
    assert set(near_join.sketch_keys(left, 80, starts)) & set(near_join.sketch_keys(right, 80, starts))


def test_turns_share_out_the_sketch_words():
    import pyarrow as pa

    texts = [" ".join(f"w{(i * k) % 97}" for k in range(40 + i)) for i in range(60)]
    nodes = [(-1) ** i * (i // 2 + 1) * 7919 for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts)], names=["node", "text"])

    def rows(*turn):
        out = near_join._sketches(5, 80, *turn)(iter([batch]))
        return [tuple(r.values()) for b in out for r in b.to_pylist()]

    whole, halves = rows(), [rows(t, 2) for t in range(2)]
    assert sorted(halves[0] + halves[1]) == sorted(whole)
    assert all(0.4 < len(h) / len(whole) < 0.6 for h in halves)
    assert not {r[1] for r in halves[0]} & {r[1] for r in halves[1]}


def test_disk_is_given_back(spark, docs):
    import glob
    import time

    from emberlog.session import stage, staging_dir

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before, old = shuffled(), set(glob.glob(f"{staging_dir(spark)}/*"))
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(setting, "false")
    try:
        dealt = stage(docs.repartition(3, "doc_id"), "dealt")
        assert spark.conf.get(setting) == "false"
    finally:
        spark.conf.unset(setting)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert dealt.count() == docs.count()
    near_join.near_classes(docs, 5, 80).count()
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{staging_dir(spark)}/*")) - old}
    assert not left & {"sketch-words", "buckets", "candidate-texts", "pairs", "rooted", "open-buckets"}
    assert "document-classes" in left
