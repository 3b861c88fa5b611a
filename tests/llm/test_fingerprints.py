"""Bottom-k sketches and edited documents against plain Python."""

import hashlib
import os

import brute
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from emberlog.llm import fingerprints

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
#: More than any document has shingles: likeness is exact.
ALL = 100_000


def _check(frame, k=ALL, error=1e-12):
    ties = F.struct(*[F.xxhash64(F.lit(i), F.coalesce("text", F.lit(""))) for i in (1, 2)])
    rows = [(r.doc_id, r.text, tuple(r.tie)) for r in frame.select("doc_id", "text", ties.alias("tie")).collect()]
    want = brute.edits(rows)
    got = fingerprints.edited_likeness(frame, k).collect()
    expected = sorted(
        str((d, len(t or ""), hashlib.sha256(want[d, t or ""][0].encode()).hexdigest())) for d, t, _ in rows
    )
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == expected
    if k == ALL:
        likeness = {}
        for (d, t), (edited, after) in want.items():
            a, b, c = (brute.word_shingles(x) for x in (t, edited, after))
            key = (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
            likeness[key] = (brute.jaccard(a, b), brute.jaccard(a, c), len(a & b) / len(a) if a else 1.0, len(a))
        for r in got:
            values = (r.near_edited, r.near_next, r.kept_share, r.distinct_shingles)
            assert values == pytest.approx(likeness[r.doc_id, r.n_chars, r.edited_sha256], abs=error)
    return rows, got


def test_documents(docs):
    _check(docs)


def test_estimates_are_near(docs):
    exact = {r.doc_id: r for r in fingerprints.edited_likeness(docs, ALL).collect()}
    near = {r.doc_id: r for r in fingerprints.edited_likeness(docs).collect()}
    off = [abs(exact[d].near_edited - near[d].near_edited) for d in exact]
    assert sum(off) / len(off) < 0.03 and max(off) < 0.2
    size = [abs(near[d].distinct_shingles / exact[d].distinct_shingles - 1) for d in exact if exact[d].distinct_shingles]
    assert sum(size) / len(size) < 0.08


def test_edges(edge, no_rows):
    rows, got = _check(edge)
    assert len(got) == len(rows)
    fingerprint = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r, t in [(r, t) for r in got for d, t, _ in rows if d == r.doc_id and len(t or "") == r.n_chars]:
        assert fingerprint.setdefault(t or "", r.fingerprint) == r.fingerprint
    assert fingerprints.edited_likeness(no_rows).count() == 0


def test_one_row_and_many_blocks(spark, docs):
    _check(docs.limit(1))
    _check(spark.createDataFrame([(7, "a b c d")] * 5, "doc_id bigint, text string"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        _check(docs)
        hot = docs.select(F.when(F.col("doc_id") % 3 == 0, F.lit(5)).otherwise(F.col("doc_id")).alias("doc_id"), "text")
        _check(hot.withColumn("text", F.when(F.col("doc_id") == 5, F.lit("one text " * 9)).otherwise(F.col("text"))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_merge_to_the_whole(spark):
    left = " ".join(f"w{i}" for i in range(300))
    right = " ".join(f"w{i}" for i in range(200, 600))
    frame = spark.createDataFrame([(left, right)], "a string, b string")
    a, b = (fingerprints.sketch(F.col(c), 64) for c in "ab")
    parts, merged, inside = frame.select(
        F.slice(F.array_distinct(F.sort_array(F.concat(fingerprints.shingle_hashes(F.col("a")), fingerprints.shingle_hashes(F.col("b"))))), 1, 64),
        fingerprints.merge(a, b, 64), fingerprints.containment(a, a, 64),
    ).first()
    assert parts == merged and inside == 1.0
