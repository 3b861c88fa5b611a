"""Rows with missing values stay, results do not depend on partitioning, staging is shared."""

import json
from types import SimpleNamespace

import numpy as np
import pytest

from emberlog import session
from emberlog.operators import lof, triage
from emberlog.operators.features import build_features, timed_event_rate
from emberlog.sources.event_table import mark_false_positives


def test_missing_address_is_a_key(spark):
    rows = [(i, None, None if i % 2 else "10.0.0.1", "HIGH", "m", "r", "syslog") for i in range(6)]
    events = spark.createDataFrame(
        rows, "seq long, timestamp string, source_ip string, severity string, message string, raw string, format string"
    )
    got = build_features(events).collect()
    assert len(got) == 6 and {r.ip_event_count for r in got} == {3}


def test_missing_time_keeps_its_row(spark):
    rows = [(1, "a", "2026-01-01 00:00:00"), (2, "a", None), (3, None, "2026-01-01 00:00:00"), (4, None, None)]
    events = spark.createDataFrame(rows, "id long, source_ip string, t string").selectExpr(
        "id", "source_ip", "cast(t as timestamp) as event_ts"
    )
    assert dict(timed_event_rate(events).select("id", "timed_event_rate").collect()) == {1: 1, 2: None, 3: 1, 4: None}


def test_outlier_factor_does_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.integers(0, 6, 3))) for i in range(1500)]
    found = []
    for parts in (2, 7):
        frame = spark.createDataFrame(rows, "seq long, a double, b double, c double").repartition(parts)
        out = lof.local_outlier_factor(frame, ["a", "b", "c"])
        found.append([(r.seq, round(r.lof_raw, 9)) for r in out.orderBy("seq").collect()])
    assert found[0] == found[1]


def test_nearest_breaks_ties_by_column():
    index, near = lof._nearest(np.array([[1.0, 0.0, 1.0, 1.0, 2.0], [3.0, 3.0, 3.0, 3.0, 3.0]]), 3)
    assert index.tolist() == [[1, 0, 2], [0, 1, 2]] and near.tolist() == [[0.0, 1.0, 1.0], [3.0] * 3]


def test_answers_field_by_field(spark):
    answers = [
        '{"threat_type":"A"} {"threat_type":"B"}',
        json.dumps({"threat_type": "A", "recommendations": "block it", "false_positive_probability": "0.5"}),
        json.dumps({"threat_type": "A", "recommendations": ["x", "y"], "false_positive_probability": "often"}),
    ]
    frame = spark.createDataFrame(list(enumerate(answers)), "id int, answer string")
    got = {r.id: r for r in triage.ingest_answers(frame).collect()}
    assert got[0].answer_source == "model-text"
    assert (got[1].answer_source, got[1].recommendations, got[1].false_positive_probability) == ("model-json", ["block it"], 0.5)
    assert (got[2].recommendations, got[2].false_positive_probability) == (["x", "y"], None)


def test_marks_of_known_and_unknown_events(spark, tmp_path):
    events = spark.range(1, 50)
    marks = spark.createDataFrame([(3, "r"), (3, None), (99, "x")], "event_id long, reason string")
    got = mark_false_positives(marks, events, str(tmp_path / "marks")).collect()
    assert sorted((r.event_id, r.found) for r in got) == [(3, True), (3, True), (99, False)]


def test_staging_needs_a_shared_folder():
    def fake(master, **conf):
        checkpoint = SimpleNamespace(isDefined=lambda: False)
        sc = SimpleNamespace(getCheckpointDir=lambda: checkpoint)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: sc))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)

    here, there = {"spark.sql.warehouse.dir": "file:/w"}, {"spark.sql.warehouse.dir": "hdfs://n/w"}
    assert session.staging_dir(fake("local[2]", **here)) == "file:/w/emberlog-stage"
    assert session.staging_dir(fake("yarn", **there)) == "hdfs://n/w/emberlog-stage"
    assert session.staging_dir(fake("yarn", **{**here, "spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    with pytest.raises(ValueError):
        session.staging_dir(fake("yarn", **here))
