import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators.detect import compare_methods, evaluate, iqr_detector, zscore_detector
from emberlog.operators.features import build_features, ml_columns, rolling_event_rate, timed_event_rate
from emberlog.operators.quantiles import exact_quantiles
from emberlog.schema import FEATURE_COLUMNS

EVENTS = [
    (0, "Jan 15 08:00:00", "HIGH", "195.178.55.22", "Failed password for invalid user admin", "", "syslog"),
    (1, "Jan 15 08:00:01", "HIGH", "195.178.55.22", "Failed password for root", "", "syslog"),
    (2, "Jan 15 08:00:02", "CRITICAL", "10.0.0.55", "LSASS memory read detected mimikatz", "", "json"),
    (3, "Jan 15 08:00:03", "INFO", "10.0.0.10", "User logged in successfully", "", "syslog"),
]
LAYOUT = "seq long, timestamp string, severity string, source_ip string, message string, raw string, format string"


def test_feature_frame(spark):
    frame = build_features(spark.createDataFrame(EVENTS, LAYOUT))
    rows = {r.seq: r for r in frame.collect()}
    assert len(rows) == 4 and len(frame.columns) >= 14
    assert ml_columns(frame) == FEATURE_COLUMNS
    assert rows[0].ip_fail_rate == 1.0 and rows[0].ip_event_count == 2
    assert (rows[0].rolling_event_rate, rows[1].rolling_event_rate) == (0, 1)
    assert (rows[0].hour_of_day, rows[0].has_auth_failure, rows[0].ip_is_external) == (8, 1, 1)
    assert rows[3].ip_fail_rate == 0.0


def test_empty_input_gives_an_empty_typed_frame(spark):
    frame = build_features(spark.createDataFrame([], LAYOUT))
    assert frame.count() == 0 and set(FEATURE_COLUMNS) <= set(frame.columns)


@pytest.mark.parametrize("block", [25, 64, 100_000])
def test_rolling_rate_equals_the_literal_loop(spark, block):
    rng = random.Random(block)
    ips = [rng.choice("aaabc") for _ in range(300)]
    expected = [sum(1 for j in range(max(0, i - 20), i) if ips[j] == ip) for i, ip in enumerate(ips)]
    rows = spark.createDataFrame(list(enumerate(ips)), "seq long, source_ip string")
    got = [r.rolling_event_rate for r in rolling_event_rate(rows, block=block).orderBy("seq").collect()]
    assert got == expected


def test_timed_rate_crosses_hours(spark):
    seconds = [3590, 3595, 3600, 3649, 3650, 3651, 7200]
    rows = spark.createDataFrame([(i, "a", s) for i, s in enumerate(seconds)], "seq long, source_ip string, s long")
    rows = rows.withColumn("event_ts", F.timestamp_seconds("s"))
    got = [r.timed_event_rate for r in timed_event_rate(rows).orderBy("seq").collect()]
    assert got == [sum(1 for t in seconds if s - 60 <= t <= s) for s in seconds]


def test_detectors_skip_constant_columns_and_small_frames(spark):
    one = spark.createDataFrame([(0, 1.0, 2.0)], "seq long, a double, b double")
    assert zscore_detector(one, ["a", "b"]).first().max_zscore == 0.0
    rows = spark.createDataFrame([(i, float(i % 3), 5.0) for i in range(50)] + [(50, 99.0, 5.0)], "seq long, a double, b double")
    flagged = iqr_detector(zscore_detector(rows, ["a", "b"]), ["a", "b"])
    assert [r.seq for r in flagged.filter("anomaly_iqr").collect()] == [50]
    assert [r.seq for r in flagged.filter("anomaly_zscore").collect()] == [50]
    assert iqr_detector(rows, ["b"]).filter("anomaly_iqr").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 25_000])
def test_quantiles_equal_the_built_in(spark, n):
    rng = random.Random(n)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), rng.choice([None, 1.0, 1.0, rng.random()])) for _ in range(n)]
    frame = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.feature, r.prob): r.quantile for r in exact_quantiles(frame, ["a", "b", "c"], probs).collect()}
    want = frame.agg(*[F.percentile(c, probs).alias(c) for c in "abc"]).first()
    for c in "abc":
        if want[c] is not None:
            assert [got[(c, p)] for p in probs] == pytest.approx(want[c], abs=1e-12)


def test_evaluation_is_safe_on_empty_cells(spark):
    rows = spark.createDataFrame([(0, False, 0)], "seq long, is_anomaly boolean, severity_score int")
    row = evaluate(rows).first()
    assert (row.precision, row.recall, row.f1_score, row.fp_rate) == (0.0, 0.0, 0.0, 0.0)
    assert compare_methods(rows, {"m": "is_anomaly"}).first().flagged == 0


def test_quantiles_narrow_their_brackets_until_few_values_are_ordered(spark):
    """Ties at the edges, heavy tails and one repeated value, with brackets far below the row count."""
    values = [0.0] * 3000 + [float(2 ** (i % 900)) for i in range(4000)] + [1.5 + i / 7 for i in range(3000)] + [7.0] * 2000
    frame = spark.createDataFrame([(v, 5.0, None) for v in values], "a double, b double, c double").repartition(5)
    probs = [0.0, 0.25, 0.3, 0.5, 0.83, 0.95, 1.0]
    got = {(r.feature, r.prob): r.quantile for r in exact_quantiles(frame, ["a", "b", "c"], probs, hold=8).collect()}
    for prob in probs:
        assert got["a", prob] == np.quantile(values, prob)
        assert got["b", prob] == 5.0
    assert not [key for key in got if key[0] == "c"]
