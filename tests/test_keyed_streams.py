"""Per-address state on streams, and models published between batches."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators.forest import fit_and_score
from emberlog.session import new_stage_path
from emberlog.sources.models import latest_version, publish_forest
from emberlog.streaming import feed, keyed

SCHEMA = "seq long, event_ts timestamp, source_ip string, severity string, tactic string"


def _stream(spark, triggers):
    """One trigger per list of (seq, seconds, address, severity, tactic)."""
    path = new_stage_path(spark, "given")
    for rows in triggers:
        frame = spark.createDataFrame(rows, "seq long, s long, source_ip string, severity string, tactic string")
        frame.select("seq", F.timestamp_seconds("s").alias("event_ts"), "source_ip", "severity", "tactic").coalesce(1).write.mode("append").parquet(path)
    return feed.table_stream(spark, path, spark.read.parquet(path).schema, max_files=1)


def _drain(stream, name):
    with keyed.keyed_state(stream.sparkSession):
        return [tuple(r) for r in feed.run_once(stream, name).collect()]


def test_address_features_over_triggers(spark):
    triggers = [
        [(2, 200, "a", "HIGH", None), (0, 100, "a", "LOW", None), (1, 150, None, None, None)],
        [(4, 250, "a", "CRITICAL", None), (3, 90, "b", "LOW", None), (30, None, None, "HIGH", None)],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = sorted(_drain(keyed.stream_features(_stream(spark, triggers)), "features"))
    assert got == [
        (0, "a", 1, 0.0, 0), (1, None, 1, 0.0, 0), (2, "a", 2, 0.5, 1), (3, "b", 1, 0.0, 0), (4, "a", 3, 0.6667, 2), (30, None, 2, 0.5, 0),
    ]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_idle_addresses_are_forgotten(spark):
    hour = 3600
    triggers = [[(0, hour, "a", "LOW", None)], [(1, 9 * hour, "b", "LOW", None)], [(2, 10 * hour, "b", "LOW", None)], [(3, 11 * hour, "a", "LOW", None)]]
    got = sorted(_drain(keyed.stream_features(_stream(spark, triggers), idle_hours=2), "idle"))
    assert [(r[0], r[2]) for r in got] == [(0, 1), (1, 1), (2, 2), (3, 1)]


def test_chains_in_order(spark):
    day = 86_400
    triggers = [
        [(1, 500, "a", "LOW", "Initial Access"), (0, 400, "a", "LOW", "Discovery"), (2, 100, "b", "LOW", "Initial Access"), (3, 300, "c", "LOW", "Discovery"),
         (9, 300, "unknown", "LOW", "Discovery"), (10, 301, "unknown", "LOW", "Initial Access")],
        [(4, 600, "b", "LOW", "Discovery"), (5, 300 + 2 * day, "c", "LOW", "Initial Access"), (6, 700, "a", "LOW", "Execution"), (7, 800, "a", "LOW", None)],
        [(8, 700 + day // 2, "a", "LOW", "Command and Control")],
    ]
    got = _drain(keyed.ordered_chain_stream(_stream(spark, triggers), delay="5 days"), "chains")
    assert sorted(r[:2] + r[3:] for r in got) == [
        ("a", "Full Intrusion Kill Chain", 500_000_000, (700 + day // 2) * 1_000_000, 8),
        ("a", "Recon to Exploit", 400_000_000, 500_000_000, 1),
    ]


def test_model_is_swapped_between_batches(spark):
    frame = spark.range(300).select(F.col("id").alias("seq"), (F.col("id") % 17).cast("double").alias("x"), F.sin("id").alias("y"))
    root, rows, shown, checkpoint = (new_stage_path(spark, n) for n in ("models", "rows", "shown", "checkpoint"))
    assert latest_version(spark, root) is None
    step = feed.scored_batches(root, shown)
    with pytest.raises(FileNotFoundError):
        step(frame, 0)
    wanted = {}
    for version, seed in ((1, 1), (2, 2)):
        scored, model = fit_and_score(frame, ["x", "y"], seed=seed, trees=20)
        assert publish_forest(spark, model, root) == version
        part = F.col("seq") % 2 == version - 1
        wanted |= {r.seq: (r.if_score, r.if_flag, version) for r in scored.filter(part).collect()}
        frame.filter(part).write.mode("append").parquet(rows)
        feed.start_batches(feed.table_stream(spark, rows, frame.schema), step, checkpoint, once=True).awaitTermination()
    got = spark.read.parquet(shown).collect()
    assert {r.seq: (r.anomaly_score, r.is_anomaly, r.model_version) for r in got} == wanted and len(got) == 300
