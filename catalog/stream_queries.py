"""Streams drained over the data derived from the given tables, checked against batch SQL."""

from pyspark.sql import functions as F

from catalog import base
from catalog.correlation_queries import (
    _ALERTS, _CHAINS, _MICROS, DAY_SESSIONS, SESSION_CHAINS, SESSIONS, _components, _flat_chains, _micros,
)
from catalog.duck_base import over, py_round
from catalog.duck_models import forest as forest_sql
from catalog.registry import query
from emberlog.session import new_stage_path, stage
from emberlog.sources.event_table import mark_false_positives, read_feedback
from emberlog.constants.kill_chains import KILL_CHAINS, UNLINKED_ADDRESSES
from emberlog.operators.forest import fit_and_score
from emberlog.schema import FEATURE_COLUMNS
from emberlog.sources.models import publish_forest
from emberlog.streaming import feed, keyed


def _table(spark, sf):
    """The event table as a stream, several files, with a timestamp the watermark accepts."""
    path = new_stage_path(spark, "stream-events")
    rows = base.stored_events(spark, sf).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    rows.write.parquet(path)
    return feed.table_stream(spark, path, rows.schema)


@query("stream_event_feed", over(
    "tagged", "SELECT timestamp, severity, source_ip, message, format, technique_id, tactic FROM tagged"
))
def stream_event_feed(spark, sf):
    path = new_stage_path(spark, "stream-lines")
    base.lines(spark, sf).select(F.col("line").alias("value")).write.text(path)
    rows = feed.run_once(feed.event_feed(feed.line_stream(spark, path)), "feed")
    return rows.select("timestamp", "severity", "source_ip", "message", "format", "technique_id", "tactic")


@query("stream_critical_alerts", over("events", "SELECT id, source_ip, message FROM ev WHERE severity = 'CRITICAL'"))
def stream_critical_alerts(spark, sf):
    alerts = feed.critical_alerts(_table(spark, sf)).select("id", "source_ip", "message")
    return feed.run_once(alerts, "alerts")


@query("stream_metrics", over("events", """
    SELECT count(*) AS total_events, count(*) FILTER (is_anomaly) AS total_anomalies,
      count(*) FILTER (is_false_positive) AS false_positives_blocked, count(*) FILTER (severity = 'CRITICAL') AS critical_events, count(*) FILTER (severity = 'HIGH') AS high_events,
      count(technique_id) AS mitre_tagged, round(count(technique_id) * 100.0 / count(*), 1) AS mitre_tag_rate,
      round(coalesce(avg(anomaly_score) FILTER (is_anomaly), 0), 3) AS avg_anomaly_score,
      (SELECT source_ip FROM ev GROUP BY source_ip ORDER BY count(*) DESC, source_ip LIMIT 1) AS top_attacker_ip,
      (SELECT technique_id FROM ev WHERE technique_id IS NOT NULL GROUP BY technique_id ORDER BY count(*) DESC, technique_id LIMIT 1) AS top_technique
    FROM ev"""))
def stream_metrics(spark, sf):
    """Totals folded over several batches, with the marks of existing events."""
    totals, marks = new_stage_path(spark, "metric-totals"), new_stage_path(spark, "feedback-table")
    path = new_stage_path(spark, "stream-events")
    rows = base.stored_events(spark, sf)
    rows.repartition(3).write.parquet(path)
    feed.start_batches(
        feed.table_stream(spark, path, rows.schema, max_files=1), feed.running_metrics(totals),
        new_stage_path(spark, "metric-checkpoint"), once=True,
    ).awaitTermination()
    mark_false_positives(base.feedback(spark, sf), rows, marks)
    return feed.merged_metrics(spark.read.parquet(totals), read_feedback(spark, marks))


@query("stream_kill_chains", over(
    "events", _ALERTS, "newest AS MATERIALIZED (SELECT * FROM ev ORDER BY id DESC LIMIT 100)", _components("newest"),
    _CHAINS, recursive=True,
))
def stream_kill_chains(spark, sf):
    newest, alerts = new_stage_path(spark, "newest"), new_stage_path(spark, "chain-alerts")
    feed.start_batches(
        _table(spark, sf), feed.running_kill_chains(newest, alerts), new_stage_path(spark, "chain-checkpoint"), once=True
    ).awaitTermination()
    batches = spark.read.parquet(alerts)
    last = batches.agg(F.max("batch_id")).scalar()
    return _flat_chains(batches.filter(F.col("batch_id") == last).drop("batch_id"))


def _window_sql(slide: int) -> str:
    starts = f"generate_series(0, {60 // slide - 1})"
    return (
        f"SELECT CAST((epoch_us(event_ts) // 1000000 // {slide} - k) * {slide} AS BIGINT) AS window_start, source_ip, count(*) AS n_events "
        f"FROM (SELECT *, unnest({starts}) AS k FROM ev) GROUP BY ALL"
    )


def _windows(stream, name):
    rows = feed.run_once(stream, name, "complete")
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "source_ip", "n_events")


@query("stream_address_rate", over("events", _window_sql(60)))
def stream_address_rate(spark, sf):
    return _windows(feed.windowed_rate(_table(spark, sf)), "rates")


@query("stream_sliding_rate", over("events", _window_sql(10)))
def stream_sliding_rate(spark, sf):
    return _windows(feed.windowed_rate(_table(spark, sf), slide="10 seconds"), "sliding-rates")


@query("stream_sessions", over(
    "events", f"SELECT source_ip, {_MICROS}, event_count, array_to_string(tactics, ',') AS tactics FROM sessions", SESSIONS
))
def stream_sessions(spark, sf):
    rows = feed.run_once(feed.session_stream(_table(spark, sf)), "sessions", "complete")
    return _micros(rows, "event_count", F.array_join("tactics", ",").alias("tactics"))


@query("stream_session_chains", over("events", SESSION_CHAINS, SESSIONS, _CHAINS))
def stream_session_chains(spark, sf):
    rows = feed.run_once(feed.session_chain_stream(_table(spark, sf)), "session-chains", "complete")
    return _micros(
        rows, "event_count", "chain_name", "severity", "match_percent",
        F.array_join("tactics_found", ",").alias("tactics_found"),
    )


@query("stream_session_chains_of_days", over("events", SESSION_CHAINS, DAY_SESSIONS, _CHAINS))
def stream_session_chains_of_days(spark, sf):
    stream = feed.session_chain_stream(_table(spark, sf), gap_minutes=1440)
    return _micros(
        feed.run_once(stream, "day-session-chains", "complete"), "event_count", "chain_name", "severity", "match_percent",
        F.array_join("tactics_found", ",").alias("tactics_found"),
    )


@query("stream_feedback_overlay", over("events", "SELECT id, severity, is_false_positive FROM ev"))
def stream_feedback_overlay(spark, sf):
    stream = feed.overlay_feedback(_table(spark, sf), base.feedback(spark, sf))
    return feed.run_once(stream.select("id", "severity", "is_false_positive"), "overlay")


# What has closed once all rows are read: the watermark is the latest time in milliseconds less the delay.
_WATERMARK = "(SELECT max(epoch_us(event_ts)) // 1000 * 1000 - 120000000 FROM ev)"


@query("stream_closed_rate", over(
    "events", f"SELECT * FROM ({_window_sql(60)}) WHERE (window_start + 60) * 1000000 <= {_WATERMARK}"
))
def stream_closed_rate(spark, sf):
    """Append mode, as deployed: a window appears once the watermark has passed it."""
    rows = feed.run_once(feed.windowed_rate(_table(spark, sf)), "closed-rates")
    return rows.select(F.unix_seconds("window_start").alias("window_start"), "source_ip", "n_events")


@query("stream_closed_sessions", over(
    "events",
    f"SELECT * FROM (SELECT source_ip, {_MICROS}, event_count, array_to_string(tactics, ',') AS tactics FROM sessions) "
    f"WHERE last_us + 300000000 <= {_WATERMARK}",
    SESSIONS,
))
def stream_closed_sessions(spark, sf):
    rows = feed.run_once(feed.session_stream(_table(spark, sf)), "closed-sessions")
    return _micros(rows, "event_count", F.array_join("tactics", ",").alias("tactics"))


@query("stream_late_marks", over(
    "events",
    "SELECT id, is_false_positive AND id <= (SELECT max(id) // 2 FROM ev) AS is_false_positive FROM ev",
))
def stream_late_marks(spark, sf):
    """Marks that arrive between two batches hold for the second one, here the lower half of the ids."""
    path, marks, shown, checkpoint = (
        new_stage_path(spark, name) for name in ("stream-events", "feedback-table", "overlay", "overlay-checkpoint")
    )
    rows = base.stored_events(spark, sf)
    half = rows.agg(F.floor(F.max("id") / 2)).scalar()
    parts = (rows.filter(F.col("id") > half), rows.filter(F.col("id") <= half))
    step = feed.overlaid_batches(marks, shown)
    for place, part in enumerate(parts):
        part.write.mode("append").parquet(path)
        stream = feed.table_stream(spark, path, rows.schema)
        feed.start_batches(stream, step, checkpoint, once=True).awaitTermination()
        if place == 0:
            mark_false_positives(base.feedback(spark, sf), rows, marks)
    return spark.read.parquet(shown).select("id", "is_false_positive")


PARTS = 3
# Ten years: the given events come in no order of time, and none is to be late.
IDLE = 24 * 3650


def _in_parts(rows, name, order="seq"):
    """A stream of ``PARTS`` triggers: equal shares of the rows in the given order, each share in no order."""
    spark = rows.sparkSession
    path = new_stage_path(spark, name)
    marks = rows.approxQuantile(order, [i / PARTS for i in range(1, PARTS)], 0.0)
    part = sum((F.when(F.col(order) >= mark, 1).otherwise(0) for mark in marks), F.lit(0))
    for i in range(PARTS):
        rows.filter(part == i).orderBy(F.xxhash64(order)).coalesce(1).write.mode("append").parquet(path)
    return feed.table_stream(spark, path, rows.schema, max_files=1)


@query("stream_features", over("parsed", f"""
    SELECT seq, source_ip, count(*) OVER so_far AS ip_event_count,
      {py_round("count(*) FILTER (severity IN ('HIGH','CRITICAL')) OVER so_far / count(*) OVER so_far", 4)} AS ip_fail_rate,
      count(*) OVER (PARTITION BY source_ip ORDER BY seq RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rolling_event_rate
    FROM parsed WINDOW so_far AS (PARTITION BY source_ip ORDER BY seq)"""))
def stream_features(spark, sf):
    """Address features over the events so far, from keyed state over several triggers."""
    events = base.parsed(spark, sf).select("seq", F.col("event_ts").cast("timestamp").alias("event_ts"), "source_ip", "severity")
    stream = _in_parts(stage(events, "parsed"), "stream-parsed")
    with keyed.keyed_state(spark):
        return feed.run_once(keyed.stream_features(stream, idle_hours=IDLE), "stream-features")


_SECOND_SEED = 7
_HALF = "(SELECT count(*) // 2 FROM features)"
_CONFIDENCE = "CASE WHEN if_score > 0.75 THEN 'HIGH' WHEN if_score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END"


@query("stream_scored_events", over(
    "features",
    f"""SELECT k AS seq, if_score AS anomaly_score, if_flag AS is_anomaly, {_CONFIDENCE} AS confidence, 1::BIGINT AS model_version FROM first_model WHERE k < {_HALF}
    UNION ALL SELECT k, if_score, if_flag, {_CONFIDENCE}, 2 FROM second_model WHERE k >= {_HALF}""",
    f"first_model AS MATERIALIZED (WITH {forest_sql('features', 'seq', FEATURE_COLUMNS, 0.1)} SELECT * FROM forest)",
    f"second_model AS MATERIALIZED (WITH {forest_sql('features', 'seq', FEATURE_COLUMNS, 0.1, _SECOND_SEED)} SELECT * FROM forest)",
))
def stream_scored_events(spark, sf):
    """Two triggers, a new model published between them; scores and flags by the range and limit of its training."""
    features = base.features(spark, sf).select("seq", *FEATURE_COLUMNS)
    models, rows, shown, checkpoint = (new_stage_path(spark, n) for n in ("models", "stream-rows", "scored", "scored-checkpoint"))
    half = features.count() // 2
    step = feed.scored_batches(models, shown)
    for part, seed in ((F.col("seq") < half, 42), (F.col("seq") >= half, _SECOND_SEED)):
        publish_forest(spark, fit_and_score(features, FEATURE_COLUMNS, seed=seed)[1], models)
        features.filter(part).write.mode("append").parquet(rows)
        feed.start_batches(feed.table_stream(spark, rows, features.schema), step, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(shown).select("seq", "anomaly_score", "is_anomaly", "confidence", "model_version")


_CHAIN_TABLE = ", ".join(f"({i}, '{c.name.replace(chr(39), chr(39) * 2)}', '{c.severity}', {list(c.tactics)})" for i, c in enumerate(KILL_CHAINS))
_TACTICS = ", ".join(f"'{t}'" for t in sorted({t for c in KILL_CHAINS for t in c.tactics}))
_STEPS = f"""
chain AS (SELECT * FROM (VALUES {_CHAIN_TABLE}) AS t(cid, chain_name, severity, tactics)),
wanted AS MATERIALIZED (SELECT seq, source_ip, tactic, epoch_us(event_ts) AS at_us, row_number() OVER (PARTITION BY source_ip ORDER BY event_ts, seq) AS i
  FROM tagged WHERE tactic IN ({_TACTICS}) AND source_ip IS NOT NULL AND source_ip NOT IN ({", ".join(f"'{a}'" for a in UNLINKED_ADDRESSES)}) AND event_ts IS NOT NULL),
walk AS (
  SELECT source_ip, cid, 0::BIGINT AS i, 0 AS step, 0::BIGINT AS first_us, 0::BIGINT AS last_us, FALSE AS done, 0::BIGINT AS seq
  FROM (SELECT DISTINCT source_ip FROM wanted), chain
  UNION ALL
  SELECT source_ip, cid, i, CASE WHEN hit THEN at_step + 1 ELSE at_step END,
    CASE WHEN (hit AND at_step = 0) OR anew THEN at_us ELSE first_us END, CASE WHEN hit OR anew THEN at_us ELSE last_us END, hit AND at_step + 1 = len(tactics), seq
  FROM (SELECT *, tactic = tactics[at_step + 1] AS hit, tactic <> tactics[at_step + 1] AND tactic = tactics[1] AND at_step = 1 AS anew FROM (
    SELECT w.source_ip, w.cid, e.i, e.at_us, e.seq, e.tactic, c.tactics, w.first_us, w.last_us,
      CASE WHEN w.done OR (w.step > 0 AND e.at_us - w.last_us > 86400000000) THEN 0 ELSE w.step END AS at_step
    FROM walk w JOIN wanted e ON e.source_ip = w.source_ip AND e.i = w.i + 1 JOIN chain c ON c.cid = w.cid))
)"""


@query("stream_ordered_chains", over(
    "tagged", "SELECT source_ip, chain_name, severity, first_us, last_us, seq FROM walk JOIN chain USING (cid) WHERE done", _STEPS, recursive=True
))
def stream_ordered_chains(spark, sf):
    """Chains completed in order, from keyed state over several triggers whose rows come in no order."""
    rows = base.tagged(spark, sf).select("seq", "event_ts", "source_ip", "tactic").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    timed = stage(rows.withColumn("at_us", F.unix_micros("event_ts")), "tagged")
    stream = _in_parts(timed, "stream-tagged", order="at_us")
    with keyed.keyed_state(spark):
        return feed.run_once(keyed.ordered_chain_stream(stream), "stream-chains")
