"""Event-table queries over the given tables."""

from pyspark.sql import functions as F

from catalog import base
from catalog.duck_base import over
from catalog.registry import query
from emberlog.functions import score_band
from emberlog.operators import queries as Q
from emberlog.session import new_stage_path
from emberlog.sources import event_table

_SHOWN = "id, severity, source_ip, message, anomaly_score, is_anomaly, technique_id, is_false_positive"


def _shown(df):
    return df.select(*_SHOWN.split(", "))


@query("event_rows", over(
    "events",
    "SELECT id, timestamp, severity, source_ip, message, log_format, anomaly_score, is_anomaly, confidence, detector_votes, "
    "technique_id, technique_name, tactic, mitre_confidence, is_false_positive, raw FROM ev",
))
def event_rows(spark, sf):
    return base.events(spark, sf).drop("event_ts")


@query("assembled_events", over(
    "events",
    """SELECT t.seq, t.timestamp, t.severity, t.source_ip, t.format AS log_format,
      coalesce(d.anomaly_score, 0.0) AS anomaly_score, coalesce(d.is_anomaly, FALSE) AS is_anomaly,
      coalesce(d.confidence, 'NONE') AS confidence, t.technique_id, t.mitre_confidence
    FROM tagged t LEFT JOIN (SELECT * FROM detected WHERE confidence <> 'NONE') d USING (seq)""",
))
def assembled_events(spark, sf):
    """Parsed, detector and tag rows joined by key; rows without a vote or a tag take the defaults."""
    votes = base.detected(spark, sf).filter("confidence <> 'NONE'")
    tags = base.tagged(spark, sf).filter("technique_id IS NOT NULL")
    return event_table.assemble_events(base.parsed(spark, sf), votes, tags).select(
        "seq", "timestamp", "severity", "source_ip", "log_format", "anomaly_score", "is_anomaly", "confidence",
        "technique_id", "mitre_confidence",
    )


@query("append_and_read_events", over(
    "events", "SELECT id, severity, source_ip, anomaly_score, is_anomaly, technique_id, FALSE AS is_false_positive FROM ev"
))
def append_and_read_events(spark, sf):
    """Two appends to a new event table; ids continue after the first batch."""
    path = new_stage_path(spark, "event-table")
    stored = base.stored_events(spark, sf)
    rows = stored.withColumn("seq", F.col("id") - 1).drop("id", "is_false_positive")
    half = stored.agg(F.floor(F.max("id") / 2)).first()[0]
    event_table.append_events(rows.filter(F.col("seq") < half), path)
    event_table.append_events(rows.filter(F.col("seq") >= half).withColumn("seq", F.col("seq") - half), path)
    return event_table.read_events(spark, path).select(
        "id", "severity", "source_ip", "anomaly_score", "is_anomaly", "technique_id", "is_false_positive"
    )


@query("append_twice", over(
    "events",
    "SELECT p AS id, severity, source_ip, anomaly_score, technique_id, 'day' || part AS batch, "
    "min(p) OVER (PARTITION BY part) AS first_id, count(*) OVER (PARTITION BY part) AS rows, max(p) OVER (PARTITION BY part) AS last_id "
    "FROM (SELECT *, (id - 1) % 3 AS part, row_number() OVER (ORDER BY (id - 1) % 3, id) AS p FROM ev)",
))
def append_twice(spark, sf):
    """Three batches, the first two written again, as a retry does: they replace themselves and keep their ids."""
    path = new_stage_path(spark, "event-table")
    rows = base.stored_events(spark, sf).withColumn("part", (F.col("id") - 1) % 3)
    rows = rows.withColumn("seq", F.floor((F.col("id") - 1) / 3)).drop("id", "is_false_positive")
    for part in (0, 1, 0, 2, 1):
        event_table.append_events(rows.filter(F.col("part") == part).drop("part"), path, batch=f"day{part}")
    batches = event_table.read_manifest(spark, path)
    events = event_table.read_events(spark, path).select("id", "severity", "source_ip", "anomaly_score", "technique_id")
    return events.join(batches, F.col("id").between(F.col("first_id"), F.col("last_id")))


@query("recent_events", over("events", f"SELECT {_SHOWN} FROM ev ORDER BY id DESC LIMIT 50"))
def recent_events(spark, sf):
    return _shown(Q.recent_events(base.events(spark, sf)))


@query("events_by_severity", over(
    "events",
    f"SELECT {_SHOWN} FROM ev WHERE severity = 'HIGH' AND NOT is_false_positive ORDER BY id DESC LIMIT 100",
))
def events_by_severity(spark, sf):
    return _shown(Q.events_by_severity(base.events(spark, sf), "high"))


@query("anomaly_events", over(
    "events",
    f"SELECT {_SHOWN} FROM ev WHERE is_anomaly AND NOT is_false_positive ORDER BY anomaly_score DESC, id DESC LIMIT 50",
))
def anomaly_events(spark, sf):
    return _shown(Q.anomalies(base.events(spark, sf)))


@query("mark_false_positives", """
    SELECT doc_id AS event_id, doc_id IN (SELECT event_id + 1 FROM events) AS found FROM labels WHERE toxic = 1""")
def mark_false_positives(spark, sf):
    events = base.table(spark, sf, "events").select((F.col("event_id") + 1).alias("id"))
    return event_table.mark_false_positives(
        base.feedback(spark, sf), events, new_stage_path(spark, "feedback-table")
    )


@query("current_events", """
    SELECT event_id + 1 AS id, event_type, (event_id + 1) IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_false_positive
    FROM events""")
def current_events(spark, sf):
    """Marks written to the feedback table, read back and laid over the events."""
    path = new_stage_path(spark, "feedback-table")
    events = base.table(spark, sf, "events").select((F.col("event_id") + 1).alias("id"), "event_type")
    event_table.mark_false_positives(base.feedback(spark, sf), events, path)
    return event_table.current_events(events, event_table.read_feedback(spark, path))


METRICS_SQL = """SELECT count(*) AS total_events, count(*) FILTER (is_anomaly) AS total_anomalies,
    count(*) FILTER (is_false_positive) AS false_positives_blocked, count(*) FILTER (severity = 'CRITICAL') AS critical_events,
    count(*) FILTER (severity = 'HIGH') AS high_events, count(technique_id) AS mitre_tagged,
    round(count(technique_id) * 100.0 / count(*), 1) AS mitre_tag_rate,
    round(coalesce(avg(anomaly_score) FILTER (is_anomaly), 0), 3) AS avg_anomaly_score,
    (SELECT source_ip FROM ev GROUP BY source_ip ORDER BY count(*) DESC, source_ip LIMIT 1) AS top_attacker_ip,
    (SELECT technique_id FROM ev WHERE technique_id IS NOT NULL GROUP BY technique_id ORDER BY count(*) DESC, technique_id LIMIT 1) AS top_technique
  FROM ev"""


@query("metrics", over("events", METRICS_SQL))
def metrics(spark, sf):
    return Q.metrics(base.events(spark, sf))


_TOP = """SELECT source_ip AS ip, count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies, max(anomaly_score) AS max_score
  FROM ev GROUP BY source_ip ORDER BY total DESC, ip LIMIT {}"""


@query("top_ips", over("events", _TOP.format(10)))
def top_ips(spark, sf):
    return Q.top_ips(base.events(spark, sf))


@query("metrics_with_top_ips", over(
    "events", f"SELECT m.total_events, m.mitre_tag_rate, t.* FROM ({METRICS_SQL}) m, ({_TOP.format(5)}) t"
))
def metrics_with_top_ips(spark, sf):
    row = Q.metrics_with_top_ips(base.events(spark, sf))
    return row.select("total_events", "mitre_tag_rate", F.explode("top_ips").alias("t")).select(
        "total_events", "mitre_tag_rate", "t.*"
    )


@query("dashboard_critical", over(
    "events", f"SELECT {_SHOWN} FROM ev WHERE severity = 'CRITICAL' ORDER BY id DESC LIMIT 80"
))
def dashboard_critical(spark, sf):
    return _shown(Q.dashboard_filter(base.events(spark, sf), "CRITICAL"))


@query("dashboard_search", over(
    "events",
    f"SELECT {_SHOWN} FROM ev WHERE is_anomaly AND (contains(lower(message), 'password') OR contains(source_ip, 'password') "
    "OR contains(lower(coalesce(technique_id, '')), 'password')) ORDER BY id DESC LIMIT 80",
))
def dashboard_search(spark, sf):
    return _shown(Q.dashboard_filter(base.events(spark, sf), "anomaly", "Password"))


_BAND = (
    "CASE WHEN anomaly_score > 0.75 THEN 'critical' WHEN anomaly_score > 0.5 THEN 'high' "
    "WHEN anomaly_score > 0.25 THEN 'medium' ELSE 'low' END"
)


@query("score_bands", over("events", f"SELECT id, {_BAND} AS band FROM ev"))
def score_bands(spark, sf):
    return base.events(spark, sf).select("id", score_band(F.col("anomaly_score")).alias("band"))


@query("band_histogram", over("events", f"SELECT {_BAND} AS band, count(*) AS n_events FROM ev GROUP BY 1"))
def band_histogram(spark, sf):
    return Q.band_histogram(base.events(spark, sf))


@query("relative_bars", over(
    "events",
    f"SELECT ip, total, round(total * 100.0 / greatest(max(total) OVER (), 1), 6) AS bar_percent FROM ({_TOP.format(5)})",
))
def relative_bars(spark, sf):
    top = Q.top_ips(base.events(spark, sf), 5)
    return Q.relative_bars(top).select("ip", "total", F.round("bar_percent", 6).alias("bar_percent"))


@query("top_suspicious", over(
    "events",
    "SELECT id AS seq, anomaly_score, is_anomaly, severity, coalesce(technique_id, 'NONE') AS technique_id, message "
    "FROM ev WHERE anomaly_score > 0.1 ORDER BY anomaly_score DESC, id LIMIT 10",
))
def top_suspicious(spark, sf):
    rows = base.stored_events(spark, sf).withColumnRenamed("id", "seq")
    return Q.top_suspicious(rows, rows, rows)


@query("severity_breakdown", over(
    "events",
    "SELECT level_order, l.severity, count(e.id) AS n_events FROM (VALUES (0, 'CRITICAL'), (1, 'HIGH'), (2, 'MEDIUM'), (3, 'LOW'), (4, 'INFO')) "
    "l(level_order, severity) LEFT JOIN ev e ON e.severity = l.severity GROUP BY ALL",
))
def severity_breakdown(spark, sf):
    return Q.severity_breakdown(base.events(spark, sf))


@query("index_percentiles", """
    SELECT max(CASE WHEN rn = n // 2 THEN l_extendedprice END) AS p50,
      max(CASE WHEN rn = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) THEN l_extendedprice END) AS p95
    FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS rn, count(*) OVER () AS n FROM lineitem)""")
def index_percentiles(spark, sf):
    return Q.index_percentiles(base.even_table(spark, sf, "lineitem", "l_extendedprice"), "l_extendedprice")
