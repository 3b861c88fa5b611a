"""Features and detectors over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import base
from catalog.duck_base import flag_columns, iqr, over, zscore
from catalog.registry import query
from emberlog.functions.text import fold_case
from emberlog.operators import detect, features, normalize
from emberlog.operators.quantiles import exact_quantiles
from emberlog.schema import FEATURE_COLUMNS
from emberlog.session import new_stage_path
from emberlog.sources import reports

#: The year of the events table, for texts without one.
TABLE_YEAR = 2024
_META = "anomaly_label, _source_ip, _message, _severity, _format, _timestamp, _raw"


@query("build_features", over("features", f"SELECT seq, {', '.join(FEATURE_COLUMNS)}, {_META} FROM features"))
def build_features(spark, sf):
    return base.features(spark, sf)


@query("feature_matrix", over("features", f"SELECT seq, {', '.join(FEATURE_COLUMNS)} FROM features"))
def feature_matrix(spark, sf):
    """The columns a model trains on, found by their names."""
    rows = base.features(spark, sf)
    return rows.select("seq", *features.ml_columns(rows))


# The given lines hold no events of the last format: features of nothing have all columns and no rows.
_FORMATS = ("syslog", "json", "evtx")


@query("features_by_format", over(
    "parsed",
    "SELECT f.format, count(p.seq) AS n_rows, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS sum_of_counts, 22 AS n_columns FROM (VALUES "
    + ", ".join(f"('{name}')" for name in _FORMATS)
    + ") f(format) LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY format, source_ip) AS n FROM parsed) p USING (format) GROUP BY 1",
))
def features_by_format(spark, sf):
    """Features built from the events of one format each, also from none."""
    events = base.parsed(spark, sf)
    parts = []
    for name in _FORMATS:
        built = features.build_features(events.filter(F.col("format") == name))
        parts.append(built.agg(
            F.lit(name).alias("format"), F.count("*").alias("n_rows"),
            F.coalesce(F.sum("ip_event_count"), F.lit(0)).alias("sum_of_counts"), F.lit(len(built.columns)).alias("n_columns"),
        ))
    return reduce(DataFrame.unionByName, parts)


@query("feature_metadata", over("features", f"SELECT seq, {_META} FROM features"))
def feature_metadata(spark, sf):
    """The label placeholder and the carried columns of every event."""
    return base.features(spark, sf).select("seq", *_META.split(", "))


@query("csv_report", over("features", f"SELECT seq, {', '.join(FEATURE_COLUMNS)}, {_META} FROM features"))
def csv_report(spark, sf):
    """Feature rows written as CSV and read back with their types."""
    path = new_stage_path(spark, "csv-report")
    rows = base.features(spark, sf)
    reports.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, escape='"', multiLine=True)


@query("json_report", over(
    "detected", "SELECT seq, anomaly_score, is_anomaly, confidence, _source_ip, _message FROM detected"
))
def json_report(spark, sf):
    """Detections written as JSON lines and read back with their types."""
    path = new_stage_path(spark, "json-report")
    rows = base.detected(spark, sf).select("seq", "anomaly_score", "is_anomaly", "confidence", "_source_ip", "_message")
    reports.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("row_features", over(
    "features",
    "SELECT seq, hour_of_day, is_weekend, severity_score, format_encoded, ip_is_external, message_length, "
    "has_sql_keywords, has_exec_keywords, has_c2_keywords, has_auth_failure, has_privilege_esc FROM features",
))
def row_features(spark, sf):
    return features.row_features(base.parsed(spark, sf)).select(
        "seq", "hour_of_day", "is_weekend", "severity_score", "format_encoded", "ip_is_external", "message_length",
        "has_sql_keywords", "has_exec_keywords", "has_c2_keywords", "has_auth_failure", "has_privilege_esc",
    )


@query("address_counts", over("features", "SELECT source_ip, ip_event_count, ip_fail_rate FROM ip_stats"))
def address_counts(spark, sf):
    return features.address_counts(base.parsed(spark, sf))


@query("rolling_event_rate", over("features", "SELECT seq, rolling_event_rate FROM features"))
def rolling_event_rate(spark, sf):
    parsed = base.parsed(spark, sf).select("seq", "source_ip")
    # A small block size makes the cut between blocks part of the check.
    return features.rolling_event_rate(parsed, block=1000).select("seq", "rolling_event_rate")


@query("timed_event_rate", over(
    "parsed",
    "SELECT seq, source_ip, count(*) OVER (PARTITION BY source_ip ORDER BY epoch(date_trunc('second', event_ts)) "
    "RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS timed_event_rate FROM parsed",
))
def timed_event_rate(spark, sf):
    return features.timed_event_rate(base.parsed(spark, sf).select("seq", "source_ip", "event_ts")).select(
        "seq", "source_ip", "timed_event_rate"
    )


@query("event_time_of_text", over(
    "parsed",
    "SELECT seq, CASE WHEN format <> 'unknown' THEN strftime(event_ts, '%Y-%m-%d %H:%M:%S') END AS event_time FROM parsed",
))
def event_time_of_text(spark, sf):
    timed = normalize.with_event_time(base.parsed(spark, sf), TABLE_YEAR)
    return timed.select("seq", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query("timed_event_rate_of_text", over(
    "parsed",
    "SELECT seq, source_ip, CASE WHEN s IS NOT NULL THEN count(*) OVER (PARTITION BY source_ip, s IS NULL ORDER BY s "
    "RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) END AS timed_event_rate FROM (SELECT *, "
    "CASE WHEN format <> 'unknown' THEN epoch(date_trunc('second', event_ts)) END AS s FROM parsed)",
))
def timed_event_rate_of_text(spark, sf):
    timed = normalize.with_event_time(base.parsed(spark, sf), TABLE_YEAR)
    return features.timed_event_rate(timed.select("seq", "source_ip", "event_ts")).select(
        "seq", "source_ip", "timed_event_rate"
    )


@query("content_flags_of_documents", f"SELECT doc_id, {flag_columns('text')} FROM documents")
def content_flags_of_documents(spark, sf):
    docs = base.spread(base.table(spark, sf, "documents").select("doc_id", "text"))
    docs = docs.withColumn("folded", fold_case(F.col("text")))
    flags = features.content_flags(F.col("text"), F.col("folded"))
    return docs.select("doc_id", *[flag.alias(name) for name, flag in flags.items()])


@query("content_flags_of_conversations", f"SELECT conv_id, turn, {flag_columns('text')} FROM conversations")
def content_flags_of_conversations(spark, sf):
    turns = base.spread(base.table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    turns = turns.withColumn("folded", fold_case(F.col("text")))
    flags = features.content_flags(F.col("text"), F.col("folded"))
    return turns.select("conv_id", "turn", *[flag.alias(name) for name, flag in flags.items()])


@query("feature_summary", over("features", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, CAST(max({c}) AS DOUBLE) AS maximum FROM features"
    for c in FEATURE_COLUMNS
)))
def feature_summary(spark, sf):
    return features.feature_summary(base.features(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("severity_distribution", over(
    "features", "SELECT _severity AS severity, count(*) AS n_events FROM features GROUP BY 1"
))
def severity_distribution(spark, sf):
    return features.severity_distribution(base.features(spark, sf))


@query("hour_histogram", over("features", "SELECT hour_of_day, count(*) AS n_events FROM features GROUP BY 1"))
def hour_histogram(spark, sf):
    return features.hour_histogram(base.features(spark, sf))


@query("busiest_addresses", over(
    "features",
    "SELECT _source_ip AS source_ip, max(ip_event_count) AS ip_event_count, max(ip_fail_rate) AS ip_fail_rate "
    "FROM features GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
))
def busiest_addresses(spark, sf):
    return features.busiest_addresses(base.features(spark, sf))


@query("suspicious_events", over(
    "features",
    "SELECT seq, _severity, _message FROM features WHERE has_sql_keywords = 1 OR has_exec_keywords = 1 OR has_c2_keywords = 1",
))
def suspicious_events(spark, sf):
    return features.suspicious_events(base.features(spark, sf)).select("seq", "_severity", "_message")


# --- detectors ----------------------------------------------------------------------------------


@query("zscore_detector", over(
    "features", "SELECT seq, round(max_z, 6) AS max_zscore, max_z > 2.5 AS anomaly_zscore FROM zs",
    zscore(FEATURE_COLUMNS),
))
def zscore_detector(spark, sf):
    return detect.zscore_detector(base.features(spark, sf), FEATURE_COLUMNS).select(
        "seq", F.round("max_zscore", 6).alias("max_zscore"), "anomaly_zscore"
    )


@query("iqr_detector", over(
    "features", "SELECT seq, anomaly_iqr FROM fenced", iqr(FEATURE_COLUMNS, "features")
))
def iqr_detector(spark, sf):
    return detect.iqr_detector(base.features(spark, sf), FEATURE_COLUMNS).select("seq", "anomaly_iqr")


@query("two_vote_ensemble", over(
    "detected", "SELECT seq, anomaly_zscore, anomaly_iqr, anomaly_score, confidence, is_anomaly FROM detected"
))
def two_vote_ensemble(spark, sf):
    return base.detected(spark, sf).select(
        "seq", "anomaly_zscore", "anomaly_iqr", "anomaly_score", "confidence", "is_anomaly"
    )


_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LINE_KEYS = "l_orderkey, l_linenumber"


@query("lineitem_zscore",
       f"WITH {zscore(_LINE_COLUMNS, 'lineitem')} SELECT {_LINE_KEYS}, round(max_z, 6) AS max_zscore, "
       "max_z > 2.5 AS anomaly_zscore, round_even(least(max_z, 5.0) / 5.0, 4) AS anomaly_score FROM zs")
def lineitem_zscore(spark, sf):
    scored = detect.zscore_detector(base.even_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", *_LINE_COLUMNS), _LINE_COLUMNS)
    return scored.select(
        "l_orderkey", "l_linenumber", F.round("max_zscore", 6).alias("max_zscore"), "anomaly_zscore",
        detect.zscore_score(F.col("max_zscore")).alias("anomaly_score"),
    )


@query("lineitem_quartiles", "SELECT feature, prob, round(quantile, 6) AS quantile FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, quantile_cont({c}, {p}) AS quantile FROM lineitem"
    for c in _LINE_COLUMNS for p in (0.25, 0.5, 0.75, 0.9)
) + ")")
def lineitem_quartiles(spark, sf):
    rows = exact_quantiles(base.even_table(spark, sf, "lineitem", *_LINE_COLUMNS), _LINE_COLUMNS, [0.25, 0.5, 0.75, 0.9])
    return rows.withColumn("quantile", F.round("quantile", 6))


@query("orders_iqr",
       f"WITH {iqr(['o_totalprice'], 'orders')} SELECT o_orderkey, anomaly_iqr FROM fenced")
def orders_iqr(spark, sf):
    return detect.iqr_detector(base.table(spark, sf, "orders"), ["o_totalprice"]).select("o_orderkey", "anomaly_iqr")


@query("event_value_anomalies",
       f"WITH {zscore(['value'], 'events')}, {iqr(['value'])} "
       "SELECT event_id, max_z > 2.5 AS anomaly_zscore, anomaly_iqr FROM fenced")
def event_value_anomalies(spark, sf):
    flagged = detect.two_vote_ensemble(base.table(spark, sf, "events"), ["value"])
    return flagged.select("event_id", "anomaly_zscore", "anomaly_iqr")


_VOTES = "CAST(anomaly_iqr AS INT) + CAST(severity_score >= 3 AS INT) + CAST(anomaly_zscore AS INT)"


@query("three_vote_ensemble", over(
    "detected",
    f"SELECT seq, {_VOTES} AS detector_votes, "
    "round_even(least(greatest(0.4 * anomaly_score + 0.4 * (severity_score / 4.0::DOUBLE) + 0.2 * anomaly_score, 0), 1), 4) AS anomaly_score, "
    f"CASE {_VOTES} WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'NONE' END AS confidence, "
    f"({_VOTES}) >= 2 AS is_anomaly FROM detected",
))
def three_vote_ensemble(spark, sf):
    """The vote and weighting themselves, on detector outputs that SQL can name."""
    inputs = base.detected(spark, sf).select(
        "seq", F.col("anomaly_iqr").alias("if_flag"), (F.col("severity_score") >= 3).alias("lof_flag"),
        F.col("anomaly_zscore").alias("zscore_flag"), F.col("anomaly_score").alias("if_score"),
        (F.col("severity_score") / 4.0).alias("lof_score"), F.col("anomaly_score").alias("z_score"),
    )
    return detect.three_vote_ensemble(inputs, "z_score").select(
        "seq", "detector_votes", "anomaly_score", "confidence", "is_anomaly"
    )


def quality_sql(flag: str, source: str) -> str:
    tp, fp = f"count(*) FILTER ({flag} AND severity_score >= 3)", f"count(*) FILTER ({flag} AND severity_score < 3)"
    fn, tn = f"count(*) FILTER (NOT {flag} AND severity_score >= 3)", f"count(*) FILTER (NOT {flag} AND severity_score < 3)"
    return f"""SELECT total_events, tp + fp AS anomalies_found, tp AS true_positives, fp AS false_positives,
      fn AS false_negatives, round(p, 3) AS precision, round(r, 3) AS recall,
      round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1_score,
      round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 3) AS fp_rate
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
      FROM (SELECT count(*) AS total_events, {tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn FROM {source}))"""


@query("evaluate_detector", over("detected", quality_sql("is_anomaly", "detected")))
def evaluate_detector(spark, sf):
    return detect.evaluate(base.detected(spark, sf))


_METHODS = {"z-score only": "anomaly_zscore", "IQR only": "anomaly_iqr", "both": "is_anomaly"}


@query("compare_methods", over("detected", " UNION ALL ".join(
    f"SELECT '{label}' AS method, anomalies_found AS flagged, round(anomalies_found * 100.0 / total_events, 1) AS rate, "
    f"precision, recall FROM ({quality_sql(flag, 'detected')})" for label, flag in _METHODS.items()
)))
def compare_methods(spark, sf):
    return detect.compare_methods(base.detected(spark, sf), _METHODS)


@query("top_scored_events", over(
    "detected", "SELECT seq, anomaly_score, confidence FROM detected ORDER BY anomaly_score DESC, seq LIMIT 10"
))
def top_scored_events(spark, sf):
    return detect.top_scored(base.detected(spark, sf)).select("seq", "anomaly_score", "confidence")


@query("top_flagged_events", over(
    "detected",
    "SELECT seq, anomaly_score, confidence FROM detected WHERE is_anomaly ORDER BY anomaly_score DESC, seq LIMIT 10",
))
def top_flagged_events(spark, sf):
    return detect.top_scored(base.detected(spark, sf), flagged_only=True).select("seq", "anomaly_score", "confidence")


@query("confidence_breakdown", over(
    "detected",
    "SELECT level_order, l.confidence, count(d.seq) AS n_events FROM (VALUES (0, 'HIGH'), (1, 'MEDIUM'), (2, 'LOW'), (3, 'NONE')) "
    "l(level_order, confidence) LEFT JOIN detected d ON d.confidence = l.confidence GROUP BY ALL",
))
def confidence_breakdown(spark, sf):
    return detect.confidence_breakdown(base.detected(spark, sf))
