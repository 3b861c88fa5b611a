"""Column layouts shared by the operators."""

from pyspark.sql import types as T

EVENTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("inserted_at", T.TimestampType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("log_format", T.StringType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("detector_votes", T.IntegerType()),
    T.StructField("technique_id", T.StringType()),
    T.StructField("technique_name", T.StringType()),
    T.StructField("tactic", T.StringType()),
    T.StructField("mitre_confidence", T.StringType()),
    T.StructField("is_false_positive", T.BooleanType()),
    T.StructField("raw", T.StringType()),
])

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("feedback_at", T.TimestampType()),
    T.StructField("reason", T.StringType()),
])

FEATURE_COLUMNS = [
    "hour_of_day", "is_weekend", "severity_score", "format_encoded", "ip_is_external",
    "ip_event_count", "ip_fail_rate", "rolling_event_rate", "message_length",
    "has_sql_keywords", "has_exec_keywords", "has_c2_keywords", "has_auth_failure",
    "has_privilege_esc",
]
