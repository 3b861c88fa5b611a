"""Shared inputs of the named queries, read from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.lines import spark_lines_sql
from emberlog.operators.detect import two_vote_ensemble
from emberlog.operators.features import (
    address_counts, build_features, deal_blocks, rate_in_blocks, row_features, with_address_counts,
)
from emberlog.operators.normalize import normalize_lines
from emberlog.operators.tagging import tag_events
from emberlog.schema import FEATURE_COLUMNS
from emberlog.session import stage, tune
from emberlog.sources.event_table import current_events, with_defaults

# The fullest part may hold this many times a core's share of the rows.
_UNEVEN = 1.25
_PARTS_PER_CORE = 4
# Events of one block of the rolling rate, which stay in one part, and events of a part.
_BLOCK = 8_192
_PART_ROWS = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table as read to all cores, unless its parts already keep them evenly busy.

    Parts are cut by bytes, but a row group is read whole by one of them, so a large file with few row groups leaves
    most parts empty. How many rows each part holds is told by the files' footers; no column is read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    per_part = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    fullest, total = per_part.agg(F.max("n"), F.sum("n")).first()
    if total is None or fullest * cores <= total * _UNEVEN:
        return df
    return df.repartition(cores * _PARTS_PER_CORE)


def even_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The chosen columns of a table, spread over the cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def _given_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _as_lines(events: DataFrame, *kept: str) -> DataFrame:
    events.createOrReplaceTempView("emberlog_given_events")
    return events.sparkSession.sql(spark_lines_sql("emberlog_given_events", *kept))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of all events: seq, event_ts, ip, event_type, line."""
    return _as_lines(spread(_given_events(spark, sf_dir)))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_lines(lines(spark, sf_dir))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_events(parsed(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows, written once because the detectors read them several times."""
    events = parsed(spark, sf_dir).drop("event_ts", "ip", "event_type")
    return stage(build_features(stage(events, "parsed")), "features")


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_vote_ensemble(features(spark, sf_dir), FEATURE_COLUMNS)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False-positive marks: the event ids named by toxic labels."""
    return (
        table(spark, sf_dir, "labels")
        .filter("toxic = 1")
        .select(F.col("doc_id").cast("long").alias("event_id"), F.lit("reviewed").alias("reason"))
    )


def _with_votes(detected: DataFrame) -> DataFrame:
    return detected.withColumn("detector_votes", F.col("anomaly_zscore").cast("int") + F.col("anomaly_iqr").cast("int"))


def _joined_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged events with their detections, joined by ``seq``."""
    tags = stage(tagged(spark, sf_dir).drop("ip", "event_type"), "tagged")
    frame = stage(build_features(tags).select("seq", *FEATURE_COLUMNS), "features")
    detections = _with_votes(two_vote_ensemble(frame, FEATURE_COLUMNS))
    kept = ("seq", "anomaly_score", "is_anomaly", "confidence", "detector_votes")
    return tags.join(detections.select(*kept), "seq", "left")


def _carried_detections(events: DataFrame, n_events: int) -> DataFrame:
    """The rows of ``_joined_detections`` for event ids that are neither null nor repeated, without a join by ``seq``.

    Events are dealt by blocks of ids before they are lines, so that features are computed on the row that keeps the
    texts, and only the narrow columns are read again.
    """
    parts = max(events.sparkSession.sparkContext.defaultParallelism, n_events // _PART_ROWS)
    dealt = deal_blocks(events, "event_id", block=_BLOCK).repartition(parts, "_block")
    parsed_lines = normalize_lines(_as_lines(dealt, "_block")).drop("ip", "event_type")
    tags = stage(rate_in_blocks(row_features(tag_events(parsed_lines)), block=_BLOCK), "tagged")
    counts = stage(address_counts(tags), "address-counts")
    rows = with_address_counts(tags, counts)
    frame = stage(rows.select(*FEATURE_COLUMNS), "features")
    return _with_votes(two_vote_ensemble(rows, FEATURE_COLUMNS, same_rows=frame))


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table (id, event_ts and the stored columns) with statistical detections."""
    events = _given_events(spark, sf_dir)
    per_id = events.groupBy("event_id").agg(F.count("*").alias("n"))
    unclear = F.count_if(F.col("event_id").isNull() | (F.col("n") > 1))
    n_events, n_unclear = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)), unclear).first()
    # Features need the id, and a repeated one pairs every tagged row with every detection of it.
    found = _joined_detections(spark, sf_dir) if n_unclear else _carried_detections(events, n_events)
    rows = with_defaults(found, keep=("event_ts",))
    return stage(
        rows.withColumn("id", F.col("seq") + 1).drop("seq").withColumn("is_false_positive", F.lit(False)),
        "events",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with the feedback applied."""
    return current_events(stored_events(spark, sf_dir), feedback(spark, sf_dir))
