"""The event table and the feedback table: append-only Parquet, corrected at read time."""

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlog.schema import EVENTS_SCHEMA, FEEDBACK_SCHEMA
from emberlog.session import stage

RAW_LENGTH = 500
_DATE = "ingest_date"
_BATCH = "ingest_batch"
#: Below the table; readers of Parquet skip names that start with an underscore.
_MANIFEST = "_manifest"
MANIFEST_SCHEMA = StructType().add("batch", "string").add("first_id", "long").add("rows", "long").add("last_id", "long")


def assemble_events(
    parsed: DataFrame,
    detections: DataFrame | None = None,
    tags: DataFrame | None = None,
    key: str = "seq",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of the event table (without id and insert time) joined by key, defaults filled in.

    ``detections`` and ``tags`` may lack rows; ``raw`` is cut to 500 characters.
    """
    joined = parsed
    if detections is not None:
        chosen = [c for c in ("anomaly_score", "is_anomaly", "confidence", "detector_votes") if c in detections.columns]
        joined = joined.join(detections.select(key, *chosen), key, "left")
    if tags is not None:
        joined = joined.join(
            tags.select(key, "technique_id", "technique_name", "tactic", "mitre_confidence"), key, "left"
        )
    return with_defaults(joined, key, keep)


def with_defaults(joined: DataFrame, key: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """Project any frame with parsed, detector and tag columns to the event-table layout."""
    none = F.lit(None).cast("string")

    def column(name: str, default, kind: str):
        source = F.col(name) if name in joined.columns else F.lit(None)
        return F.coalesce(source.cast(kind), default).alias(name)

    def optional(name: str):
        return (F.col(name) if name in joined.columns else none).alias(name)

    return joined.select(
        key,
        *keep,
        column("timestamp", F.lit(""), "string"),
        column("severity", F.lit("INFO"), "string"),
        column("source_ip", F.lit("unknown"), "string"),
        column("message", F.lit(""), "string"),
        F.coalesce(F.col("format"), F.lit("unknown")).alias("log_format"),
        column("anomaly_score", F.lit(0.0), "double"),
        column("is_anomaly", F.lit(False), "boolean"),
        column("confidence", F.lit("NONE"), "string"),
        column("detector_votes", F.lit(0), "int"),
        optional("technique_id"),
        optional("technique_name"),
        optional("tactic"),
        column("mitre_confidence", F.lit("NONE"), "string"),
        F.substring(F.coalesce(F.col("raw"), F.lit("")), 1, RAW_LENGTH).alias("raw"),
    )


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed batch: its name, first id, number of rows and last id."""
    return _read(spark, f"{path}/{_MANIFEST}", MANIFEST_SCHEMA)


def append_events(rows: DataFrame, path: str, key: str = "seq", batch: str | None = None) -> int:
    """Append assembled rows as one batch and return their number.

    Ids continue after the last committed one: ``last id + 1 + key``, so ``key`` must start at 0 and be dense
    for ids without gaps. A batch is written once, to a folder of its own, partitioned by ingest date; then its
    row in the manifest commits it, so that readers see all of a batch or nothing. The next first id comes from
    the manifest and not from the stored rows.

    A ``batch`` that is already there is replaced and keeps its ids; without a name every call is a new batch.
    Refused is a repeated batch with more rows than the ids that it holds, if others have followed. One writer at a time.
    """
    spark = rows.sparkSession
    name = uuid.uuid4().hex if batch is None else batch
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-', not {batch!r}")
    manifest = read_manifest(spark, path)
    seen = manifest.agg(
        F.max("last_id").alias("last"),
        F.max(F.when(F.col("batch") == name, F.col("first_id"))).alias("first"),
        F.max(F.when(F.col("batch") == name, F.col("last_id"))).alias("own_last"),
    ).first()
    first_id = seen.first if seen.first is not None else (seen.last or 0) + 1
    if seen.first is not None and seen.own_last < seen.last:
        largest = rows.agg(F.max(key)).first()[0]
        if largest is not None and first_id + largest > seen.own_last:
            raise ValueError(f"batch {name!r} has grown and later batches follow it")

    numbered = rows.withColumn("id", F.lit(first_id) + F.col(key))
    stamped = numbered.withColumn("inserted_at", F.current_timestamp()).withColumn("is_false_positive", F.lit(False))
    layout = stamped.select(*[F.col(f.name).cast(f.dataType) for f in EVENTS_SCHEMA.fields])
    folder = f"{path}/{_BATCH}={name}"
    layout.withColumn(_DATE, F.to_date("inserted_at")).write.mode("overwrite").partitionBy(_DATE).parquet(folder)
    # The batch's own ids only: one column of what was just written.
    written = _read(spark, folder, EVENTS_SCHEMA).agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    last_id = first_id - 1 if written.last is None else written.last
    entry = spark.range(1).select(
        F.lit(name).alias("batch"), F.lit(first_id).cast("long").alias("first_id"),
        F.lit(written.n).cast("long").alias("rows"), F.lit(last_id).cast("long").alias("last_id"),
    )
    entry.write.mode("overwrite").parquet(f"{path}/{_MANIFEST}/of={name}")
    return written.n


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The committed batches of the event table; an empty table if nothing was written yet.

    The join is by the folder's name, so folders that no manifest row commits are not read.
    """
    by_batch = StructType(list(EVENTS_SCHEMA.fields)).add(_BATCH, "string")
    committed = read_manifest(spark, path).select(F.col("batch").alias(_BATCH))
    return _read(spark, path, by_batch).join(committed, _BATCH, "left_semi").select(*EVENTS_SCHEMA.names)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FEEDBACK_SCHEMA)


def mark_false_positives(
    marks: DataFrame, events: DataFrame, feedback_path: str
) -> DataFrame:
    """Record feedback (event_id, reason) for events that exist; returns event_id and ``found``.

    A second mark of the same event is recorded again.
    """
    spark = marks.sparkSession
    named = marks.select(F.col("event_id").alias("id")).distinct()
    known = events.select("id").join(named, "id", "left_semi").distinct()
    known = known.select(F.col("id").alias("event_id"), F.lit(True).alias("_known"))
    checked = stage(
        marks.select("event_id", F.coalesce("reason", F.lit("")).alias("reason"))
        .join(known, "event_id", "left")
        .withColumn("found", F.coalesce("_known", F.lit(False)))
        .withColumn("id", F.uuid())
        .drop("_known"),
        "feedback",
    )
    (
        checked.filter("found")
        .withColumn("feedback_at", F.current_timestamp())
        .select(*[F.col(f.name).cast(f.dataType) for f in FEEDBACK_SCHEMA.fields])
        .withColumn(_DATE, F.to_date("feedback_at"))
        .write.mode("append")
        .partitionBy(_DATE)
        .parquet(feedback_path)
    )
    return checked.select("event_id", "found")


def mark_false_positive(
    spark: SparkSession, events: DataFrame, feedback_path: str, event_id: int, reason: str = ""
) -> bool:
    """Mark one event; False if there is no such event."""
    marks = spark.createDataFrame([(event_id, reason)], "event_id long, reason string")
    return mark_false_positives(marks, events, feedback_path).filter("found").count() > 0


def current_events(events: DataFrame, feedback: DataFrame, id_col: str = "id") -> DataFrame:
    """Events with ``is_false_positive`` taken from the feedback table."""
    marked = feedback.select(F.col("event_id").alias(id_col)).distinct().withColumn("_marked", F.lit(True))
    return (
        events.drop("is_false_positive")
        .join(marked, id_col, "left")
        .withColumn("is_false_positive", F.coalesce("_marked", F.lit(False)))
        .drop("_marked")
    )
