"""Live feed, running metrics, alerts and windowed rates on streams.

The checkpoint of a query takes the place of a "last seen id", so no row is lost however many
arrive between two triggers. Stateful jobs carry a watermark; deploy them in append mode.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberlog.constants.kill_chains import KILL_CHAINS, MIN_MATCH
from emberlog.operators.correlate import (
    address_sessions,
    component_keys,
    correlation_nodes,
    kill_chains,
    session_chains,
)
from emberlog.operators.features import row_features
from emberlog.operators.forest import ForestModel, load_and_predict
from emberlog.operators.normalize import normalize_lines
from emberlog.operators.tagging import tag_events
from emberlog.session import new_stage_path
from emberlog.sources.event_table import current_events, read_feedback
from emberlog.sources.models import latest_version, load_forest

NEWEST_FOR_CHAINS = 100


def line_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New lines (``line``) of a folder of log files."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder).select(F.make_valid_utf8("value").alias("line"))


def table_stream(spark: SparkSession, path: str, schema: StructType, max_files: int | None = None) -> DataFrame:
    """New rows of a Parquet table."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def event_feed(lines: DataFrame, with_features: bool = False) -> DataFrame:
    """Parsed and tagged events; optionally the features that need no other row."""
    events = tag_events(normalize_lines(lines))
    return row_features(events) if with_features else events


def critical_alerts(events: DataFrame) -> DataFrame:
    return events.filter(F.col("severity") == "CRITICAL")


def overlay_feedback(events: DataFrame, feedback: DataFrame, id_col: str = "id") -> DataFrame:
    """Stream of events joined with the feedback table as it is when the stream starts.

    Marks that arrive later are seen by ``overlaid_batches``.
    """
    return current_events(events, feedback, id_col)


def overlaid_batches(feedback_path: str, path: str, id_col: str = "id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: lay the feedback over each batch as the table is at that time.

    Rows already written keep their flag; a retried batch overwrites its own folder.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        feedback = read_feedback(batch.sparkSession, feedback_path)
        current_events(batch, feedback, id_col).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return step


def windowed_rate(
    events: DataFrame, ts_col: str = "event_ts", length: str = "60 seconds",
    slide: str | None = None, delay: str = "2 minutes",
) -> DataFrame:
    """Events per address and window."""
    window = F.window(ts_col, length, slide) if slide else F.window(ts_col, length)
    return (
        events.withWatermark(ts_col, delay)
        .groupBy(window.alias("w"), "source_ip")
        .agg(F.count("*").alias("n_events"))
        .select(F.col("w.start").alias("window_start"), "source_ip", "n_events")
    )


def session_stream(events: DataFrame, ts_col: str = "event_ts", gap_minutes: int = 5, delay: str = "2 minutes") -> DataFrame:
    """Address sessions with the tactics seen in them."""
    return address_sessions(events.withWatermark(ts_col, delay), ts_col, gap_minutes, stream=True)


def session_chain_stream(events: DataFrame, ts_col: str = "event_ts", gap_minutes: int = 5,
                         delay: str = "2 minutes", chains=KILL_CHAINS, min_match: float = MIN_MATCH) -> DataFrame:
    """Kill chains that show within one address session."""
    return session_chains(session_stream(events, ts_col, gap_minutes, delay), chains, min_match)


def metric_partials(events: DataFrame) -> DataFrame:
    """Additive figures of a batch of events per address and technique.

    Partials of any number of batches add up to the metrics row, see ``merged_metrics``.
    """
    return events.groupBy("source_ip", "technique_id").agg(
        F.count("*").alias("n"),
        F.count_if("is_anomaly").alias("n_anomalies"),
        F.sum(F.when(F.col("is_anomaly"), F.col("anomaly_score")).otherwise(0.0)).alias("score_sum"),
        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
        F.count_if(F.col("severity") == "HIGH").alias("n_high"),
    )


def merged_metrics(partials: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """The metrics row from partials and the feedback table, which holds marks of existing events only.

    Of rows carried by ``running_metrics`` (with a ``batch_id``) the latest batch counts: it has the totals.
    """
    if "batch_id" in partials.columns:
        latest = partials.agg(F.max("batch_id")).scalar()
        partials = partials.filter(F.col("batch_id") == latest)
    blocked = feedback.agg(F.count_distinct("event_id")).scalar() if feedback is not None else F.lit(0)

    def top(column: str):
        rows = partials.filter(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
        return rows.orderBy(F.desc("n"), column).limit(1).select(column).scalar()

    total, tagged = F.col("total_events"), F.col("mitre_tagged")
    return partials.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("n_anomalies"), F.lit(0)).alias("total_anomalies"),
        F.coalesce(F.sum("n_critical"), F.lit(0)).alias("critical_events"),
        F.coalesce(F.sum("n_high"), F.lit(0)).alias("high_events"),
        F.coalesce(F.sum(F.when(F.col("technique_id").isNotNull(), F.col("n"))), F.lit(0)).alias("mitre_tagged"),
        F.sum("score_sum").alias("_sum"),
    ).select(
        "total_events", "total_anomalies", blocked.alias("false_positives_blocked"),
        "critical_events", "high_events", "mitre_tagged",
        F.when(total > 0, F.round(tagged / total * 100, 1)).otherwise(F.lit(0.0)).alias("mitre_tag_rate"),
        F.when(F.col("total_anomalies") > 0, F.round(F.col("_sum") / F.col("total_anomalies"), 3))
        .otherwise(F.lit(0.0)).alias("avg_anomaly_score"),
        top("source_ip").alias("top_attacker_ip"),
        top("technique_id").alias("top_technique"),
    )


def _write_slot(rows: DataFrame, path: str, batch_id: int) -> None:
    """Carry rows to the next batch in one of two folders.

    A batch reads the other folder than it writes, so a retry finds its input unchanged and nothing piles up.
    """
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")


def _read_slot(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/slot={batch_id % 2}").drop("batch_id")


def running_metrics(totals_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: add the batch's figures to the totals per address and technique.

    ``merged_metrics(spark.read.parquet(totals_path), feedback)`` is the metrics row at any time.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        totals = metric_partials(batch)
        if batch_id > 0:
            earlier = _read_slot(batch.sparkSession, totals_path, batch_id - 1)
            figures = [c for c in totals.columns if c not in ("source_ip", "technique_id")]
            totals = (
                totals.unionByName(earlier)
                .groupBy("source_ip", "technique_id")
                .agg(*[F.sum(c).alias(c) for c in figures])
            )
        _write_slot(totals, totals_path, batch_id)

    return step


def running_kill_chains(
    newest_path: str, alerts_path: str, newest: int = NEWEST_FOR_CHAINS
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: keep the newest events and write the alerts over them.

    Events need the columns of the event table; only ``newest`` rows are carried between batches.
    """
    wanted = ["id", "source_ip", "severity", "tactic", "technique_id", "anomaly_score", "message"]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*wanted).orderBy(F.desc("id")).limit(newest)
        if batch_id > 0:
            earlier = _read_slot(spark, newest_path, batch_id - 1)
            rows = rows.unionByName(earlier).orderBy(F.desc("id")).limit(newest)
        _write_slot(rows.coalesce(1), newest_path, batch_id)
        alerts = kill_chains(component_keys(correlation_nodes(_read_slot(spark, newest_path, batch_id))))
        alerts.coalesce(1).write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")

    return step


def scored_batches(model_root: str, path: str, key: str = "seq") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: score each batch of feature rows by the newest published model, with the range of its training.

    A model published between two batches is used from the next one on. Rows carry ``model_version``; a retried batch
    overwrites its own folder. Raises while no model is published.
    """
    loaded: dict[int, ForestModel] = {}

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = latest_version(spark, model_root)
        if newest is None:
            raise FileNotFoundError(f"no model is published below {model_root}")
        version, folder = newest
        if version not in loaded:
            loaded.clear()
            loaded[version] = load_forest(spark, folder)
        scored = load_and_predict(batch, loaded[version], key, training_range=True)
        scored.withColumn("model_version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return step


def start_append(stream: DataFrame, path: str, checkpoint: str, once: bool = False,
                 interval: str = "2 seconds") -> StreamingQuery:
    """Write a stream to a Parquet table, every ``interval`` or once over all there is."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.outputMode("append").start()


def start_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
                  once: bool = False, interval: str = "20 seconds", mode: str = "append") -> StreamingQuery:
    """Run a ``foreachBatch`` step on every trigger."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.outputMode(mode).start()


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream over all data there is and return its result table.

    Complete mode rewrites the whole result on every trigger; the last one counts.
    """
    spark = stream.sparkSession
    path, checkpoint = new_stage_path(spark, name), new_stage_path(spark, f"{name}-checkpoint")
    if mode == "append":
        start_append(stream, path, checkpoint, once=True).awaitTermination()
    else:
        def overwrite(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        start_batches(stream, overwrite, checkpoint, once=True, mode=mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
