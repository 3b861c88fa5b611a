"""Answers of a slow step, kept from batch to batch: every key is asked once."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from emberlog.operators.triage import distinct_requests, enrichment_key

_KEY = StructType().add("cache_key", "string")
#: What the marked source of a kept answer ends with.
CACHED_MARK = " [cached]"


def stored_answers(spark: SparkSession, path: str, fields: StructType = _KEY) -> DataFrame:
    """``fields`` of the kept answers with the ``batch`` that asked for them; empty if nothing was kept yet."""
    schema = StructType(list(fields.fields)).add("batch", LongType())
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def unanswered(events: DataFrame, path: str, batch_id: int, profile: str = "v1", order_col: str = "id") -> DataFrame:
    """One event for each key that no batch before ``batch_id`` has an answer for, the first by ``order_col``.

    Keys are made distinct before they meet the kept ones, of which only the key column is read.
    """
    known = stored_answers(events.sparkSession, path).filter(F.col("batch") < batch_id)
    return distinct_requests(events, profile, order_col).join(known, "cache_key", "left_anti")


def keep_answers(answers: DataFrame, path: str, batch_id: int) -> None:
    """Keep a batch's answers (``cache_key`` and any columns), one per key: the smallest row where a key has several.

    A batch has a folder of its own, and a repeated batch replaces it, so a retry leaves nothing twice.
    """
    row = F.struct(*[F.col(c) for c in answers.columns])
    single = answers.groupBy("cache_key").agg(F.min(row).alias("r")).select("r.*")
    single.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def answer_batch(
    events: DataFrame,
    path: str,
    batch_id: int,
    answer: Callable[[DataFrame], DataFrame],
    profile: str = "v1",
    order_col: str = "id",
) -> DataFrame:
    """All events with the answer of their key; ``answer`` sees only requests whose key is new.

    ``answer`` takes requests (``cache_key`` and an event's columns) and returns ``cache_key`` with columns
    that the events lack. Added to the events: ``cache_key``, those columns, ``asked_by`` (``order_col`` of the
    event that was asked) and ``cached`` (the answer was there before this event came). If ``answer`` gives a
    ``source``, a cached event's source ends with a mark. Requests without an answer give NULLs and are asked again
    by the next batch.

    Batch ids grow from call to call; a retry of the latest batch asks the same requests and replaces
    their answers. ``order_col`` is unique. Events are read twice: pass stored ones.
    """
    requests = unanswered(events, path, batch_id, profile, order_col)
    asked = requests.select("cache_key", F.col(order_col).alias("asked_by"))
    answers = answer(requests)
    fields = answers.select("cache_key", *[c for c in answers.columns if c != "cache_key"]).schema
    keep_answers(answers.join(asked, "cache_key"), path, batch_id)

    stored_fields = StructType(list(fields.fields)).add("asked_by", events.schema[order_col].dataType)
    kept = stored_answers(events.sparkSession, path, stored_fields).filter(F.col("batch") <= batch_id)
    joined = events.withColumn("cache_key", enrichment_key(profile)).join(kept, "cache_key", "left")
    cached = F.coalesce((F.col("batch") < batch_id) | (F.col("asked_by") != F.col(order_col)), F.lit(False))
    marked = joined.withColumn("cached", cached).drop("batch")
    if "source" not in fields.names:
        return marked
    return marked.withColumn(
        "source", F.when(F.col("cached"), F.concat("source", F.lit(CACHED_MARK))).otherwise(F.col("source"))
    )


def batch_report(answered: DataFrame) -> DataFrame:
    """Requests, those that had to be asked or have no answer, hits and hit rate of one answered batch."""
    return answered.agg(
        F.count("*").alias("requests"), F.count_if(~F.col("cached")).alias("asked"), F.count_if("cached").alias("hits")
    ).select(
        "requests", "asked", "hits",
        F.when(F.col("requests") > 0, F.round(F.col("hits") / F.col("requests"), 4)).otherwise(F.lit(0.0)).alias("hit_rate"),
    )
