"""Global row numbers without sorting in one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.session import stage


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a gapless ``name`` from 0 in the given order; the rows are range-partitioned, sorted and written once.

    Equal sort keys are dealt to several partitions by where they were read and numbered in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col("_tie")]
    placed = stage(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumn("_place", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the session.
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    number = F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, number).drop("_place", "_part", "_offset")
