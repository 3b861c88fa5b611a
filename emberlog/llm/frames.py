"""Small DataFrame helpers that several of the corpus operators share."""

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.session import stage

#: White space between words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows per Arrow batch handed to Python, so that a batch of very long texts stays small.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: rows per Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ship_with_tasks(module: str) -> None:
    """Send a module's functions to the workers by value, so that they need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def document_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The chosen columns of the documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def words_of(text: Column) -> Column:
    """The words of a text as an array (null text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def global_row_numbers(df: DataFrame, order: list[Column], name: str = "row_number", keep: list[Column] | None = None) -> DataFrame:
    """Adds a gapless ``name`` from 0 in the given order, without sorting in one task.

    Rows are range-partitioned and sorted, so a local number is the position in the partition; the
    partitions' counts (one row each) give the offsets. Equal sort keys are numbered in any order and dealt to
    several partitions by where they were read, so end the order with columns that tell different rows apart. The rows are
    written once; with ``keep``, only those columns of them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col("_tie")]
    placed = stage(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .select(*(keep or [F.col(f"`{c}`") for c in df.columns]), F.monotonically_increasing_id().alias("_place")),
        "ranked",
    )
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per partition: bounded by the partition count of the session.
    return (
        placed.join(F.broadcast(offsets), part == F.col("_part"))
        .withColumn(name, F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_place", "_part", "_offset")
    )


def rolled(df: DataFrame, key: str, place: str, block: int, sums: dict[str, Column], back: bool = False) -> DataFrame:
    """``df`` with running aggregates (inclusive) of each ``key`` in the order of ``place`` (from 0), blocks of ``block`` places at a time.

    ``sums`` maps new columns to aggregate functions of columns that give the same when applied to their own results (sum,
    bit_xor): name -> (function, column, empty value). A busy key is cut into blocks of places, then into blocks of blocks, so no
    task sorts more than a block of rows or ``block`` * 64 block totals of it.
    """
    near, far = F.floor(F.col(place) / block).alias("_b1"), F.floor(F.col(place) / (block * block * 64)).alias("_b2")
    rows = df.select("*", near, far)

    def over(keys: list[str], order: str, inclusive: bool) -> Window:
        last = Window.currentRow if inclusive else -1
        return Window.partitionBy(*keys).orderBy(F.col(order).desc() if back else F.col(order)).rowsBetween(Window.unboundedPreceding, last)

    totals = rows.groupBy(F.col(key).alias("_key"), "_b1", "_b2").agg(*[f(c).alias(f"_s_{n}") for n, (f, c, _) in sums.items()])
    tops = totals.groupBy("_key", "_b2").agg(*[f(f"_s_{n}").alias(f"_t_{n}") for n, (f, _, _) in sums.items()])
    across = tops.select(
        F.col("_key").alias("_key2"), F.col("_b2").alias("_c2"),
        *[F.coalesce(f(f"_t_{n}").over(over(["_key"], "_b2", False)), F.lit(e)).alias(f"_u_{n}") for n, (f, _, e) in sums.items()],
    )
    inside = totals.select(
        "_key", "_b1", "_b2",
        *[F.coalesce(f(f"_s_{n}").over(over(["_key", "_b2"], "_b1", False)), F.lit(e)).alias(f"_v_{n}") for n, (f, _, e) in sums.items()],
    )
    offsets = inside.join(across, (F.col("_key") == F.col("_key2")) & (F.col("_b2") == F.col("_c2"))).select(
        "_key", F.col("_b1").alias("_c1"), *[f"_u_{n}" for n in sums], *[f"_v_{n}" for n in sums]
    )
    local = rows.select("*", *[f(c).over(over([key, "_b1"], place, True)).alias(f"_l_{n}") for n, (f, c, _) in sums.items()])
    joined = local.join(offsets, (F.col(key) == F.col("_key")) & (F.col("_b1") == F.col("_c1")))

    def whole(n: str) -> Column:
        parts = [F.col(f"_{x}_{n}") for x in "luv"]
        if sums[n][0] is F.bit_xor:
            return parts[0].bitwiseXOR(parts[1]).bitwiseXOR(parts[2])
        return parts[0] + parts[1] + parts[2]

    return joined.select(*df.columns, *[whole(n).alias(n) for n in sums])
