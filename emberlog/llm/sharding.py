"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Row r of n moves to place p(r); shard = p mod shards, slot = p div shards. The permutation is a keyed
function of (seed, n), so place and origin can be computed for any row without a table.
"""

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.frames import global_row_numbers

ROUNDS = 6
#: Cycle-walking steps. With n rows, fewer than sqrt(n) + 1 places of the domain are unused, so a
#: walk leaves it in one step with probability above 1 - 1/sqrt(n), and within sqrt(n) + 1 steps surely.
WALK = 64


def whole(value: Column, by: int) -> Column:
    """Whole-number quotient, exact for every long."""
    return F.call_function("div", value, F.lit(by).cast("long")) if by > 1 else value.cast("long")


def feistel_place(number: Column, rows: int, seed: int, rounds: int = ROUNDS) -> Column:
    """The permuted place of row ``number`` among 0 .. rows - 1."""
    left = max(1, isqrt(max(rows, 1) - 1) + 1) if rows > 1 else 1
    right = -(-max(rows, 1) // left)

    def round_value(k: Column, half: Column, size: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), k, half), F.lit(size))

    def mixed(state: Column, k: Column) -> Column:
        even = k % 2 == 0
        a = F.when(even, (state["a"] + round_value(k, state["b"], left)) % left).otherwise(state["a"])
        b = F.when(even, state["b"]).otherwise((state["b"] + round_value(k, state["a"], right)) % right)
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def once(value: Column) -> Column:
        start = F.struct(
            whole(value, right).alias("a"),
            (value % right).cast("long").alias("b"),
        )
        steps = F.array(*[F.lit(k) for k in range(rounds)])
        return F.aggregate(steps, start, mixed, lambda s: s["a"] * right + s["b"])

    walk = F.array(*[F.lit(k) for k in range(WALK)])
    place = F.aggregate(
        walk,
        number.cast("long"),
        lambda v, k: F.when((k > 0) & (v < rows), v).otherwise(once(v)),
    )
    return F.when(place < rows, place).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def shard_rows(df: DataFrame, order: list[Column], shards: int = 8, seed: int = 20) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by at most one row. Nulls sort first; rows equal in all order columns share the
    places their group gets, in any order; an empty table gives an empty result. Columns of ``df`` named
    shard or slot are replaced. The same rows, seed and shard count give the same result.
    """
    numbered = global_row_numbers(df.drop("shard", "slot"), order, "_number")
    rows = numbered.count()
    place = feistel_place(F.col("_number"), rows, seed)
    return (
        numbered.withColumn("_to", place)
        .withColumn("shard", (F.col("_to") % shards).cast("int"))
        .withColumn("slot", whole(F.col("_to"), shards))
        .drop("_number", "_to")
    )


def document_shards(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Null text counts as empty (size 1). Documents are numbered by (doc_id, checksum, size), so equal
    rows are interchangeable.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return shard_rows(narrow, order, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
