"""Connected components by alternating stars; no component is ever gathered in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import stage


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and all its v; the minimum is combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (a, b: bigint).

    Each round, every node hands its larger neighbours to its smallest one, then its smaller ones too,
    until nothing changes; the edges of a round are written once. No edges give an empty result.
    """
    current = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = _toward_minimum(large)
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(met.select("u", F.col("m").alias("v"))).distinct()
        current = stage(small, "edges")
        mark = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
