"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct shingle hashes. Sketches of parts merge into the
sketch of the whole; two sketches estimate resemblance, containment and the number of distinct shingles.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.once import once
from emberlog.llm.frames import let, words_of
from emberlog.session import stage

SHINGLE = 5
SKETCH = 128
#: Order of documents: descending id, null last, then two hashes of the text.
KEY = ["_null", "_down", "_hash1", "_hash2"]


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all ``width``-word shingles of a text; a shorter text is one shingle, no words are none."""

    def grams(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        )
        return F.when(F.size(h) >= width, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), grams)


def sketch(text: Column, k: int = SKETCH, width: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text (null text: empty)."""
    return F.slice(F.array_distinct(F.sort_array(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated Jaccard likeness, exact while the union has at most k shingles; two empty sketches: 1."""
    both = F.array_intersect(a, b)
    share = let(
        merge(a, b, k), lambda u: F.size(F.array_intersect(u, both)) / F.greatest(F.size(u), F.lit(1)).cast("double")
    )
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles, exact below k."""
    largest = (F.get(a, F.lit(k - 1)).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / largest)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    j = resemblance(a, b, k)
    shared = j * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (F.lit(1.0) + j)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def sketch_text(a: Column) -> Column:
    """A sketch as text: base 64 of its 8-byte hashes."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def fingerprint(docs: DataFrame, text: str = "text", k: int = SKETCH) -> DataFrame:
    """``docs`` with a ``sketch`` column (replaced if it is there); no shuffle."""
    return docs.drop("sketch").withColumn("sketch", sketch(F.col(text), k))


def _order_key(doc_id: Column) -> list[Column]:
    """Columns that ascend as ids descend, null last (~x falls as x rises and never overflows)."""
    return [doc_id.isNull().alias("_null"), F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")).alias("_down")]


def _block_starts(keys: DataFrame) -> list[tuple]:
    """The first key of each block, ascending: one per shuffle partition, so bounded by the session's setting."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(parts, *KEY).select(*KEY, F.spark_partition_id().alias("_part"))
    firsts = placed.groupBy("_part").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    return sorted(tuple(row) for row in firsts.collect())


def _block_of(starts: list[tuple]) -> Column:
    """The number of the last block that starts at or before the row's key, by binary search."""
    keys = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(k, KEY, strict=True)]) for k in starts])
    own = F.struct(*KEY)
    jumps = [1 << i for i in reversed(range(len(starts).bit_length()))]
    step = lambda at, jump: F.when(F.get(keys, at + jump) <= own, at + jump).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), step)


def _with_next(texts: DataFrame, starts: list[tuple], k: int) -> DataFrame:
    """Different texts with their sketch, and the text and sketch of the next one; texts are shuffled once.

    Rows are dealt by blocks of the order. The first row of a block is also lent to the block before it (that of the first block
    to the last one), so the next row is always in the same block.
    """
    last = len(starts) - 1
    is_first = F.struct(*KEY) == F.get(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, KEY, strict=True)]) for s in starts]), F.col("_block"))
    before = F.when(F.col("_block") == 0, last).otherwise(F.col("_block") - 1)
    placed = once(texts.withColumn("_block", _block_of(starts)), "_block")
    here = F.struct(F.col("_block").alias("_block"), F.lit(False).alias("_lent"))
    lent = F.struct(before.alias("_block"), F.lit(True).alias("_lent"))
    dealt = placed.select(
        *KEY, "_id", "_copies", "_text", F.inline(F.when(is_first, F.array(here, lent)).otherwise(F.array(here)))
    ).repartition(len(starts), "_block")
    sketched = once(dealt.withColumn("_own", sketch(F.col("_text"), k)), "_own")
    order = Window.partitionBy("_block").orderBy("_lent", *KEY)
    return sketched.withColumns({"_next_text": F.lead("_text").over(order), "_next_own": F.lead("_own").over(order)}).filter("not _lent")


def edited_likeness(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next and estimates of every document.

    A document is edited by replacing its second half with the start of the next document's text. Null text
    is empty; null ids are last; documents of one id are ordered by text hash; rows equal in id and
    text all get that document's result. A single document is its own next one. An empty table gives an
    empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("_text")
    texts = docs.select(F.col("doc_id").alias("_id"), text)
    hashes = [F.xxhash64(F.lit(i), "_text").alias(f"_hash{i}") for i in (1, 2)]
    texts = once(texts.select("_id", *_order_key(F.col("_id")), *hashes, "_text"), *KEY[2:])
    counts = stage(texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_copies")), "document-keys")
    starts = _block_starts(counts)
    if counts.filter("_copies > 1").isEmpty():
        texts = texts.withColumn("_copies", F.lit(1).cast("long"))
    else:
        # Equal rows become one, combined before the shuffle, so a row that is there very often stays small.
        texts = texts.groupBy("_id", *KEY).agg(F.count(F.lit(1)).alias("_copies"), F.first("_text").alias("_text"))
    if not starts:
        starts = [(False, 0, 0, 0)]
    met = _with_next(texts, starts, k)
    half = F.floor(F.length("_text") / 2).cast("int")
    edit = F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring("_next_text", F.lit(1), half))
    edited = once(met.withColumn("_edited", edit), "_edited")
    sketched = once(edited.withColumn("_new", sketch(F.col("_edited"), k)), "_new")
    own, new = F.col("_own"), F.col("_new")
    result = sketched.select(
        F.col("_id").alias("doc_id"), F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        sketch_text(own).alias("fingerprint"), sketch_text(new).alias("edited_fingerprint"),
        resemblance(own, new, k).alias("near_edited"), resemblance(own, F.col("_next_own"), k).alias("near_next"),
        containment(own, new, k).alias("kept_share"), distinct_shingles(own, k).alias("distinct_shingles"), "_copies",
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return once(result, "near_edited", "near_next", "kept_share").select("*", copies.alias("_copy")).drop("_copy", "_copies")
