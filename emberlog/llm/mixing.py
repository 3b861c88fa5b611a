"""Mixing sources to target weights.

Words are summed per source; every source gets a target share of all words by its weight, but at most
``cap`` times what it has, the excess going to the others by weight. A document is emitted
floor(target / size of the source) times, and once more with the fraction as probability; the draw is a
hash of the document and the seed, turned by its source's shift, so reruns agree.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.frames import SPACE, global_row_numbers
from emberlog.session import stage

WEIGHTS = (5, 2, 1)
CAP = 3
#: Turns of the draws among which each source chooses the one that meets its target best.
SHIFTS = 32


def word_count(text: Column) -> Column:
    """Number of words (null text: 0)."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed, the document's id and its text alone."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target and rate per source, from rows of (source, size).

    Sources take the weights in turn, in code-point order, null last. A source without words has
    target and rate 0. The result has one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_numbers(per, [F.col("source").asc_nulls_last()], "_rank")
    of_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stage(
        ranked.withColumn("_weight", of_rank).withColumn("_most", F.col("source_size") * cap), "source-weights"
    )
    total, weight = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    level, capped = (total / weight if total else 0.0), None
    while total:
        full = F.col("_most") < F.col("_weight") * level
        now = ranked.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if now == capped:
            break
        capped = now
        level = (total - (now[0] or 0)) / now[1] if now[1] else level
    target = F.least(F.col("_most").cast("double"), F.col("_weight") * F.lit(float(level)))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), target / F.col("source_size"))).otherwise(0.0)
    return ranked.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _of_source(rows: DataFrame, rates: DataFrame, source: Column) -> DataFrame:
    """``rows`` with the columns of ``rates`` but the source; null is a source."""
    return rows.withColumn("_source", source).join(
        rates.withColumnRenamed("source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))
    ).drop("_source", "_of")


def _extra(draw: Column, rate: Column, shift: Column) -> Column:
    """1 for the documents that get one copy more; a shift turns all draws of a source round the unit circle."""
    return F.when(F.pmod(draw + shift / float(SHIFTS), F.lit(1.0)) < rate - F.floor(rate), 1).otherwise(0)


def with_shifts(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """``rates`` with ``shift``, from ``sized`` (source, size, _draw).

    Every shift gives each document the fraction as its probability. A source takes the one of SHIFTS by
    which its words come nearest to its target, so that few or very unequal documents do not miss it.
    """
    drawn = _of_source(sized.select("source", "size", "_draw"), rates, F.col("source"))
    missing = F.max(F.col("target") - F.floor("rate") * F.col("source_size"))
    apart = [
        F.abs(F.sum(_extra(F.col("_draw"), F.col("rate"), F.lit(k)) * F.col("size")) - missing) for k in range(SHIFTS)
    ]
    nearest = F.array_min(F.array(*[F.struct(d.alias("apart"), F.lit(k).alias("shift")) for k, d in enumerate(apart)]))
    kept = [F.max(c).alias(c) for c in ("source_size", "target", "rate")]
    return stage(drawn.groupBy("source").agg(*kept, nearest["shift"].alias("shift")), "source-rates")


def copies() -> Column:
    """How often a document with ``_draw`` and its source's ``rate`` and ``shift`` is emitted."""
    return (F.floor("rate") + _extra(F.col("_draw"), F.col("rate"), F.col("shift"))).cast("long")


def mixture_plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, shift, copies and taken of every document.

    Null text has size 0; a null source is a source of its own, the last one. Rows equal in id and text
    get the same draw. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    sized = stage(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            draw(F.col("doc_id"), F.col("text"), seed).alias("_draw"),
        ),
        "sized",
    )
    rates = with_shifts(sized, source_rates(sized, weights, cap))
    planned = _of_source(sized, rates, F.col("source")).withColumn("copies", copies()).drop("_draw")
    return planned.withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 11) -> DataFrame:
    """The mixed corpus: every document as often as its rate and draw say, columns unchanged."""
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    drawn = row.withColumn("_draw", draw(F.col("_row.doc_id"), F.col("_row.text"), seed))
    sized = stage(
        drawn.select(F.col("_row.source").alias("source"), word_count(F.col("_row.text")).alias("size"), "_draw"), "sized"
    )
    rates = with_shifts(sized, source_rates(sized, weights, cap))
    planned = _of_source(drawn, rates, F.col("_row.source"))
    return planned.select("_row", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("_row.*")
