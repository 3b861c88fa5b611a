"""Feature job: one numeric row per parsed event."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.constants import parsing as P
from emberlog.functions.numbers import python_round
from emberlog.functions.once import once
from emberlog.functions.text import fold_case, is_external, lookup, search, severity_rank
from emberlog.functions.times import hour_of_day, is_weekend
from emberlog.schema import FEATURE_COLUMNS

ROLLING_ROWS = 20
ROLLING_BLOCK = 65_536
RATE_SECONDS = 60


def address_counts(events: DataFrame, ip_col: str = "source_ip") -> DataFrame:
    """Events and fail rate (HIGH and CRITICAL share) per address, pre-aggregated before the shuffle."""
    severe = F.col("severity").isin("HIGH", "CRITICAL")
    return events.groupBy(ip_col).agg(
        F.count("*").alias("ip_event_count"),
        python_round(F.count_if(severe) / F.count("*"), 4).alias("ip_fail_rate"),
    )


def with_address_counts(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Events with the figures that ``address_counts`` gives their address; a missing one is a key like any other."""
    counts = counts.withColumnRenamed("source_ip", "_counted_ip")
    return events.join(counts, F.col("source_ip").eqNullSafe(F.col("_counted_ip"))).drop("_counted_ip")


def rolling_event_rate(
    events: DataFrame,
    seq_col: str = "seq",
    ip_col: str = "source_ip",
    rows: int = ROLLING_ROWS,
    block: int = ROLLING_BLOCK,
) -> DataFrame:
    """Add how many of the previous ``rows`` rows of the whole list have the same address.

    ``seq_col`` must be dense. The list is cut into blocks of ``block`` rows; the last ``rows`` rows
    of a block are also dealt to the next one, so a busy address never lands in one task.
    """
    return rate_in_blocks(deal_blocks(events, seq_col, rows, block), seq_col, ip_col, rows, block)


def deal_blocks(events: DataFrame, seq_col: str = "seq", rows: int = ROLLING_ROWS, block: int = ROLLING_BLOCK) -> DataFrame:
    """Add ``_block``, the block of ``block`` numbers a row is in; the last ``rows`` of one come again in the next."""
    seq = F.col(seq_col)
    own = F.floor(seq / block)
    near_end = seq % block >= block - rows
    return events.withColumn("_block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))


def rate_in_blocks(
    dealt: DataFrame,
    seq_col: str = "seq",
    ip_col: str = "source_ip",
    rows: int = ROLLING_ROWS,
    block: int = ROLLING_BLOCK,
) -> DataFrame:
    """``rolling_event_rate`` of rows dealt by ``deal_blocks``; the borrowed rows leave again.

    Rows already partitioned by ``_block`` are not moved.
    """
    frame = Window.partitionBy("_block", ip_col).orderBy(seq_col).rangeBetween(-rows, -1)
    return (
        dealt.withColumn("rolling_event_rate", F.count("*").over(frame))
        .filter(F.col("_block") == F.floor(F.col(seq_col) / block))
        .drop("_block")
    )


def timed_event_rate(
    events: DataFrame,
    ts_col: str = "event_ts",
    ip_col: str = "source_ip",
    seconds: int = RATE_SECONDS,
) -> DataFrame:
    """Add the documented rate: events of the address in the last ``seconds`` seconds, own included.

    Events are first counted per address and second, so the window sees at most one row per second.
    The window runs per address and hour, with the last ``seconds`` of an hour dealt to the next.
    """
    table = events.withColumn("_second", F.unix_seconds(F.col(ts_col).cast("timestamp")))
    per_second = table.groupBy(ip_col, "_second").agg(F.count("*").alias("_n"))
    hour = F.floor(F.col("_second") / 3600)
    near_end = F.col("_second") % 3600 >= 3600 - seconds
    frame = Window.partitionBy(ip_col, "_hour").orderBy("_second").rangeBetween(-seconds, 0)
    rates = (
        per_second.withColumn(
            "_hour", F.explode(F.when(near_end, F.array(hour, hour + 1)).otherwise(F.array(hour)))
        )
        .withColumn("timed_event_rate", F.sum("_n").over(frame))
        .filter(F.col("_hour") == hour)
        .select(ip_col, "_second", "timed_event_rate")
    )
    # A missing address is a key like any other; rows without a time stay, without a rate.
    rates = rates.withColumnRenamed(ip_col, "_rate_ip").withColumnRenamed("_second", "_rate_second")
    same = F.col(ip_col).eqNullSafe(F.col("_rate_ip")) & (F.col("_second") == F.col("_rate_second"))
    return table.join(rates, same, "left").drop("_second", "_rate_ip", "_rate_second")


def content_flags(message: Column, folded: Column) -> dict[str, Column]:
    """The five keyword features of a message; ``folded`` is ``fold_case(message)``."""
    patterns = {
        "has_sql_keywords": P.SQL_WORDS,
        "has_exec_keywords": P.EXEC_WORDS,
        "has_c2_keywords": P.C2_WORDS,
        "has_auth_failure": P.AUTH_WORDS,
        "has_privilege_esc": P.PRIVILEGE_WORDS,
    }
    return {
        name: reduce(or_, [search(message, folded, p) for p in pattern.split("|")]).cast("int")
        for name, pattern in patterns.items()
    }


def row_features(events: DataFrame, hour_fallback: int = -1) -> DataFrame:
    """Features that need no other row; safe on streams. Input columns are kept."""
    message = F.coalesce(F.col("message"), F.lit(""))
    folded = once(events.withColumn("_folded", fold_case(message)), "_folded")
    return folded.select(
        *events.columns,
        hour_of_day(F.coalesce(F.col("timestamp"), F.lit("")), hour_fallback).alias("hour_of_day"),
        is_weekend(F.coalesce(F.col("timestamp"), F.lit(""))).alias("is_weekend"),
        severity_rank(F.col("severity")).alias("severity_score"),
        lookup(F.col("format"), P.FORMAT_CODE, 4).alias("format_encoded"),
        is_external(F.col("source_ip")).alias("ip_is_external"),
        F.char_length(message).alias("message_length"),
        *[flag.alias(name) for name, flag in content_flags(message, F.col("_folded")).items()],
    )


def build_features(
    events: DataFrame,
    seq_col: str = "seq",
    hour_fallback: int = -1,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """All 14 features with the label placeholder and the carried metadata columns.

    The per-address counts are aggregated and joined back: the join is a broadcast only while Spark
    finds the counts small at run time, else a sort-merge join that splits a busy address.
    """
    rolled = rolling_event_rate(row_features(events, hour_fallback), seq_col)
    return with_address_counts(rolled, address_counts(events)).select(
        seq_col,
        *keep,
        *FEATURE_COLUMNS,
        F.lit(0).alias("anomaly_label"),
        F.col("source_ip").alias("_source_ip"),
        F.substring("message", 1, 120).alias("_message"),
        F.col("severity").alias("_severity"),
        F.col("format").alias("_format"),
        F.col("timestamp").alias("_timestamp"),
        F.substring("raw", 1, 120).alias("_raw"),
    )


def ml_columns(features: DataFrame, exclude: tuple[str, ...] = ("seq",)) -> list[str]:
    """Numeric feature columns: no leading underscore, not the label, not a key."""
    return [
        name
        for name in features.columns
        if not name.startswith("_") and name != "anomaly_label" and name not in exclude
    ]


def feature_summary(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean and maximum per feature, one row each."""
    columns = columns or [c for c in FEATURE_COLUMNS if c in features.columns]
    stats = features.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"max_{c}") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"avg_{c}").alias("mean"), F.col(f"max_{c}").alias("maximum"))
            for c in columns
        ]
    )
    return stats.select(F.explode(rows).alias("row")).select("row.*")


def severity_distribution(features: DataFrame) -> DataFrame:
    return (
        features.groupBy(F.col("_severity").alias("severity"))
        .agg(F.count("*").alias("n_events"))
        .orderBy(F.desc("n_events"), "severity")
    )


def hour_histogram(features: DataFrame) -> DataFrame:
    return features.groupBy("hour_of_day").agg(F.count("*").alias("n_events")).orderBy("hour_of_day")


def busiest_addresses(features: DataFrame, top: int = 5) -> DataFrame:
    """Addresses with the most events and their fail rate."""
    return (
        features.groupBy(F.col("_source_ip").alias("source_ip"))
        .agg(
            F.max("ip_event_count").alias("ip_event_count"),
            F.max("ip_fail_rate").alias("ip_fail_rate"),
        )
        .orderBy(F.desc("ip_event_count"), "source_ip")
        .limit(top)
    )


def suspicious_events(features: DataFrame) -> DataFrame:
    """Rows with a SQL, execution or command-and-control keyword."""
    return features.filter(
        (F.col("has_sql_keywords") == 1)
        | (F.col("has_exec_keywords") == 1)
        | (F.col("has_c2_keywords") == 1)
    )
