"""Queries over the event table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.constants.parsing import SEVERITY_RANK
from emberlog.functions.numbers import score_band
from emberlog.operators.quantiles import exact_quantiles

SEVERITIES = list(SEVERITY_RANK)


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """Newest events; false positives are not hidden."""
    return events.orderBy(F.desc("id")).limit(limit)


def events_by_severity(events: DataFrame, severity: str, limit: int = 100) -> DataFrame:
    """Newest events of a severity without false positives."""
    level = severity.upper()
    if level not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}, not {severity!r}")
    return (
        events.filter((F.col("severity") == level) & ~F.col("is_false_positive"))
        .orderBy(F.desc("id"))
        .limit(limit)
    )


def anomalies(events: DataFrame, limit: int = 50) -> DataFrame:
    """Anomalies without false positives, highest score first, newest first among equals."""
    return (
        events.filter(F.col("is_anomaly") & ~F.col("is_false_positive"))
        .orderBy(F.desc("anomaly_score"), F.desc("id"))
        .limit(limit)
    )


def metrics(events: DataFrame) -> DataFrame:
    """One row of summary figures; false positives are included in all counts.

    One scan: counts per address and technique first, then that much smaller result by address, by technique and in
    total. Most frequent values: ties go to the smaller value, NULL first.
    """
    is_anomaly = F.col("is_anomaly")
    pairs = events.groupBy("source_ip", "technique_id").agg(
        F.count("*").alias("n"),
        F.count_if(is_anomaly).alias("anomalies"),
        F.count_if(F.col("is_false_positive")).alias("false_positives"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count("technique_id").alias("tagged"),
        F.sum(F.when(is_anomaly, F.col("anomaly_score"))).alias("score"),
        F.count(F.when(is_anomaly, F.col("anomaly_score"))).alias("scored"),
    )
    counts = ["n", "anomalies", "false_positives", "critical", "high", "tagged", "score", "scored"]
    sets = pairs.groupingSets(
        [[F.col("source_ip")], [F.col("technique_id")], []], F.col("source_ip"), F.col("technique_id")
    ).agg(*[F.sum(c).alias(c) for c in counts], F.grouping("source_ip").alias("no_ip"), F.grouping("technique_id").alias("no_technique"))
    overall = (F.col("no_ip") == 1) & (F.col("no_technique") == 1)

    def total(name: str) -> Column:
        return F.coalesce(F.max(F.when(overall, F.col(name))), F.lit(0)).alias(name)

    def most_frequent(name: str, rows: Column) -> Column:
        return F.min(F.when(rows, F.struct((-F.col("n")).alias("order"), F.col(name).alias("value"))))["value"]

    one = sets.agg(
        *[total(c) for c in counts],
        most_frequent("source_ip", F.col("no_ip") == 0).alias("top_attacker_ip"),
        most_frequent("technique_id", (F.col("no_technique") == 0) & F.col("technique_id").isNotNull()).alias("top_technique"),
    )
    rate = F.when(F.col("n") > 0, F.round(F.col("tagged") / F.col("n") * 100, 1)).otherwise(F.lit(0.0))
    mean = F.when(F.col("scored") > 0, F.col("score") / F.col("scored")).otherwise(F.lit(0.0))
    return one.select(
        F.col("n").alias("total_events"), F.col("anomalies").alias("total_anomalies"),
        F.col("false_positives").alias("false_positives_blocked"), F.col("critical").alias("critical_events"),
        F.col("high").alias("high_events"), F.col("tagged").alias("mitre_tagged"), rate.alias("mitre_tag_rate"),
        F.round(mean, 3).alias("avg_anomaly_score"), "top_attacker_ip", "top_technique",
    )


def top_ips(events: DataFrame, limit: int = 10) -> DataFrame:
    """Most active addresses with anomaly count and highest score."""
    return (
        events.groupBy(F.col("source_ip").alias("ip"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("is_anomaly")).alias("anomalies"),
            F.max("anomaly_score").alias("max_score"),
        )
        .orderBy(F.desc("total"), "ip")
        .limit(limit)
    )


def metrics_with_top_ips(events: DataFrame, limit: int = 5) -> DataFrame:
    """The metrics row with the top addresses as an array of structs, most active first."""
    ranked = top_ips(events, limit).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("o"), "ip", "total", "anomalies", "max_score")))
        .alias("rows")
    ).select(
        F.transform(
            "rows", lambda r: F.struct(r["ip"].alias("ip"), r["total"].alias("total"),
                                       r["anomalies"].alias("anomalies"), r["max_score"].alias("max_score"))
        )
    )
    return metrics(events).withColumn("top_ips", ranked.scalar())


def dashboard_filter(events: DataFrame, tab: str = "ALL", search: str = "", limit: int = 80) -> DataFrame:
    """Rows of a dashboard tab (ALL, CRITICAL, HIGH, anomaly) that contain the search text.

    Message and technique ignore case, the address does not.
    """
    if tab in ("CRITICAL", "HIGH"):
        rows = events.filter(F.col("severity") == tab)
    elif tab == "anomaly":
        rows = events.filter("is_anomaly")
    elif tab == "ALL":
        rows = events
    else:
        raise ValueError(f"unknown tab {tab!r}")
    if search:
        text = search.lower()
        rows = rows.filter(
            F.lower(F.coalesce("message", F.lit(""))).contains(text)
            | F.coalesce("source_ip", F.lit("")).contains(text)
            | F.lower(F.coalesce("technique_id", F.lit(""))).contains(text)
        )
    return rows.orderBy(F.desc("id")).limit(limit)


def band_histogram(events: DataFrame) -> DataFrame:
    """Events per score band."""
    band = score_band(F.coalesce("anomaly_score", F.lit(0.0)))
    return events.groupBy(band.alias("band")).agg(F.count("*").alias("n_events")).orderBy("band")


def relative_bars(top: DataFrame) -> DataFrame:
    """Each top address's share of the largest count, in percent."""
    largest = top.agg(F.greatest(F.max("total"), F.lit(1))).scalar()
    return top.withColumn("bar_percent", F.col("total") / largest * 100)


def top_suspicious(
    scores: DataFrame, events: DataFrame, tags: DataFrame, floor: float = 0.1,
    inclusive: bool = False, top: int = 10, key: str = "seq",
) -> DataFrame:
    """Highest-scored events above ``floor`` with severity, technique and message.

    The score filter comes before the joins, and only the winners' texts are carried.
    """
    above = F.col("anomaly_score") >= floor if inclusive else F.col("anomaly_score") > floor
    best = scores.filter(above).select(key, "anomaly_score", "is_anomaly").orderBy(
        F.desc("anomaly_score"), key
    ).limit(top)
    return (
        best.join(events.select(key, "severity", "message"), key)
        .join(tags.select(key, "technique_id"), key)
        .select(
            key, "anomaly_score", "is_anomaly", "severity",
            F.coalesce("technique_id", F.lit("NONE")).alias("technique_id"), "message",
        )
        .orderBy(F.desc("anomaly_score"), key)
    )


def severity_breakdown(events: DataFrame) -> DataFrame:
    """Events per severity in fixed order, levels without events included."""
    counts = events.agg(*[F.count_if(F.col("severity") == level).alias(level) for level in SEVERITIES])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("level_order"), F.lit(level).alias("severity"), F.col(level).alias("n_events"))
            for i, level in enumerate(SEVERITIES)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def index_percentiles(df: DataFrame, column: str) -> DataFrame:
    """p50 and p95 by index in the sorted values: n // 2 and min(int(0.95 n), n - 1)."""
    kind = df.schema[column].dataType
    rows = exact_quantiles(
        df, [column], [0.5, 0.95],
        [lambda n: n // 2, lambda n: min(int(n * 0.95), n - 1)],
    )
    return rows.agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).cast(kind).alias("p50"),
        F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).cast(kind).alias("p95"),
    )
