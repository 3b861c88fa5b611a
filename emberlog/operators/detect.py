"""Statistical detectors, votes and detector reports."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.numbers import safe_ratio
from emberlog.functions.once import once
from emberlog.operators.quantiles import exact_quantiles
from emberlog.schema import FEATURE_COLUMNS

Z_THRESHOLD = 2.5
IQR_MULTIPLIER = 1.5
CONFIDENCE_LEVELS = ["HIGH", "MEDIUM", "LOW", "NONE"]


def column_stats(df: DataFrame, columns: list[str]) -> Column:
    """Mean and sample deviation of every column as one scalar struct (a single aggregate pass)."""
    return df.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)],
            *[F.stddev_samp(c).alias(f"std_{i}") for i, c in enumerate(columns)],
        )
    ).scalar()


def max_zscore(
    df: DataFrame, columns: list[str], output: str = "max_zscore", same_rows: DataFrame | None = None
) -> DataFrame:
    """Add the largest absolute z-score over the columns; a constant column scores 0.

    Means and deviations are read from ``same_rows``, where it is given: the same rows in a cheaper frame.
    """
    with_stats = df.withColumn("_stats", column_stats(df if same_rows is None else same_rows, columns))

    def z(index: int, name: str) -> Column:
        mean, std = F.col(f"_stats.mean_{index}"), F.col(f"_stats.std_{index}")
        return F.when(std > 0, F.abs(F.col(name) - mean) / std).otherwise(F.lit(0.0))

    scores = [z(i, c) for i, c in enumerate(columns)]
    largest = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return once(with_stats.withColumn(output, largest).drop("_stats"), output)


def zscore_detector(
    df: DataFrame,
    columns: list[str],
    threshold: float = Z_THRESHOLD,
    flag: str = "anomaly_zscore",
    same_rows: DataFrame | None = None,
) -> DataFrame:
    """Add ``max_zscore`` and a flag for rows above ``threshold`` deviations in any column."""
    return max_zscore(df, columns, same_rows=same_rows).withColumn(flag, F.col("max_zscore") > threshold)


def _quartiles(df: DataFrame, columns: list[str], approximate: bool = False) -> dict[str, tuple[float, float]]:
    """First and third quartile of every column that has values."""
    if approximate:
        marks = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75]) for c in columns]).first()
        return {c: tuple(q) for c, q in zip(columns, marks) if q is not None}
    rows = exact_quantiles(df, columns, [0.25, 0.75]).collect()
    by_place = {(row.feature, row.prob): row.quantile for row in rows}
    return {c: (by_place[c, 0.25], by_place[c, 0.75]) for c in columns if (c, 0.25) in by_place}


def _outside_fences(
    df: DataFrame, columns: list[str], quartiles: dict[str, tuple[float, float]], multiplier: float, flag: str
) -> DataFrame:
    def outside(name: str) -> Column:
        first, third = quartiles.get(name, (0.0, 0.0))
        width = third - first
        if width == 0:
            return F.lit(False)
        low, high = first - multiplier * width, third + multiplier * width
        return F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False))

    return once(df.withColumn(flag, reduce(or_, [outside(c) for c in columns])), flag)


def iqr_detector(
    df: DataFrame,
    columns: list[str],
    multiplier: float = IQR_MULTIPLIER,
    flag: str = "anomaly_iqr",
    approximate: bool = False,
) -> DataFrame:
    """Flag rows outside the quartile fences of any column; columns without spread are skipped.

    Quartiles are exact and computed when this is called, see ``exact_quantiles``;
    ``approximate=True`` takes one sketch pass instead. Stage an input that is costly to compute.
    """
    return _outside_fences(df, columns, _quartiles(df, columns, approximate), multiplier, flag)


def zscore_score(max_z: Column) -> Column:
    """Largest z-score clipped at 5 and scaled to 0-1."""
    return F.bround(F.least(max_z, F.lit(5.0)) / 5.0, 4)


def two_vote_ensemble(
    df: DataFrame,
    columns: list[str],
    z_threshold: float = Z_THRESHOLD,
    iqr_multiplier: float = IQR_MULTIPLIER,
    same_rows: DataFrame | None = None,
) -> DataFrame:
    """z-score and IQR votes: both agree HIGH (an anomaly), one LOW, none NONE.

    All figures over the rows are read from ``same_rows``, where it is given: the same rows in a cheaper frame.
    """
    # Quartiles are taken before the z-scores are added, or every pass of theirs would compute them again.
    quartiles = _quartiles(df if same_rows is None else same_rows, columns)
    scored = zscore_detector(df, columns, z_threshold, same_rows=same_rows)
    flagged = _outside_fences(scored, columns, quartiles, iqr_multiplier, "anomaly_iqr")
    z, iqr = F.col("anomaly_zscore"), F.col("anomaly_iqr")
    return (
        flagged.withColumn("anomaly_score", zscore_score(F.col("max_zscore")))
        .withColumn("confidence", F.when(z & iqr, "HIGH").when(z | iqr, "LOW").otherwise("NONE"))
        .withColumn("is_anomaly", z & iqr)
        .drop("max_zscore")
    )


def three_vote_ensemble(df: DataFrame, z_score_col: str | None = None) -> DataFrame:
    """Votes of ``if_flag``, ``lof_flag`` and ``zscore_flag``: two make an anomaly.

    The score is 0.4 forest + 0.4 outlier factor + 0.2 of ``z_score_col`` (0 when not given).
    """
    votes = reduce(
        lambda a, b: a + b, [F.col(c).cast("int") for c in ("if_flag", "lof_flag", "zscore_flag")]
    )
    extra = F.coalesce(F.col(z_score_col), F.lit(0.0)) if z_score_col else F.lit(0.0)
    combined = 0.4 * F.col("if_score") + 0.4 * F.col("lof_score") + 0.2 * extra
    count = F.col("detector_votes")
    return (
        df.withColumn("detector_votes", votes)
        .withColumn("anomaly_score", F.bround(F.least(F.greatest(combined, F.lit(0.0)), F.lit(1.0)), 4))
        .withColumn(
            "confidence",
            F.when(count == 3, "HIGH").when(count == 2, "MEDIUM").when(count == 1, "LOW").otherwise("NONE"),
        )
        .withColumn("is_anomaly", count >= 2)
    )


def _quality(hit: Column, truth: Column) -> list[Column]:
    return [
        F.count("*").alias("total_events"),
        F.count_if(hit).alias("anomalies_found"),
        F.count_if(hit & truth).alias("true_positives"),
        F.count_if(hit & ~truth).alias("false_positives"),
        F.count_if(~hit & truth).alias("false_negatives"),
        F.count_if(~hit & ~truth).alias("_true_negatives"),
    ]


def _with_ratios(counts: DataFrame, *keys: str) -> DataFrame:
    tp, fp, fn, tn = (
        F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "_true_negatives")
    )
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    both = precision + recall
    f1 = F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))
    return counts.select(
        *keys,
        "total_events", "anomalies_found", "true_positives", "false_positives", "false_negatives",
        F.round(precision, 3).alias("precision"),
        F.round(recall, 3).alias("recall"),
        F.round(f1, 3).alias("f1_score"),
        F.round(safe_ratio(fp, fp + tn), 3).alias("fp_rate"),
    )


def evaluate(df: DataFrame, flag: str = "is_anomaly", severity_col: str = "severity_score") -> DataFrame:
    """Detector quality against the proxy label severity >= HIGH."""
    return _with_ratios(df.agg(*_quality(F.col(flag), F.col(severity_col) >= 3)))


def compare_methods(
    df: DataFrame, flags: dict[str, str], severity_col: str = "severity_score"
) -> DataFrame:
    """Flagged rows, rate in percent, precision and recall per method (label -> flag column)."""
    methods = F.explode(
        F.array(
            *[
                F.struct(F.lit(label).alias("method"), F.col(flag).alias("hit"))
                for label, flag in flags.items()
            ]
        )
    )
    long = df.select((F.col(severity_col) >= 3).alias("truth"), methods.alias("m")).select("truth", "m.*")
    counts = long.groupBy("method").agg(*_quality(F.col("hit"), F.col("truth")))
    return _with_ratios(counts, "method").select(
        "method",
        F.col("anomalies_found").alias("flagged"),
        F.round(F.col("anomalies_found") / F.col("total_events") * 100, 1).alias("rate"),
        "precision",
        "recall",
    )


def top_scored(
    df: DataFrame, n: int = 10, flagged_only: bool = False, key: str = "seq", flag: str = "is_anomaly"
) -> DataFrame:
    """Highest scores, optionally among flagged rows only; ties by key."""
    rows = df.filter(F.col(flag)) if flagged_only else df
    return rows.orderBy(F.desc("anomaly_score"), key).limit(n)


def confidence_breakdown(df: DataFrame) -> DataFrame:
    """Rows per confidence level, levels without rows included."""
    counts = df.agg(*[F.count_if(F.col("confidence") == level).alias(level) for level in CONFIDENCE_LEVELS])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("level_order"), F.lit(level).alias("confidence"), F.col(level).alias("n_events"))
            for i, level in enumerate(CONFIDENCE_LEVELS)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")
