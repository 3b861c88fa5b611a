"""Number expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def python_round(value: Column, digits: int) -> Column:
    """Round to the nearest; exact binary ties go to the even digit, as ``round`` does in Python."""
    scaled = value * F.lit(float(2 ** (digits + 1)))
    return F.when(scaled == F.floor(scaled), F.bround(value, digits)).otherwise(
        F.round(value, digits)
    )


def score_band(score: Column) -> Column:
    """Display band of an anomaly score."""
    return (
        F.when(score > 0.75, "critical")
        .when(score > 0.5, "high")
        .when(score > 0.25, "medium")
        .otherwise("low")
    )


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def settled(value: float | None) -> float:
    """A mean or deviation without the last digits, which depend on the order of summation (null: 0)."""
    return float(f"{value or 0.0:.12g}")
