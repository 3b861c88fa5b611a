"""CSV and JSON sinks for features, detections and reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: arrays and structs become JSON text."""
    nested = {name for name, kind in df.dtypes if kind.startswith(("array", "struct", "map"))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header and rows; white space at the ends of a value is kept."""
    _flat(df).write.mode(mode).csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
