"""Keep costly columns from being computed again wherever they are used."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *names: str) -> DataFrame:
    """Evaluate the named columns exactly once per row.

    A filter (also one that a join implies) is otherwise pushed below the projection by repeating
    the column's whole expression, and nested definitions multiply. Rows pass through a one-element
    ``inline``, which filters on its output do not cross.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))
