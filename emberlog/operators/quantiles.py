"""Exact order statistics without gathering a column in one task."""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACCURACY = 10_000
# Sketch ranks are off by at most 1/ACCURACY of the rows; the bracket is ten times wider.
_MARGIN = 10 / ACCURACY
# Different values that one task may order.
HOLD = 10_000


def linear_position(prob: float) -> Callable[[int], float]:
    """Position of a linearly interpolated quantile among n sorted values, counted from 0."""
    return lambda n: prob * (n - 1)


@dataclass
class _Cell:
    """A wanted position of one column and the bracket of values known to hold it."""

    column: int
    prob: int
    position: float
    kept: int
    values: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    margin: float = _MARGIN

    @property
    def value(self) -> Column:
        return F.col(f"c{self.column}")

    def within(self) -> Column:
        if self.low is None:
            return self.value.isNotNull()
        return F.coalesce(self.value.between(F.lit(self.low), F.lit(self.high)), F.lit(False))

    def edges(self) -> list[float]:
        """Shares of the bracket's rows between which the position lies."""
        last = max(self.kept - 1, 1)
        lower = (math.floor(self.position) - self.below) / last - self.margin
        upper = (math.ceil(self.position) - self.below) / last + self.margin
        return [min(max(lower, 0.0), 1.0), min(max(upper, 0.0), 1.0)]


def _by_bracket(cells: list[_Cell]) -> list[list[_Cell]]:
    """The cells that look at the same rows of the same column, together."""
    shared: dict[tuple, list[_Cell]] = {}
    for cell in cells:
        shared.setdefault((cell.column, cell.low, cell.high), []).append(cell)
    return list(shared.values())


def _narrow(numeric: DataFrame, cells: list[_Cell]) -> None:
    """Take a sketch inside every bracket, count the proposed bracket and accept it if it holds the rank."""
    groups = _by_bracket(cells)
    sketches = numeric.agg(
        *[
            F.percentile_approx(
                F.when(group[0].within(), group[0].value), [e for cell in group for e in cell.edges()], ACCURACY
            )
            for group in groups
        ]
    ).first()
    proposed = []
    for group, marks in zip(groups, sketches):
        for place, cell in enumerate(group):
            low, high = marks[2 * place], marks[2 * place + 1]
            proposed.append(_Cell(cell.column, cell.prob, cell.position, 0, 0, 0, low, high))
    counts = numeric.agg(
        *[
            figure
            for cell in proposed
            for figure in (
                F.count_if(cell.value < F.lit(cell.low)),
                F.count_if(cell.within()),
                F.approx_count_distinct(F.when(cell.within(), cell.value)),
            )
        ]
    ).first()
    in_order = [cell for group in groups for cell in group]
    for place, (cell, narrow) in enumerate(zip(in_order, proposed)):
        below, kept, values = counts[3 * place:3 * place + 3]
        if below <= math.floor(cell.position) and math.ceil(cell.position) < below + kept:
            cell.low, cell.high, cell.below, cell.kept, cell.values = narrow.low, narrow.high, below, kept, values
            cell.margin = _MARGIN
        elif cell.margin >= 1.0:
            raise ArithmeticError("the input of a quantile changed between two passes")
        else:
            cell.margin *= 4


def _ordered(numeric: DataFrame, cells: list[_Cell]) -> dict[tuple[int, int], tuple[float, float]]:
    """The values at the two ranks around every position; each bracket holds few different values."""
    if not cells:
        return {}

    groups = _by_bracket(cells)

    # Rows in no bracket leave at once, repeated values are counted before the shuffle.
    candidates = [x for i, group in enumerate(groups) for x in (F.lit(i), F.when(group[0].within(), group[0].value))]
    counted = (
        numeric.select(F.stack(F.lit(len(groups)), *candidates).alias("bracket", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy("bracket", "value")
        .agg(F.count("*").alias("n"))
    )
    through = F.sum("n").over(
        Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def wanted(cell: _Cell) -> Column:
        ranks = (math.floor(cell.position) - cell.below, math.ceil(cell.position) - cell.below)
        return F.struct(
            F.lit(cell.column).alias("i"), F.lit(cell.prob).alias("j"),
            F.lit(ranks[0]).cast("long").alias("low_rank"), F.lit(ranks[1]).cast("long").alias("high_rank"),
        )

    entries = [part for i, group in enumerate(groups) for part in (F.lit(i), F.array(*map(wanted, group)))]
    last = F.col("through")
    first = last - F.col("n")

    def at(rank: str) -> Column:
        return F.max(F.when((first <= F.col(rank)) & (F.col(rank) < last), F.col("value")))

    rows = (
        counted.withColumn("through", through)
        .select("value", "n", "through", F.inline(F.create_map(*entries)[F.col("bracket")]))
        .groupBy("i", "j")
        .agg(at("low_rank").alias("low"), at("high_rank").alias("high"))
        .collect()
    )
    return {(row.i, row.j): (row.low, row.high) for row in rows}


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    positions: list[Callable[[int], float]] | None = None,
    hold: int = HOLD,
) -> DataFrame:
    """One row per column and probability: ``feature``, ``prob``, ``quantile``; none for empty columns.

    A bracket around every wanted rank starts as the whole column; a column of few different values is
    counted and ordered at once. While a bracket holds more than about ``hold`` different values, a percentile sketch of the rows inside proposes a narrower one and a
    second pass counts the rows below and inside; a proposal that misses the rank is widened and taken
    again. Each round keeps about two thousandths of a bracket's rows, so no step orders more than
    ``hold`` values however long the input is. ``positions`` replaces the linear positions by other
    functions of the row count. Runs jobs when called: stage an input that is costly to compute.
    """
    places = positions or [linear_position(p) for p in probs]
    numeric = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    figures = numeric.agg(
        *[F.count(f"c{i}") for i in range(len(columns))], *[F.approx_count_distinct(f"c{i}") for i in range(len(columns))]
    ).first()
    sizes, values = figures[:len(columns)], figures[len(columns):]
    cells = [
        _Cell(i, j, float(places[j](n)), n, values[i]) for i, n in enumerate(sizes) if n for j in range(len(probs))
    ]
    wide = [cell for cell in cells if cell.values > hold]
    while wide:
        _narrow(numeric, wide)
        wide = [cell for cell in wide if cell.values > hold]
    single = [cell for cell in cells if cell.low is not None and cell.low == cell.high]
    found = {(cell.column, cell.prob): (cell.low, cell.high) for cell in single}
    found.update(_ordered(numeric, [cell for cell in cells if (cell.column, cell.prob) not in found]))
    rows = []
    for cell in cells:
        low, high = found[cell.column, cell.prob]
        part = cell.position - math.floor(cell.position)
        rows.append((columns[cell.column], float(probs[cell.prob]), low + (high - low) * part))
    return df.sparkSession.createDataFrame(rows, "feature string, prob double, quantile double")
