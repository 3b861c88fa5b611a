"""Local outlier factor with exact neighbours, spread over bounded blocks.

Rows collapse to distinct vectors with a multiplicity, numbered in the order of their values. A k-d tree over a sample deals
them to cells, and cells that are too large are cut into rings around their centre, so blocks have a fixed size however many vectors
there are. The own block bounds a vector's k-distance; boxes and rings tell which other blocks can hold a nearer neighbour,
and it meets only those. Visitors of a block come in chunks: no task ever holds more than a block and a chunk. Nothing is
approximated.
"""

import heapq
import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions.numbers import settled
from emberlog.operators.quantiles import exact_quantiles
from emberlog.operators.ranking import row_numbers
from emberlog.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEIGHBOURS = 20
#: Vectors per block, visitors that meet a block in one task, visitors that look through the rings of a cell in one task.
BLOCK, VISITORS, NARROWED = 256, 2_048, 16_384
#: Cells of the tree (its boxes go to every task: some MB) and sampled vectors per cell; beyond, rings take over.
TOP_CELLS, SAMPLED_PER_CELL = 4_096, 16


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences so that equal vectors get exactly 0."""
    total = np.zeros((len(a), len(b)))
    for dim in range(a.shape[1]):
        total += (a[:, dim, None] - b[None, :, dim]) ** 2
    return np.sqrt(total)


def _nearest(distance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Column indexes and distances of the ``count`` nearest per row, nearest first; ties by column."""
    count = min(count, distance.shape[1])
    part = np.sort(np.argpartition(distance, count - 1, axis=1)[:, :count], axis=1)
    near = np.take_along_axis(distance, part, axis=1)
    last = near.max(axis=1)
    for row in np.flatnonzero((distance <= last[:, None]).sum(axis=1) > count):
        tied = np.flatnonzero(distance[row] <= last[row])
        part[row] = np.sort(tied[np.argsort(distance[row, tied], kind="stable")[:count]])
        near[row] = distance[row, part[row]]
    order = np.argsort(near, axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1), np.take_along_axis(near, order, axis=1)


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct standardised vectors (population deviation, constant columns 0) with multiplicity."""
    stats = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = [
        (F.col(c) - settled(stats[f"m{i}"])) / (settled(stats[f"s{i}"]) or 1.0)
        for i, c in enumerate(columns)
    ]
    counted = df.groupBy(*columns).agg(F.count("*").alias("mult"))
    # Numbers follow the values, so that no result depends on where a row was read.
    numbered = row_numbers(counted, [F.col(c) for c in columns], "vid")
    return stage(numbered.select(*columns, F.array(*scaled).alias("v"), "mult", "vid"), "lof-vectors")


@dataclass
class _Tree:
    """A k-d tree: inner nodes split a dimension at a value, leaves are the cells."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray

    def cells_of(self, values: np.ndarray) -> np.ndarray:
        at = np.zeros(len(values), dtype=np.int64)
        active = np.flatnonzero(self.dim[at] >= 0)
        while len(active):
            here = at[active]
            lower = values[active, self.dim[here]] <= self.cut[here]
            at[active] = np.where(lower, self.left[here], self.right[here])
            active = active[self.dim[at[active]] >= 0]
        return at


def _grow_tree(sample: np.ndarray, cells: int) -> _Tree:
    """Median splits of the widest dimension, the largest cell first, until there are ``cells`` of them."""
    nodes, heap = [[-1, 0.0, -1, -1]], [(-len(sample), 0, np.arange(len(sample)))]
    centres, left_over = {}, cells - 1
    while heap:
        _, node, members = heapq.heappop(heap)
        part = sample[members]
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(sample.shape[1])
        if left_over <= 0 or len(part) < 2 or not spread.any():
            centres[node] = part.mean(axis=0) if len(part) else np.zeros(sample.shape[1])
            continue
        dim = int(np.argmax(spread))
        cut = float(np.median(part[:, dim]))
        if cut == part[:, dim].max():
            cut = float(part[part[:, dim] < cut, dim].max())
        lower = part[:, dim] <= cut
        nodes[node] = [dim, cut, len(nodes), len(nodes) + 1]
        for side in (members[lower], members[~lower]):
            heapq.heappush(heap, (-len(side), len(nodes), side))
            nodes.append([-1, 0.0, -1, -1])
        left_over -= 1
    dim, cut, left, right = (np.array(column) for column in zip(*nodes, strict=True))
    centre = np.array([centres.get(i, np.zeros(sample.shape[1])) for i in range(len(nodes))])
    return _Tree(dim.astype(int), cut.astype(float), left.astype(int), right.astype(int), centre)


def _tree(vectors: DataFrame, n: int, block: int) -> _Tree:
    """A tree over a hash-chosen sample: about n / block cells, at most TOP_CELLS; larger cells are cut into rings."""
    cells = int(min(TOP_CELLS, max(1, math.ceil(n / block))))
    wanted = cells * SAMPLED_PER_CELL
    span = 2**31
    draw = F.pmod(F.xxhash64("vid"), F.lit(span))
    # A hash threshold keeps twice the wanted number before the ordered limit.
    rows = vectors.filter(draw <= int(min(1.0, 2.0 * wanted / n) * span)).orderBy(draw, "vid").limit(wanted).select("v").collect()
    if not rows:
        rows = vectors.orderBy("vid").limit(1).select("v").collect()
    return _grow_tree(np.array([row.v for row in rows], dtype=float), cells)


def _in_blocks(vectors: DataFrame, tree: _Tree, block: int) -> tuple[DataFrame, DataFrame]:
    """Vectors with their block (cell, sub), and one row per block: its box, its ring around the centre, its weight.

    A cell of at least two blocks is cut into equal rings by the distance to its centre. No ring is smaller than ``block``: a
    remainder of a few vectors could not bound their k-distances, and they would meet all other blocks.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def assign(batches):
        known = shared.value
        for batch in batches:
            values = np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), -1)
            cell = known.cells_of(values)
            ring = np.sqrt(((values - known.centre[cell]) ** 2).sum(axis=1))
            yield batch.assign(cell=cell.astype(np.int32), ring=ring)

    placed = vectors.select("vid", "v", "mult").mapInPandas(assign, "vid long, v array<double>, mult long, cell int, ring double")
    ranked = row_numbers(placed, [F.col("cell"), F.col("ring"), F.col("vid")], "place")
    starts = ranked.groupBy("cell").agg(F.min("place").alias("start"), F.count("*").alias("held"))
    rings = F.greatest(F.lit(1), F.floor(F.col("held") / block))
    sub = F.floor((F.col("place") - F.col("start")) * rings / F.col("held")).cast("int")
    # At most one row per cell of the tree.
    members = ranked.join(F.broadcast(starts), "cell").withColumn("sub", sub).drop("place", "start", "held")
    dims = len(tree.centre[0])
    blocks = members.groupBy("cell", "sub").agg(
        F.array(*[F.min(F.col("v")[i]) for i in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("v")[i]) for i in range(dims)]).alias("high"),
        F.min("ring").alias("inner"), F.max("ring").alias("outer"), F.sum("mult").alias("weight"), F.count("*").alias("n"),
    )
    return members.drop("ring"), stage(blocks, "lof-blocks")


def _from_boxes(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance of every vector to every box."""
    total = np.zeros((len(values), len(low)))
    for dim in range(values.shape[1]):
        x = values[:, dim, None]
        total += np.maximum(np.maximum(low[None, :, dim] - x, x - high[None, :, dim]), 0.0) ** 2
    return np.sqrt(total)


def _within_boxes(values: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """A distance within which every vector has ``k`` neighbours, as whole boxes lie within it; infinite if there are too few."""
    total = np.zeros((len(values), len(low)))
    for dim in range(values.shape[1]):
        x = values[:, dim, None]
        total += np.maximum(np.abs(x - low[None, :, dim]), np.abs(x - high[None, :, dim])) ** 2
    order = np.argsort(total, axis=1, kind="stable")
    enough = np.cumsum(weight[order], axis=1) - 1 >= k
    last = np.sqrt(np.take_along_axis(total, order, axis=1))[np.arange(len(values)), enough.argmax(axis=1)]
    return np.where(enough.any(axis=1), last, np.inf)


def _array(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _visits(members: DataFrame, blocks: DataFrame, tree: _Tree, k: int) -> DataFrame:
    """place (of a block), vid, v, bound: the blocks that may hold one of the ``k`` nearest of a vector."""
    spark = members.sparkSession
    # One box per cell of the tree, so at most TOP_CELLS rows.
    cells = blocks.groupBy("cell").agg(
        F.array(*[F.min(F.col("low")[i]) for i in range(len(tree.centre[0]))]).alias("low"),
        F.array(*[F.max(F.col("high")[i]) for i in range(len(tree.centre[0]))]).alias("high"), F.count("*").alias("subs"), F.sum("weight").alias("weight"),
    ).toPandas()
    shared = spark.sparkContext.broadcast((cells["cell"].to_numpy(), _array(cells["low"]), _array(cells["high"]), cells["weight"].to_numpy()))

    def route(group: pd.DataFrame) -> pd.DataFrame:
        """Bound the k-distance within the own block, then list the cells that may hold nearer ones."""
        group = group.sort_values("vid", ignore_index=True)
        names, low, high, weight = shared.value
        values, mult = _array(group["v"]), group["mult"].to_numpy()
        index, near = _nearest(_distances(values, values), k + 1)
        enough = np.cumsum(mult[index], axis=1) - 1 >= k
        bound = np.where(enough.any(axis=1), near[np.arange(len(near)), enough.argmax(axis=1)], np.inf)
        for lost in np.array_split(np.flatnonzero(np.isinf(bound)), 1 + np.isinf(bound).sum() // 512):
            bound[lost] = _within_boxes(values[lost], low, high, weight, k)
        bound = bound * (1 + 1e-9) + 1e-12
        found = [_from_boxes(values[i:i + 512], low, high) <= bound[i:i + 512, None] for i in range(0, len(values), 512)]
        return pd.DataFrame({"vid": group["vid"], "v": group["v"], "bound": bound, "cells": [list(names[row]) for part in found for row in part]})

    routed = stage(
        _dealt(members, "cell", "sub").groupBy("cell", "sub").applyInPandas(route, "vid long, v array<double>, bound double, cells array<int>"),
        "lof-routes",
    )
    visitors = routed.select("vid", "v", "bound", F.explode("cells").alias("cell"))
    if int(cells["subs"].max()) == 1:
        return visitors.select((F.col("cell").cast("long") * 2**31).alias("place"), "vid", "v", "bound")
    centre = spark.sparkContext.broadcast(tree.centre)

    def narrow(seeking: pd.DataFrame, holding: pd.DataFrame) -> pd.DataFrame:
        """Of the blocks of one cell, those whose box and ring come near enough."""
        if not len(seeking) or not len(holding):
            return pd.DataFrame({"place": [], "vid": [], "v": [], "bound": []}).astype({"place": "int64", "vid": "int64"})
        values, bound = _array(seeking["v"]), seeking["bound"].to_numpy()[:, None]
        place = int(holding["cell"].iloc[0]) * 2**31 + holding["sub"].to_numpy().astype(np.int64)
        away = np.sqrt(((values - centre.value[int(holding["cell"].iloc[0])]) ** 2).sum(axis=1))[:, None]
        near = _from_boxes(values, _array(holding["low"]), _array(holding["high"])) <= bound
        near &= (away - holding["outer"].to_numpy() <= bound) & (holding["inner"].to_numpy() - away <= bound)
        row, column = np.nonzero(near)
        found = seeking.iloc[row]
        return pd.DataFrame({"place": place[column], "vid": found["vid"].to_numpy(), "v": found["v"].tolist(), "bound": found["bound"].to_numpy()})

    seekers, held = _chunked(visitors, blocks, "cell", NARROWED)
    return stage(
        seekers.groupBy("cell", "chunk").cogroup(held.groupBy("cell", "chunk")).applyInPandas(
            narrow, "place long, vid long, v array<double>, bound double"
        ),
        "lof-visits",
    )


def _chunked(visitors: DataFrame, held: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Visitors of a key in chunks of about ``size``, and what is held there copied to every chunk."""
    chunks = visitors.groupBy(key).agg(F.ceil(F.count("*") / size).alias("chunks"))
    chunk = F.pmod(F.xxhash64("vid", key), F.col("chunks")).alias("chunk")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    return (
        _dealt(visitors.join(chunks, key).select("*", chunk).drop("chunks"), key, "chunk"),
        _dealt(held.join(chunks, key).select("*", copies).drop("chunks"), key, "chunk"),
    )


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys over all partitions: few bytes here mean much work, so they are not to be coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@dataclass
class Neighbours:
    """vid, near, distance, weight rows; ``pairs`` vectors were compared of ``all_pairs``."""

    rows: DataFrame
    pairs: int
    all_pairs: int

    @property
    def share(self) -> float:
        return self.pairs / max(self.all_pairs, 1)


def find_neighbours(vectors: DataFrame, k: int, block: int = BLOCK) -> Neighbours:
    """Exactly ``k`` neighbours per vector, counted with multiplicity, nearest first, ties by the order of the vectors.

    Copies of the vector itself are neighbours at distance 0; the last neighbour counts in part.
    """
    n = vectors.count()
    tree = _tree(vectors, n, block)
    members, blocks = _in_blocks(vectors, tree, block)
    visitors = _visits(members, blocks, tree, k)
    place = F.col("cell").cast("long") * 2**31 + F.col("sub")
    sizes = blocks.select(place.alias("place"), "n")
    pairs = visitors.groupBy("place").agg(F.count("*").alias("visits")).join(sizes, "place").agg(F.sum(F.col("visits") * F.col("n"))).first()[0]
    seekers, held = _chunked(visitors, members.select(place.alias("place"), "vid", "v", "mult"), "place", VISITORS)

    def meet(seeking: pd.DataFrame, holding: pd.DataFrame) -> pd.DataFrame:
        if not len(seeking) or not len(holding):
            return pd.DataFrame({"vid": [], "near": [], "distance": [], "mult": []}).astype(
                {"vid": "int64", "near": "int64", "mult": "int64"}
            )
        holding = holding.sort_values("vid", ignore_index=True)
        index, near = _nearest(_distances(_array(seeking["v"]), _array(holding["v"])), k + 1)
        row, column = np.nonzero(near <= seeking["bound"].to_numpy()[:, None])
        chosen = index[row, column]
        return pd.DataFrame(
            {
                "vid": seeking["vid"].to_numpy()[row],
                "near": holding["vid"].to_numpy()[chosen],
                "distance": near[row, column],
                "mult": holding["mult"].to_numpy()[chosen],
            }
        )

    met = (
        seekers.groupBy("place", "chunk")
        .cogroup(held.groupBy("place", "chunk"))
        .applyInPandas(meet, "vid long, near long, distance double, mult long")
    )
    others = F.when(F.col("near") == F.col("vid"), F.col("mult") - 1).otherwise(F.col("mult"))
    by_distance = Window.partitionBy("vid").orderBy("distance", "near").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = (
        met.withColumn("mult", others)
        .filter("mult > 0")
        .withColumn("before", F.sum("mult").over(by_distance) - F.col("mult"))
        .filter(F.col("before") < k)
        .select("vid", "near", "distance", F.least("mult", F.lit(k) - F.col("before")).alias("weight"))
    )
    return Neighbours(rows, int(pairs or 0), n * n)


def nearest_neighbours(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The rows of ``find_neighbours``."""
    return find_neighbours(vectors, k, block).rows


def local_outlier_factor(
    df: DataFrame, columns: list[str], neighbours: int = NEIGHBOURS, block: int = BLOCK
) -> DataFrame:
    """Add ``lof_raw``: mean local density of the neighbours over the row's own.

    Density is 1 / (mean reach distance + 1e-10). Rows with equal vectors get equal values.
    """
    numeric = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(columns)])
    axes = [f"_x{i}" for i in range(len(columns))]
    vectors = _vectors(numeric, axes)
    n_rows = vectors.agg(F.sum("mult")).first()[0] or 0
    if n_rows < 2:
        return df.withColumn("lof_raw", F.lit(1.0))
    k = int(min(neighbours, n_rows - 1))
    near = stage(nearest_neighbours(vectors, k, block), "lof-neighbours")

    k_distance = near.groupBy(F.col("vid").alias("near")).agg(F.max("distance").alias("k_distance"))
    reach = F.greatest("distance", "k_distance")
    density = stage(
        near.join(k_distance, "near")
        .groupBy("vid")
        .agg((F.lit(1.0) / (F.sum(F.col("weight") * reach) / k + 1e-10)).alias("density")),
        "lof-density",
    )
    around = density.select(F.col("vid").alias("near"), F.col("density").alias("near_density"))
    factor = (
        near.join(around, "near")
        .groupBy("vid")
        .agg((F.sum(F.col("weight") * F.col("near_density")) / k).alias("around"))
        .join(density, "vid")
        .select("vid", (F.col("around") / F.col("density")).alias("lof_raw"))
    )
    scores = vectors.select("vid", *axes).join(factor, "vid").drop("vid")
    return numeric.join(scores, axes).drop(*axes)


def lof_detector(
    df: DataFrame,
    columns: list[str],
    contamination: float = 0.1,
    neighbours: int = NEIGHBOURS,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``lof_score`` (0-1) and ``lof_flag`` (the top ``contamination`` share)."""
    scored = stage(local_outlier_factor(df, columns, neighbours, block), "lof-scores")
    low, high = scored.agg(F.min("lof_raw"), F.max("lof_raw")).first()
    if low is None:
        return scored.withColumn("lof_score", F.lit(0.0)).withColumn("lof_flag", F.lit(False)).drop("lof_raw")
    cut = exact_quantiles(scored.select("lof_raw"), ["lof_raw"], [1.0 - contamination]).first()["quantile"]
    raw = F.col("lof_raw")
    score = F.bround((raw - low) / (high - low), 4) if high > low else F.lit(0.0)
    return scored.withColumn("lof_score", score).withColumn("lof_flag", raw > cut).drop("lof_raw")
