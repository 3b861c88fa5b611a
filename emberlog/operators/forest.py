"""Isolation forest: trees are grown in parallel tasks from bounded samples, rows scored in batches."""

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions.numbers import settled
from emberlog.operators.quantiles import exact_quantiles
from emberlog.session import stage

# Task functions travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 200
SAMPLE = 256
SEED = 42
# A tree over 256 rows has at most 511 nodes, so the model never exceeds this size.
MAX_NODES_PER_TREE = 2 * SAMPLE - 1
_EULER = 0.5772156649015329
# Expected rows of the pool that all trees draw from.
POOL = 16_384
# Draws are whole numbers below SPAN; paths are multiples of 1 / PATH_UNITS.
SPAN, PATH_UNITS = 2**52, 2**20

_NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double, size int"
)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree over ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    usual = 2.0 * (np.log(np.maximum(safe - 1.0, 1.0)) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, usual))


def _share(*parts: object) -> float:
    """A number in [0, 1) that follows from the parts alone: the first 52 bits of their MD5."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / SPAN


def _draw(*parts: Column) -> Column:
    """The same number of columns, times SPAN."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _grow(rows: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, path) of one tree.

    A split follows from the seed, the tree and the place of its node alone (the children of place p are 2p and 2p + 1), so the
    same trees can be grown anywhere. Paths are multiples of 2^-20: their sums do not depend on any order.
    """
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[tuple] = []
    waiting = [(0, 1, np.arange(len(rows)), 0)]
    next_id = 1
    while waiting:
        node, place, members, depth = waiting.pop()
        part = rows[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(varied) == 0:
            path = depth + float(average_path(len(members)))
            nodes.append((node, -1, 0.0, -1, -1, float(np.rint(path * PATH_UNITS)) / PATH_UNITS))
            continue
        feature = int(varied[int(_share(seed, tree, place, "feature") * len(varied))])
        threshold = float(low[feature] + _share(seed, tree, place, "threshold") * (high[feature] - low[feature]))
        goes_left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, next_id, next_id + 1, 0.0))
        waiting.append((next_id, 2 * place, members[goes_left], depth + 1))
        waiting.append((next_id + 1, 2 * place + 1, members[~goes_left], depth + 1))
        next_id += 2
    return nodes


@dataclass
class ForestModel:
    """Scaler figures and tree nodes. Both are small: at most 200 x 511 nodes."""

    columns: list[str]
    mean: list[float]
    std: list[float]
    nodes: pd.DataFrame
    score_low: float = float("nan")
    score_high: float = float("nan")
    cut: float = float("nan")
    contamination: float = 0.1

    @staticmethod
    def _depths(ordered: pd.DataFrame, offsets: np.ndarray) -> list[int]:
        """The longest way from the root to a leaf, tree by tree; a child comes after its parent."""
        left, right = ordered["left"].to_numpy(), ordered["right"].to_numpy()
        depth = np.zeros(len(ordered), dtype=int)
        base = np.repeat(offsets, np.diff([*offsets, len(ordered)]))
        for node in np.flatnonzero(left >= 0):
            depth[base[node] + left[node]] = depth[base[node] + right[node]] = depth[node] + 1
        return [int(part.max()) for part in np.split(depth, offsets[1:])]

    def raw_score(self, spark: SparkSession) -> Column:
        """Column of 2^(-mean path / expected path): higher is more anomalous."""
        ordered = self.nodes.sort_values(["tree", "node"])
        sizes = ordered.groupby("tree").size().to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        start = np.repeat(offsets, sizes)
        left, right = ordered["left"].to_numpy(), ordered["right"].to_numpy()
        inner = left >= 0
        # A leaf leads to itself, so all rows take the same number of steps and none has to be told apart.
        itself = np.arange(len(ordered))
        sides = np.where(inner, [start + left, start + right], itself)
        packed = spark.sparkContext.broadcast(
            {
                "roots": offsets,
                "steps": self._depths(ordered, offsets),
                "feature": np.where(inner, ordered["feature"].to_numpy(), 0),
                "threshold": ordered["threshold"].to_numpy(),
                "next": np.ascontiguousarray(sides.T).reshape(-1),
                "path": ordered["path"].to_numpy(),
                "expected": float(average_path(ordered["size"].iloc[0])),
                "mean": np.array(self.mean),
                "std": np.array(self.std),
            }
        )

        @F.pandas_udf("double")
        def score(batch: pd.DataFrame) -> pd.Series:
            model = packed.value
            values = batch.to_numpy(dtype=float, na_value=0.0)
            # Log rows repeat a lot: every distinct vector of the batch walks the trees once.
            rows, back = np.unique(values, axis=0, return_inverse=True)
            back = back.reshape(-1)
            rows = (rows - model["mean"]) / model["std"]
            total = np.zeros(len(rows))
            flat, first = rows.reshape(-1), np.arange(len(rows)) * rows.shape[1]
            feature, threshold, following = model["feature"], model["threshold"], model["next"]
            for root, steps in zip(model["roots"], model["steps"], strict=True):
                at = np.full(len(rows), root)
                for _ in range(steps):
                    lower = flat.take(first + feature.take(at)) <= threshold.take(at)
                    at = following.take(2 * at + ~lower)
                total += model["path"].take(at)
            depth = total / len(model["roots"])
            scored = np.exp2(-depth / model["expected"]) if model["expected"] > 0 else np.ones(len(rows))
            return pd.Series(scored[back])

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in self.columns]))


def _sampled(
    df: DataFrame, key: str, columns: list[str], n: int, trees: int, sample: int, seed: int, pool: int = POOL
) -> DataFrame:
    """At most ``sample`` rows per tree, drawn by hash order from one pool of about ``pool`` rows.

    The pool is a hash-chosen share of all rows, so the draws cost the same however many rows there are.
    """
    pooled = df.filter(_draw(F.lit(seed + 1), F.col(key)) < int(min(1.0, pool / n) * SPAN))
    draw = _draw(F.lit(seed), F.col("tree"), F.col(key))
    rows = pooled.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    by_draw = Window.partitionBy("tree").orderBy("draw", key)
    # Twice the wanted share passes the threshold, the exact number is cut by place.
    return (
        rows.withColumn("draw", draw)
        .filter(F.col("draw") < int(min(1.0, 2.0 * sample / min(n, pool)) * SPAN))
        .withColumn("place", F.row_number().over(by_draw))
        .filter(F.col("place") <= sample)
        .select("tree", key, *columns)
    )


def fit_isolation_forest(
    df: DataFrame,
    columns: list[str],
    key: str = "seq",
    contamination: float = 0.1,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> ForestModel:
    """Train on standardised columns (population deviation, constant columns left at 0)."""
    stats = df.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    if not stats["n"]:
        raise ValueError("an isolation forest needs at least one row")
    mean = [settled(stats[f"m{i}"]) for i in range(len(columns))]
    std = [settled(stats[f"s{i}"]) or 1.0 for i in range(len(columns))]

    numeric = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    chosen = _sampled(numeric, key, columns, stats["n"], trees, sample, seed)
    centre, scale = np.array(mean), np.array(std)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values(key)
        rows = (ordered[columns].to_numpy(dtype=float) - centre) / scale
        nodes = _grow(rows, seed, tree)
        frame = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        frame.insert(0, "tree", tree)
        frame["size"] = len(rows)
        return frame

    nodes = chosen.groupBy("tree").applyInPandas(grow, _NODE_SCHEMA).toPandas()
    return ForestModel(list(columns), mean, std, nodes, contamination=contamination)


def _cut_and_range(raw: DataFrame, contamination: float) -> tuple[float, float, float]:
    low, high = raw.agg(F.min("if_raw"), F.max("if_raw")).first()
    # The lowest share of decision values equals the highest share of raw scores.
    cut = exact_quantiles(raw, ["if_raw"], [1.0 - contamination]).first()["quantile"]
    return low, high, cut


def score_isolation_forest(
    df: DataFrame, model: ForestModel, key: str = "seq", training_range: bool = False,
    keep_cut: bool = False,
) -> DataFrame:
    """Add ``if_score`` (0-1, higher is more anomalous) and ``if_flag``.

    The range and the flag limit are taken over the scored rows, or from the model:
    ``training_range`` reuses both and needs no second pass, as on streams; ``keep_cut`` reuses the
    flag limit only.
    """
    scored = df.withColumn("if_raw", model.raw_score(df.sparkSession))
    low, high, cut = model.score_low, model.score_high, model.cut
    if not training_range:
        scored = stage(scored, "forest-scores")
        low, high, batch_cut = _cut_and_range(scored.select("if_raw"), model.contamination)
        cut = cut if keep_cut else batch_cut
    raw = F.col("if_raw")
    width = high - low
    position = (raw - low) / width if width > 0 else F.lit(0.0)
    clipped = F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0))
    return (
        scored.withColumn("if_score", F.bround(clipped, 4))
        .withColumn("if_flag", raw > F.lit(cut))
        .drop("if_raw")
    )


def fit_and_score(
    df: DataFrame, columns: list[str], key: str = "seq", contamination: float = 0.1, seed: int = SEED,
    trees: int = TREES,
) -> tuple[DataFrame, ForestModel]:
    """Train, score the training rows and keep their range and flag limit in the model."""
    model = fit_isolation_forest(df, columns, key, contamination, trees=trees, seed=seed)
    scored = stage(df.withColumn("if_raw", model.raw_score(df.sparkSession)), "forest-scores")
    model.score_low, model.score_high, model.cut = _cut_and_range(scored.select("if_raw"), contamination)
    raw = F.col("if_raw")
    width = model.score_high - model.score_low
    score = F.bround((raw - model.score_low) / width, 4) if width > 0 else F.lit(0.0)
    return (
        scored.withColumn("if_score", score).withColumn("if_flag", raw > model.cut).drop("if_raw"),
        model,
    )


def load_and_predict(df: DataFrame, model: ForestModel, key: str = "seq", training_range: bool = False) -> DataFrame:
    """Score new rows with a saved model: flag, score and confidence by score."""
    scored = score_isolation_forest(df, model, key, training_range, keep_cut=True)
    score = F.col("if_score")
    return (
        scored.withColumnRenamed("if_flag", "is_anomaly")
        .withColumn("confidence", F.when(score > 0.75, "HIGH").when(score > 0.50, "MEDIUM").otherwise("LOW"))
        .withColumnRenamed("if_score", "anomaly_score")
    )
