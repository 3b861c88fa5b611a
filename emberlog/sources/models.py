"""Saved forest models: one Parquet table of scaler figures and one of tree nodes."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emberlog.operators.forest import MAX_NODES_PER_TREE, ForestModel

_SCALER = "position int, name string, mean double, std double"
_LIMITS = "score_low double, score_high double, cut double, contamination double"


def save_forest(spark: SparkSession, model: ForestModel, path: str, mode: str = "overwrite") -> None:
    rows = [
        (i, name, model.mean[i], model.std[i]) for i, name in enumerate(model.columns)
    ]
    limits = [(float(model.score_low), float(model.score_high), float(model.cut), float(model.contamination))]
    spark.createDataFrame(rows, _SCALER).coalesce(1).write.mode(mode).parquet(f"{path}/scaler")
    spark.createDataFrame(limits, _LIMITS).coalesce(1).write.mode(mode).parquet(f"{path}/limits")
    spark.createDataFrame(model.nodes).coalesce(1).write.mode(mode).parquet(f"{path}/nodes")


def load_forest(spark: SparkSession, path: str) -> ForestModel:
    """Read a model back; raises if the path holds none or more nodes than a forest can have."""
    scaler = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()
    limits = spark.read.parquet(f"{path}/limits").first()
    nodes = spark.read.parquet(f"{path}/nodes")
    trees, total = nodes.agg(F.count_distinct("tree"), F.count("*")).first()
    if total > trees * MAX_NODES_PER_TREE:
        raise ValueError(f"{path} holds {total} nodes for {trees} trees")
    return ForestModel(
        [row.name for row in scaler],
        [row["mean"] for row in scaler],
        [row["std"] for row in scaler],
        nodes.toPandas(),
        limits.score_low, limits.score_high, limits.cut, limits.contamination,
    )


_VERSIONS = "version long, folder string"


def publish_forest(spark: SparkSession, model: ForestModel, root: str) -> int:
    """Store a model as the next version below ``root``; readers see it once its row in the version table is written."""
    version = (latest_version(spark, root) or (0, ""))[0] + 1
    folder = f"model-{version}-{uuid.uuid4().hex}"
    save_forest(spark, model, f"{root}/{folder}")
    spark.createDataFrame([(version, folder)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def latest_version(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and folder of the newest version; None while there is none. One small row a version is read."""
    try:
        rows = spark.read.schema(_VERSIONS).parquet(f"{root}/versions")
    except AnalysisException:
        return None
    newest = rows.orderBy(F.desc("version"), "folder").first()
    return (newest.version, f"{root}/{newest.folder}") if newest else None
