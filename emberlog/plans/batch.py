"""From parsed events to the event table: features, three detectors, votes, tags."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.detect import three_vote_ensemble, zscore_detector
from emberlog.operators.features import build_features
from emberlog.operators.forest import ForestModel, fit_and_score
from emberlog.operators.lof import lof_detector
from emberlog.operators.tagging import tag_events
from emberlog.schema import FEATURE_COLUMNS
from emberlog.session import stage
from emberlog.sources.event_table import with_defaults


@dataclass
class Analysis:
    """Results of one batch; all frames share the key ``seq``."""

    features: DataFrame
    detections: DataFrame
    tags: DataFrame
    events: DataFrame
    model: ForestModel


def run_ensemble(
    features: DataFrame,
    columns: list[str] = FEATURE_COLUMNS,
    contamination: float = 0.1,
    z_score_col: str | None = None,
    key: str = "seq",
) -> tuple[DataFrame, ForestModel]:
    """Isolation forest, outlier factor and z-score with the three-way vote.

    Pass a staged frame. Each detector adds its columns to the frame of the one before: the forest scores rows in place, the
    outlier factor is joined by vector, the z-score compares with two figures a column; nothing is joined by key.
    """
    taken = features.withColumnRenamed(z_score_col, "_z_score") if z_score_col else features
    forest, model = fit_and_score(taken, columns, key, contamination)
    scored = zscore_detector(lof_detector(forest, columns, contamination), columns, flag="zscore_flag")
    voted = three_vote_ensemble(scored, "_z_score" if z_score_col else None)
    return voted.drop("if_score", "lof_score", "max_zscore", "_z_score"), model


def analyse_events(parsed: DataFrame, contamination: float = 0.1, keep: tuple[str, ...] = ()) -> Analysis:
    """Run the whole batch over parsed events with a dense ``seq``.

    Tags sit on the same rows as the parsed text, so only the detections are joined by key.
    """
    tags = stage(tag_events(parsed), "tagged-events")
    features = stage(build_features(tags), "features")
    detections, model = run_ensemble(features, contamination=contamination)
    detections = stage(detections, "detections")
    scored = detections.select("seq", "anomaly_score", "is_anomaly", "confidence", "detector_votes")
    events = with_defaults(tags.join(scored, "seq", "left"), keep=keep).withColumn("id", F.col("seq") + 1)
    return Analysis(features, detections, tags, events.withColumn("is_false_positive", F.lit(False)), model)
