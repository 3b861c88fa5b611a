import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators.forest import fit_and_score, load_and_predict
from emberlog.operators import lof
from emberlog.operators.forest import _grow, average_path
from emberlog.operators.lof import lof_detector, local_outlier_factor
from emberlog.plans.batch import analyse_events, run_ensemble
from emberlog.sources.models import load_forest, save_forest


def cloud(n=600, planted=6, seed=3):
    rng = np.random.default_rng(seed)
    values = np.vstack([rng.normal(0, 1, (n - planted, 3)), rng.normal(0, 1, (planted, 3)) + 12])
    frame = pd.DataFrame(values, columns=["a", "b", "c"])
    frame.insert(0, "seq", range(n))
    return frame


def brute_force_factor(values, k):
    z = (values - values.mean(0)) / values.std(0)
    distance = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    np.fill_diagonal(distance, np.inf)
    index = np.argsort(distance, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(distance, index, axis=1)
    reach = np.maximum(near, near[:, -1][index])
    density = 1 / (reach.mean(1) + 1e-10)
    return density[index].mean(1) / density


@pytest.mark.parametrize(("block", "cells"), [(256, 4096), (24, 4096), (16, 2)])
def test_outlier_factor_equals_brute_force(spark, monkeypatch, block, cells):
    """Also with many cells, and with two cells cut into many rings."""
    monkeypatch.setattr(lof, "TOP_CELLS", cells)
    rng = np.random.default_rng(7)
    values = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(4, 0.1, (100, 3)), [[20, 20, 20]]])
    values[:30] = values[0]
    frame = pd.DataFrame(values, columns=["a", "b", "c"])
    frame.insert(0, "seq", range(len(frame)))
    got = local_outlier_factor(spark.createDataFrame(frame), ["a", "b", "c"], block=block)
    raw = got.orderBy("seq").toPandas()["lof_raw"].to_numpy()
    assert raw == pytest.approx(brute_force_factor(values, 20), rel=1e-9)


def test_outlier_factor_of_equal_and_few_rows(spark):
    same = spark.createDataFrame([(i, 1.0) for i in range(30)], "seq long, a double")
    assert lof_detector(same, ["a"]).filter("lof_score <> 0 OR lof_flag").count() == 0
    assert lof_detector(same.limit(1), ["a"]).count() == 1
    # Fewer rows than neighbours: every other row is a neighbour.
    few = np.array([[0.0], [1.0], [50.0]])
    frame = spark.createDataFrame([(i, float(v[0])) for i, v in enumerate(few)], "seq long, a double")
    raw = local_outlier_factor(frame, ["a"]).orderBy("seq").toPandas()["lof_raw"].to_numpy()
    assert raw == pytest.approx(brute_force_factor(few, 2), rel=1e-9)


def test_forest_finds_planted_rows_and_reloads(spark, tmp_path):
    frame = spark.createDataFrame(cloud())
    scored, model = fit_and_score(frame, ["a", "b", "c"], contamination=0.05)
    rows = scored.toPandas()
    assert rows["if_score"].between(0, 1).all() and rows["if_score"].max() == 1.0
    assert set(rows.nlargest(6, "if_score")["seq"]) == set(range(594, 600))
    assert abs(rows["if_flag"].mean() - 0.05) < 0.01
    assert len(model.nodes) <= 200 * 511

    save_forest(spark, model, str(tmp_path / "model"))
    again = load_forest(spark, str(tmp_path / "model"))
    predicted = load_and_predict(frame, again).toPandas().sort_values("seq")
    assert (predicted["anomaly_score"].to_numpy() == rows.sort_values("seq")["if_score"].to_numpy()).all()
    assert (predicted["is_anomaly"].to_numpy() == rows.sort_values("seq")["if_flag"].to_numpy()).all()
    assert set(predicted["confidence"]) <= {"HIGH", "MEDIUM", "LOW"}


def test_forest_is_deterministic_and_handles_constant_rows(spark):
    frame = spark.createDataFrame(cloud(100, 2))
    first, _ = fit_and_score(frame, ["a", "b", "c"], trees=20)
    second, _ = fit_and_score(frame.repartition(3), ["a", "b", "c"], trees=20)
    assert first.select("seq", "if_score").exceptAll(second.select("seq", "if_score")).isEmpty()
    same = spark.createDataFrame([(i, 1.0) for i in range(10)], "seq long, a double")
    scored, _ = fit_and_score(same, ["a"], trees=5)
    assert scored.filter("if_score <> 0 OR if_flag").count() == 0


def test_vote_and_batch_analysis(spark):
    voted, _ = run_ensemble(spark.createDataFrame(cloud()), ["a", "b", "c"], 0.05)
    rows = voted.toPandas()
    assert set(rows[rows["is_anomaly"]]["seq"]) >= set(range(594, 600))
    assert rows["anomaly_score"].max() <= 0.8
    assert (rows["is_anomaly"] == (rows["detector_votes"] >= 2)).all()

    parsed = spark.createDataFrame(
        [(i, "2026-01-15 10:00:00", "INFO", f"10.0.0.{i % 5}", "session opened", "raw", "json") for i in range(60)]
        + [(60, "2026-01-17 03:00:00", "CRITICAL", "9.9.9.9", "EventID=1102 powershell " * 9, "raw", "json")],
        "seq long, timestamp string, severity string, source_ip string, message string, raw string, format string",
    )
    result = analyse_events(parsed)
    rows = {r.id: r for r in result.events.collect()}
    assert sorted(rows) == list(range(1, 62))
    assert (rows[61].technique_id, rows[61].severity, rows[1].technique_id) == ("T1059.001", "CRITICAL", None)
    found = {r.seq: r for r in result.detections.collect()}
    assert found[60].if_flag and found[60].zscore_flag and found[60].is_anomaly
    assert rows[61].anomaly_score == found[60].anomaly_score >= 0.4


def test_neighbours_are_found_among_few_pairs(spark):
    """Of four times the vectors, a smaller share of all pairs is compared."""
    shares = []
    for n in (1500, 6000):
        frame = spark.createDataFrame(cloud(n))
        shares.append(lof.find_neighbours(lof._vectors(frame, ["a", "b", "c"]), 20, block=64).share)
    assert shares[1] < 0.6 * shares[0] < 0.3


def test_trees_follow_from_seed_tree_and_place():
    rows = np.random.default_rng(2).normal(size=(256, 3))
    nodes = _grow(rows, 42, 5)
    assert nodes == _grow(rows, 42, 5) != _grow(rows, 42, 6)
    inner = [n for n in nodes if n[3] >= 0]
    assert len(nodes) == 2 * len(inner) + 1 and sorted(n[0] for n in nodes) == list(range(len(nodes)))
    assert all(n[5] * 2**20 == int(n[5] * 2**20) for n in nodes)
    assert max(n[5] for n in nodes) <= 8 + average_path(256)


def test_vote_keeps_columns_and_a_given_score(spark):
    frame = spark.createDataFrame(cloud(200, 3)).selectExpr("*", "1.0D AS given", "'x' AS other")
    voted, _ = run_ensemble(frame, ["a", "b", "c"], 0.05, z_score_col="given")
    assert voted.filter("other = 'x'").count() == 200
    assert voted.agg(F.min("anomaly_score")).first()[0] >= 0.2 and "given" not in voted.columns
