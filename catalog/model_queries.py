"""Trained detectors over the given tables; their SQL grows the same trees and compares all pairs."""

from pyspark.sql import functions as F

from catalog import base
from catalog.detection_queries import quality_sql
from catalog.duck_base import FEATURES, over, zscore
from catalog.duck_models import VOTED, forest as forest_sql, outlier_factor, standardised
from catalog.registry import query
from emberlog.operators import forest, lof
from emberlog.operators.detect import evaluate
from emberlog.plans.batch import analyse_events, run_ensemble
from emberlog.schema import FEATURE_COLUMNS
from emberlog.session import new_stage_path, stage
from emberlog.sources.models import load_forest, save_forest


_FOREST = forest_sql("features", "seq", FEATURE_COLUMNS, 0.1)
_FACTOR = outlier_factor("features", "seq", FEATURE_COLUMNS, 0.1)
_VOTE = (zscore(FEATURE_COLUMNS), _FOREST, _FACTOR, VOTED)
# Order and line number alone do not tell the given lines apart. Valid in Spark SQL and DuckDB.
_ITEM_KEY = "concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"
_ITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("isolation_forest", over("features", "SELECT k AS seq, if_score, if_flag FROM forest", _FOREST))
def isolation_forest(spark, sf):
    scored, _ = forest.fit_and_score(base.features(spark, sf), FEATURE_COLUMNS)
    return scored.select("seq", "if_score", "if_flag")


@query("isolation_forest_of_lineitem", f"""
    WITH {forest_sql("lineitem", _ITEM_KEY, _ITEM_COLUMNS, 0.05)}
    SELECT l_orderkey, l_linenumber, if_score, if_flag FROM lineitem JOIN forest ON k = {_ITEM_KEY}""")
def isolation_forest_of_lineitem(spark, sf):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = base.even_table(spark, sf, "lineitem", *names, *_ITEM_COLUMNS).withColumn("key", F.expr(_ITEM_KEY))
    scored, _ = forest.fit_and_score(rows, _ITEM_COLUMNS, key="key", contamination=0.05)
    return scored.select("l_orderkey", "l_linenumber", "if_score", "if_flag")


@query("saved_forest_predictions", over(
    "features", """SELECT k AS seq, if_score AS anomaly_score, if_flag AS is_anomaly,
        CASE WHEN if_score > 0.75 THEN 'HIGH' WHEN if_score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM forest""", _FOREST,
))
def saved_forest_predictions(spark, sf):
    """Model written, read back and applied to the same rows."""
    features = base.features(spark, sf)
    _, model = forest.fit_and_score(features, FEATURE_COLUMNS)
    path = new_stage_path(spark, "model")
    save_forest(spark, model, path)
    predicted = forest.load_and_predict(features, load_forest(spark, path))
    return predicted.select("seq", "anomaly_score", "is_anomaly", "confidence")


@query("saved_forest_agrees", over(
    "features", "SELECT count(*) AS n_rows, count(if_score) AS equal_scores, count(if_flag) AS equal_flags, min(if_score) AS lowest, max(if_score) AS highest FROM forest",
    _FOREST,
))
def saved_forest_agrees(spark, sf):
    """A saved model scores the training rows as the fresh one did."""
    features = base.features(spark, sf)
    fresh, model = forest.fit_and_score(features, FEATURE_COLUMNS)
    path = new_stage_path(spark, "model")
    save_forest(spark, model, path)
    again = forest.load_and_predict(features, load_forest(spark, path), training_range=True)
    both = fresh.select("seq", "if_score", "if_flag").join(
        again.select("seq", "anomaly_score", "is_anomaly"), "seq"
    )
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("if_score") == F.col("anomaly_score")).alias("equal_scores"),
        F.count_if(F.col("if_flag") == F.col("is_anomaly")).alias("equal_flags"),
        F.min("if_score").alias("lowest"),
        F.max("if_score").alias("highest"),
    )


@query("local_outlier_factor", over("features", "SELECT k AS seq, lof_score, lof_flag FROM factor", _FACTOR))
def local_outlier_factor(spark, sf):
    return lof.lof_detector(base.features(spark, sf), FEATURE_COLUMNS).select("seq", "lof_score", "lof_flag")


@query("neighbour_weights", """
    WITH v AS (SELECT c_acctbal, c_nationkey, count(*) AS mult FROM customer GROUP BY ALL),
    st AS (SELECT avg(c_acctbal) AS m0, stddev_pop(c_acctbal) AS s0, avg(c_nationkey) AS m1, stddev_pop(c_nationkey) AS s1 FROM customer),
    z AS MATERIALIZED (SELECT c_acctbal, c_nationkey, mult, (c_acctbal - m0) / s0 AS x, (c_nationkey - m1) / s1 AS y FROM v, st),
    nn AS (SELECT a.c_acctbal, a.c_nationkey, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
        b.mult - CAST(a.c_acctbal = b.c_acctbal AND a.c_nationkey = b.c_nationkey AS INT) AS mult, b.c_acctbal AS bx, b.c_nationkey AS by_ FROM z a, z b),
    w AS (SELECT *, sum(mult) OVER (PARTITION BY c_acctbal, c_nationkey ORDER BY d, bx, by_) - mult AS before FROM nn WHERE mult > 0)
    SELECT c_acctbal, c_nationkey, count(*) AS n_near, sum(least(mult, 20 - before))::BIGINT AS weight, round(max(d), 6) AS k_distance
    FROM w WHERE before < 20 GROUP BY c_acctbal, c_nationkey""")
def neighbour_weights(spark, sf):
    """Neighbours, their weight and the k-distance of every distinct vector; copies counted."""
    columns = ["c_acctbal", "c_nationkey"]
    numeric = base.table(spark, sf, "customer").select(*[F.col(c).cast("double").alias(c) for c in columns])
    vectors = lof._vectors(numeric, columns)
    near = lof.nearest_neighbours(vectors, 20).groupBy("vid").agg(
        F.count("*").alias("n_near"), F.sum("weight").alias("weight"), F.round(F.max("distance"), 6).alias("k_distance")
    )
    return vectors.join(near, "vid").select("c_acctbal", F.col("c_nationkey").cast("long").alias("c_nationkey"), "n_near", "weight", "k_distance")


@query("customer_outlier_factor", """
    WITH st AS (SELECT avg(c_acctbal) AS m0, stddev_pop(c_acctbal) AS s0, avg(c_nationkey) AS m1, stddev_pop(c_nationkey) AS s1 FROM customer),
    z AS MATERIALIZED (SELECT c_custkey, (c_acctbal - m0) / s0 AS x, (c_nationkey - m1) / s1 AS y FROM customer, st),
    nn AS MATERIALIZED (SELECT * FROM (SELECT a.c_custkey AS a, b.c_custkey AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
        row_number() OVER (PARTITION BY a.c_custkey ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.c_custkey) AS rn
      FROM z a JOIN z b ON a.c_custkey <> b.c_custkey) WHERE rn <= 20),
    kd AS (SELECT a AS b, max(d) AS k FROM nn GROUP BY a),
    lrd AS MATERIALIZED (SELECT a, 1 / (avg(greatest(d, k)) + 1e-10) AS l FROM nn JOIN kd USING (b) GROUP BY a)
    SELECT nn.a AS c_custkey, round(avg(o.l) / any_value(s.l), 6) AS lof FROM nn JOIN lrd o ON o.a = nn.b JOIN lrd s ON s.a = nn.a GROUP BY nn.a""")
def customer_outlier_factor(spark, sf):
    rows = lof.local_outlier_factor(base.table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return rows.select("c_custkey", F.round("lof_raw", 6).alias("lof"))


@query("three_detector_vote", over(
    "features", "SELECT seq, if_flag, lof_flag, zscore_flag, detector_votes, anomaly_score, confidence, is_anomaly FROM voted", *_VOTE
))
def three_detector_vote(spark, sf):
    voted, _ = run_ensemble(base.features(spark, sf))
    return voted.select(
        "seq", "if_flag", "lof_flag", "zscore_flag", "detector_votes", "anomaly_score", "confidence", "is_anomaly"
    )


@query("three_detector_quality", over("features", quality_sql("is_anomaly", "voted"), *_VOTE))
def three_detector_quality(spark, sf):
    voted, _ = run_ensemble(base.features(spark, sf))
    return evaluate(voted)


@query("analysed_events", over(
    "tagged", """SELECT t.seq, t.seq + 1 AS id, t.timestamp, t.severity, t.source_ip, t.message, t.format AS log_format, v.anomaly_score, v.is_anomaly,
        v.confidence, v.detector_votes, t.technique_id, t.technique_name, t.tactic, t.mitre_confidence, substr(t.raw, 1, 500) AS raw,
        FALSE AS is_false_positive FROM tagged t JOIN voted v USING (seq)""", FEATURES, *_VOTE,
))
def analysed_events(spark, sf):
    """All batch steps from lines to event rows."""
    parsed = stage(base.parsed(spark, sf).drop("event_ts", "ip", "event_type"), "parsed")
    return analyse_events(parsed).events
