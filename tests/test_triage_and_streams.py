from pyspark.sql import functions as F

from emberlog.operators import triage as T
from emberlog.streaming import feed

LAYOUT = "id long, message string, severity string, source_ip string, anomaly_score double, technique_id string, tactic string"


def verdicts(spark, rows, profile="v1"):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LAYOUT)
    return T.quality_rubric(T.triage(frame, profile)).orderBy("id").collect()


def test_triage_examples(spark):
    got = verdicts(spark, [
        ("Failed password for invalid user admin from 195.178.55.22", "HIGH", "195.178.55.22", 0.82, "T1110.001", "Credential Access"),
        ("LSASS memory read detected mimikatz credential dump", "CRITICAL", "10.0.0.55", 0.96, None, None),
        ("User logged in successfully", "INFO", "10.0.0.10", 0.04, None, None),
        ("odd but unknown", "INFO", "10.0.0.10", 0.75, None, None),
        ("New scheduled task", "HIGH", "10.0.0.1", 0.1, None, None),
    ])
    assert got[0].threat_type == "Brute Force Attack (T1110.001)"
    assert got[0].recommendations[0] == "Block IP 195.178.55.22 at firewall immediately"
    assert "LSASS" in got[1].threat_type
    assert got[2].false_positive_probability == 0.80 and got[2].explanation.startswith("Anomaly score 0.04/1.0")
    assert got[3].threat_type == "High-Confidence Anomaly"
    assert got[4].threat_type == "Persistence via Scheduled Task (T1053.005)"
    assert got[0].quality_score == 90 and got[0].grade == "A" and got[0].issues == []
    assert got[2].issues == ["Only 2 recommendations (need 3)"]
    assert verdicts(spark, [("New scheduled task", "HIGH", "1.1.1.1", 0.1, None, None)], "v2")[0].threat_type == "Low Risk"


def test_answers(spark):
    good = '{"threat_type":"T","explanation":"E","attacker_intent":"A","risk":"R","recommendations":["1"],"false_positive_probability":0.5}'
    rows = spark.createDataFrame(
        [(0, good), (1, f"text ```json\n{good}\n``` tail"), (2, "no json " + "x" * 400), (3, "[1, 2]")], "id long, answer string"
    )
    got = T.ingest_answers(rows, profile="v2").orderBy("id").collect()
    assert [r.answer_source for r in got] == ["model-json", "model-json", "model-text", "model-text"]
    assert (got[1].threat_type, got[1].recommendations) == ("T", ["1"])
    assert (len(got[2].explanation), got[2].threat_type, got[2].recommendations) == (300, "AI Analysis", ["Investigate immediately"])


def test_keys_and_prompts(spark):
    row = ("m" * 80, "CRITICAL", "1.1.1.1", 0.5, None, None)
    frame = spark.createDataFrame([(0, *row), (1, "m" * 80, "CRITICAL", "2.2.2.2", 0.5, None, None)], LAYOUT)
    assert T.cache_report(frame, "v1").first().distinct_keys == 1
    assert T.cache_report(frame, "v2").first().hit_rate == 0.0
    prompts = T.build_prompts(frame).first()
    assert prompts.prompt_style == "few_shot" and "CRITICAL SEVERITY" in prompts.prompt
    assert "- MITRE Technique: not identified\n" in prompts.prompt and "0.50 / 1.0" in prompts.prompt
    assert T.build_prompts(frame, "fast").first().prompt.startswith("SOC analyst.")


def test_feed_loses_nothing_between_runs(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    stream = feed.event_feed(feed.line_stream(spark, folder, max_files=1))
    total = 0
    for run in range(2):
        lines = [(f"Jan 15 10:00:{i:02d} host app[1]: failed password from 1.2.3.{run}",) for i in range(30)]
        spark.createDataFrame(lines, "value string").repartition(3).write.mode("append").text(folder)
        total += 30
        feed.start_append(stream, out, checkpoint, once=True).awaitTermination()
        assert spark.read.parquet(out).count() == total
    assert spark.read.parquet(out).filter("technique_id = 'T1110.001'").count() == total


def test_running_metrics_add_up_and_retry(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, "m", "HIGH" if i % 2 else "INFO", f"1.1.1.{i % 3}", i / 10, "T1" if i < 4 else None, None) for i in range(10)], LAYOUT
    ).withColumn("is_anomaly", F.col("anomaly_score") > 0.5)
    step = feed.running_metrics(str(tmp_path / "partials"))
    step(rows.filter("id < 6"), 0)
    step(rows.filter("id >= 6"), 1)
    step(rows.filter("id >= 6"), 1)
    row = feed.merged_metrics(spark.read.parquet(str(tmp_path / "partials"))).first()
    assert (row.total_events, row.total_anomalies, row.high_events, row.mitre_tagged) == (10, 4, 5, 4)
    assert (row.mitre_tag_rate, row.avg_anomaly_score, row.top_attacker_ip) == (40.0, 0.75, "1.1.1.0")
