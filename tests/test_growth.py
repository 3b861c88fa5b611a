"""Steps whose work must grow with their input only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import base
from emberlog.constants.attack_rules import RULES
from emberlog.functions.text import fold_case, plain_search, rarest_suffix, required_literal
from emberlog.functions.times import hour_of_day, is_weekend
from emberlog.operators import detect, lof, quantiles, rule_table
from emberlog.operators.normalize import normalize_lines

_RULE_TYPE = "technique string, confidence string, pattern string, rule_order long, pattern_order int"
_TEXTS = [
    "Failed PASSWORD for root", "host 12 sshd[7]: hello", "ſshd[7]: folded", "x" * 40 + "needle" + "y" * 40, "ab", "", None,
    "a CVE-2024-77 and é sshd[9]:", "x" * 300, "only the second branch here", "12 ports in 9",
]


def _rules(spark):
    patterns = [r"failed password", r"sshd\[7\]", r"sshd\[9\]", r"x{3}needle", "x" * 30, r"no branch|second branch", r"\d+ ports? in \d+", r"^a", r"b$", r"needley{40}$"]
    rows = [("T1046", ("HIGH", "MEDIUM", "LOW")[i % 3], p, i, 0) for i, p in enumerate(patterns)]
    rows += [("T1190", "LOW", f"absent{i}text", 100 + i, 0) for i in range(60)]
    return spark.createDataFrame(rows, _RULE_TYPE)


def test_large_rule_tables_take_one_pass(spark, monkeypatch):
    events = spark.createDataFrame([(i % 8, text, None) for i, text in enumerate(_TEXTS)], "seq long, message string, raw string")
    names = spark.createDataFrame([("T1046", "scan", "Discovery")], "technique string, name string, tactic string")
    whole = rule_table.tag_by_rule_table(events, _rules(spark), names).collect()
    passes = []
    real = rule_table._first_match
    monkeypatch.setattr(rule_table, "_first_match", lambda patterns: passes.append(len(patterns)) or real(patterns))
    cut = rule_table.tag_by_rule_table(events, _rules(spark), names, slice_bytes=64, block=16).collect()
    assert sorted(map(str, cut)) == sorted(map(str, whole)) and len(cut) == len(_TEXTS)
    assert sum(row.technique_id is not None for row in cut) >= 8
    # Only patterns without a required text are sent to the rows slice by slice.
    assert len(passes) <= 2


def test_columns_of_few_values_need_no_sketch(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a sketch was taken")

    monkeypatch.setattr(quantiles, "_narrow", refuse)
    rows = spark.range(5_000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("b"), F.lit(None).cast("long").alias("c"))
    found = {(r.feature, r.prob): r.quantile for r in quantiles.exact_quantiles(rows, ["a", "b", "c"], [0.25, 0.75], hold=100).collect()}
    assert found == {("a", 0.25): 1.0, ("a", 0.75): 5.0, ("b", 0.25): 0.0, ("b", 0.75): 2.0}


def test_quartiles_are_taken_of_the_frame_itself(spark, monkeypatch):
    seen = []
    real = detect.exact_quantiles
    monkeypatch.setattr(detect, "exact_quantiles", lambda df, *rest: seen.append(df.columns) or real(df, *rest))
    detect.two_vote_ensemble(spark.range(50).withColumn("x", F.col("id") % 5), ["x"]).count()
    assert seen == [["id", "x"]]


@pytest.mark.parametrize("mark", ["", "\x01", "$1"])
def test_groups_of_lines_from_one_match(spark, mark):
    lines = [
        f"Jan  5 10:11:12 web01 sshd[{mark}1]: from 10.0.0.7 {mark}",
        f'10.0.0.9 - - [05/Jan/2024:10:11:12 +0000] "GET /{mark}x HTTP/1.1" 404 17',
        f"2024-01-05 10:11:12 EventID=4625 Message=no user {mark}",
    ]
    rows = normalize_lines(spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "seq long, line string")).orderBy("seq").collect()
    assert [r.format for r in rows] == ["syslog", "apache", "windows_event"]
    assert rows[0].timestamp == "Jan 5 10:11:12" and rows[0].message == f"from 10.0.0.7 {mark}".strip() or mark == "\x01"
    assert rows[1].message == f"GET /{mark}x → HTTP 404" and rows[1].source_ip == "10.0.0.9"
    assert rows[2].message == f"EventID 4625: no user {mark}".rstrip() or mark == "\x01"


def test_no_ring_is_too_small_to_bound_its_neighbours(spark):
    rows = spark.range(6_000).select((F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10.0).alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    found = lof.find_neighbours(lof._vectors(rows, ["x", "y"]), 20, block=48)
    # With rings of 48 and remainders it was 0.048: vectors of a remainder met all others.
    assert found.share < 0.02


def test_boxes_bound_what_a_small_block_cannot(spark):
    low, high = np.array([[0.0], [2.0], [9.0]]), np.array([[1.0], [3.0], [9.0]])
    bound = lof._within_boxes(np.array([[0.5], [9.0]]), low, high, np.array([2, 2, 1]), 3)
    assert bound.tolist() == [2.5, 9.0]
    assert np.isinf(lof._within_boxes(np.array([[0.5]]), low, high, np.array([2, 2, 1]), 5)).all()


def test_hours_ask_no_date_parser(spark):
    """Days that every month has need no calendar; other days are cast, not parsed by a layout."""
    days = ["Feb 28", "feb 29", "Feb 30", "Apr 31", "Abc 5", "JAN 09", "Jan  5"]
    rows = [(f"{day} 07:01:02", None if day in ("feb 29", "Feb 30", "Apr 31", "Abc 5") else 7, 0) for day in days]
    rows += [
        ("29/Feb/2023:08:00:01 +0000", None, 0), ("29/feb/2024:08:00:01 +0000", 8, 0), ("28/Foo/2024:08:00:01 Z", None, 0),
        ("2024-02-29 09:00:00", 9, 0), ("2023-02-29 09:00:00", None, 0), ("2024-06-01 9:00:00", 9, 1), ("2024-6-2T23:00:00Z", 23, 1),
        ("2024-06-31T23:00:00z", None, 0), ("  2024-06-30 05:00:00\t", 5, 1), ("", None, 0), ("2024-13-01 05:00:00", None, 0),
    ]
    times = spark.createDataFrame(rows, "ts string, hour int, weekend int")
    found = times.select("*", hour_of_day(F.col("ts"), F.lit(None)).alias("h"), is_weekend(F.col("ts")).alias("w"))
    assert [r for r in found.collect() if (r.hour, r.weekend) != (r.h, r.w)] == []
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "gettimestamp" not in plan and "to_date" not in plan


def _rows_per_part(df):
    return [row.n for row in df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]


def test_a_large_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    single, many = str(tmp_path / "single"), str(tmp_path / "many")
    spark.range(20_000).coalesce(1).write.parquet(single)
    spark.range(20_000).repartition(8).write.parquet(many)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        read = spark.read.parquet(single)
        cores = spark.sparkContext.defaultParallelism
        assert read.rdd.getNumPartitions() >= cores and max(_rows_per_part(read)) == 20_000
        dealt = base.spread(read)
        assert max(_rows_per_part(dealt)) <= 20_000 / cores
        assert sorted(row.id for row in dealt.collect()) == list(range(20_000))
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        even = spark.read.parquet(many)
        if even.rdd.getNumPartitions() >= cores:
            assert base.spread(even) is even
        empty = spark.read.parquet(many).filter("id < 0")
        assert base.spread(empty).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_plain_searches_start_at_rare_characters(spark):
    assert [rarest_suffix(t) for t in ("powershell", "failed password", "c2", "", "rce")] == ["wershell", "word", "c2", "", "rce"]
    literals = sorted({required_literal(p)[0].lower() for rule in RULES for p in rule.patterns} | {"c2", "1=1"})
    texts = [
        f"{before}{part}{after}" for text in literals if text for part in (text, rarest_suffix(text), text[:-1])
        for before, after in (("", ""), ("x", "y"))
    ] + ["", None, "é powershell"]
    rows = spark.createDataFrame([(text,) for text in texts], "text string").withColumn("folded", fold_case(F.col("text")))
    folded = F.col("folded")
    different = rows.select(*[(~plain_search(folded, t).eqNullSafe(folded.contains(t))).cast("int").alias(f"c{i}") for i, t in enumerate(literals)])
    assert sum(different.agg(*[F.sum(c).alias(c) for c in different.columns]).first()) == 0


def _given_rows(spark, path, ids):
    rows = [(i, None if n % 11 == 5 else n, None if n % 13 == 7 else n * 7 % 90, ("error", "purchase", "click", "view", "signup")[n % 5]) for n, i in enumerate(ids)]
    events = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string")
    events.select("event_id", F.timestamp_seconds(F.col("at") * 1800 + 1704067200).alias("ts"), "user_id", "event_type").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_single_event_ids_need_no_join(spark, monkeypatch, tmp_path):
    """Rows over several blocks get what the join by id gives them, without that join and its shuffle of all texts."""
    monkeypatch.setattr(base, "_BLOCK", 64)
    monkeypatch.setattr(base, "_PART_ROWS", 50)
    sf = _given_rows(spark, tmp_path, range(400))
    joined = base.with_defaults(base._joined_detections(spark, sf), keep=("event_ts",))
    want = sorted(map(str, joined.withColumn("seq", F.col("seq") + 1).collect()))
    monkeypatch.setattr(base, "_joined_detections", None)
    got = base.stored_events(spark, sf).withColumnRenamed("id", "seq")
    assert sorted(map(str, got.select(joined.columns).collect())) == want and len(want) > 300
    assert got.filter("detector_votes > 0").count()


def test_repeated_and_missing_event_ids_are_joined(spark, monkeypatch, tmp_path):
    sf = _given_rows(spark, tmp_path, [None, 0, 1, 1, *range(2, 40)])
    monkeypatch.setattr(base, "_carried_detections", None)
    rows = base.stored_events(spark, sf)
    # Both rows of id 1 meet both detections; the row without an id keeps the defaults.
    assert rows.filter("id = 2").count() == 4 and rows.filter("id = 3").count() == 1
    assert [(row.detector_votes, row.confidence) for row in rows.filter("id IS NULL").collect()] == [(0, "NONE")]
