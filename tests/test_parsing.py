import pytest
from pyspark.sql import functions as F

from emberlog.constants.attack_rules import RULES, TECHNIQUES, WORD_BOUNDED_RULES, Rule
from emberlog.functions import event_time, hour_of_day, is_weekend, matches
from emberlog.functions.text import fold_case, required_literal, search
from emberlog.operators.normalize import normalize_export_records, normalize_lines, with_event_time
from emberlog.operators.rule_table import tag_by_rule_table
from emberlog.operators.tagging import rules_from_table, tag_events


def parse(spark, *lines, **options):
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "seq long, line string")
    return {r.seq: r for r in normalize_lines(rows, **options).collect()}


def test_examples_of_every_format(spark):
    got = parse(
        spark,
        "Jan 15 14:32:01 webserver sshd[1234]: Failed password for invalid user admin from 195.178.55.22 port 44392 ssh2",
        '195.178.55.22 - - [15/Jan/2026:14:32:01 +0000] "GET /admin HTTP/1.1" 403 512',
        "2026-01-15 14:32:01 EventID=4625 User=CORP\\jsmith Source=192.168.1.55 Message=An account failed to log on",
        '{"timestamp":"2026-01-15T14:32:01Z","severity":"HIGH","source_ip":"77.88.44.3","message":"SQL injection attempt"}',
        '{"timestamp":"2026-01-15T14:32:10Z","level":"warning","src_ip":"10.0.0.5","msg":"Outbound"}',
        "2026-01-15 14:33:00 EventID=1102 Message=The audit log was cleared",
        "", "   ", "# comment", "\t　",
        "free text from 10.1.2.3",
    )
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 10]
    assert (got[0].format, got[0].severity, got[0].source_ip) == ("syslog", "HIGH", "195.178.55.22")
    assert got[0].timestamp == "Jan 15 14:32:01"
    assert (got[1].format, got[1].severity, got[1].message) == ("apache", "MEDIUM", "GET /admin → HTTP 403")
    assert (got[2].format, got[2].severity) == ("windows_event", "HIGH")
    assert got[2].message == "EventID 4625: [CORP\\jsmith] An account failed to log on"
    assert (got[3].format, got[3].severity, got[3].source_ip) == ("json", "HIGH", "77.88.44.3")
    assert (got[4].severity, got[4].source_ip) == ("MEDIUM", "10.0.0.5")
    assert (got[5].severity, got[5].source_ip) == ("CRITICAL", "unknown")
    assert (got[10].format, got[10].timestamp, got[10].source_ip) == ("unknown", "unknown", "10.1.2.3")


def test_json_corner_cases(spark):
    got = parse(
        spark,
        '{"a":1} junk', '{"a":1} {"b":2}', "[1]", "123", "null", "{'severity':'HIGH'}",
        "{}", '{"severity":"","level":"err"}', '{"source_ip":0,"src_ip":"1.2.3.4"}', '{"message":"0"}',
        '{"severity":"odd","message":"m"}',
    )
    assert [got[i].format for i in range(6)] == ["unknown"] * 6
    assert (got[6].format, got[6].severity, got[6].message) == ("json", "INFO", "{}")
    assert got[7].severity == "HIGH"
    assert got[8].source_ip == "1.2.3.4"
    assert got[9].message == "0"
    assert got[10].severity == "ODD"


def test_one_digit_hours_only_when_lenient(spark):
    line = "Jan 15  8:00:00 gateway sshd[1]: Failed password from 1.2.3.4"
    assert parse(spark, line)[0].format == "unknown"
    assert parse(spark, line, lenient_time=True)[0].format == "syslog"


def test_export_records(spark):
    record = (
        "\r\n  Source: Auditing\r\n  Date: 2026-01-15T10:00:00\r\n  Event ID: 4625\r\n  Computer: HOST\r\n"
        "  Account Name: bob\r\n  Network: 10.0.0.9\r\n  Description: \r\nAn account failed.\r\nMore.\r\n\r\nTail"
    )
    rows = spark.createDataFrame([(0, record), (1, "no id here"), (2, "Event ID: 1")], "seq long, record string")
    a = {r.seq: r for r in normalize_export_records(rows, profile="A").collect()}
    b = {r.seq: r for r in normalize_export_records(rows, profile="B").collect()}
    assert sorted(a) == [0, 2]
    assert a[0].message == "EventID=4625 User=bob Source=10.0.0.9 Auditing: An account failed.\nMore."
    assert (a[0].severity, a[0].timestamp) == ("HIGH", "2026-01-15T10:00:00")
    assert (a[2].message, a[2].source_ip, a[2].severity) == ("EventID=1 Windows: EventID 1", "unknown", "INFO")
    assert b[0].message == "EventID=4625: Failed logon attempt | User: bob | From: 10.0.0.9 | Host: HOST"
    assert (b[2].message, b[2].source_ip) == ("EventID=1: Windows Event 1 | Host: local", "127.0.0.1")
    with pytest.raises(ValueError):
        normalize_export_records(rows, profile="C")


def test_timestamps(spark):
    texts = {
        "Jan 15 14:32:01": (14, 0), "jan 5 4:02:01": (4, 0), "Feb 29 10:00:00": (-1, 0), "Jan 32 10:00:00": (-1, 0),
        "15/Jan/2026:07:32:01 +0530": (7, 0), "31/Feb/2026:07:32:01 +0000": (-1, 0),
        "2026-01-17 23:00:00": (23, 1), "2026-01-15 23:00:00": (23, 0), "2026-02-30 23:00:00": (-1, 0),
        "2026-01-18T05:00:00Z": (5, 1), "2026-01-18T25:00:00Z": (-1, 0), "unknown": (-1, 0), "": (-1, 0),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.h, r.w) for r in rows.select("t", hour_of_day(F.col("t")).alias("h"), is_weekend(F.col("t")).alias("w")).collect()}
    assert got == texts
    at = {r.t: r.e for r in rows.select("t", F.date_format(event_time(F.col("t"), 2024), "yyyy-MM-dd HH:mm").alias("e")).collect()}
    assert at["Jan 15 14:32:01"] == "2024-01-15 14:32"
    assert at["15/Jan/2026:07:32:01 +0530"] == "2026-01-15 02:02"
    assert at["2026-01-18T05:00:00Z"] == "2026-01-18 05:00"
    assert at["unknown"] is None


def tags(spark, *texts, raw="", **options):
    rows = spark.createDataFrame([(i, t, raw) for i, t in enumerate(texts)], "seq long, message string, raw string")
    return [r for r in tag_events(rows, **options).orderBy("seq").collect()]


def test_tagging_examples(spark):
    got = tags(
        spark,
        "Failed password for invalid user admin from 195.178.55.22",
        "SQL injection attempt union select password from users",
        "powershell.exe -EncodedCommand SQBFAFgA detected",
        "EventID=1102 The audit log was cleared",
        "LSASS memory read credential dump",
        "Normal user login from known device at 9am",
        "ſql injection",
    )
    assert [r.technique_id for r in got] == [
        "T1110.001", "T1190", "T1059.001", "T1562.001", "T1055.012", None, "T1190",
    ]
    assert (got[0].tactic, got[0].mitre_confidence, got[0].matched_rule) == ("Credential Access", "HIGH", "failed password")
    assert (got[5].mitre_confidence, got[5].tactic) == ("NONE", None)


def test_word_bounded_rules_and_rule_tables(spark):
    assert tags(spark, "Source=10.0.0.1")[0].technique_id == "T1190"
    assert tags(spark, "Source=10.0.0.1", rules=WORD_BOUNDED_RULES)[0].technique_id is None
    table = spark.createDataFrame(
        [("T1", "LOW", "abc", 0, 0), ("T2", "HIGH", "x+y", 1, 1), ("T2", "HIGH", "abc", 1, 0)],
        "technique string, confidence string, pattern string, rule_order int, pattern_order int",
    )
    rules = rules_from_table(table)
    assert rules == (Rule("T1", "LOW", ("abc",)), Rule("T2", "HIGH", ("abc", "x+y")))
    row = tags(spark, "abc", rules=rules)[0]
    assert (row.technique_id, row.technique_name, row.matched_rule) == ("T2", "Unknown", "abc")


def test_search_equals_the_plain_regular_expression(spark):
    patterns = sorted({p for rule in RULES for p in rule.patterns}) + [r"((a)b)c", r"a|b", r"x{2}y", r"\bfoo\b", r"a[bc]d"] + [
        r"[a-c]{3} xxy", r"(ab){1}c", r".*?foo", r"x??xy", r"ab\[1\]", r"a+?b+c", r"[)]?abc", r"(?s)cross.site",
    ]
    texts = [
        "abc xxy foo acd", "../etc CVE-2024-11 rce", "IEX  (1)", "91.108.4.55", "12 ports in 3", "union    select", "4.2 GB copied",
        "PORTSCAN REVERSE SHELL", "ſcan ſweep", "Kelvin", "cross\nsite", "a.b", "Ab[1]", "-ENC -ExecutionPolicy", "log x delete",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", fold_case(F.col("t")))
    checks = rows.select("t", *[(search(F.col("t"), F.col("f"), p) == matches(F.col("t"), p)).alias(f"c{i}") for i, p in enumerate(patterns)])
    for row in checks.collect():
        wrong = [patterns[i] for i in range(len(patterns)) if not row[f"c{i}"]]
        assert not wrong, (row.t, wrong)
    assert required_literal(r"sql.?inject") == ("inject", False)


def test_event_time_of_text(spark):
    texts = ["Feb 29 01:02:03", "10/Oct/2023:23:59:59 +0200", "2023-10-10 09:08:07", "2023-10-10T09:08:07Z", "unknown", None]
    rows = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "seq int, timestamp string, event_ts string")

    def times(year):
        got = with_event_time(rows, year).selectExpr("seq", "date_format(event_ts, 'yyyy-MM-dd HH:mm:ss') t").collect()
        return [t for _, t in sorted(got)]

    assert times(2024) == [
        "2024-02-29 01:02:03", "2023-10-10 21:59:59", "2023-10-10 09:08:07", "2023-10-10 09:08:07", None, None
    ]
    assert times(2023)[0] is None


RULE_TABLE = "technique string, confidence string, pattern string, rule_order long, pattern_order int"
NAMES = "technique string, name string, tactic string"


def test_rule_table_equals_compiled_rules(spark):
    texts = [
        "Failed password for admin", "nmap and MASSCAN", "ſcan ſweep", "12 ports in 3", "quiet", "", None, "powershell -enc x",
        "union    select", "IEX  (1)", "cross\nsite", "x" * 200_000 + " mimikatz lsass",
    ]
    events = spark.createDataFrame(
        [(i, t, None if i % 2 else "raw nmap" if i % 3 == 0 else "") for i, t in enumerate(texts)],
        "seq long, message string, raw string",
    ).withColumn("priority", F.lit(7)).withColumn("note", F.lit("kept"))
    rows = [(r.technique, r.confidence, p, i, j) for i, r in enumerate(RULES) for j, p in enumerate(r.patterns)]
    rules = spark.createDataFrame(rows + [("T9", "ODD", "quiet", 99, 0), ("T9", "HIGH", None, 99, 1)], RULE_TABLE)
    names = spark.createDataFrame([(t, *rest) for t, rest in TECHNIQUES.items()], NAMES)
    want = {tuple(r) for r in tag_events(events).collect()}
    # One slice, then slices of a few patterns each: the winner is the same.
    for size, block in ((1 << 20, 1024), (400, 4)):
        got = tag_by_rule_table(events, rules, names, slice_bytes=size, block=block)
        assert got.columns == tag_events(events).columns
        assert {tuple(r) for r in got.collect()} == want
    none = tag_by_rule_table(events, rules.limit(0), names)
    assert {(r.technique_id, r.mitre_confidence) for r in none.collect()} == {(None, "NONE")}
    assert tag_by_rule_table(events.limit(0), rules, names).count() == 0


def test_rule_table_of_fifty_thousand_patterns(spark):
    rules = spark.range(50_000).select(
        F.concat(F.lit("T"), F.col("id") % 7).alias("technique"),
        F.when(F.col("id") % 3 == 0, "HIGH").otherwise("LOW").alias("confidence"),
        F.format_string(r"user\s+u%d\b", "id").alias("pattern"), F.col("id").alias("rule_order"),
        F.lit(0).alias("pattern_order"),
    )
    events = spark.range(0, 100_000, 997).select(F.format_string("USER  u%d and user u4 came", "id").alias("message"))
    names = spark.createDataFrame([("T0", "zero", "tactic"), ("T0", "zero", "tactic")], NAMES)
    got = tag_by_rule_table(events, rules, names, raw_col=None, slice_bytes=2 << 20).collect()
    assert len(got) == 101
    for row in got:
        n = int(row.message.split()[1][1:])
        best = n if n < 50_000 and (n % 3 == 0 or n < 4) else 4
        assert row.matched_rule == rf"user\s+u{best}\b" and row.technique_id == f"T{best % 7}"
        assert row.technique_name == ("zero" if best % 7 == 0 else "Unknown")
