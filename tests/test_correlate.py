import glob
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.operators import correlate as C
from emberlog.session import staging_dir

SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
TACTICS = ["Initial Access", "Execution", "Command and Control", "Discovery", None, None]
LAYOUT = "id long, source_ip string, severity string, tactic string, technique_id string, anomaly_score double, message string"


def random_events(seed, n=150):
    rng = random.Random(seed)
    ips = ["1.1.1.1"] * 5 + ["2.2.2.2", "3.3.3.3", "unknown", "0.0.0.0"] + [f"9.9.9.{i}" for i in range(8)]
    return [
        (i, rng.choice(ips), rng.choice(SEVERITIES), rng.choice(TACTICS) if rng.random() < 0.4 else None, None, rng.random(), "m")
        for i in range(n)
    ]


def literal_links(events):
    """The three link rules, written out over the newest-first list."""
    ordered = sorted(events, key=lambda e: -e[0])
    links = {}
    by_ip, by_tactic = defaultdict(list), defaultdict(list)
    for e in ordered:
        if e[1] not in ("unknown", "0.0.0.0"):
            by_ip[e[1]].append(e)
        if e[3]:
            by_tactic[e[3]].append(e)
    for group in by_ip.values():
        for i, a in enumerate(group):
            for b in group[i + 1:i + 15]:
                links[frozenset((a[0], b[0]))] = "same_ip"
    for group in by_tactic.values():
        for i, a in enumerate(group):
            for b in group[i + 1:i + 8]:
                links.setdefault(frozenset((a[0], b[0])), "same_tactic")
    for group in by_ip.values():
        ranked = sorted(group, key=lambda e: SEVERITIES.index(e[2]))
        for a, b in zip(ranked, ranked[1:]):
            if SEVERITIES.index(b[2]) > SEVERITIES.index(a[2]):
                links.setdefault(frozenset((a[0], b[0])), "severity_escalation")
    return links


def literal_groups(events, links):
    parent = {e[0]: e[0] for e in events}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in (sorted(pair) for pair in links):
        parent[root(a)] = root(b)
    members = defaultdict(set)
    for e in events:
        members[root(e[0])].add(e[0])
    return {max(m): m for m in members.values() if len(m) >= 2}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_and_groups_equal_the_literal_rules(spark, seed, monkeypatch):
    # Small chunks and blocks make their borders part of the check.
    monkeypatch.setattr(C, "CHUNK", 16)
    events = random_events(seed)
    nodes = C.correlation_nodes(spark.createDataFrame(events, LAYOUT)).cache()
    got = {frozenset((r.u, r.v)): r.relation for r in C.correlation_edges(nodes).collect()}
    links = literal_links(events)
    assert got == links
    wanted = literal_groups(events, links)
    keys = C.component_keys(nodes)
    groups = {r.group_id: r.event_count for r in C.correlated_groups(keys).collect()}
    assert groups == {first: len(members) for first, members in wanted.items()}
    members = defaultdict(set)
    for r in C.group_members(nodes, C.component_keys(nodes)).collect():
        members[r.group_id].add(r.event_id)
    assert dict(members) == wanted


def test_rank_blocks(spark):
    rng = random.Random(5)
    rows = [(p, rng.choice("ab")) for p in range(-500, 500)]
    frame = spark.createDataFrame(rows, "position long, k string")
    got = {(r.k, r.position): r.r for r in C._rank_within(frame, "k", "r", width=37).collect()}
    for key in "ab":
        places = sorted(p for p, k in rows if k == key)
        assert [got[(key, p)] for p in places] == list(range(len(places)))


def test_kill_chain_needs_more_than_two_of_three(spark):
    def alerts(tactics):
        events = [(i, "1.1.1.1", "HIGH", t, f"T{i}", 0.9, "m") for i, t in enumerate(tactics)]
        keys = C.component_keys(C.correlation_nodes(spark.createDataFrame(events, LAYOUT)))
        return {r.chain_name: r for r in C.kill_chains(keys).collect()}

    assert alerts(["Initial Access", "Execution"]) == {}
    full = alerts(["Initial Access", "Execution", "Command and Control"])
    assert list(full) == ["Full Intrusion Kill Chain"]
    row = full["Full Intrusion Kill Chain"]
    assert row.alert == "🚨 KILL CHAIN: Full Intrusion Kill Chain — 3 events from 1.1.1.1"
    assert (row.match_percent, row.techniques) == (100, ["T0", "T1", "T2"])
    assert "Recon to Exploit" in alerts(["Discovery", "Initial Access"])


def test_sessions_cross_midnight(spark):
    day = 86_400
    seconds = [day - 200, day - 100, day + 150, day + 449, day + 749, 3 * day]
    rows = spark.createDataFrame([(i, "1.1.1.1", s, "Execution") for i, s in enumerate(seconds)], "id long, source_ip string, s long, tactic string")
    rows = rows.withColumn("event_ts", F.timestamp_seconds("s"))
    got = [(r.a, r.b, r.event_count) for r in C.address_sessions(rows).select(
        F.unix_seconds("first_ts").alias("a"), F.unix_seconds("last_ts").alias("b"), "event_count").orderBy("a").collect()]
    assert got == [(day - 200, day + 449, 4), (day + 749, day + 749, 1), (3 * day, 3 * day, 1)]


def test_edge_counts_report(spark):
    edges = C.correlation_edges(C.correlation_nodes(spark.createDataFrame(random_events(9), LAYOUT)))
    got = {r.relation: r.n_edges for r in C.edge_type_counts(edges).collect()}
    assert got == dict(Counter(literal_links(random_events(9)).values()))


def test_time_links_of_a_burst_of_one_address(spark):
    # A third of all events are one address within one second; many share the very moment.
    rng = random.Random(4)
    events = [(i, "9.9.9.9" if i % 3 == 0 else f"1.1.1.{i % 40}", rng.randrange(4) if i % 3 == 0 else rng.randrange(86_400)) for i in range(3000)]
    frame = spark.createDataFrame(events, "id long, source_ip string, s long").withColumn("event_ts", F.timestamp_seconds("s"))
    got = {(r.u, r.v, r.key) for r in C.timed_ip_edges(frame).collect()}
    wanted = set()
    by_ip = defaultdict(list)
    for i, ip, s in events:
        by_ip[ip].append((s, i))
    for ip, rows in by_ip.items():
        rows.sort()
        for n, (s, i) in enumerate(rows):
            wanted |= {(min(i, j), max(i, j), ip) for t, j in rows[n + 1:n + 15] if t - s <= 300}
    assert got == wanted
    # The address that is a third of all rows was sorted in several tasks, one file each.
    newest = max(glob.glob(f"{staging_dir(spark)}/ranked-*"), key=os.path.getmtime)
    busy = spark.read.parquet(newest).filter("ip_key = '9.9.9.9'").select(F.input_file_name())
    assert busy.count() == 1000 and busy.distinct().count() > 1


def test_time_links_leave_no_event_of_the_window_out(spark, monkeypatch):
    # Far more than 14 events within five minutes, some exactly five minutes apart, and times before 1970.
    monkeypatch.setattr(C, "CELL", 16)
    rng = random.Random(5)
    events = [(i, "9.9.9.9" if i % 3 else f"1.1.1.{i % 4}", rng.choice([-400, -301, -300, 0, 1, 299, 300, 301, 600, 7_000])) for i in range(240)]
    events += [(7, "9.9.9.9", 0), (None, "9.9.9.9", 1), (900, None, 1), (901, "0.0.0.0", 1), (902, "unknown", 1), (903, "9.9.9.9", None)]
    frame = spark.createDataFrame(events, "id long, source_ip string, s long").withColumn("event_ts", F.timestamp_seconds("s"))
    got = Counter((r.u, r.v, r.key) for r in C.timed_ip_edges(frame, reach=None).collect())
    linked = [e for e in events if e[1] not in (None, "0.0.0.0", "unknown") and e[2] is not None]
    wanted = Counter()
    for n, (i, ip, s) in enumerate(linked):
        for j, other, t in linked[n + 1:]:
            if ip == other and abs(s - t) <= 300:
                ids = [x for x in (i, j) if x is not None]
                wanted[min(ids), max(ids), ip] += 1
    assert got == wanted and sum(wanted.values()) > 5_000
    at_once = C.timed_ip_edges(frame, window_minutes=0, reach=None).count()
    assert at_once == sum(a[1:] == b[1:] for n, a in enumerate(linked) for b in linked[n + 1:])


def test_timed_links_query_has_no_reach(spark, monkeypatch):
    from catalog import base, correlation_queries

    # Twenty events of one address within a minute: 190 pairs, 175 of them among the next 14.
    frame = spark.createDataFrame([(i, "9.9.9.9", i) for i in range(20)], "id long, source_ip string, s long")
    monkeypatch.setattr(base, "stored_events", lambda spark, sf: frame.withColumn("event_ts", F.timestamp_seconds("s")))
    assert correlation_queries.timed_ip_edges(spark, "").count() == 190
