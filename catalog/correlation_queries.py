"""Correlation over the whole event table derived from the given tables."""

from pyspark.sql import functions as F

from catalog import base
from catalog.duck_base import SEVERITY_RANK, over, text
from catalog.registry import query
from emberlog.constants.kill_chains import KILL_CHAINS
from emberlog.operators import correlate as C

# Links, as self-joins over ranks.
_LINKS = f"""
nd AS MATERIALIZED (SELECT id, event_ts, coalesce(source_ip, 'unknown') AS source_ip, severity, {SEVERITY_RANK} AS lvl,
    coalesce(tactic, '') AS tactic, coalesce(technique_id, '') AS technique_id, anomaly_score, substr(message, 1, 80) AS message FROM ev),
ipr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY id DESC) AS rk,
    row_number() OVER (PARTITION BY source_ip ORDER BY lvl, id DESC) AS sk FROM nd WHERE source_ip NOT IN ('unknown', '0.0.0.0')),
tar AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tactic ORDER BY id DESC) AS rk FROM nd WHERE tactic <> ''),
e1 AS MATERIALIZED (SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, 'same_ip' AS relation, a.source_ip AS key, 1.0::DOUBLE AS weight
  FROM ipr a JOIN ipr b ON a.source_ip = b.source_ip AND b.rk > a.rk AND b.rk <= a.rk + 14),
e2 AS MATERIALIZED (SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, 'same_tactic' AS relation, a.tactic AS key, 0.7::DOUBLE AS weight
  FROM tar a JOIN tar b ON a.tactic = b.tactic AND b.rk > a.rk AND b.rk <= a.rk + 7
  WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.u = least(a.id, b.id) AND e1.v = greatest(a.id, b.id))),
e3 AS MATERIALIZED (SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, 'severity_escalation' AS relation, a.source_ip AS key, 1.5::DOUBLE AS weight
  FROM ipr a JOIN ipr b ON a.source_ip = b.source_ip AND b.sk = a.sk + 1 AND b.lvl > a.lvl
  WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.u = least(a.id, b.id) AND e1.v = greatest(a.id, b.id))
    AND NOT EXISTS (SELECT 1 FROM e2 WHERE e2.u = least(a.id, b.id) AND e2.v = greatest(a.id, b.id))),
edges AS MATERIALIZED (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3)
"""

_CHAINS = "chain_table(chain_name, severity, description, required, ord) AS (VALUES " + ", ".join(
    f"({text(c.name)}, {text(c.severity)}, {text(c.description)}, [{', '.join(text(t) for t in c.tactics)}], {i})"
    for i, c in enumerate(KILL_CHAINS)
) + ")"


def _components(source: str) -> str:
    """Event components by reachability between tactics that share an address."""
    return f"""
nd AS MATERIALIZED (SELECT id, coalesce(source_ip, 'unknown') AS source_ip, coalesce(tactic, '') AS tactic,
    coalesce(technique_id, '') AS technique_id, anomaly_score FROM {source}),
it AS (SELECT DISTINCT source_ip, tactic FROM nd WHERE tactic <> '' AND source_ip NOT IN ('unknown', '0.0.0.0')),
tl AS (SELECT DISTINCT a.tactic AS a, b.tactic AS b FROM it a JOIN it b USING (source_ip)),
reach AS (SELECT a, b FROM tl UNION SELECT r.a, t.b FROM reach r JOIN tl t ON r.b = t.a),
lab AS (SELECT a AS tactic, min(b) AS label FROM reach GROUP BY a),
ipl AS (SELECT source_ip, min(label) AS label FROM it JOIN lab USING (tactic) GROUP BY source_ip),
comp AS MATERIALIZED (SELECT nd.*, CASE WHEN nd.tactic <> '' THEN 't:' || coalesce(lab.label, nd.tactic)
    WHEN ipl.label IS NOT NULL THEN 't:' || ipl.label WHEN nd.source_ip NOT IN ('unknown', '0.0.0.0') THEN 'ip:' || nd.source_ip END AS component
  FROM nd LEFT JOIN lab ON lab.tactic = nd.tactic LEFT JOIN ipl ON ipl.source_ip = nd.source_ip),
grp AS MATERIALIZED (SELECT component, max(id) AS first_id, count(*) AS event_count, max(anomaly_score) AS max_score,
    list_sort(coalesce(list(DISTINCT source_ip) FILTER (source_ip <> 'unknown'), [])) AS ips,
    list_sort(coalesce(list(DISTINCT tactic) FILTER (tactic <> ''), [])) AS tactics,
    list_sort(coalesce(list(DISTINCT technique_id) FILTER (technique_id <> ''), [])) AS techniques
  FROM comp WHERE component IS NOT NULL GROUP BY component HAVING count(*) >= 2)
"""


_ALERTS = """
SELECT chain_name, severity, description, CAST(round_even(share * 100, 0) AS INT) AS match_percent, event_count,
  array_to_string(ips[1:3], ',') AS source_ips, array_to_string(found, ',') AS tactics_found, array_to_string(techniques[1:5], ',') AS techniques,
  '🚨 KILL CHAIN: ' || chain_name || ' — ' || event_count || ' events from ' || coalesce(ips[1], 'unknown') AS alert
FROM (SELECT *, len(found) / len(required) AS share, row_number() OVER (PARTITION BY chain_name ORDER BY first_id DESC) AS place
  FROM (SELECT g.*, c.*, list_sort(list_intersect(c.required, g.tactics)) AS found FROM grp g, chain_table c)
  WHERE len(found) / len(required) >= 0.67) WHERE place = 1
"""


def _nodes(spark, sf):
    return C.correlation_nodes(base.stored_events(spark, sf))


def _flat_chains(df):
    return df.select(*[
        F.array_join(c, ",").alias(c) if c in ("source_ips", "tactics_found", "techniques") else F.col(c)
        for c in df.columns
    ])


@query("correlation_nodes", over(
    "events",
    "SELECT nd.id, -nd.id AS position, nd.source_ip, nd.severity, nd.tactic, nd.technique_id, nd.anomaly_score, nd.message, "
    "ev.timestamp, epoch_us(ev.event_ts) AS inserted_us FROM nd JOIN ev USING (id)", _LINKS,
))
def correlation_nodes(spark, sf):
    events = base.stored_events(spark, sf).withColumn("inserted_at", F.col("event_ts").cast("timestamp"))
    nodes = C.correlation_nodes(events)
    return nodes.withColumn("inserted_us", F.unix_micros("inserted_at")).drop("inserted_at")


def _ranked(spark, sf):
    return C.ranked_nodes(_nodes(spark, sf).select("id", "position", "source_ip", "severity", "tactic"))


@query("same_ip_edges", over("events", "SELECT * FROM e1", _LINKS))
def same_ip_edges(spark, sf):
    return C.same_ip_edges(_ranked(spark, sf))


@query("same_tactic_edges", over("events", "SELECT * FROM e2", _LINKS))
def same_tactic_edges(spark, sf):
    return C.same_tactic_edges(_ranked(spark, sf))


@query("severity_escalation_edges", over("events", "SELECT * FROM e3", _LINKS))
def severity_escalation_edges(spark, sf):
    return C.escalation_edges(_ranked(spark, sf))


@query("correlation_edges", over("events", "SELECT * FROM edges", _LINKS))
def correlation_edges(spark, sf):
    return C.correlation_edges(_nodes(spark, sf))


@query("edge_type_counts", over(
    "events", "SELECT relation, count(*) AS n_edges FROM edges GROUP BY relation", _LINKS
))
def edge_type_counts(spark, sf):
    return C.edge_type_counts(C.correlation_edges(_nodes(spark, sf)))


_GROUPS = """SELECT first_id AS group_id, event_count, array_to_string(ips[1:5], ',') AS source_ips,
  array_to_string(tactics, ',') AS tactics, round(max_score, 3) AS max_score FROM grp"""


def _flat_groups(df):
    return df.withColumn("source_ips", F.array_join("source_ips", ",")).withColumn(
        "tactics", F.array_join("tactics", ",")
    )


@query("correlated_groups", over("events", _GROUPS, _components("ev"), recursive=True))
def correlated_groups(spark, sf):
    return _flat_groups(C.correlated_groups(C.component_keys(_nodes(spark, sf))))


@query("correlated_groups_by_label_passing", over("events", _GROUPS, _components("ev"), recursive=True))
def correlated_groups_by_label_passing(spark, sf):
    """The same groups; components always come from label passing."""
    return _flat_groups(C.correlated_groups(C.component_keys(_nodes(spark, sf))))


@query("top_groups", over(
    "events", _GROUPS + " ORDER BY event_count DESC, group_id DESC LIMIT 5", _components("ev"), recursive=True
))
def top_groups(spark, sf):
    return _flat_groups(C.top_groups(C.correlated_groups(C.component_keys(_nodes(spark, sf)))))


@query("group_members", over(
    "events", "SELECT first_id AS group_id, id AS event_id FROM comp JOIN grp USING (component)",
    _components("ev"), recursive=True,
))
def group_members(spark, sf):
    nodes = _nodes(spark, sf)
    return C.group_members(nodes, C.component_keys(nodes))


@query("kill_chains", over("events", _ALERTS, _components("ev"), _CHAINS, recursive=True))
def kill_chains(spark, sf):
    return _flat_chains(C.kill_chains(C.component_keys(_nodes(spark, sf))))


@query("kill_chain_scan", over(
    "events", f"SELECT *, (SELECT count(*) FROM newest) AS events_scanned, count(*) OVER () AS count FROM ({_ALERTS})",
    "newest AS MATERIALIZED (SELECT * FROM ev ORDER BY id DESC LIMIT 200)", _components("newest"), _CHAINS, recursive=True,
))
def kill_chain_scan(spark, sf):
    return _flat_chains(C.kill_chain_scan(base.stored_events(spark, sf)))


@query("graph_nodes", over(
    "events",
    "SELECT id, source_ip AS label, anomaly_score AS score, severity, technique_id AS technique, tactic, "
    "substr(message, 1, 60) AS message FROM nd", _LINKS,
))
def graph_nodes(spark, sf):
    return C.graph_nodes(_nodes(spark, sf))


@query("graph_edges", over("events", "SELECT u AS source, v AS target, relation, weight FROM edges", _LINKS))
def graph_edges(spark, sf):
    return C.graph_edges(C.correlation_edges(_nodes(spark, sf)))


@query("graph_summary", over(
    "events",
    "SELECT (SELECT count(*) FROM ev) AS node_count, (SELECT count(*) FROM edges) AS edge_count, "
    "(SELECT count(*) FROM grp) AS correlated_groups, "
    f"(SELECT count(*) FROM ({_ALERTS})) AS kill_chain_count",
    _LINKS, _components("ev").replace("nd AS MATERIALIZED", "nd2 AS MATERIALIZED").replace("FROM nd", "FROM nd2")
    .replace("nd.", "nd2."), _CHAINS, recursive=True,
))
def graph_summary(spark, sf):
    nodes = _nodes(spark, sf)
    keys = C.component_keys(nodes)
    return C.graph_summary(nodes, C.correlation_edges(nodes), C.correlated_groups(keys), C.kill_chains(keys))


_NEWEST = "newest AS MATERIALIZED (SELECT * FROM ev ORDER BY id DESC LIMIT 100)"
_NEWEST_LINKS = _LINKS.replace("FROM ev)", "FROM newest)")


def _newest_graph(spark, sf):
    return C.newest_graph(base.stored_events(spark, sf))


@query("newest_graph_nodes", over(
    "events",
    "SELECT id, source_ip AS label, anomaly_score AS score, severity, technique_id AS technique, tactic, "
    "substr(message, 1, 60) AS message FROM nd", _NEWEST, _NEWEST_LINKS,
))
def newest_graph_nodes(spark, sf):
    """Nodes of the graph over the newest 100 events."""
    return _newest_graph(spark, sf)[0]


@query("newest_graph_edges", over(
    "events", "SELECT u AS source, v AS target, relation, weight FROM edges", _NEWEST, _NEWEST_LINKS
))
def newest_graph_edges(spark, sf):
    return _newest_graph(spark, sf)[1]


@query("newest_graph_summary", over(
    "events",
    "SELECT (SELECT count(*) FROM newest) AS node_count, (SELECT count(*) FROM edges) AS edge_count, "
    "(SELECT count(*) FROM grp) AS correlated_groups, "
    f"(SELECT count(*) FROM ({_ALERTS})) AS kill_chain_count",
    _NEWEST, _NEWEST_LINKS, _components("newest").replace("nd AS MATERIALIZED", "nd2 AS MATERIALIZED")
    .replace("FROM nd", "FROM nd2").replace("nd.", "nd2."), _CHAINS, recursive=True,
))
def newest_graph_summary(spark, sf):
    return _newest_graph(spark, sf)[2]


@query("timed_ip_edges", over(
    "events",
    "SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, 'same_ip_in_time' AS relation, a.source_ip AS key, "
    "1.0::DOUBLE AS weight FROM tm a JOIN tm b ON a.source_ip = b.source_ip AND b.rk > a.rk "
    "AND epoch_us(b.event_ts) - epoch_us(a.event_ts) <= 300000000",
    "tm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY event_ts, id) AS rk FROM ev "
    "WHERE source_ip NOT IN ('unknown', '0.0.0.0'))",
))
def timed_ip_edges(spark, sf):
    """All links within five minutes, however many events of the address lie between."""
    return C.timed_ip_edges(base.stored_events(spark, sf), reach=None)


SESSIONS = """
ses AS MATERIALIZED (SELECT *, sum(opens) OVER (PARTITION BY source_ip ORDER BY event_ts, id) AS s FROM (
  SELECT *, CASE WHEN coalesce(epoch_us(event_ts) - epoch_us(lag(event_ts) OVER (PARTITION BY source_ip ORDER BY event_ts, id)), 300000000) >= 300000000
    THEN 1 ELSE 0 END AS opens FROM ev WHERE source_ip NOT IN ('unknown', '0.0.0.0'))),
sessions AS MATERIALIZED (SELECT source_ip, min(event_ts) AS first_ts, max(event_ts) AS last_ts, count(*) AS event_count,
  list_sort(coalesce(list(DISTINCT tactic) FILTER (tactic IS NOT NULL), [])) AS tactics FROM ses GROUP BY source_ip, s)
"""
_MICROS = "epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us"


def _micros(df, *rest):
    return df.select(
        "source_ip", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), *rest,
    )


@query("address_sessions", over(
    "events", f"SELECT source_ip, {_MICROS}, event_count, array_to_string(tactics, ',') AS tactics FROM sessions", SESSIONS
))
def address_sessions(spark, sf):
    sessions = C.address_sessions(base.stored_events(spark, sf))
    return _micros(sessions, "event_count", F.array_join("tactics", ",").alias("tactics"))


_SESSION_CHAINS = f"""SELECT source_ip, {_MICROS}, event_count, chain_name, severity,
    CAST(round_even(len(found) / len(required) * 100, 0) AS INT) AS match_percent, array_to_string(found, ',') AS tactics_found
  FROM (SELECT s.*, c.*, list_sort(list_intersect(c.required, s.tactics)) AS found FROM sessions s, chain_table c)
  WHERE len(found) / len(required) >= """
SESSION_CHAINS = _SESSION_CHAINS + "0.67"


@query("session_chains", over("events", SESSION_CHAINS, SESSIONS, _CHAINS))
def session_chains(spark, sf):
    chains = C.session_chains(C.address_sessions(base.stored_events(spark, sf)))
    return _micros(
        chains, "event_count", "chain_name", "severity", "match_percent",
        F.array_join("tactics_found", ",").alias("tactics_found"),
    )


@query("session_chains_in_part", over("events", _SESSION_CHAINS + "0.3", SESSIONS, _CHAINS))
def session_chains_in_part(spark, sf):
    """Few sessions hold two thirds of a chain; here one tactic of three is enough."""
    chains = C.session_chains(C.address_sessions(base.stored_events(spark, sf)), min_match=0.3)
    return _micros(
        chains, "event_count", "chain_name", "severity", "match_percent",
        F.array_join("tactics_found", ",").alias("tactics_found"),
    )


# With a day of silence as the gap, sessions are long enough to hold whole chains.
DAY_SESSIONS = SESSIONS.replace("300000000", "86400000000")


@query("session_chains_of_days", over("events", SESSION_CHAINS, DAY_SESSIONS, _CHAINS))
def session_chains_of_days(spark, sf):
    chains = C.session_chains(C.address_sessions(base.stored_events(spark, sf), gap_minutes=1440))
    return _micros(
        chains, "event_count", "chain_name", "severity", "match_percent",
        F.array_join("tactics_found", ",").alias("tactics_found"),
    )


_IN_ORDER = " UNION ALL ".join(
    f"SELECT source_ip, {text(c.name)} AS chain_name, epoch_us(t0) AS first_us, epoch_us(t{len(c.tactics) - 1}) AS last_us FROM "
    f"(SELECT source_ip, " + ", ".join(f"min(event_ts) FILTER (tactic = {text(t)}) AS t{i}" for i, t in enumerate(c.tactics))
    + " FROM ev WHERE source_ip NOT IN ('unknown', '0.0.0.0') GROUP BY source_ip) WHERE "
    + " AND ".join(f"t{i} <= t{i + 1}" for i in range(len(c.tactics) - 1))
    for c in KILL_CHAINS
)


@query("ordered_chains", over("events", _IN_ORDER))
def ordered_chains(spark, sf):
    return _micros(C.ordered_chains(base.stored_events(spark, sf)), "chain_name")
