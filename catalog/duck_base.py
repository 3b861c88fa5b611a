"""Common table expressions of the SQL counterparts (DuckDB dialect)."""

from catalog.lines import duck_lines_sql
from emberlog.constants import parsing as P
from emberlog.constants.attack_rules import CONFIDENCE_RANK, RULES, TECHNIQUES
from emberlog.schema import FEATURE_COLUMNS

_WIN = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+EventID=(\d+)\s+"
    r"(?:User=(\S+)\s+)?(?:Source=(\d+\.\d+\.\d+\.\d+)\s+)?Message=(.+)"
)
_ACC = r'^(\d+\.\d+\.\d+\.\d+)\s+-\s+-\s+\[([^\]]+)\]\s+"(\w+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\d+|-)'
_SYS = r"^(\w{3})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s+(.+)"
QUAD = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def case_of(key: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {text(k)} THEN {text(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


def any_word(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(w)})" for w in words) + ")"


def syslog_severity(expr: str) -> str:
    whens = " ".join(
        f"WHEN {any_word(f'lower({expr})', words)} THEN {text(level)}" for level, words in P.SYSLOG_WORDS.items()
    )
    return f"CASE {whens} ELSE 'INFO' END"


def found(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {text('(?i)' + pattern)})"


def address(expr: str) -> str:
    return f"coalesce(nullif(regexp_extract({expr}, {text(QUAD)}, 1), ''), 'unknown')"


LINES = f"lines AS MATERIALIZED ({duck_lines_sql()})"

_JSON = {
    name: "coalesce(" + ", ".join(f"nullif(json_extract_string(line, '$.\"{k}\"'), '')" for k in keys) + f", {rest})"
    for name, keys, rest in (
        ("ts", P.JSON_TIMESTAMP_KEYS, "'unknown'"),
        ("sev", P.JSON_SEVERITY_KEYS, "'INFO'"),
        ("ip", P.JSON_IP_KEYS, "'unknown'"),
        ("msg", P.JSON_MESSAGE_KEYS, "line"),
    )
}


def _part(pattern: str, group: int) -> str:
    return f"regexp_extract(line, {text(pattern)}, {group})"


PARSED = f"""
shaped AS MATERIALIZED (SELECT *, CASE
    WHEN line LIKE '{{%}}' AND json_valid(line) THEN 'json'
    WHEN regexp_matches(line, {text(_WIN)}) THEN 'windows_event'
    WHEN regexp_matches(line, {text(_ACC)}) THEN 'apache'
    WHEN regexp_matches(line, {text(_SYS)}) THEN 'syslog'
    ELSE 'unknown' END AS format FROM lines),
worded AS (SELECT *,
    CASE format WHEN 'json' THEN {_JSON["msg"]}
      WHEN 'windows_event' THEN 'EventID ' || {_part(_WIN, 2)} || ': '
        || CASE WHEN {_part(_WIN, 3)} = '' THEN '' ELSE '[' || {_part(_WIN, 3)} || '] ' END || {_part(_WIN, 5)}
      WHEN 'apache' THEN {_part(_ACC, 3)} || ' ' || {_part(_ACC, 4)} || ' → HTTP ' || {_part(_ACC, 5)}
      WHEN 'syslog' THEN {_part(_SYS, 6)}
      ELSE substr(line, 1, 200) END AS message,
    CASE WHEN format = 'json' THEN upper({_JSON["sev"]}) END AS level,
    CASE WHEN format = 'apache' THEN CAST({_part(_ACC, 5)} AS INT) END AS status
  FROM shaped),
parsed AS MATERIALIZED (SELECT seq, event_ts, ip, event_type,
    CASE format WHEN 'json' THEN {_JSON["ts"]} WHEN 'windows_event' THEN {_part(_WIN, 1)}
      WHEN 'apache' THEN {_part(_ACC, 2)}
      WHEN 'syslog' THEN {_part(_SYS, 1)} || ' ' || {_part(_SYS, 2)} || ' ' || {_part(_SYS, 3)}
      ELSE 'unknown' END AS timestamp,
    CASE format
      WHEN 'json' THEN CASE WHEN level IN ('WARNING','WARN') THEN 'MEDIUM' WHEN level IN ('ERROR','ERR') THEN 'HIGH'
        WHEN level IN ('DEBUG','TRACE') THEN 'LOW' ELSE level END
      WHEN 'windows_event' THEN {case_of(_part(_WIN, 2), P.WINDOWS_SEVERITY, "'LOW'")}
      WHEN 'apache' THEN CASE WHEN status >= 500 OR status IN (401, 403) THEN 'MEDIUM' WHEN status = 404 THEN 'LOW' ELSE 'INFO' END
      WHEN 'syslog' THEN {syslog_severity("message")}
      ELSE 'INFO' END AS severity,
    CASE format WHEN 'json' THEN {_JSON["ip"]}
      WHEN 'windows_event' THEN coalesce(nullif({_part(_WIN, 4)}, ''), 'unknown')
      WHEN 'apache' THEN {_part(_ACC, 1)}
      WHEN 'syslog' THEN {address("message")}
      ELSE {address("line")} END AS source_ip,
    message, line AS raw, format
  FROM worded)
"""

_RANKED = sorted(RULES, key=lambda rule: -CONFIDENCE_RANK[rule.confidence])


def tag_columns(expr: str) -> str:
    """technique_id, technique_name, tactic, mitre_confidence and matched_rule of a text."""
    rule = "CASE " + " ".join(
        f"WHEN {found(expr, '(?:' + '|'.join(f'(?:{p})' for p in r.patterns) + ')')} THEN {i}"
        for i, r in enumerate(_RANKED)
    ) + " END"
    pattern = "CASE _rule " + " ".join(
        f"WHEN {i} THEN CASE " + " ".join(f"WHEN {found(expr, p)} THEN {text(p)}" for p in r.patterns) + " END"
        for i, r in enumerate(_RANKED)
    ) + " END"

    def by_rule(values, default="NULL") -> str:
        return "CASE _rule " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + f" ELSE {default} END"

    return rule, ", ".join((
        by_rule([r.technique for r in _RANKED]) + " AS technique_id",
        by_rule([TECHNIQUES[r.technique][0] for r in _RANKED]) + " AS technique_name",
        by_rule([TECHNIQUES[r.technique][1] for r in _RANKED]) + " AS tactic",
        by_rule([r.confidence for r in _RANKED], "'NONE'") + " AS mitre_confidence",
        pattern + " AS matched_rule",
    ))


_RULE, _TAG_COLUMNS = tag_columns("txt")
TAGGED = f"""
tagged AS MATERIALIZED (SELECT * EXCLUDE (txt, _rule), {_TAG_COLUMNS}
  FROM (SELECT *, {_RULE} AS _rule FROM (SELECT *, message || ' ' || raw AS txt FROM parsed)))
"""


def py_round(expr: str, digits: int) -> str:
    """Nearest; exact binary ties to the even digit."""
    scaled = f"(({expr}) * {float(2 ** (digits + 1))})"
    return f"CASE WHEN {scaled} = floor({scaled}) THEN round_even({expr}, {digits}) ELSE round({expr}, {digits}) END"


_HOUR = r"""CASE format
   WHEN 'syslog' THEN CAST(regexp_extract(timestamp, '\s(\d{2}):\d{2}:\d{2}$', 1) AS INT)
   WHEN 'apache' THEN CAST(regexp_extract(timestamp, ':(\d{2}):\d{2}:\d{2}\s', 1) AS INT)
   WHEN 'windows_event' THEN CAST(regexp_extract(timestamp, '\s(\d{2}):', 1) AS INT)
   WHEN 'json' THEN CAST(regexp_extract(timestamp, 'T(\d{2}):', 1) AS INT) ELSE -1 END"""

FLAGS = {
    "has_sql_keywords": P.SQL_WORDS,
    "has_exec_keywords": P.EXEC_WORDS,
    "has_c2_keywords": P.C2_WORDS,
    "has_auth_failure": P.AUTH_WORDS,
    "has_privilege_esc": P.PRIVILEGE_WORDS,
}


def flag_columns(expr: str) -> str:
    return ", ".join(f"CAST({found(expr, '(?:' + p + ')')} AS INT) AS {name}" for name, p in FLAGS.items())


def external(expr: str) -> str:
    return (
        f"CASE WHEN {expr} IS NULL OR {expr} IN ('unknown', '') "
        f"OR regexp_matches({expr}, {text(P.PRIVATE_ADDRESS)}) THEN 0 ELSE 1 END"
    )


SEVERITY_RANK = "CASE severity " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in P.SEVERITY_RANK.items()
) + " ELSE 0 END"

FEATURES = f"""
ip_stats AS (SELECT source_ip, count(*) AS ip_event_count,
    {py_round("count(*) FILTER (severity IN ('HIGH','CRITICAL')) / count(*)", 4)} AS ip_fail_rate
  FROM parsed GROUP BY source_ip),
features AS MATERIALIZED (SELECT seq, {_HOUR} AS hour_of_day,
    CASE WHEN format IN ('windows_event','json') AND isodow(CAST(substr(timestamp, 1, 10) AS DATE)) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    {SEVERITY_RANK} AS severity_score,
    {case_of("format", P.FORMAT_CODE, "4")} AS format_encoded,
    {external("source_ip")} AS ip_is_external,
    ip_event_count, ip_fail_rate,
    count(*) OVER (PARTITION BY source_ip ORDER BY seq RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rolling_event_rate,
    length(message) AS message_length, {flag_columns("message")},
    0 AS anomaly_label, source_ip AS _source_ip, substr(message, 1, 120) AS _message, severity AS _severity,
    format AS _format, timestamp AS _timestamp, substr(raw, 1, 120) AS _raw
  FROM parsed JOIN ip_stats USING (source_ip))
"""


def zscore(columns, source: str = "features", key: str = "seq") -> str:
    """CTE ``zs``: key and largest absolute z-score."""
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(columns))
    terms = ", ".join(
        f"CASE WHEN s{i} > 0 THEN abs({c} - m{i}) / s{i} ELSE 0.0 END" for i, c in enumerate(columns)
    )
    return (
        f"zstats AS MATERIALIZED (SELECT {stats} FROM {source}), "
        f"zs AS MATERIALIZED (SELECT {source}.*, greatest({terms}) AS max_z FROM {source}, zstats)"
    )


def iqr(columns, source: str = "zs") -> str:
    """CTE ``fenced``: the source with ``anomaly_iqr``."""
    quart = ", ".join(
        f"quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS b{i}" for i, c in enumerate(columns)
    )
    terms = " OR ".join(
        f"(b{i} <> a{i} AND ({c} < a{i} - 1.5 * (b{i} - a{i}) OR {c} > b{i} + 1.5 * (b{i} - a{i})))"
        for i, c in enumerate(columns)
    )
    names = f"{source}.*"
    return (
        f"quartiles AS MATERIALIZED (SELECT {quart} FROM {source}), "
        f"fenced AS MATERIALIZED (SELECT {names}, ({terms}) AS anomaly_iqr FROM {source}, quartiles)"
    )


DETECTED = (
    zscore(FEATURE_COLUMNS) + ", " + iqr(FEATURE_COLUMNS) + """,
detected AS MATERIALIZED (SELECT *, max_z > 2.5 AS anomaly_zscore, round_even(least(max_z, 5.0) / 5.0, 4) AS anomaly_score,
    CASE WHEN max_z > 2.5 AND anomaly_iqr THEN 'HIGH' WHEN max_z > 2.5 OR anomaly_iqr THEN 'LOW' ELSE 'NONE' END AS confidence,
    (max_z > 2.5 AND anomaly_iqr) AS is_anomaly FROM fenced)
"""
)

EVENTS = """
ev AS MATERIALIZED (SELECT t.seq + 1 AS id, t.event_ts, t.timestamp, t.severity, t.source_ip, t.message, t.format AS log_format,
    d.anomaly_score, d.is_anomaly, d.confidence, CAST(d.anomaly_zscore AS INT) + CAST(d.anomaly_iqr AS INT) AS detector_votes,
    t.technique_id, t.technique_name, t.tactic, t.mitre_confidence, substr(t.raw, 1, 500) AS raw,
    (t.seq + 1) IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_false_positive
  FROM tagged t JOIN detected d USING (seq))
"""

_ORDER = ["lines", "parsed", "tagged", "features", "detected", "events"]
_PARTS = {
    "lines": LINES, "parsed": PARSED, "tagged": TAGGED, "features": FEATURES, "detected": DETECTED, "events": EVENTS,
}
_NEEDS = {
    "lines": ["lines"],
    "parsed": ["lines", "parsed"],
    "tagged": ["lines", "parsed", "tagged"],
    "features": ["lines", "parsed", "features"],
    "detected": ["lines", "parsed", "features", "detected"],
    "events": _ORDER,
}


def over(base: str, select: str, *extra: str, recursive: bool = False) -> str:
    """SQL with the CTEs up to ``base``, further CTEs and the final SELECT."""
    ctes = [_PARTS[name] for name in _NEEDS[base]] + list(extra)
    word = "WITH RECURSIVE " if recursive else "WITH "
    return word + ", ".join(ctes) + " " + select
