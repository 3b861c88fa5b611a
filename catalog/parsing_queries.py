"""Sources, normalisation and tagging over the given tables."""

from pyspark.sql import functions as F

from catalog import base
from catalog.duck_base import (
    QUAD, any_word, case_of, external, found, over, syslog_severity, tag_columns, text,
)
from catalog.registry import query
from emberlog.constants import parsing as P
from emberlog.constants.attack_rules import CONFIDENCE_RANK, RULES, TECHNIQUES
from emberlog.functions import is_external
from emberlog.functions.text import first_address, lookup
from emberlog.operators import normalize, tagging
from emberlog.operators.rule_table import tag_by_rule_table
from emberlog.session import new_stage_path
from emberlog.sources.lines import read_export_records, read_lines, read_sources

_PARSED_COLUMNS = "seq, timestamp, severity, source_ip, message, raw, format"


@query("normalize_events", over("parsed", f"SELECT {_PARSED_COLUMNS} FROM parsed"))
def normalize_events(spark, sf):
    return base.parsed(spark, sf).drop("event_ts", "ip", "event_type")


@query("format_report", over(
    "parsed",
    "SELECT format, count(*) AS n_lines, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent "
    "FROM parsed GROUP BY format",
))
def format_report(spark, sf):
    return normalize.parse_rate_report(base.parsed(spark, sf))


@query("extraction_rate", over(
    "lines", "SELECT count(*) AS n_lines, count(*) AS n_events, 100.0::DOUBLE AS extraction_rate FROM lines"
))
def extraction_rate(spark, sf):
    lines = base.lines(spark, sf)
    return normalize.extraction_rate(lines, normalize.normalize_lines(lines))


def _format_query(name: str):
    @query(f"parse_{name}", over("parsed", f"SELECT {_PARSED_COLUMNS} FROM parsed WHERE format = '{name}'"))
    def run(spark, sf):
        return base.parsed(spark, sf).filter(F.col("format") == name).drop("event_ts", "ip", "event_type")

    return run


for _name in P.FORMAT_CODE:
    _format_query(_name)


@query("documents_as_lines", f"""
    SELECT doc_id, 'INFO' AS severity, coalesce(nullif(regexp_extract(line, {text(QUAD)}, 1), ''), 'unknown') AS source_ip,
      length(substr(line, 1, 200)) AS message_length, length(line) AS raw_length, md5(line) AS raw_md5, 'unknown' AS format
    FROM (SELECT doc_id, trim(text, E' \\t\\n\\r') AS line FROM documents)
    WHERE line <> '' AND line NOT LIKE '#%'""")
def documents_as_lines(spark, sf):
    docs = base.table(spark, sf, "documents").select("doc_id", "text")
    return normalize.normalize_lines(docs, "text").select(
        "doc_id", "severity", "source_ip", F.length("message").alias("message_length"),
        F.length("raw").alias("raw_length"), F.md5("raw").alias("raw_md5"), "format",
    )


@query("syslog_severity_of_conversations",
       f"SELECT conv_id, turn, {syslog_severity('text')} AS severity FROM conversations")
def syslog_severity_of_conversations(spark, sf):
    return base.table(spark, sf, "conversations").select(
        "conv_id", "turn", normalize.syslog_severity(F.col("text")).alias("severity")
    )


@query("http_status_severity", """
    SELECT l_orderkey, l_linenumber, status,
      CASE WHEN TRY_CAST(status AS INT) >= 500 THEN 'MEDIUM' WHEN TRY_CAST(status AS INT) IN (401, 403) THEN 'MEDIUM'
        WHEN TRY_CAST(status AS INT) = 404 THEN 'LOW' ELSE 'INFO' END AS severity
    FROM (SELECT l_orderkey, l_linenumber, CAST(200 + l_suppkey * 7 % 400 AS VARCHAR) AS status FROM lineitem)""")
def http_status_severity(spark, sf):
    status = (200 + F.col("l_suppkey") * 7 % 400).cast("string")
    return base.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", status.alias("status"), normalize.status_severity(status).alias("severity")
    )


_EVENT_ID = (
    "CASE event_type WHEN 'error' THEN '4625' WHEN 'purchase' THEN '4698' WHEN 'signup' THEN '4740' "
    "WHEN 'click' THEN '1102' ELSE '9999' END"
)


@query("windows_event_severity",
       f"SELECT event_id, {_EVENT_ID} AS windows_id, {case_of(_EVENT_ID, P.WINDOWS_SEVERITY, chr(39) + 'LOW' + chr(39))} AS severity FROM events")
def windows_event_severity(spark, sf):
    events = base.table(spark, sf, "events").select("event_id", F.expr(_EVENT_ID).alias("windows_id"))
    return events.withColumn("severity", normalize.windows_severity(F.col("windows_id")))


# Export records built from the events table, the same text in both dialects.
_RECORD = """
SELECT event_id, chr(10) || '  Log Name: Security' || chr(10) || '  Source: Auditing ' || event_type || chr(10)
  || CASE WHEN user_id % 11 = 0 THEN '' ELSE '  Date: {D}' || chr(10) END
  || CASE WHEN user_id % 13 = 0 THEN '' ELSE '  Event ID: ' || eid || chr(10) END
  || CASE WHEN user_id % 3 = 0 THEN '' ELSE '  Computer: HOST-' || CAST(user_id % 10 AS STRING) || chr(10) END
  || CASE WHEN user_id % 4 = 0 THEN '  Account Name: -' || chr(10) ELSE '  Account Name: u' || CAST(user_id AS STRING) || chr(10) END
  || CASE WHEN user_id % 5 = 0 THEN '' ELSE '  Network Address: ' || '10.0.0.' || CAST(user_id % 250 AS STRING) || chr(10) END
  || CASE WHEN user_id % 7 = 0 THEN '' ELSE '  Description: ' || chr(10) || 'A ' || event_type || ' was seen with value '
       || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '.' || chr(10) || 'See Event[] for more, the usual text of such records goes on for a while.' || chr(10) || chr(10)
       || 'Trailer' || chr(10) END AS record
FROM (SELECT *, {EID} AS eid FROM {events}) e
"""
_SPARK_RECORD = _RECORD.replace("'  Date: {D}'", "'  Date: ' || date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")").replace(
    "{EID}", _EVENT_ID)
_DUCK_RECORD = _RECORD.replace("'  Date: {D}'", "'  Date: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S')").replace(
    "{EID}", _EVENT_ID).replace("{events}", "events")


def _records(spark, sf):
    events = base.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return spark.sql(_SPARK_RECORD, events=base.spread(events))


def _export_sql(profile: str) -> str:
    def field(pattern: str) -> str:
        return f"nullif(regexp_extract(record, {text(pattern)}, 1), '')"

    missing = "'unknown'" if profile == "A" else "'127.0.0.1'"
    severity = case_of("eid", P.EXPORT_SEVERITY_A if profile == "A" else P.EXPORT_SEVERITY_B, "'INFO'")
    user = "CASE WHEN usr IS NULL OR usr = '-' THEN '' ELSE {} || usr END"
    ip = f"CASE WHEN source_ip = {missing} THEN '' ELSE {{}} || source_ip END"
    if profile == "A":
        message = (
            "'EventID=' || eid || " + user.format("' User='") + " || " + ip.format("' Source='")
            + " || ' ' || coalesce(trim(src), 'Windows') || ': ' || substr(descr, 1, 100)"
        )
    else:
        label = case_of("eid", P.EXPORT_TEXT_B, "'Windows Event ' || eid")
        message = (
            f"'EventID=' || eid || ': ' || {label} || " + user.format("' | User: '") + " || " + ip.format("' | From: '")
            + " || ' | Host: ' || coalesce(comp, 'local')"
        )
    return f"""
    WITH records AS ({_DUCK_RECORD}), fields AS (SELECT event_id, record, {field(r'Event ID:\s*(\d+)')} AS eid,
        {field(r'Date:\s*(\S+)')} AS dt, {field(r'Source:\s*(.+)')} AS src, {field(r'Computer:\s*(\S+)')} AS comp,
        {field(r'Account Name:\s*(\S+)')} AS usr, coalesce({field(QUAD)}, {missing}) AS source_ip,
        CASE WHEN contains(record, 'Description:')
          THEN trim(split_part(split_part(record, 'Description:', 2), chr(10) || chr(10), 1), E' \\n')
          ELSE 'EventID ' || {field(r'Event ID:\s*(\d+)')} END AS descr FROM records)
    SELECT event_id, coalesce(dt, 'unknown') AS timestamp, {severity} AS severity, source_ip, {message} AS message,
      substr(trim(record, E' \\n'), 1, 300) AS raw, 'windows_event' AS format FROM fields WHERE eid IS NOT NULL"""


@query("normalize_export_records_a", _export_sql("A"))
def normalize_export_records_a(spark, sf):
    return normalize.normalize_export_records(_records(spark, sf), profile="A")


@query("normalize_export_records_b", _export_sql("B"))
def normalize_export_records_b(spark, sf):
    return normalize.normalize_export_records(_records(spark, sf), profile="B")


@query("export_record_source", f"""
    WITH records AS ({_DUCK_RECORD})
    SELECT record, count(*) AS n FROM (SELECT trim(record, E' \\n') AS record FROM records) GROUP BY record""")
def export_record_source(spark, sf):
    """Records written as export files and read back with the splittable reader."""
    path = new_stage_path(spark, "export-files")
    marked = F.concat(F.lit("Event["), F.col("event_id").cast("string"), F.lit("]:"), F.col("record"))
    _records(spark, sf).select(marked.alias("value")).write.text(path)
    records = read_export_records(spark, path)
    return records.groupBy(F.btrim("record", F.lit(" \n")).alias("record")).agg(F.count("*").alias("n"))


@query("line_source", over(
    "lines",
    "SELECT count(*) AS n_lines, 0::BIGINT AS first_seq, count(*) - 1 AS last_seq, count(*) AS n_seq, "
    "CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines",
))
def line_source(spark, sf):
    """Lines written as text files and read back with a dense row number."""
    path = new_stage_path(spark, "line-files")
    base.lines(spark, sf).select(F.col("line").alias("value")).write.text(path)
    return read_lines(spark, [path, path + "-missing"]).agg(
        F.count("*").alias("n_lines"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.count_distinct("seq").alias("n_seq"), F.sum(F.length("line")).alias("n_chars"),
    )


@query("ordered_lines", over("lines", "SELECT seq, line FROM lines"))
def ordered_lines(spark, sf):
    """Lines written in order to several files come back under their own numbers."""
    path = new_stage_path(spark, "ordered-lines")
    lines = base.lines(spark, sf).repartitionByRange(4, "seq").sortWithinPartitions("seq")
    lines.select(F.col("line").alias("value")).write.text(path)
    return read_lines(spark, path)


@query("combined_sources", over(
    "parsed",
    f"""SELECT seq, timestamp, severity, source_ip, message, format FROM parsed UNION ALL
    SELECT (SELECT count(*) FROM parsed) + row_number() OVER (ORDER BY event_id) - 1, timestamp, severity, source_ip, message, format
    FROM ({_export_sql("A")})""",
))
def combined_sources(spark, sf):
    """Lines first, then export records, under one dense row number."""
    line_path, export_path = new_stage_path(spark, "source-lines"), new_stage_path(spark, "source-exports")
    lines = base.lines(spark, sf).repartitionByRange(4, "seq").sortWithinPartitions("seq")
    lines.select(F.col("line").alias("value")).write.text(line_path)
    marked = F.concat(F.lit("Event["), F.col("event_id").cast("string"), F.lit("]:"), F.col("record"))
    records = _records(spark, sf).repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    records.select(marked.alias("value")).write.text(export_path)
    events = read_sources(spark, "combined", [line_path], [export_path])
    return events.select("seq", "timestamp", "severity", "source_ip", "message", "format")


@query("external_addresses", over(
    "lines", f"SELECT seq, ip, {external('ip')} AS is_external FROM lines"
))
def external_addresses(spark, sf):
    return base.lines(spark, sf).select("seq", "ip", is_external(F.col("ip")).alias("is_external"))


@query("page_addresses", f"""
    SELECT page_id, coalesce(nullif(regexp_extract(html, {text(QUAD)}, 1), ''), 'unknown') AS address FROM pages""")
def page_addresses(spark, sf):
    return base.table(spark, sf, "pages").select("page_id", first_address(F.col("html")).alias("address"))


# --- tagging ------------------------------------------------------------------------------------

_TAGS = "technique_id, technique_name, tactic, mitre_confidence, matched_rule"


@query("tag_events", over("tagged", f"SELECT seq, {_TAGS} FROM tagged"))
def tag_events(spark, sf):
    return base.tagged(spark, sf).select("seq", *_TAGS.split(", "))


# One rule per order, for the lines of the process with the order's number; the fixed rules come before them.
_ORDER_CONFIDENCE = {"F": "HIGH", "O": "MEDIUM", "P": "LOW"}
_BY_ORDER = f"""
SELECT seq, CASE WHEN wins THEN 'T1046' ELSE technique_id END AS technique_id,
  CASE WHEN wins THEN {text(TECHNIQUES["T1046"][0])} ELSE technique_name END AS technique_name,
  CASE WHEN wins THEN {text(TECHNIQUES["T1046"][1])} ELSE tactic END AS tactic,
  CASE WHEN wins THEN confidence ELSE mitre_confidence END AS mitre_confidence,
  CASE WHEN wins THEN 'sshd' || chr(92) || '[' || o_orderkey || chr(92) || ']: ' ELSE matched_rule END AS matched_rule
FROM (SELECT *, o_orderkey IS NOT NULL
    AND {case_of("confidence", CONFIDENCE_RANK, "-1")} > {case_of("mitre_confidence", CONFIDENCE_RANK, "-1")} AS wins
  FROM (SELECT t.*, o.o_orderkey, {case_of("o.o_orderstatus", _ORDER_CONFIDENCE, "'NONE'")} AS confidence FROM tagged t
    LEFT JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = regexp_extract(t.raw, 'sshd.([0-9]+).: ', 1)))"""


def _fixed_rules(spark):
    rows = [(r.technique, r.confidence, p, i, j) for i, r in enumerate(RULES) for j, p in enumerate(r.patterns)]
    return spark.createDataFrame(rows, "technique string, confidence string, pattern string, rule_order long, pattern_order int")


@query("tags_by_rule_table", over("tagged", _BY_ORDER))
def tags_by_rule_table(spark, sf):
    """The fixed rules and one rule per order, all from one table; at sf0.1 150,000 patterns."""
    per_order = base.table(spark, sf, "orders").select(
        F.lit("T1046").alias("technique"),
        lookup(F.col("o_orderstatus"), _ORDER_CONFIDENCE, "NONE").alias("confidence"),
        F.format_string("sshd\\[%d\\]: ", "o_orderkey").alias("pattern"),
        (F.col("o_orderkey") + len(RULES)).alias("rule_order"),
        F.lit(0).alias("pattern_order"),
    )
    techniques = spark.createDataFrame(
        [(t, name, tactic) for t, (name, tactic) in TECHNIQUES.items()], "technique string, name string, tactic string"
    )
    rules = _fixed_rules(spark).unionByName(per_order)
    return tag_by_rule_table(base.parsed(spark, sf), rules, techniques).select("seq", *_TAGS.split(", "))


def _text_tags(name: str, keys: str, expr: str) -> str:
    rule, columns = tag_columns("txt")
    return (
        f"SELECT {keys}, {columns} FROM (SELECT *, {rule} AS _rule FROM (SELECT {keys}, {expr} || ' ' AS txt FROM {name}))"
    )


@query("tag_documents", _text_tags("documents", "doc_id", "text"))
def tag_documents(spark, sf):
    docs = base.spread(base.table(spark, sf, "documents").select("doc_id", "text"))
    return tagging.tag_events(docs, message_col="text", raw_col=None).drop("text")


@query("tag_conversations", _text_tags("conversations", "conv_id, turn", "text"))
def tag_conversations(spark, sf):
    turns = base.spread(base.table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return tagging.tag_events(turns, message_col="text", raw_col=None).drop("text")


@query("tag_pages", _text_tags("pages", "page_id", "html"))
def tag_pages(spark, sf):
    pages = base.spread(base.table(spark, sf, "pages").select("page_id", "html"))
    return tagging.tag_events(pages, message_col="html", raw_col=None).drop("html")


@query("technique_report", over(
    "tagged",
    "SELECT technique_id, technique_name, count(*) AS n_events FROM tagged WHERE technique_id IS NOT NULL "
    "GROUP BY ALL ORDER BY n_events DESC, technique_id LIMIT 8",
))
def technique_report(spark, sf):
    return tagging.technique_report(base.tagged(spark, sf))


@query("tactic_report", over(
    "tagged", "SELECT tactic, count(*) AS n_events FROM tagged WHERE tactic IS NOT NULL GROUP BY tactic"
))
def tactic_report(spark, sf):
    return tagging.tactic_report(base.tagged(spark, sf))


@query("tag_rate", over(
    "tagged",
    "SELECT count(*) AS total_events, count(technique_id) AS tagged_events, "
    "round(count(technique_id) * 100.0 / count(*), 1) AS tag_rate FROM tagged",
))
def tag_rate(spark, sf):
    return tagging.tag_rate(base.tagged(spark, sf))


_EXPECTED = (
    "CASE event_type WHEN 'error' THEN 'T1110.001' WHEN 'purchase' THEN 'T1190' WHEN 'signup' THEN 'T1078' "
    "WHEN 'click' THEN 'T1059.001' END"
)


@query("tagging_accuracy", over(
    "tagged",
    "SELECT count(*) AS threat_events, count(technique_id) AS classified, "
    "count(*) FILTER (technique_id = expected) AS correct, "
    "round(count(technique_id) * 100.0 / count(*), 1) AS classification_rate, "
    "round(count(*) FILTER (technique_id = expected) * 100.0 / count(*), 1) AS accuracy "
    f"FROM (SELECT *, {_EXPECTED} AS expected FROM tagged) WHERE expected IS NOT NULL",
))
def tagging_accuracy(spark, sf):
    labelled = base.tagged(spark, sf).withColumn("expected_technique", F.expr(_EXPECTED))
    return tagging.tagging_accuracy(labelled)


@query("suspicious_words_in_documents", f"""
    SELECT doc_id, {any_word('lower(text)', P.SYSLOG_WORDS['CRITICAL'])} AS critical_word,
      {found('text', '(?:' + P.AUTH_WORDS + ')')} AS auth_word FROM documents""")
def suspicious_words_in_documents(spark, sf):
    from emberlog.functions import contains_any, matches

    docs = base.spread(base.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        contains_any(F.lower("text"), P.SYSLOG_WORDS["CRITICAL"]).alias("critical_word"),
        matches(F.col("text"), P.AUTH_WORDS).alias("auth_word"),
    )
