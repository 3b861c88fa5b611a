"""Raw lines and export records to the parsed event schema (column expressions only)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.constants import parsing as P
from emberlog.functions.once import once
from emberlog.functions.text import (
    contains_any,
    empty_to_null,
    first_address,
    lookup,
    strip_space,
)
from emberlog.functions.times import event_time

_JSON_KEYS = P.JSON_TIMESTAMP_KEYS + P.JSON_SEVERITY_KEYS + P.JSON_IP_KEYS + P.JSON_MESSAGE_KEYS
_JSON_TYPE = "array<struct<" + ",".join(f"`{key}`:string" for key in _JSON_KEYS) + ">>"

# Texts of JSON values that count as empty (zero, false, empty list or object).
_EMPTY_JSON = ["0", "0.0", "-0", "-0.0", "false", "[]", "{}"]

# Stands between the groups of one match.
_BREAK = "\x01"


def _worded_severity(lowered: Column) -> Column:
    result = None
    for severity, words in P.SYSLOG_WORDS.items():
        hit = contains_any(lowered, words)
        result = F.when(hit, severity) if result is None else result.when(hit, severity)
    return result.otherwise("INFO")


def syslog_severity(message: Column) -> Column:
    """Severity by the first word group found in the lower-cased message, else INFO."""
    return _worded_severity(F.lower(message))


def status_severity(status: Column) -> Column:
    """Severity of an HTTP status."""
    code = status.try_cast("int")
    return (
        F.when(code >= 500, "MEDIUM")
        .when(code == 403, "MEDIUM")
        .when(code == 401, "MEDIUM")
        .when(code == 404, "LOW")
        .otherwise("INFO")
    )


def windows_severity(event_id: Column) -> Column:
    return lookup(event_id, P.WINDOWS_SEVERITY, "LOW")


def spelled_severity(severity: Column) -> Column:
    """Map the alternative spellings to the five levels; other texts stay."""
    result = None
    for level, spellings in P.SEVERITY_SPELLINGS.items():
        hit = severity.isin(*spellings)
        result = F.when(hit, level) if result is None else result.when(hit, level)
    return result.otherwise(severity)


def _truthy(record: Column, line: Column, keys: list[str]) -> Column:
    """First alias with a non-empty value. Only a bare 0, false, [] or {} is empty, not its string."""
    values = []
    for key in keys:
        value = record.getField(key)
        quoted = line.rlike(rf'"{key}"\s*:\s*"')
        # A missing value is told first: the search for quotes is the costly part.
        values.append(F.when(value.isNotNull() & (value != "") & (~value.isin(*_EMPTY_JSON) | quoted), value))
    return F.coalesce(*values)


def _groups(raw: Column, pattern: str, numbers: tuple[int, ...]) -> Column:
    """The groups of an anchored pattern that fits ``raw``, from one match instead of one per group."""
    joined = F.regexp_replace(raw, f"{pattern}(?s:.*)", _BREAK.join(f"${number}" for number in numbers))
    one_by_one = F.array(*[F.regexp_extract(raw, pattern, number) for number in numbers])
    return F.when(raw.contains(_BREAK), one_by_one).otherwise(F.split(joined, _BREAK))


def normalize_lines(
    lines: DataFrame, line_col: str = "line", lenient_time: bool = False
) -> DataFrame:
    """Parse a table of raw lines; blank and ``#`` lines are dropped, other columns are kept.

    Formats are tried in the order JSON, Windows text, access log, syslog; the rest is ``unknown``.
    ``lenient_time`` also accepts one-digit hours in syslog lines.
    """
    syslog_pattern = P.SYSLOG_LINE_LENIENT if lenient_time else P.SYSLOG_LINE
    kept = [c for c in lines.columns if c != line_col]
    raw = F.col("raw")
    stripped = lines.withColumn("raw", strip_space(F.col(line_col)))

    # Wrapped in brackets, so that text after the object makes the whole value invalid.
    wrapped = F.from_json(
        F.concat(F.lit("["), raw, F.lit("]")), _JSON_TYPE, {"allowSingleQuotes": "false"}
    )
    with_json = stripped.withColumn("_json", F.when(raw.like("{%}"), wrapped))
    is_json = F.col("_json").isNotNull() & (F.size("_json") == 1)
    with_format = with_json.withColumn(
        "format",
        F.when(is_json, "json")
        .when(raw.contains("EventID=") & raw.rlike(P.WINDOWS_LINE), "windows_event")
        .when(raw.contains('"') & raw.rlike(P.ACCESS_LINE), "apache")
        .when(raw.rlike(syslog_pattern), "syslog")
        .otherwise("unknown"),
    )

    # One extraction per field; everything below reads the array instead of the line.
    groups = {
        "windows_event": (P.WINDOWS_LINE, (1, 2, 3, 4, 5)),
        "apache": (P.ACCESS_LINE, (1, 2, 3, 4, 5)),
        "syslog": (syslog_pattern, (1, 2, 3, 6)),
    }
    kind = F.col("format")
    parts = None
    for name, (pattern, numbers) in groups.items():
        fields = _groups(raw, pattern, numbers)
        parts = F.when(kind == name, fields) if parts is None else parts.when(kind == name, fields)
    record = F.col("_json")[0]
    with_parts = with_format.select(
        *kept,
        "raw",
        "format",
        parts.alias("_parts"),
        F.when(
            kind == "json",
            F.array(
                _truthy(record, raw, P.JSON_TIMESTAMP_KEYS),
                F.upper(_truthy(record, raw, P.JSON_SEVERITY_KEYS)),
                _truthy(record, raw, P.JSON_IP_KEYS),
                _truthy(record, raw, P.JSON_MESSAGE_KEYS),
            ),
        ).alias("_values"),
    )

    part = [F.col("_parts")[index] for index in range(5)]
    value = [F.col("_values")[index] for index in range(4)]
    user = empty_to_null(part[2])
    with_message = with_parts.withColumn(
        "message",
        F.when(kind == "json", F.coalesce(value[3], raw))
        .when(
            kind == "windows_event",
            F.concat(
                F.lit("EventID "), part[1], F.lit(": "),
                F.coalesce(F.concat(F.lit("["), user, F.lit("] ")), F.lit("")), part[4],
            ),
        )
        .when(kind == "apache", F.concat(part[2], F.lit(" "), part[3], F.lit(" → HTTP "), part[4]))
        .when(kind == "syslog", part[3])
        .otherwise(F.substring(raw, 1, 200)),
    ).withColumn("_lower", F.when(kind == "syslog", F.lower(F.col("message"))))
    shaped = once(with_message, "raw", "format", "_parts", "_values", "message", "_lower")

    timestamp = (
        F.when(kind == "json", F.coalesce(value[0], F.lit("unknown")))
        .when(kind == "windows_event", part[0])
        .when(kind == "apache", part[1])
        .when(kind == "syslog", F.concat_ws(" ", *part[:3]))
        .otherwise("unknown")
    )
    severity = (
        F.when(kind == "json", spelled_severity(F.coalesce(value[1], F.lit("INFO"))))
        .when(kind == "windows_event", windows_severity(part[1]))
        .when(kind == "apache", status_severity(part[4]))
        .when(kind == "syslog", _worded_severity(F.col("_lower")))
        .otherwise("INFO")
    )
    source_ip = (
        F.when(kind == "json", F.coalesce(value[2], F.lit("unknown")))
        .when(kind == "windows_event", F.coalesce(empty_to_null(part[3]), F.lit("unknown")))
        .when(kind == "apache", part[0])
        .when(kind == "syslog", first_address(F.col("message")))
        .otherwise(first_address(raw))
    )
    return shaped.filter((raw != "") & ~raw.startswith("#")).select(
        *kept,
        timestamp.alias("timestamp"),
        severity.alias("severity"),
        F.coalesce(source_ip, F.lit("unknown")).alias("source_ip"),
        "message",
        "raw",
        "format",
    )


def normalize_export_records(
    records: DataFrame, record_col: str = "record", profile: str = "A"
) -> DataFrame:
    """Parse multi-line event-export records; records without an event id are dropped.

    Profile A builds the message from source and description, profile B from a text table.
    """
    if profile not in ("A", "B"):
        raise ValueError(f"profile must be A or B, not {profile!r}")
    kept = [c for c in records.columns if c != record_col]
    text = F.col("_text")
    table = records.withColumn("_text", F.regexp_replace(F.col(record_col), r"\r\n?", "\n"))

    def field(pattern: str) -> Column:
        return empty_to_null(F.regexp_extract(text, f"(?dU){pattern}", 1))

    table = table.withColumn("_event_id", field(r"Event ID:\s*(\d+)")).filter(
        F.col("_event_id").isNotNull()
    )
    event_id = F.col("_event_id")
    missing = "unknown" if profile == "A" else "127.0.0.1"
    address = F.coalesce(field(P.DOTTED_QUAD.removeprefix("(?U)")), F.lit(missing))
    table = table.withColumn("source_ip", address)

    user = field(r"Account Name:\s*(\S+)")
    named_user = F.when(user != "-", user)
    known_ip = F.when(F.col("source_ip") != missing, F.col("source_ip"))
    if profile == "A":
        source = F.coalesce(strip_space(field(r"Source:\s*(.+)")), F.lit("Windows"))
        has_description = text.contains("Description:")
        description = F.when(
            has_description,
            strip_space(F.regexp_extract(text, r"(?dU)Description:((?s:.*?))(?=\n\n|\z)", 1)),
        ).otherwise(F.concat(F.lit("EventID "), event_id))
        message = F.concat(
            F.lit("EventID="), event_id,
            F.coalesce(F.concat(F.lit(" User="), named_user), F.lit("")),
            F.coalesce(F.concat(F.lit(" Source="), known_ip), F.lit("")),
            F.lit(" "), source, F.lit(": "), F.substring(description, 1, 100),
        )
        severity = lookup(event_id, P.EXPORT_SEVERITY_A, "INFO")
    else:
        host = F.coalesce(field(r"Computer:\s*(\S+)"), F.lit("local"))
        label = F.coalesce(
            F.try_element_at(
                F.create_map(*[F.lit(x) for pair in P.EXPORT_TEXT_B.items() for x in pair]), event_id
            ),
            F.concat(F.lit("Windows Event "), event_id),
        )
        message = F.concat(
            F.lit("EventID="), event_id, F.lit(": "), label,
            F.coalesce(F.concat(F.lit(" | User: "), named_user), F.lit("")),
            F.coalesce(F.concat(F.lit(" | From: "), known_ip), F.lit("")),
            F.lit(" | Host: "), host,
        )
        severity = lookup(event_id, P.EXPORT_SEVERITY_B, "INFO")
    table = once(table, "_text", "_event_id", "source_ip")
    return table.select(
        *kept,
        F.coalesce(field(r"Date:\s*(\S+)"), F.lit("unknown")).alias("timestamp"),
        severity.alias("severity"),
        "source_ip",
        message.alias("message"),
        F.substring(strip_space(text), 1, 300).alias("raw"),
        F.lit("windows_event").alias("format"),
    )


def with_event_time(parsed: DataFrame, assumed_year: int = 1970) -> DataFrame:
    """``parsed`` with ``event_ts``, the time that the text in ``timestamp`` stands for; an earlier one is replaced.

    NULL where no layout fits; such rows stay. Syslog text carries no year: ``assumed_year`` is taken.
    """
    timed = parsed.withColumn("event_ts", event_time(F.col("timestamp"), assumed_year))
    return once(timed, "event_ts")


def parse_rate_report(parsed: DataFrame) -> DataFrame:
    """Rows and share per format, in percent of all rows."""
    counts = parsed.groupBy("format").agg(F.count("*").alias("n_lines"))
    total = counts.agg(F.sum("n_lines")).scalar()
    return counts.select(
        "format", "n_lines", F.round(F.col("n_lines") / total * 100, 1).alias("percent")
    )


def extraction_rate(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Share of input lines that became events, in percent."""
    n_lines = lines.agg(F.count("*")).scalar()
    return parsed.agg(F.count("*").alias("n_events")).select(
        n_lines.alias("n_lines"),
        "n_events",
        F.when(n_lines > 0, F.round(F.col("n_events") / n_lines * 100, 1))
        .otherwise(F.lit(0.0))
        .alias("extraction_rate"),
    )
