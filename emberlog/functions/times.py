"""Timestamp expressions over the four text layouts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import lookup, strip_space

_CLOCK = r"(2[0-3]|[01]?\d):([0-5]?\d):([0-5]?\d)"
_DAY = r"(3[01]|[12]\d|0?[1-9])"

# Shapes of the four layouts.
SYSLOG_TIME = rf"(?i)^([a-z]{{3}})\s+{_DAY}\s+{_CLOCK}$"
ACCESS_TIME = rf"(?i)^{_DAY}/([a-z]{{3}})/(\d{{4}}):{_CLOCK}\s+([+-]\d{{2}}):?(\d{{2}})$"
ACCESS_TIME_UTC = rf"(?i)^{_DAY}/([a-z]{{3}})/(\d{{4}}):{_CLOCK}\s+Z$"
WINDOWS_TIME = rf"^(\d{{4}})-(1[0-2]|0?[1-9])-{_DAY}\s+{_CLOCK}$"
ISO_TIME = rf"(?i)^(\d{{4}})-(1[0-2]|0?[1-9])-{_DAY}T{_CLOCK}Z$"

# Longest day of each month in a year without a leap day.
MONTH_DAYS = {
    "jan": 31, "feb": 28, "mar": 31, "apr": 30, "may": 31, "jun": 30,
    "jul": 31, "aug": 31, "sep": 30, "oct": 31, "nov": 30, "dec": 31,
}
MONTH_NUMBER = {name: index + 1 for index, name in enumerate(MONTH_DAYS)}

# Starts of texts whose day exists in every month, so that no calendar is asked.
_EARLY_DAY = r"(?:1\d|2[0-8]|0?[1-9])"
_SYSLOG_EARLY = rf"(?i)^(?:{'|'.join(MONTH_DAYS)})\s+{_EARLY_DAY}\s"
_ACCESS_EARLY = rf"(?i)^{_EARLY_DAY}/(?:{'|'.join(MONTH_DAYS)})/(?!0000)"
_NUMERIC_EARLY = rf"^(?!0000)\d{{4}}-(?:1[0-2]|0?[1-9])-{_EARLY_DAY}[T\s]"


def _part(ts: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(ts, pattern, group)


def _number(ts: Column, pattern: str, group: int) -> Column:
    return _part(ts, pattern, group).try_cast("int")


def _numeric_date(ts: Column, pattern: str) -> Column:
    """Date of a text that fits ``pattern``, from one match; NULL if the calendar has no such day."""
    return F.regexp_replace(ts, pattern, "$1-$2-$3").try_cast("date")


def _access_date(ts: Column, pattern: str) -> Column:
    month = lookup(F.lower(_part(ts, pattern, 2)), MONTH_NUMBER, 0).cast("string")
    return F.concat_ws("-", _part(ts, pattern, 3), month, _part(ts, pattern, 1)).try_cast("date")


def _valid_syslog(ts: Column) -> Column:
    month = F.lower(_part(ts, SYSLOG_TIME, 1))
    in_month = _number(ts, SYSLOG_TIME, 2) <= lookup(month, MONTH_DAYS, 0)
    return ts.rlike(SYSLOG_TIME) & (ts.rlike(_SYSLOG_EARLY) | in_month)


def hour_of_day(timestamp: Column, fallback: int | Column = -1) -> Column:
    """Wall-clock hour of the timestamp text; ``fallback`` where no layout fits."""
    ts = strip_space(timestamp)
    default = fallback if isinstance(fallback, Column) else F.lit(fallback)

    def valid(pattern: str, early: str, date: Column) -> Column:
        return ts.rlike(pattern) & (ts.rlike(early) | date.isNotNull())

    return (
        F.when(_valid_syslog(ts), _number(ts, SYSLOG_TIME, 3))
        .when(valid(ACCESS_TIME, _ACCESS_EARLY, _access_date(ts, ACCESS_TIME)), _number(ts, ACCESS_TIME, 4))
        .when(valid(ACCESS_TIME_UTC, _ACCESS_EARLY, _access_date(ts, ACCESS_TIME_UTC)), _number(ts, ACCESS_TIME_UTC, 4))
        .when(valid(WINDOWS_TIME, _NUMERIC_EARLY, _numeric_date(ts, WINDOWS_TIME)), _number(ts, WINDOWS_TIME, 4))
        .when(valid(ISO_TIME, _NUMERIC_EARLY, _numeric_date(ts, ISO_TIME)), _number(ts, ISO_TIME, 4))
        .otherwise(default)
    )


def is_weekend(timestamp: Column) -> Column:
    """1 on Saturday and Sunday for the two layouts with a numeric date, else 0."""
    ts = strip_space(timestamp)
    day = F.when(ts.rlike(WINDOWS_TIME), _numeric_date(ts, WINDOWS_TIME)).when(
        ts.rlike(ISO_TIME), _numeric_date(ts, ISO_TIME)
    )
    return F.when(F.weekday(day) >= 5, 1).otherwise(0)


def event_time(timestamp: Column, assumed_year: int = 1970) -> Column:
    """Real timestamp of the text, NULL where no layout fits; syslog text carries no year."""
    ts = strip_space(timestamp)

    def clock(pattern: str, group: int) -> Column:
        return F.concat_ws(":", *[_part(ts, pattern, group + step) for step in range(3)])

    def at(date: Column, time_text: Column, zone: Column | None = None) -> Column:
        text = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), time_text)
        if zone is not None:
            return F.try_to_timestamp(F.concat(text, F.lit(" "), zone), F.lit("yyyy-MM-dd H:m:s Z"))
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:m:s"))

    syslog_month = lookup(F.lower(_part(ts, SYSLOG_TIME, 1)), MONTH_NUMBER, 0).cast("string")
    syslog_date = F.try_to_date(
        F.concat_ws("-", F.lit(f"{assumed_year:04d}"), syslog_month, _part(ts, SYSLOG_TIME, 2)), "yyyy-M-d"
    )
    zone = F.concat(_part(ts, ACCESS_TIME, 7), _part(ts, ACCESS_TIME, 8))
    return (
        F.when(ts.rlike(SYSLOG_TIME), at(syslog_date, clock(SYSLOG_TIME, 3)))
        .when(ts.rlike(ACCESS_TIME), at(_access_date(ts, ACCESS_TIME), clock(ACCESS_TIME, 4), zone))
        .when(ts.rlike(ACCESS_TIME_UTC), at(_access_date(ts, ACCESS_TIME_UTC), clock(ACCESS_TIME_UTC, 4)))
        .when(ts.rlike(WINDOWS_TIME), at(_numeric_date(ts, WINDOWS_TIME), clock(WINDOWS_TIME, 4)))
        .when(ts.rlike(ISO_TIME), at(_numeric_date(ts, ISO_TIME), clock(ISO_TIME, 4)))
    )
