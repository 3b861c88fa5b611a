"""Column expressions: everything here takes and returns ``Column`` and stays JVM-side."""

from emberlog.functions.numbers import python_round, score_band
from emberlog.functions.text import (
    contains_any,
    first_address,
    is_external,
    matches,
    severity_rank,
    strip_space,
)
from emberlog.functions.times import event_time, hour_of_day, is_weekend

__all__ = [
    "contains_any", "event_time", "first_address", "hour_of_day", "is_external", "is_weekend",
    "matches", "python_round", "score_band", "severity_rank", "strip_space",
]
