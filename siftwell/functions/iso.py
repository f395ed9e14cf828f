"""ISO dates held in text.

A text value *looks like* a date when it starts with ``yyyy-MM-dd`` (a prefix test, so
``2020-01-01xyz`` counts); it *parses* only when the whole value is a date, a date and a
time, or a date, a time and a UTC offset. A column can therefore be of kind ``date`` and
still hold values that fall into no time bucket.

A day that its month does not have, such as ``2020-02-30``, does not parse.

Functions take and return SQL text, so an expression over many columns is built in one call.
"""

from __future__ import annotations

# The patterns that decide whether text is a date.
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"
TIME_PART = r"[T ]\d{2}:\d{2}"
ISO_WHOLE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:\d{2})?)?\s*$"
)
ISO_OFFSET = r"(Z|[+-]\d{2}:\d{2})\s*$"

SECONDS_PER_DAY = 86400


def looks_like_date(value: str) -> str:
    return f"{value} RLIKE r'{ISO_PREFIX}'"


def has_time_part(value: str) -> str:
    return f"{value} RLIKE r'{TIME_PART}'"


def iso_seconds(value: str) -> str:
    """Seconds since 1970-01-01 of an ISO text value, NULL when it does not parse.

    Spark's casts do the reading. Without an offset it is wall-clock time, whatever the session's
    time zone; with one it is the moment in UTC.
    """
    local = f"try_cast({value} AS timestamp_ntz)"
    clock = (
        f"CAST(unix_date(CAST({local} AS date)) AS bigint) * {SECONDS_PER_DAY} "
        f"+ hour({local}) * 3600 + minute({local}) * 60 + second({local})"
    )
    # date, time and "Z" take at least 17 characters; Spark reads an offset only behind seconds
    whole = rf"regexp_replace({value}, r'^(.{{16}})\s*(Z|[+-][0-9:]{{5}})\s*$', '$1:00$2')"
    moment = f"CASE WHEN length({value}) >= 17 AND {value} RLIKE r'{ISO_OFFSET}' THEN unix_seconds(try_cast({whole} AS timestamp)) ELSE {clock} END"
    return f"CASE WHEN {value} RLIKE r'{ISO_WHOLE}' THEN {moment} END"


def iso_day(value: str) -> str:
    """Day number since 1970-01-01 of an ISO text value."""
    return f"CAST(floor(({iso_seconds(value)}) / {SECONDS_PER_DAY}) AS int)"
