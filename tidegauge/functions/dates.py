"""Date and time expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default date pattern and the pattern of a time stamp.
DATE_PATTERN = "yyyy-MM-dd"
TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ss"
# Reads both ``2024-01-05`` and ``2024-1-5``.
LENIENT_DATE_PATTERN = "yyyy-M-d"


def parse_timestamp(text: Column | str, pattern: str | None = None, strict: bool = False) -> Column:
    """Text to timestamp. Malformed text gives NULL or, if ``strict``, an error in any session."""
    text = F.col(text) if isinstance(text, str) else text
    parsed = F.try_to_timestamp(text) if pattern is None else F.try_to_timestamp(text, F.lit(pattern))
    if not strict:
        return parsed
    return F.coalesce(parsed, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a timestamp: "), text))))


def parse_date(text: Column | str, pattern: str = LENIENT_DATE_PATTERN, strict: bool = True) -> Column:
    """Date text to the timestamp of its midnight. Malformed text is an error by default."""
    return parse_timestamp(text, pattern, strict)


def format_date(value: Column | str, pattern: str = DATE_PATTERN) -> Column:
    return F.date_format(value, pattern)


def utc_stamp(instant: Column | str | None = None) -> Column:
    """An instant, by default now, as UTC text to the second.

    Counted in seconds from the epoch, so the session's time zone and its
    clock changes have no part in it. An instant without a zone is taken to be
    in the session's.
    """
    if instant is None:
        instant = F.current_timestamp()
    instant = (F.col(instant) if isinstance(instant, str) else instant).cast("timestamp")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (epoch + F.unix_seconds(instant) * F.expr("interval '1' second")).cast("string")
