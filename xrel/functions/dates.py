"""Dates as ISO text. Entity times are TIMESTAMP_NTZ holding UTC, so no session zone is involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MS = 86_400_000


def iso_millis(ts: Column) -> Column:
    """A TIMESTAMP_NTZ as yyyy-MM-ddTHH:mm:ss.SSSZ, cut to milliseconds."""
    text = ts.cast("timestamp_ntz").cast("string")
    return F.concat(
        F.substring(text, 1, 10),
        F.lit("T"),
        F.substring(text, 12, 8),
        F.lit("."),
        F.rpad(F.substring(text, 21, 3), 3, "0"),
        F.lit("Z"),
    )


def _iso_from_epoch(ms: Column, date_only: bool) -> Column:
    day = F.floor(ms / F.lit(_DAY_MS)).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string")
    if date_only:
        return date
    rest = ms - day.cast("bigint") * F.lit(_DAY_MS)

    def two(unit_ms: int, base: int) -> Column:
        return F.lpad((F.floor(rest / F.lit(unit_ms)) % F.lit(base)).cast("string"), 2, "0")

    millis = F.lpad((rest % F.lit(1000)).cast("string"), 3, "0")
    return F.concat(
        date, F.lit("T"), two(3_600_000, 24), F.lit(":"), two(60_000, 60), F.lit(":"), two(1000, 60),
        F.lit("."), millis, F.lit("Z"),
    )


def normalise_date(text: Column, hour: int = 0, minute: int = 0, second: int = 0, date_only: bool = False) -> Column:
    """ISO text for a date or date-time string; null when it is neither.

    A bare date, month or year takes the given time of day in UTC (ignored when out of range); a date-time, with or
    without seconds and with T or a space, is read as UTC where it names no offset.
    """
    in_range = 0 <= hour <= 23 and 0 <= minute <= 59 and 0 <= second <= 59
    shift = (hour * 3600 + minute * 60 + second) * 1000 if in_range else 0
    # The forms that are accepted.
    is_date = text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")
    has_offset = text.rlike(r"[Tt ].*([Zz]|[+-]\d{2}:?\d{2})$")
    day = F.concat(text, F.when(F.length(text) == 4, "-01-01").when(F.length(text) == 7, "-01").otherwise(""))
    as_instant = F.when(is_date, F.concat(day, F.lit("T00:00:00Z"))).when(has_offset, text)
    instant = as_instant.otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")
    ms = F.unix_millis(instant) + F.when(is_date, F.lit(shift)).otherwise(F.lit(0))
    return F.when(F.trim(text) != "", _iso_from_epoch(ms, date_only))
