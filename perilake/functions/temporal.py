"""Dates and UTC instants. All parsing is lenient: bad text becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilake.functions.text import cleaned, col

# Fixed value: text that carries an explicit zone.
ZONED = r"(?i)(Z|[+-]\d{2}:?\d{2}| UTC)$"
DAY_MICROS = 86_400_000_000


def as_date(value: str | Column) -> Column:
    return cleaned(value).try_cast("date")


def as_instant(value: str | Column) -> Column:
    """Timestamp from ISO text; ``Z``, offsets and a trailing `` UTC`` are understood."""
    return F.regexp_replace(cleaned(value), r" UTC$", "Z").try_cast("timestamp")


def as_zoned_instant(value: str | Column) -> Column:
    """Like :func:`as_instant`, but text without a zone is NULL."""
    return F.when(cleaned(value).rlike(ZONED), as_instant(value))


def micros(value: str | Column) -> Column:
    """Exact integer microseconds, for range frames that must separate same-second events."""
    return F.unix_micros(col(value).cast("timestamp"))


def text_date(value: str | Column) -> Column:
    """Calendar date as written in the text, before any zone shift."""
    return F.substring(cleaned(value), 1, 10).try_cast("date")


def reporting_delay_days(incident: str | Column, submitted: str | Column) -> Column:
    """Days from the incident to the written submission date."""
    return F.datediff(text_date(submitted), text_date(incident)).cast("double")


def vehicle_age(submitted: str | Column, model_year: str | Column) -> Column:
    """Years between submission and model year; NULL without a vehicle."""
    return F.year(col(submitted)) - col(model_year)


def iso_event_time(value: str | Column) -> Column:
    """``...Z`` rendering: midnight for date-only text, milliseconds only when there are any
    sub-second digits. Blank or unreadable text is NULL."""
    instant = as_instant(value)
    return F.when(
        F.unix_micros(instant) % 1_000_000 != 0, F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ).otherwise(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
