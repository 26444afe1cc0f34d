"""Dates as sources write them: lists of patterns, tried in order; what fits none is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def first_date(text: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in patterns))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def listing_date(text: Column) -> Column:
    """Without a leading note of posting or update and what follows a bar."""
    bare = F.regexp_replace(_trim(text), r"(?i)^(posted on|last updated on|updated?:?)\s*", "")
    return first_date(_trim(F.regexp_replace(bare, r"\s*\|.*$", "")), *K.DATES_LISTING, *K.DATES_ISO)


def alert_date(text: Column) -> Column:
    return first_date(_trim(text), *K.DATES_LISTING, *K.DATES_ISO)


def table_date(text: Column) -> Column:
    return first_date(_trim(F.regexp_replace(text, r"\s+", " ")), *K.DATES_TABLE, *K.DATES_ISO)


def map_date(text: Column) -> Column:
    return first_date(text, *K.DATES_ISO, *K.DATES_MAP)


def open_data_date(text: Column) -> Column:
    """The first 19 characters as ISO; so fractions and time zones are dropped."""
    t = _trim(text)
    return F.coalesce(first_date(F.substring(t, 1, 19), *K.DATES_ISO), first_date(t, *K.DATES_OPEN_DATA))


def epoch_ms(text: Column) -> Column:
    """Milliseconds since the epoch, as a number or its text; negative ones are null. Else ISO."""
    t = _trim(text)
    n = t.try_cast("double")
    number = F.timestamp_millis(F.when(n >= 0, n.cast("decimal(38,0)").try_cast("long"))).cast("timestamp_ntz")
    return F.when(n.isNotNull(), number).otherwise(first_date(F.substring(t, 1, 19), *K.DATES_ISO))


def pdf_header(page: Column) -> Column:
    """The date header at the start of a page, or null."""
    return F.nullif(_trim(F.regexp_extract(page, K.PDF_DATE_HEADER, 0)), F.lit(""))


def pdf_date(header: Column) -> Column:
    return first_date(F.regexp_replace(header, r"(?i)^(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday),\s+", ""), *K.DATES_PDF)


def feed_date(published: Column, updated: Column) -> Column:
    """RFC 822 or ISO, as UTC (the session's time zone must be UTC); the update's date where there is none of publication."""

    def one(t: Column) -> Column:
        bare = F.regexp_replace(t, "^[A-Za-z]{3,9}, *", "")  # the weekday says nothing new
        zoned = [F.timestamp_micros(F.unix_micros(F.try_to_timestamp(bare, F.lit(p)))).cast("timestamp_ntz") for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX")]
        return F.coalesce(*zoned, first_date(t, *K.DATES_ISO))

    return F.coalesce(one(published), one(updated))


def business_deadline(day: Column, days: int = 10) -> Column:
    """The date ``days`` weekdays after ``day``."""
    later = F.sequence(F.date_add(day, 1), F.date_add(day, 2 * days + 4))
    return F.element_at(F.filter(later, lambda d: F.weekday(d) < 5), days)
