"""Dates of the feed, independent of the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_HAS_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"


def parse_utc(text: Column) -> Column:
    """ISO-8601 text to a timestamp, null when unreadable; no zone means UTC."""
    zoned = (
        F.when(text.rlike(_DATE_ONLY), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(_HAS_ZONE), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return F.try_to_timestamp(zoned)


def utc_day(instant: Column) -> Column:
    """The UTC calendar date of a timestamp."""
    days = F.floor(F.unix_seconds(instant) / F.lit(86400))
    return F.date_from_unix_date(days.cast("int"))


def month_name(month: Column) -> Column:
    """1 → Jan … 12 → Dec."""
    return F.date_format(F.make_date(F.lit(2000), month.cast("int"), F.lit(1)), "MMM")
