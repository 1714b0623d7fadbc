"""Date parsing (F12-F14, T9, T10); everything in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["is_date", "likely_date", "parse_date"]

#: Prefix pattern, and the groups of year, month and day.
FORMATS = ((r"^(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)), (r"^(\d{2})/(\d{2})/(\d{4})", (3, 1, 2)), (r"^(\d{2})-(\d{2})-(\d{4})", (3, 2, 1)))
#: Layouts that a date may have as a whole.
LAYOUTS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "dd.MM.yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
)


def parse_date(c: Column) -> Column:
    """ISO date-times, then dates by prefix, with years 1900 to 2100."""
    text = c.cast("string")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(T|$)"), F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz"))
    found = [iso]
    for pattern, (y, m, d) in FORMATS:
        year, month, day = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (y, m, d))
        good = text.rlike(pattern) & year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31)
        # days beyond the month's end run on into the next month
        found.append(F.when(good, F.date_add(F.make_date(year, month, F.lit(1)), day - 1).cast("timestamp_ntz")))
    return F.coalesce(*found)


def is_date(c: Column) -> Column:
    """A text that is a date as a whole, in one of a closed list of layouts."""
    text = c.cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in LAYOUTS]).isNotNull()


def likely_date(c: Column) -> Column:
    """begins like an ISO, US or EU date."""
    return c.cast("string").rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})")
