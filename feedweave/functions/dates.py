"""Dates of feeds as timestamps, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by their first three letters, and zone names with offsets.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"z": "+00:00", "ut": "+00:00", "utc": "+00:00", "gmt": "+00:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00"}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?"
_ZONE = r"(z|[+-]\d{2}:?\d{2}|[a-z]{1,3})?"
_MONTH = r"([a-z]{3,9})"
_DAY = r"(?:[a-z]{3},\s*)?"


#: Forms in the order that they are tried, after white space is collapsed and
#: letters are small: a pattern, and which groups are year, month, day, time, zone.
#: The first pattern that fits decides; a first number over 12 is no US month.
FORMS = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[t ]{_TIME} ?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^{_DAY}(\d{{1,2}}) {_MONTH} (\d{{2,4}}) {_TIME} ?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (r"^([1-9]\d{3})$", "$1|1|1|||||"),
    (r"^([1-9]\d{3})-(\d{2})$", "$1|$2|1|||||"),
    (rf"^[a-z]{{3}} {_MONTH} (\d{{1,2}}) {_TIME} (\d{{4}})$", "$7|$1|$2|$3|$4|$5|$6|"),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1|$2|$3|||||"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?: {_TIME})?$", "$1|$2|$3|$4|$5|$6|$7|"),
    (rf"^(\d{{1,2}}) {_MONTH} (\d{{4}})$", "$3|$2|$1|||||"),
    (rf"^{_MONTH} (\d{{1,2}}), (\d{{4}})(?: {_TIME})?$", "$3|$1|$2|$4|$5|$6|$7|"),
    (rf"^(0?[1-9]|1[0-2])/(\d{{1,2}})/(\d{{4}})(?: {_TIME})?$", "$3|$1|$2|$4|$5|$6|$7|"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3|$1|$2|||||"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?: {_TIME})?$", "$3|$2|$1|$4|$5|$6|$7|"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: {_TIME})?$", "$3|$2|$1|$4|$5|$6|$7|"),
    (rf"^(\d{{1,2}})-{_MONTH}-(\d{{4}})$", "$3|$2|$1|||||"),
)


def _moment(parts: Column) -> Column:
    """A timestamp of the textual parts, null if they are no date; no zone means UTC."""
    year, month, day, hour, minute, second, fraction, zone = (F.get(parts, F.lit(k)) for k in range(8))
    zones = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    two = lambda c: F.lpad(c, 2, "0")
    offset = F.when(zone.rlike(r"^[+-]"), F.regexp_replace(zone, r"^(...):?(..)$", "$1:$2")).otherwise(F.coalesce(F.element_at(zones, zone), F.lit("+00:00")))
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(month, 1, 3))
    month = F.when(month.rlike(r"^\d"), month).when(at > 0, at.cast("string"))
    year = F.when(F.length(year) == 2, F.concat(F.when(year < "50", "20").otherwise("19"), year)).when(F.length(year) == 3, (year.try_cast("int") + 1900).cast("string")).otherwise(year)
    second = F.when(second == "60", "59").otherwise(second)
    text = F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit("T"), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), F.substring(fraction, 1, 7), offset)
    return text.try_cast("timestamp")


def parse_date(text: Column) -> Column:
    """The instant of a date in any form that feeds use, else null.

    Tried in order: ISO 8601 and RFC 3339; RFC 2822, with or without a weekday,
    right or wrong; a year; a year and month; asctime; then day-month-year and
    month-day-year forms in words and numbers, US before European. Text without
    a zone is taken as UTC.
    """
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " "))

    def instant(s: Column) -> Column:
        canonical = F.lit(None).cast("string")
        for pattern, order in reversed(FORMS):
            canonical = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, order)).otherwise(canonical)
        return F.get(F.transform(F.array(F.split(canonical, r"\|")), _moment), F.lit(0))

    return F.get(F.transform(F.array(plain), instant), F.lit(0))
