"""RFC 3339 text to an exact instant, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = (
    r"^(\d{4}-\d{2}-\d{2})[Tt ]([01]\d|2[0-3]):([0-5]\d):([0-5]\d|60)(?:\.(\d+))?"
    r"(?:[Zz]|([+-])([01]\d|2[0-3]):([0-5]\d))$"
)


def _num(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(text.try_cast("int"))


def rfc3339(text: Column) -> Column:
    """struct<sec: bigint, nano: int> since 1970 UTC, or null where text is no RFC 3339 time.

    Digits beyond the ninth are dropped. A second of 60 is the first one of the next minute.
    """
    part = lambda i: F.regexp_extract(text, RFC3339, i)
    days = F.unix_date(F.try_to_date(part(1), "yyyy-MM-dd"))
    sign = F.when(part(6) == "-", -1).otherwise(1)
    offset = sign * (_num(part(7)) * 3600 + _num(part(8)) * 60)
    sec = days.cast("bigint") * 86400 + _num(part(2)) * 3600 + _num(part(3)) * 60 + _num(part(4)) - offset
    nano = _num(F.rpad(F.substring(part(5), 1, 9), 9, "0"))
    return F.when(text.rlike(RFC3339) & days.isNotNull(), F.struct(sec.alias("sec"), nano.alias("nano")))


def rfc3339_seconds(text: Column) -> Column:
    """Whole seconds since 1970 UTC, or null."""
    return rfc3339(text)["sec"]
