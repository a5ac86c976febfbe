"""Free-text timestamps to a tagged form, in the JVM.

A value becomes struct<local_us, offset_s, abbr>: the wall time as microseconds, as if it were UTC;
the stated offset in seconds, 0 for UTC and for bare counts, null if none is stated; the zone
abbreviation, if one is. It is null where the text states no valid date with a time of day.

Every spelling is first rewritten to nine fields: date order, three date parts, hour, minute,
second, fraction, half of the day, zone. Fields that a spelling lacks are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ZONE = r"(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5})?(?:\[[^\]]*\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"([AaPp]\.?[Mm]\.?)?"
_DAY = r"(?:[A-Za-z]{3,9},? +)?"
_IN_WORDS = r"([A-Za-z]{3,9})"
_SEP = "\u0001"

#: (pattern, order of the date parts, groups in the order of the fields; 0 for an absent field).
FORMATS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|,? +)(?:\([A-Za-z]{{3,9}}\) +)?{_CLOCK} *{_HALF} *{_ZONE}$", "ymd", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE}$", "ymd", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}),? +{_CLOCK} *{_HALF} *(?:Uhr|h)? *{_ZONE}$", "num", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^{_CLOCK} *{_HALF} *(?:on )?{_DAY}(\d{{1,2}}) {_IN_WORDS}\.?,? +(\d{{4}}) *{_ZONE}$", "dmy", (6, 7, 8, 1, 2, 3, 4, 5, 9)),
    (rf"^{_DAY}(\d{{1,2}}) {_IN_WORDS}\.?,? +(\d{{4}})(?:,| at)? +{_CLOCK} *{_HALF} *{_ZONE}$", "dmy", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^{_DAY}{_IN_WORDS}\.? (\d{{1,2}}),? +(\d{{4}})(?:,| at)? +{_CLOCK} *{_HALF} *{_ZONE}$", "mdy", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日 *(上午|下午|午前|午後)? *{_CLOCK} *{_ZONE}$", "ymd", (1, 2, 3, 5, 6, 7, 8, 4, 9)),
)
COUNT = r"^-?\d{9,19}(?:\.\d+)?$"
#: English month names, of which the first three letters count.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def tidy(text: Column) -> Column:
    """Any run of spaces as one blank, none at the ends, full-width digits and signs as plain ones."""
    plain = F.translate(text, "０１２３４５６７８９：／－．，", "0123456789:/-.,")
    return F.trim(F.regexp_replace(plain, r"(?U)[\s  　​﻿]+", " "))


def _month(word: Column) -> Column:
    low = F.lower(word)
    known = [F.when((low == m) | (low == m[:3]) | ((low == "sept") if i == 9 else F.lit(False)), i) for i, m in enumerate(MONTHS, 1)]
    return F.coalesce(*known, word.try_cast("int"))


def _int(text: Column, empty: int | None = None) -> Column:
    return F.when(text == "", F.lit(empty).cast("int")).otherwise(text.try_cast("int"))


def _offset(zone: Column) -> Column:
    digits = F.rpad(F.regexp_replace(F.substring(zone, 2, 9), ":", ""), 4, "0")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    stated = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (hours * 3600 + minutes * 60)
    return F.when(F.upper(zone).isin("Z", "UTC", "GMT"), 0).when(
        zone.rlike(r"^[+-]") & (hours < 24) & (minutes < 60), stated
    )


def with_reading(df: DataFrame, text: str, day_first: str, name: str) -> DataFrame:
    """Add the tagged form of a text column.

    day_first names a boolean column that orders all-numeric dates without leading year; null means
    true. The steps are columns of their own, so that no pattern is matched twice.
    """
    t = F.col("_t")
    fields = reduce(
        lambda rest, f: F.when(
            t.rlike(f[0]),
            F.regexp_replace(t, f[0], _SEP.join([f[1], *[f"${g}" if g else "" for g in f[2]]])),
        ).otherwise(rest),
        reversed(FORMATS),
        F.lit(None).cast("string"),
    )
    part = lambda i: F.col("_f").getItem(i)
    order = F.when(part(0) == "num", F.when(F.coalesce(F.col(day_first), F.lit(True)), "dmy").otherwise("mdy")).otherwise(part(0))
    pick = lambda y, d, m: F.when(F.col("_o") == "ymd", part(y)).when(F.col("_o") == "dmy", part(d)).otherwise(part(m))
    written = pick(1, 3, 3)
    year = written.try_cast("int") + F.when(F.length(written) == 2, 2000).otherwise(0)
    month, day = _month(pick(2, 2, 1)), pick(3, 1, 2).try_cast("int")
    date = F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd"))
    half, said = F.lower(F.regexp_replace(part(8), r"\.", "")), _int(part(4))
    pm, am = half.isin("pm", "下午", "午後"), half.isin("上午", "午前")
    # 午前0:30 and 下午13:05 are written with the hour of the day.
    hour = (
        F.when(half == "", said)
        .when(said.between(1, 12), said % 12 + F.when(pm, 12).otherwise(0))
        .when(am & (said == 0), 0)
        .when(half.isin("下午", "午後") & said.between(13, 23), said)
    )
    minute, second = _int(part(5)), _int(part(6), 0)
    fraction = _int(F.rpad(F.substring(part(7), 1, 6), 6, "0"), 0)
    wall = F.struct(
        ((F.col("_d").cast("bigint") * 86400 + F.col("_h") * 3600 + minute * 60 + second) * 1_000_000 + fraction).alias("local_us"),
        F.col("_z").cast("int").alias("offset_s"),
        F.when((part(9) != "") & F.col("_z").isNull(), F.upper(part(9))).alias("abbr"),
    )
    valid = F.col("_d").isNotNull() & F.col("_h").between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    # A bare count: its size shows the unit.
    whole, size = F.col("_w"), F.abs(F.col("_w"))
    below = _int(F.rpad(F.substring(F.regexp_extract(t, r"\.(\d+)$", 1), 1, 6), 6, "0"), 0).cast("bigint")
    us = (
        F.when(size < 10**11, whole * 1_000_000 + F.when(whole < 0, -below).otherwise(below))
        .when(size < 10**14, whole * 1000)
        .when(size < 10**17, whole)
        .otherwise((whole - F.pmod(whole, F.lit(1000))) / 1000)
    )
    count = F.struct(us.cast("bigint").alias("local_us"), F.lit(0).alias("offset_s"), F.lit(None).cast("string").alias("abbr"))
    return (
        df.withColumn("_t", tidy(F.col(text)))
        .withColumn("_f", F.split(fields, _SEP, -1))
        .withColumn("_w", F.when(t.rlike(COUNT), F.regexp_extract(t, r"^(-?\d+)", 1).try_cast("bigint")))
        .withColumn("_o", order)
        .withColumn("_d", date)
        .withColumn("_h", hour)
        .withColumn("_z", _offset(part(9)))
        .withColumn(name, F.when(whole.isNotNull(), count).when(valid, wall))
        .drop("_t", "_f", "_w", "_o", "_d", "_h", "_z")
    )


def offset_at(utc_us: Column, zone: Column) -> Column:
    """Offset in microseconds that a zone has at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone)) - utc_us


def with_place(df: DataFrame, local_us: Column, zone: Column, name: str) -> DataFrame:
    """Add struct<utc_us, reading> of a wall time in a zone; null where either is null.

    The offsets a day before and a day after are the only ones that can hold, as no zone changes
    its offset twice within two days. Twice: both hold, the earlier instant counts. Skipped: neither
    holds, and the offset before moves the time later by what the clock skipped.
    """
    day = 86_400_000_000
    l, before, after = F.col("_l"), F.col("_before"), F.col("_after")
    holds = lambda o: offset_at(l - o, F.col("_zone")) == o
    got = lambda us, reading: F.struct(us.alias("utc_us"), F.lit(reading).alias("reading"))
    return (
        df.withColumn("_l", local_us)
        .withColumn("_zone", zone)
        .withColumn("_before", offset_at(l - day, F.col("_zone")))
        .withColumn("_after", offset_at(l + day, F.col("_zone")))
        .withColumn("_holds", F.struct(holds(before).alias("b"), holds(after).alias("a")))
        .withColumn(
            name,
            F.when(before == after, got(l - before, "single"))
            .when(F.col("_holds.b") & F.col("_holds.a"), got(l - F.greatest(before, after), "twice"))
            .when(F.col("_holds.b"), got(l - before, "single"))
            .when(F.col("_holds.a"), got(l - after, "single"))
            .when(before.isNotNull(), got(l - before, "skipped")),
        )
        .drop("_l", "_zone", "_before", "_after", "_holds")
    )
