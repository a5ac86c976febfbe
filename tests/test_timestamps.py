from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from anamnesis.functions.instants import rfc3339
from anamnesis.functions.timestamps import with_place, with_reading
from anamnesis.operators.clock_zones import abbreviations, estimate


def us(*a):
    return int(datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000


CASES = [
    # text, day first, zone, instant, reading
    ("2024-09-01T12:39:56Z", True, "Asia/Tokyo", us(2024, 9, 1, 12, 39, 56), "single"),
    ("2024-09-01t12:39:56z", True, "Asia/Tokyo", us(2024, 9, 1, 12, 39, 56), "single"),
    ("  2024-08-28T17:06:39+10:00[Australia/Sydney]\n", True, "UTC", us(2024, 8, 28, 7, 6, 39), "single"),
    ("2024-08-24T19:09:09.015778343+10:00", True, "UTC", us(2024, 8, 24, 9, 9, 9) + 15778, "single"),
    ("20240917T191910+1000", True, "UTC", us(2024, 9, 17, 9, 19, 10), "single"),
    ("Thu, 09 Nov 2023 08:16:15 -0300", True, "UTC", us(2023, 11, 9, 11, 16, 15), "single"),
    ("1724653539.46", True, "UTC", 1724653539460000, "single"),
    ("1725580170386", True, "UTC", 1725580170386000, "single"),
    ("1724749066793340", True, "UTC", 1724749066793340, "single"),
    ("2023/04/02 (Sun) 02:39", True, "UTC", us(2023, 4, 2, 2, 39), "single"),
    ("06/10/2024 02:56", True, "UTC", us(2024, 10, 6, 2, 56), "single"),
    ("09/21/2023 11:56:18 PM", False, "UTC", us(2023, 9, 21, 23, 56, 18), "single"),
    ("07/09/24 12:58:02 AM", True, "UTC", us(2024, 9, 7, 0, 58, 2), "single"),
    ("27.04.2025, 22:55 Uhr", True, "Europe/Lisbon", us(2025, 4, 27, 21, 55), "single"),
    ("12:23 pm on 24 September, 2024", True, "UTC", us(2024, 9, 24, 12, 23), "single"),
    ("2024年4月7日 下午2:17", True, "Asia/Shanghai", us(2024, 4, 7, 6, 17), "single"),
    ("2024-10-27 02:30:00", True, "Europe/Berlin", us(2024, 10, 27, 0, 30), "twice"),
    ("2024-03-31 02:30:00", True, "Europe/Berlin", us(2024, 3, 31, 1, 30), "skipped"),
    ("2024-03-31 01:59:59", True, "Europe/Berlin", us(2024, 3, 31, 0, 59, 59), "single"),
    ("2024-10-27 02:30:00 CET", True, "Europe/Berlin", us(2024, 10, 27, 1, 30), "single"),
    ("2024-10-27 02:30:00 CEST", True, "Europe/Berlin", us(2024, 10, 27, 0, 30), "single"),
    ("2024-11-27 19:50:02 CST", True, "Asia/Shanghai", us(2024, 11, 27, 11, 50, 2), "single"),
]
SAYING_NOTHING = ["2024-02-30T10:00:00Z", "2024-06-31 08:15", "25:61 on 8 May, 2024", "2024-05-14", "2024-05", "2025-W10", "TBD", "", None, "13:05 PM on 8 May, 2024", "0000-00-00 00:00:00"]


def test_every_spelling(spark):
    rows = [(t, f, z, u, r) for t, f, z, u, r in CASES] + [(t, True, "UTC", None, None) for t in SAYING_NOTHING]
    df = spark.createDataFrame(rows, "said string, day_first boolean, zone string, want long, kind string")
    zones = sorted({c[2] for c in CASES})
    read = with_reading(df, "said", "day_first", "r")
    named = F.try_element_at(abbreviations(zones), F.concat_ws("|", "zone", "r.abbr"))
    offset = F.coalesce(F.col("r.offset_s"), named).cast("long")
    got = with_place(read.withColumn("offset", offset), F.col("r.local_us"), F.col("zone"), "p").collect()
    for x in got:
        if x.want is None:
            assert x.r is None, x.said
        elif x.offset is not None:
            assert (x.r.local_us - x.offset * 1_000_000, "single") == (x.want, x.kind), x.said
        else:
            assert (x.p.utc_us, x.p.reading) == (x.want, x.kind), x.said


@pytest.mark.parametrize(
    "text,want",
    [("2024-01-01T00:00:00Z", (1704067200, 0)), ("2024-01-01t01:00:00.5+01:00", (1704067200, 500000000)), ("2024-02-30T00:00:00Z", None), ("1970", None), ("2024-01-01T00:00:00", None), ("", None), (None, None), ("2024-01-01T00:00:00-24:00", None)],
)
def test_rfc3339(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(rfc3339(F.col("t")).alias("x")).first().x
    assert (None if got is None else tuple(got)) == want


def test_zone_is_estimated_from_order(spark):
    # Wall times of an undeclared origin, each between stated instants half an hour off either side.
    base, rows = us(2024, 1, 10), []
    for month in range(12):
        at = base + month * 30 * 86_400_000_000
        local = at + (3_600_000_000 if not 2 < month < 10 else 7_200_000_000)
        rows.append(("o", local, at - 1_800_000_000, at + 1_800_000_000, None))
    df = spark.createDataFrame(rows, "origin string, local_us long, at_least long, at_most long, declared string")
    got = estimate(df, ["UTC", "Europe/Berlin", "Asia/Tokyo", "America/New_York"]).first()
    assert (got.zone_name, got.n_violations) == ("Europe/Berlin", 0)
    told = estimate(df.withColumn("declared", F.lit("UTC")), ["UTC", "Europe/Berlin"]).first()
    assert (told.zone_name, told.n_violations, told.undeclared_zone) == ("Europe/Berlin", 0, "Europe/Berlin") and told.declared_violations > 0
    # Two zones that fit alike: the declared one counts.
    alike = df.where("month(timestamp_micros(local_us)) = 1").withColumn("declared", F.lit("Europe/Paris"))
    tie = estimate(alike, ["Europe/Berlin", "Europe/Paris"]).first()
    assert (tie.zone_name, tie.undeclared_zone) == ("Europe/Paris", "Europe/Berlin")
    assert estimate(df.limit(0), ["UTC"]).count() == 0
    assert estimate(df.withColumn("at_least", F.lit(None).cast("long")).withColumn("at_most", F.lit(None).cast("long")), ["UTC"]).count() == 0
