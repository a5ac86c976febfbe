"""Zones of origins that write wall times, estimated from what the times must agree with.

Each wall time gives bounds: the nearest stated instants before and after it in its sequence, or
another spelling of the same moment. For each origin every candidate zone, which is a history of
offsets, is tried on all its bounded wall times, and the zone that breaks the fewest bounds is
chosen. A zone declared for the origin decides between zones that break as few.

A wall time that stands out of its sequence by months breaks a bound in every zone, so the zone
chosen may break some as well.

Scale: candidates come from a small table that does not grow, so the work is a constant times the
bounded wall times and is combined on the map side; sequences of any length are scanned in buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions.timestamps import with_place

#: A spelling may lack its seconds, so instants this near count as equal.
SLACK_US = 60_000_000


def estimate(walls: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """(origin, zone_name, n_bounded, n_violations, declared, declared_violations, undeclared_zone): the zone chosen for each origin.

    walls: (origin, local_us, at_least, at_most, declared), bounds in microseconds or null; declared
    is the zone declared for the origin or null. A null origin is an origin of its own. Ties go to the
    declared zone, then to the first name; undeclared_zone is the choice without that. An origin
    without bounded wall times is not in the result.
    """
    tried = walls.where("at_least is not null or at_most is not null").withColumn("zone_name", F.explode(F.array(*[F.lit(z) for z in candidates])))
    broken = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    by_zone = (
        with_place(tried, F.col("local_us"), F.col("zone_name"), "p")
        .withColumn("utc", F.col("p.utc_us"))
        .groupBy("origin", "zone_name")
        .agg(
            F.count(F.lit(1)).alias("n_bounded"),
            F.sum(
                broken(F.col("utc") < F.col("at_least") - SLACK_US) + broken(F.col("utc") > F.col("at_most") + SLACK_US)
            ).alias("n_violations"),
            F.max("declared").alias("declared"),
        )
        .withColumn("other", F.coalesce(F.col("zone_name") != F.col("declared"), F.lit(True)))
    )
    chosen = F.struct("zone_name", "n_bounded", "n_violations", "declared")
    return (
        by_zone.groupBy("origin")
        .agg(
            F.min_by(chosen, F.struct("n_violations", "other", "zone_name")).alias("b"),
            F.max(F.when(~F.col("other"), F.col("n_violations"))).alias("declared_violations"),
            F.min_by("zone_name", F.struct("n_violations", "zone_name")).alias("undeclared_zone"),
        )
        .select("origin", "b.*", "declared_violations", "undeclared_zone")
    )


def abbreviations(zones: Sequence[str]) -> Column:
    """Map from 'zone|abbreviation' to the offset in seconds that it stands for there, from the zone rules."""
    from datetime import UTC, datetime, timedelta
    from zoneinfo import ZoneInfo

    held = {}
    for zone in zones:
        at, info = datetime(1975, 1, 1, tzinfo=UTC), ZoneInfo(zone)
        while at.year < 2038:
            local = at.astimezone(info)
            held[f"{zone}|{local.tzname()}"] = int(local.utcoffset().total_seconds())
            at += timedelta(days=30)
    pairs = [F.lit(x) for kv in sorted(held.items()) for x in kv]
    return F.create_map(*pairs)
