"""One UTC instant for every stated moment: problem 3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.timestamps import with_place, with_reading
from anamnesis.operators.clock_zones import abbreviations, estimate
from anamnesis.operators.ordered import neighbours
from anamnesis.session import cut
from anamnesis.sources.tables import table

#: Records of a chain that are scanned together.
RUN = 1024
_TAGGED = ("record_kind", "record_id", "origin")


def _tagged(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Join the origin's declared profile, which is small, and read the text."""
    known = df.join(profiles, "origin", "left")
    return with_reading(known, "said", "day_first", "r").drop("said", "day_first")


def _stated(r: str = "r"):
    """The instant of a value that states its offset."""
    at = F.col(r)
    return F.when(at["offset_s"].isNotNull(), at["local_us"] - at["offset_s"].cast("bigint") * 1_000_000)


def _values(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All values in tagged form with the bounds that hold for each; and the profiles."""
    profiles = (
        table(spark, folder, "clock_profiles")
        .where("origin is not null")
        .groupBy("origin")
        .agg(F.min("zone_name").alias("declared"), F.min("day_first").alias("day_first"))
    )
    null = F.lit(None).cast("bigint")
    cases = table(spark, folder, "eval_cases")
    asked = _tagged(
        cases.where("id is not null").select(
            F.lit("eval_case").alias("record_kind"), F.col("id").alias("record_id"), "origin", F.col("reference_time").alias("said")
        ).distinct(),
        profiles,
    ).select("*", null.alias("at_least"), null.alias("at_most"))
    spelled = cases.select("origin", F.explode("sessions").alias("s")).select(
        F.lit("eval_session").alias("record_kind"), F.col("s.external_id").alias("record_id"), "origin", F.col("s.occurred_at").alias("said")
    )
    # Spellings of one session are spellings of one moment: a stated one binds the others.
    once = _tagged(spelled.where("record_id is not null").distinct(), profiles)
    bound = once.groupBy("record_id").agg(F.min(_stated()).alias("at_least"), F.max(_stated()).alias("at_most"))
    met = once.join(bound, "record_id")
    log = table(spark, folder, "control_records").where("record_sha256 is not null")
    records = (
        log.select("record_sha256", "origin", "timestamp_text", "store_id", "sequence")
        .groupBy("record_sha256")
        .agg(F.min(F.struct("store_id", "sequence", "origin", "timestamp_text")).alias("x"))
        .select(F.lit("control").alias("record_kind"), F.col("record_sha256").alias("record_id"), "x.origin", F.col("x.timestamp_text").alias("said"), "x.store_id", "x.sequence")
    )
    chain = neighbours(
        _tagged(records, profiles), ["store_id"], F.floor(F.col("sequence") / RUN), ["sequence", "record_id"], _stated()
    )
    chain = chain.withColumnRenamed("value_before", "at_least").withColumnRenamed("value_after", "at_most")
    columns = [*_TAGGED, "declared", "r", "at_least", "at_most"]
    # Read once, used twice; and no filter on r is pushed into the patterns, which would multiply them.
    return cut(reduce(DataFrame.unionByName, [x.select(columns) for x in (asked, met, chain)])).where("r is not null"), profiles


def zone_estimates(values: DataFrame, zones: list[str]) -> DataFrame:
    local = values.where("r.offset_s is null and r.abbr is null")
    return estimate(local.select("origin", F.col("r.local_us").alias("local_us"), "at_least", "at_most", "declared"), zones)


def _zones(profiles: DataFrame) -> list[str]:
    """Candidate zones: those of clock_profiles, a small table that does not grow."""
    return sorted(r[0] for r in profiles.select("declared").where("declared is not null").distinct().collect())


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stated offsets hold; an abbreviation is looked up in the origin's zone; other wall times are placed in it."""
    values, profiles = _values(spark, folder)
    zones = _zones(profiles)
    chosen = zone_estimates(values, zones).select("origin", "zone_name")
    local = F.col("r.local_us")
    joined = (
        values.join(chosen, values["origin"].eqNullSafe(chosen["origin"]), "left")
        .drop(chosen["origin"])
        .withColumn("zone", F.coalesce("zone_name", "declared", F.lit("UTC")))
        .withColumn("named", F.try_element_at(abbreviations(zones), F.concat_ws("|", "zone", "r.abbr")) if zones else F.lit(None).cast("int"))
        .withColumn("at", F.coalesce(_stated(), local - F.col("named").cast("bigint") * 1_000_000))
    )
    stated = F.struct(F.col("at").alias("utc_us"), F.lit("single").alias("reading"))
    placed = with_place(joined, local, F.col("zone"), "w").withColumn("p", F.when(F.col("at").isNotNull(), stated).otherwise(F.col("w")))
    # Of several spellings of one record a stated one counts, then the one with the finest digits.
    best = F.struct((F.col("at").isNull()).alias("unstated"), (-F.pmod("p.utc_us", F.lit(60_000_000))).alias("coarse"), F.col("p.utc_us").alias("utc_us"), F.col("p.reading").alias("reading"))
    return (
        placed.groupBy("record_kind", "record_id")
        .agg(F.min(best).alias("b"))
        .select("record_kind", "record_id", "b.utc_us", "b.reading")
    )


def p3_zone_fit(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen zone of each origin, how many bounds it and the declared zone break, and the choice without a declared one."""
    values, profiles = _values(spark, folder)
    return zone_estimates(values, _zones(profiles))


QUERIES = {"p3_found": p3_found, "p3_zone_fit": p3_zone_fit}
ORACLES = {}
