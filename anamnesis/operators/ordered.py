"""Ordered scans over groups of any size.

A window over one group runs in one task. Here a group is first parted into buckets by a
deterministic bucket number, so only bucket summaries are ever scanned per group: as many rows
as the order column's span holds buckets, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Number the rows of each group from 0 in the given order.

    bucket must be monotone in the order. Rows that tie in the whole order get their numbers in
    no fixed order, so the order should be unique. A null in the order sorts first.
    """
    b = "_bucket"
    parted = df.withColumn(b, bucket)
    local = parted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)))
    before = Window.partitionBy(*group).orderBy(F.col(b).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy(*group, b)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    keys = [*group, b]
    on = [local[k].eqNullSafe(offsets[k]) for k in keys]
    return local.join(offsets, on).select(
        *[local[c] for c in df.columns], (F.col("_offset") + F.col("_rank") - 1).alias(name)
    )


def neighbours(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], value: Column) -> DataFrame:
    """Add value_before and value_after: the nearest non-null values at earlier and later rows.

    value is null where a row has nothing to offer to the others. The row itself is left out.
    """
    b = "_bucket"
    parted = df.withColumn("_value", value).withColumn(b, bucket)
    w = Window.partitionBy(*group, b).orderBy(*order)
    up, down = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    local = parted.withColumn("_up", F.last("_value", True).over(up)).withColumn("_down", F.first("_value", True).over(down))
    g = Window.partitionBy(*group).orderBy(F.col(b).asc_nulls_first())
    first_last = parted.groupBy(*group, b).agg(
        F.min_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_first"),
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"),
    )
    carried = first_last.withColumn(
        "_in", F.last("_last", True).over(g.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn("_out", F.first("_first", True).over(g.rowsBetween(1, Window.unboundedFollowing)))
    on = [local[k].eqNullSafe(carried[k]) for k in (*group, b)]
    return local.join(carried, on).select(
        *[local[c] for c in df.columns],
        F.coalesce("_up", "_in").alias("value_before"),
        F.coalesce("_down", "_out").alias("value_after"),
    )
