"""Positions inside a group that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.session import cut_lineage


def numbered(df: DataFrame, key: str, order: tuple[str, ...], name: str) -> DataFrame:
    """Add the 1-based position of each row inside ``key``, ordered by ``order``.

    A window over ``key`` alone would sort a hot key in one task. Rows are cut
    into ranges of (key, order) instead, numbered inside each range, and shifted
    by the sizes of the earlier ranges of the same key. ``order`` must be unique
    inside ``key``.
    """
    ranges = cut_lineage(
        df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    )
    sizes = ranges.groupBy(key, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        key, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("_range", key).orderBy(*order)
    return (
        ranges.withColumn("_nth", F.row_number().over(inside))
        .join(shifts, [key, "_range"])
        .withColumn(name, F.col("_nth") + F.col("_shift"))
        .drop("_nth", "_shift", "_range")
    )
