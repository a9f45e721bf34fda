"""Shared pieces: input tables, written intermediate tables, prefix sums over any group size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.session import drop_path, scratch_path

#: A word of the contracts: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages start from the files, so a lost executor costs no recomputation beyond its own
    tasks, and joins between written tables leave Spark free to split skewed partitions.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if "/askloom-" in folder:
                drop_path(df.sparkSession, folder)


def spare(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores added until ``df`` has no such column in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def group_key(value: Column) -> Column:
    """A join key that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def prefix_sums(
    df: DataFrame, group: str, order: list[str], values: dict[str, str], of_groups: DataFrame | None = None
) -> DataFrame:
    """For each value column, the sum over earlier rows of the group and over the whole group.

    ``values`` maps a column to a prefix ``p``; ``p_before`` and ``p_total`` are added. A group may
    hold any share of the rows: rows are cut into ranges of (group, order), summed inside each
    range, and shifted by the sums of the group's earlier ranges. ``group`` must not be null;
    rows that tie in ``order`` follow one another in an undefined order, so it should be unique
    unless tied rows are equal. Columns of ``of_groups`` (one row per group) are added by way of
    the shifts, of which a group has one per range, so that a hot group is never a join key.
    """
    ranges = written(
        df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sums = ranges.groupBy(group, "_range").agg(
        *(F.sum(c).alias(f"_{p}") for c, p in values.items())
    )
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(
        group,
        "_range",
        *(F.coalesce(F.sum(f"_{p}").over(earlier), F.lit(0)).alias(f"_{p}_shift") for p in values.values()),
        *(F.sum(f"_{p}").over(of_group).alias(f"{p}_total") for p in values.values()),
    )
    if of_groups is not None:
        shifts = shifts.join(of_groups, group)
    inside = (
        Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    within = ranges.withColumns(
        {f"_{p}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, p in values.items()}
    )
    joined = within.join(shifts, [group, "_range"])
    return joined.withColumns(
        {f"{p}_before": F.col(f"_{p}_in") + F.col(f"_{p}_shift") for p in values.values()}
    ).drop("_range", *(f"_{p}_{x}" for p in values.values() for x in ("in", "shift")))
