"""Removal of repeated three-line windows, in DataFrame functions only.

Every run of ``size`` consecutive lines is hashed. A window that occurs more than once in the
corpus keeps its first occurrence, by (doc_id, row, position); the lines covered by any later occurrence
go, but for lines that the window's first occurrence holds itself. Overlapping windows merge by taking the
union of the covered positions.

Defined results: lines are split at ``\\n`` and compared exactly, blank lines included; only windows of
nothing but blank lines are no windows. A null text counts as
empty and comes back as ''. Texts with fewer than ``size`` lines have no window and stay whole. Rows
are numbered once, in a written table, and every row is a document of its own, whatever its id: ids only
order the occurrences. A null id comes last; of rows with equal or null ids the one with the lower
number comes first, in the order of the input's partitions. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import WORD, written


def windows(docs: DataFrame, size: int) -> DataFrame:
    """(hash, doc_id, _row, pos) of every window; 128 bits of MD5 stand for the window's lines."""
    lines = docs.select("doc_id", "_row", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    runs = lines.where(F.size("lines") >= size).select(
        "doc_id",
        "_row",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("lines") - F.lit(size - 1)),
                lambda i: F.array_join(F.slice("lines", i, size), "\n"),
            )
        ).alias("pos", "run"),
    )
    return runs.where(F.col("run").rlike(WORD)).select(
        F.unhex(F.md5("run")).alias("hash"), "doc_id", "_row", "pos"
    )


def remove_repeated(docs: DataFrame, *, size: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed and the text without later occurrences of repeated windows."""
    rows = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), "rows")
    found = written(windows(rows, size), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row", "pos")
    # counted before the join, so that windows that occur once travel no further
    repeated = written(
        found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"),
        "repeated",
    ).drop("n")
    later = found.join(repeated, "hash").where(place > F.col("first"))
    # a later occurrence that overlaps the first one leaves the first one's lines
    own = F.when(F.col("first._row") == F.col("_row"), F.col("first.pos") + size).otherwise(F.lit(0))
    spans = F.struct(F.greatest("pos", own).alias("start"), (F.col("pos") + F.lit(size - 1)).alias("end"))
    covered = later.groupBy("_row").agg(F.collect_set(spans).alias("spans"))
    lines = rows.select("doc_id", "_row", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    gone = F.array_distinct(
        F.flatten(
            F.transform(
                F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")),
                lambda s: F.sequence(s["start"], s["end"]),
            )
        )
    )
    marked = (
        lines.join(covered, "_row", "left")
        .select("doc_id", "lines", gone.alias("gone"))
        .select(
            "doc_id",
            "lines",
            F.size("gone").alias("n_removed"),
            F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")).alias("left"),
        )
    )
    return marked.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.when(F.col("n_removed") == 0, F.array_join("lines", "\n"))
        .otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
        .alias("text"),
    )
