"""Exact de-duplication by skew-safe combining, in DataFrame functions only.

Copies are combined three times, and each time rows meet only if their digest *and* their full
text agree: inside each map task (Spark's partial aggregate), then per (digest, salt), then per
digest over the salts. The salt is the input partition modulo ``salts``, so however many copies a
text has, one task gets at most one row of it per map task and salt, and the last stage at most
``salts`` rows.

Defined results: a null text counts as empty; texts are compared byte for byte; of equal texts
the row with the largest id stays; an id of null loses against any other; rows that repeat the
winning id with the same text are one document (all are marked kept, :func:`deduplicate` returns
one of them). An empty table gives an empty result. Other columns are not read by :func:`classes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import spare, written


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(docs: DataFrame, *, digest=sha256, salts: int = 32) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        digest(F.col("text")).alias("digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    )
    salted = rows.groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    texts = (
        salted.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    # rows of a digest are together already: this costs no shuffle
    return texts.groupBy("digest").agg(
        F.when(F.count("*") == 1, F.max("keep_id"))
        .otherwise(F.raise_error(F.lit("two different texts share a digest")).cast("long"))
        .alias("keep_id"),
        F.sum("group_size").alias("group_size"),
    )


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    best = written(winners(docs, **options), "winners")
    rows = docs.select("doc_id", sha256(F.coalesce(F.col("text"), F.lit(""))).alias("digest"))
    return rows.join(best, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns.

    They are found by (winning id, digest), which is unique, so no hot key is joined.
    """
    as_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    key, digest = spare(docs, "_key", "_digest")
    best = winners(docs, **options).select(as_key("keep_id").alias(key), F.col("digest").alias(digest))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumns({key: as_key("doc_id"), digest: sha256(F.coalesce(F.col("text"), F.lit("")))})
    return rows.join(best, [key, digest], "left_semi").dropDuplicates([key, digest]).select(*columns)
