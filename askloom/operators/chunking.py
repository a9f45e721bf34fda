"""Documents to overlapping token windows: flat, and parent/child."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.settings import DEFAULTS, Settings


def window_count(n: Column, size: int, overlap: int) -> Column:
    """Windows that cover ``n`` tokens: the last one is the first to reach the end."""
    step = max(size - overlap, 1)
    return F.when(n <= 0, 0).otherwise(
        F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(step)).cast("int") + 1
    )


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """Array of token arrays. All but the last window hold exactly ``size`` tokens."""
    step = max(size - overlap, 1)
    count = window_count(F.size(tokens), size, overlap)
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.expr("cast(array() as array<int>)")
    )
    return F.transform(starts, lambda i: F.slice(tokens, i * step + 1, size))


def window_texts(
    rows: DataFrame, carried: list[str], size: int, overlap: int, pos: str
) -> DataFrame:
    """(carried, pos, text): one row per window of ``text``.

    A text that surely fits one window is that window; only longer ones are split into tokens.
    """
    body = T.rstrip_ascii(F.col("text"))
    fits = (body != "") & T.at_most_tokens(body, size)
    tokenized = rows.withColumn("_whole", F.when(fits, body)).withColumn(
        "_tokens", F.when(F.col("_whole").isNull(), T.tokens(F.col("text")))
    )
    split = F.transform(
        token_windows(F.col("_tokens"), size, overlap), lambda w: F.array_join(w, "")
    )
    windows = F.when(F.col("_whole").isNotNull(), F.array("_whole")).otherwise(split)
    return T.each(tokenized, carried, windows, "text", pos)


def windows_per_full_parent(settings: Settings) -> int:
    """Children cut from a parent of full size; a constant, so numbering needs no shuffle."""
    extra = max(settings.parent_size - settings.child_size, 0)
    step = max(settings.child_size - settings.child_overlap, 1)
    return -(-extra // step) + 1


def chunk_flat(
    docs: DataFrame, size: int = DEFAULTS.flat_size, overlap: int = DEFAULTS.flat_overlap,
    doc_type: str = "local",
) -> DataFrame:
    """One row per window; every other column of ``docs`` is carried along."""
    carried = [c for c in docs.columns if c != "text"]
    return (
        window_texts(docs, carried, size, overlap, "chunk_index")
        .withColumn("doc_type", F.lit(doc_type))
        .withColumn("chunk_type", F.lit(doc_type))
        .withColumn("chunk_id", F.concat_ws("_", "source", "chunk_index"))
    )


def chunk_parents(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Parent windows of each document with heading, page range and table flag."""
    carried = [c for c in docs.columns if c != "text"]
    return (
        window_texts(docs, carried, settings.parent_size, settings.parent_overlap, "parent_index")
        .withColumn(
            "parent_id", F.concat(F.col("source"), F.lit("::parent::"), F.col("parent_index"))
        )
        .withColumn("section", T.section_header(F.col("text")))
        .withColumn("pages", T.page_range(F.col("text")))
        .withColumn("has_table", T.has_table(F.col("text")))
    )


def children_of(parents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Children cut inside each parent, numbered across the document.

    A projection from start to end: a full parent always yields the same number
    of children, so ``chunk_index`` is arithmetic on the two positions.
    """
    per_parent = windows_per_full_parent(settings)
    carried = [c for c in parents.columns if c != "text"]
    return (
        window_texts(parents, carried, settings.child_size, settings.child_overlap, "child_index")
        .withColumn("chunk_index", F.col("parent_index") * per_parent + F.col("child_index"))
        .withColumn("chunk_id", F.concat_ws("_", "source", "chunk_index"))
        .withColumn("chunk_type", F.lit("child"))
        .withColumn("doc_type", F.lit("local"))
    )


def chunk_children(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return children_of(chunk_parents(docs, settings), settings)
