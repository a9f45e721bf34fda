"""Mixing sources to target weights by prefix sums over hash-random order.

Each document gets a hash-random key. Rows are range-sorted by (source, key), word counts are
summed up to each row by distributed prefix sums, and each source is cut at its exact budget:
``floor(target)`` words, whole passes over the source first, then the words up to the cut. The
document at the cut is taken in part, so the words taken equal the budget.

Defined results: a null text has size 0; a null source is a source of its own, last in order; ids
that tie in the key are ordered by id and text hash, so equal rows are interchangeable. Sources
without words get target 0. An empty table gives an empty result. Other columns are not read by
:func:`shares`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import WORD, group_key, prefix_sums, spare, word_count, written


def targets(sizes: DataFrame, *, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Words per source: (source, source_size) gains ``target``.

    Weights repeat along the sources in code-point order. A source may be read ``max_epochs``
    times at most; what it cannot use is shared again by weight. With sources sorted by
    (most words / weight), the shared level is the largest of (words left / weight left) over the
    prefixes of capped sources, so one prefix sum replaces the rounds.
    """
    one = sizes.select("source", "source_size").withColumns(
        {"_all": F.lit("all"), "_null": F.col("source").isNull(), "_one": F.lit(1)}
    )
    placed = prefix_sums(one, "_all", ["_null", "source"], {"_one": "place"})
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place_before") % len(weights)).cast("int"))
    most = F.col("source_size") * F.lit(max_epochs)
    rated = placed.withColumns({"weight": weight.cast("long"), "_most": most}).withColumn(
        "_ratio", F.col("_most").cast("double") / F.col("weight").cast("double")
    )
    summed = written(
        prefix_sums(
            rated.select("source", "source_size", "weight", "_most", "_ratio", "_all", "_null"),
            "_all",
            ["_ratio", "_null", "source"],
            {"_most": "most", "weight": "weight", "source_size": "size"},
        ),
        "targets",
    )
    level = summed.agg(
        F.max(
            (F.col("size_total") - F.col("most_before")).cast("double")
            / (F.col("weight_total") - F.col("weight_before")).cast("double")
        ).alias("_level")
    )
    return summed.crossJoin(F.broadcast(level)).select(  # one row
        "source",
        "source_size",
        F.least(F.col("_most").cast("double"), F.col("_level") * F.col("weight").cast("double")).alias("target"),
    )


def shares(docs: DataFrame, *, seed: int = 11, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, size, source_size, target, epochs and taken of every document (and ``carry``)."""
    sized = written(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 16).alias("_draw"),
            F.xxhash64("text").alias("_tie"),
            group_key(F.col("source")).alias("_source"),
            *carry,
        ),
        "sizes",
    )
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    goals = targets(sizes, **options).withColumn("_source", group_key(F.col("source")))
    # full passes and the rest of the budget, per source
    whole = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    goals = written(
        goals.select(
            "_source", "source_size", "target", passes.alias("epochs"),
            (whole - passes * F.col("source_size")).alias("_rest"),
        ),
        "goals",
    )
    sums = prefix_sums(
        sized.drop("source"), "_source", ["_draw", "doc_id", "_tie"], {"size": "size"}, goals
    )
    partly = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("size_before")))
    return sums.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + partly).cast("long").alias("taken"),
        "epochs",
        *carry,
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: a row for each pass over a document, its text cut where the budget ends.

    Documents without words carry no weight and are kept once.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row, whole, words = spare(docs, "_row", "_size", "_words")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    marks = shares(rows, carry=(row,), **options)
    partly = F.col("taken") - F.col("epochs") * F.col("size")
    lengths = F.concat(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")),
        F.when(partly > 0, F.array(partly)).otherwise(F.array().cast("array<bigint>")),
    )
    marks = marks.select(
        row,
        F.col("size").alias(whole),
        F.explode(F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(lengths)).alias(words),
    )
    cut = F.array_join(
        F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col(words).cast("int")), ""
    )
    joined = rows.join(marks, row)
    text = F.when(F.col(words) < F.col(whole), cut).otherwise(F.col("text"))
    fresh = {"text": text}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col(words) < F.col(whole), F.length(cut).cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(fresh).select(*columns)
