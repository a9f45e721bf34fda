"""A corpus pipeline of five stages over ``documents``.

Each stage reads what its predecessor wrote. All stages but the last return the columns of
``documents``: toxic documents go, then exact copies, then near copies; the rest is mixed to the
target weights and packed into training sequences.

SQL cannot express a trained classifier, so ``ORACLE_SQL`` is None and the tests compare with
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askloom.llm import exact_dedup, mixing, packing, simhash, toxicity
from askloom.llm.common import table, written
from askloom.llm.registry import prepare, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the toxicity threshold of their language go."""
    prepare(spark)
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    prepare(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal fingerprints the document with the smallest id stays."""
    prepare(spark)
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that each source gives its share of words."""
    prepare(spark)
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a document that the mix repeats is packed as often."""
    prepare(spark)
    return packing.pack(docs, tokenizer=tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
