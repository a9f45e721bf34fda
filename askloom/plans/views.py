"""The given tables seen as corpus, questions, sessions and articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.operators import chunking, corpus
from askloom.operators.dense import CellIndex, build_cells
from askloom.operators.matching import containing
from askloom.plans.retrieve import Corpus, ingest
from askloom.session import cut_lineage, drop_path, scratch_path
from askloom.settings import Settings

# Small windows make many chunks; the retrieval corpus uses the default sizes.
SMALL = Settings(parent_size=120, parent_overlap=20, child_size=40, child_overlap=8)
K = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        F.concat_ws("/", "source", "doc_id").alias("source"),
        F.col("source").alias("source_rel"),
        F.col("source").alias("topic"),
        F.col("lang").alias("subtopic"),
        "text",
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out a table whose files make fewer tasks than there are cores, and only such a one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def raw_docs(spark: SparkSession, sf: str) -> DataFrame:
    return as_documents(spread(table(spark, sf, "documents"), "doc_id"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.clean_documents(raw_docs(spark, sf))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval_corpus(spark, sf).chunks


_VERSIONS: dict[tuple[str, str], tuple[tuple, Corpus]] = {}


def input_version(spark: SparkSession, sf: str, *names: str) -> tuple:
    """Bytes and modification time of the input tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
        files = path.getFileSystem(conf)
        out.append((files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime()))
    return tuple(out)


def retrieval_corpus(spark: SparkSession, sf: str) -> Corpus:
    """The stored corpus of a data folder: ingested by the first query that asks, opened by the rest.

    Default-size children and parents; ``quality`` is the label of the document. A new version of
    the input replaces the old one.
    """
    key = (spark.sparkContext.applicationId, sf)
    version = input_version(spark, sf, "documents", "labels")
    if key in _VERSIONS and _VERSIONS[key][0] == version:
        return Corpus.open(spark, _VERSIONS[key][1].path)
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    fresh = ingest(docs(spark, sf), extra=labels)
    if key in _VERSIONS:
        drop_path(spark, _VERSIONS[key][1].path)
    _VERSIONS[key] = (version, fresh)
    return fresh


_CELLS: dict[str, CellIndex] = {}


def vector_cells(spark: SparkSession, sf: str) -> CellIndex:
    """The inverted file over the vectors of the stored corpus, built by the first query that asks."""
    store = retrieval_corpus(spark, sf)
    if store.path not in _CELLS:
        _CELLS[store.path] = build_cells(store.vectors, scratch_path(spark, "cells"))
    return _CELLS[store.path]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each line of a document is a page; a line with cell bars is also a table."""
    documents = spread(table(spark, sf, "documents"), "doc_id")
    lines = T.each(documents, ["doc_id"], F.split("text", "\n", -1), "text", "pos")
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    cells = F.split("text", r"\|", -1)
    numbers = F.transform(cells, lambda x, i: F.concat(F.lit("c"), (i + 1).cast("string")))
    markdown = T.table_markdown(F.array(numbers, cells))
    return lines.select(
        "doc_id",
        (F.col("pos") + 1).alias("page"),
        F.when(bars >= 2, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(bars >= 2, F.array(markdown))
        .otherwise(F.expr("cast(array() as array<string>)"))
        .alias("tables"),
    )


def qrels(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, target): documents whose raw text holds the question text."""
    found = containing(
        raw_docs(spark, sf).select(F.col("source").alias("target"), F.col("text").alias("body")),
        questions(spark, sf),
    )
    return found.select("query_id", "target")
