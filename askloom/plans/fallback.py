"""From a weak local retrieval to a context: articles filtered, chunked, merged and trimmed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions import udfs
from askloom.operators import articles as A
from askloom.operators import context as C
from askloom.plans.retrieve import Retrieval
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Fallback:
    """Stage results; every frame is keyed by ``query_id``."""

    #: Questions that fell back, with the vectors that articles are compared to.
    asked: DataFrame
    #: Chunks of the articles that passed, and the rows left after each stage.
    chunks: DataFrame
    stats: DataFrame
    #: Local rows, then dynamic ones, of every question, within the token budget.
    context: DataFrame


def question_vectors(result: Retrieval, settings: Settings = DEFAULTS, embedder=None) -> DataFrame:
    """(query_id, query_vector, centroid) of the questions with low confidence.

    The centroid is the unit mean of the question's local rows, or the question itself if it has none.
    """
    weak = result.confidence.where("low_confidence").select("query_id")
    asked = udfs.embed_column(result.questions.join(weak, "query_id"), "query", "query_vector", embedder, settings.vector_dim)
    rows = result.context.join(weak, "query_id", "left_semi").select("query_id", "text")
    local = udfs.embed_column(rows, "text", "embedding", embedder, settings.vector_dim)
    near = A.centroids(local, "query_id", settings.vector_dim)
    return asked.join(near, "query_id", "left").select(
        "query_id", "query_vector", F.coalesce("centroid", "query_vector").alias("centroid")
    )


def dynamic_rows(chunks: DataFrame, like: DataFrame) -> DataFrame:
    """Article chunks as context rows with the columns of ``like``, ranked in the order of their articles."""
    given = {
        "chunk_type": F.lit("dynamic"), "doc_type": F.lit("dynamic"), "has_table": F.lit(False),
        "similarity": F.col("relevance_score"),
        "rank": F.row_number().over(Window.partitionBy("query_id").orderBy("position", "doc_id", "chunk_index")),
    }
    known = set(chunks.columns)
    columns = []
    for field in like.schema.fields:
        value = given.get(field.name)
        if value is None:
            value = F.col(field.name) if field.name in known else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return chunks.select(*columns)


def answer_context(
    result: Retrieval, articles: DataFrame, now: Column, settings: Settings = DEFAULTS, embedder=None
) -> Fallback:
    """Context of every question; those with low confidence get chunks of their articles behind the local rows.

    ``articles`` are the fetched rows of each question, as the funnel takes them. Articles of questions that
    the local corpus answers are not looked at.
    """
    asked = cut_lineage(question_vectors(result, settings, embedder))
    survivors, stats = A.run_funnel(articles, asked, now, settings, embedder)
    chunks = cut_lineage(A.dynamic_chunks(survivors, now, settings))
    both = result.context.withColumn("is_dynamic", F.lit(False)).unionByName(
        dynamic_rows(chunks, result.context).withColumn("is_dynamic", F.lit(True))
    )
    counted = both.withColumn("tokens", T.token_count(F.col("text")).cast("long"))
    return Fallback(asked, chunks, stats, C.token_budget(counted, settings.max_context_tokens))
