"""Benchmark evaluation: retrieval and answer metrics of a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.operators import metrics
from askloom.plans.retrieve import Corpus, retrieve
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS, Settings
from askloom.sources.benchmark import judgements

RETRIEVAL = ("hit_at_k", "precision_at_k", "recall_at_k", "ap_at_k", "mrr_at_k", "ndcg_at_k")
ANSWER = ("token_f1", "rouge_2_f1", "rouge_l_f1", "bleu_1", "bleu_4", "exact_match")


def evaluate(
    corpus: Corpus, benchmark: DataFrame, answers: DataFrame, settings: Settings = DEFAULTS,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(one summary row, rows per question).

    ``benchmark`` comes from ``load_benchmark``; ``answers`` holds (query_id,
    candidate) from whatever writes the answers.
    """
    k = max(settings.eval_top_k, 1)
    result = retrieve(corpus, benchmark.select("query_id", "query"), k, settings, **options)
    qrels = judgements(benchmark)
    sources = metrics.unique_sources(result.context, k)
    ranks = metrics.retrieval_metrics(metrics.matched_ranks(sources, qrels), qrels, k)
    pairs = (
        benchmark.select("query_id", F.col("reference_text").alias("reference"))
        .join(answers, "query_id", "left")
        .withColumn(
            "candidate",
            F.coalesce(F.nullif("candidate", F.lit("")), F.lit("No generated answer text.")),
        )
    )
    scores = metrics.ngram_scores(pairs, ("query_id",))
    whole = pairs.select(
        "query_id",
        metrics.rouge_l(F.col("reference"), F.col("candidate")).alias("rouge_l_f1"),
        metrics.exact_match(F.col("reference"), F.col("candidate")).alias("exact_match"),
    )
    per_query = cut_lineage(
        benchmark.select("query_id", "query", "document_ids", "reference_format")
        .join(ranks, "query_id", "left")
        .join(scores, "query_id", "left")
        .join(whole, "query_id", "left")
        .join(result.confidence, "query_id", "left")
    )
    return metrics.macro_means(per_query, (*RETRIEVAL, *ANSWER)), per_query
