"""Evaluation: retrieval metrics, answer metrics, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions import udfs
from askloom.settings import DEFAULTS


def normalize_doc_id(c: Column) -> Column:
    return F.lower(T.strip(F.replace(c, F.lit("\\"), F.lit("/"))))


def path_suffixes(c: Column) -> Column:
    """A path and everything that follows one of its slashes."""
    return T.let(
        F.split(c, "/", -1),
        lambda parts: F.transform(
            parts, lambda x, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/")
        ),
    )


def match_doc_ids(
    candidates: DataFrame, targets: DataFrame, on: tuple[str, ...] = (),
    candidate: str = "candidate", target: str = "target",
) -> DataFrame:
    """Pairs that are equal or where one is a path suffix of the other.

    Both directions are equi-joins on exploded suffixes, no pair is compared in vain.
    """
    down = T.each(
        candidates, candidates.columns, F.array_distinct(path_suffixes(F.col(candidate))), "_key"
    ).join(targets.withColumn("_key", F.col(target)), [*on, "_key"])
    up = T.each(
        targets, targets.columns, F.array_distinct(path_suffixes(F.col(target))), "_key"
    ).join(candidates.withColumn("_key", F.col(candidate)), [*on, "_key"])
    return down.drop("_key").unionByName(up.drop("_key")).distinct()


def unique_sources(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, source, source_rank) of the distinct sources among the first ``k`` rows."""
    first = (
        rows.filter(F.col("rank") <= k)
        .withColumn("source", normalize_doc_id(F.col("source")))
        .filter(F.col("source") != "")
        .groupBy("query_id", "source")
        .agg(F.min("rank").alias("_rank"))
    )
    order = Window.partitionBy("query_id").orderBy("_rank")
    return first.withColumn("source_rank", F.row_number().over(order)).drop("_rank")


def matched_ranks(sources: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, source_rank, target): each rank takes one free target, best rank first.

    A fold over at most ``k`` ranks per question.
    """
    pairs = match_doc_ids(
        sources.withColumnRenamed("source", "candidate"),
        qrels.select("query_id", normalize_doc_id(F.col("target")).alias("target")).distinct(),
        on=("query_id",),
    )
    per_rank = pairs.groupBy("query_id", "source_rank").agg(
        F.sort_array(F.collect_set("target")).alias("targets")
    )
    per_query = per_rank.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("source_rank", "targets"))).alias("ranks")
    )

    def take(state: Column, entry: Column) -> Column:
        free = F.array_except(entry["targets"], F.transform(state, lambda s: s["target"]))
        hit = F.struct(
            entry["source_rank"].alias("source_rank"), F.get(free, F.lit(0)).alias("target")
        )
        return F.when(F.size(free) > 0, F.concat(state, F.array(hit))).otherwise(state)

    empty = F.expr("cast(array() as array<struct<source_rank: int, target: string>>)")
    hits = per_query.select("query_id", F.aggregate("ranks", empty, take).alias("hits"))
    return T.each(hits, ["query_id"], F.col("hits"), "hit").select("query_id", "hit.*")


def retrieval_metrics(matched: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Hit, precision, recall, average precision, reciprocal rank and NDCG at ``k``."""
    judged = qrels.select("query_id", "target").distinct().groupBy("query_id").agg(
        F.count("*").alias("relevant_count")
    )
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("source_rank"))
    per_query = (
        matched.withColumn("_nth", nth)
        .groupBy("query_id")
        .agg(
            F.count("*").alias("hits"),
            F.min("source_rank").alias("first_hit_rank"),
            F.sum(F.col("_nth") / F.col("source_rank")).alias("_ap"),
            F.sum(1.0 / F.log2(F.col("source_rank") + 1.0)).alias("_dcg"),
        )
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("relevant_count"), F.lit(k)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / F.log2(i + 1.0),
    )
    hits = F.coalesce("hits", F.lit(0))
    return judged.join(per_query, "query_id", "left").select(
        "query_id",
        "relevant_count",
        hits.alias("hits"),
        F.when(hits > 0, 1.0).otherwise(0.0).alias("hit_at_k"),
        F.round(hits / F.lit(k), 6).alias("precision_at_k"),
        F.round(hits / F.col("relevant_count"), 6).alias("recall_at_k"),
        F.round(F.coalesce("_ap", F.lit(0.0)) / F.col("relevant_count"), 6).alias("ap_at_k"),
        F.round(F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0)), 6).alias("mrr_at_k"),
        F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_at_k"),
        "first_hit_rank",
    )


def macro_means(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row: mean of each metric over all questions; no question gives 0."""
    mean = lambda n: F.round(F.coalesce(F.avg(F.coalesce(n, F.lit(0.0))), F.lit(0.0)), 6)
    return metrics.agg(
        F.count("*").alias("query_count"), *[mean(n).alias(n) for n in names]
    )


def _grams(tokens: Column, max_n: int) -> Column:
    """All n-grams up to ``max_n`` as (n, gram)."""
    of_size = lambda t, n: F.transform(
        F.filter(F.sequence(F.lit(1), F.size(t) + 1), lambda i: i <= F.size(t) - (n - 1)),
        lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(t, i, n), " ").alias("gram")),
    )
    return T.let(tokens, lambda t: F.concat(*[of_size(t, n) for n in range(1, max_n + 1)]))


def ngram_overlap(pairs: DataFrame, keys: tuple[str, ...], max_n: int) -> DataFrame:
    """(keys, n, overlap): clipped n-gram matches of ``reference`` and ``candidate``."""
    side = lambda column, r, c: T.each(
        pairs, list(keys), _grams(T.alnum_tokens(F.col(column)), max_n), "g"
    ).select(*keys, "g.n", "g.gram", F.lit(r).alias("in_ref"), F.lit(c).alias("in_cand"))
    counts = (
        side("reference", 1, 0)
        .unionByName(side("candidate", 0, 1))
        .groupBy(*keys, "n", "gram")
        .agg(F.sum("in_ref").alias("in_ref"), F.sum("in_cand").alias("in_cand"))
    )
    return counts.groupBy(*keys, "n").agg(
        F.sum(F.least("in_ref", "in_cand")).alias("overlap"),
        F.sum("in_ref").alias("ref_total"),
        F.sum("in_cand").alias("cand_total"),
    )


def f_measure(overlap: Column, ref_total: Column, cand_total: Column) -> Column:
    """Harmonic mean of overlap/candidate and overlap/reference."""
    total = ref_total + cand_total
    return F.when(F.coalesce(overlap, F.lit(0)) > 0, 2.0 * overlap / total).otherwise(0.0)


def ngram_scores(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Token F1 (= ROUGE-1), ROUGE-2, BLEU-1 and BLEU-4 in one pass.

    No stemming. BLEU replaces a zero match count by 0.1 and applies the brevity penalty.
    """
    found = ngram_overlap(pairs, keys, 4)
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    wide = found.groupBy(*keys).agg(
        *[
            pick(n, c).alias(f"{c}_{n}")
            for n in range(1, 5)
            for c in ("overlap", "ref_total", "cand_total")
        ]
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    f1 = lambda n: f_measure(
        zero(f"overlap_{n}"), zero(f"ref_total_{n}"), zero(f"cand_total_{n}")
    )

    def log_precision(n: int) -> Column:
        matches = F.when(zero(f"overlap_{n}") == 0, F.lit(0.1)).otherwise(zero(f"overlap_{n}"))
        return F.log(matches / F.greatest(zero(f"cand_total_{n}"), F.lit(1)))

    ref, cand = zero("ref_total_1"), zero("cand_total_1")
    brevity = F.when(cand > ref, F.lit(1.0)).otherwise(F.exp(1.0 - F.try_divide(ref, cand)))
    bleu = lambda log_sum: F.round(
        F.when(zero("overlap_1") > 0, brevity * F.exp(log_sum)).otherwise(0.0), 6
    )
    scored = wide.select(
        *keys,
        F.round(f1(1), 6).alias("token_f1"),
        F.round(f1(2), 6).alias("rouge_2_f1"),
        bleu(log_precision(1)).alias("bleu_1"),
        bleu(sum((0.25 * log_precision(n) for n in range(2, 5)), 0.25 * log_precision(1))).alias(
            "bleu_4"
        ),
    )
    names = ("token_f1", "rouge_2_f1", "bleu_1", "bleu_4")
    return (
        pairs.select(*keys)
        .join(scored, list(keys), "left")
        .na.fill(0.0, subset=list(names))
    )


def exact_match(reference: Column, candidate: Column) -> Column:
    joined = lambda c: F.array_join(T.alnum_tokens(c), " ")
    return F.when(joined(reference) == joined(candidate), 1.0).otherwise(0.0)


def rouge_l(reference: Column, candidate: Column) -> Column:
    """F1 of the longest common token subsequence."""
    ref, cand = T.alnum_tokens(reference), T.alnum_tokens(candidate)
    return F.round(f_measure(udfs.lcs_length(ref, cand), F.size(ref), F.size(cand)), 6)


def similarity_stats(
    rows: DataFrame, questions: DataFrame, threshold: float = DEFAULTS.confidence_threshold
) -> DataFrame:
    """Min, max, mean similarity and rows strictly above the threshold; zeros without rows."""
    stats = rows.groupBy("query_id").agg(
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.round(F.avg("similarity"), 6).alias("mean_similarity"),
        F.count_if(F.col("similarity") > threshold).alias("above_threshold"),
        F.count("*").alias("total"),
    )
    return questions.select("query_id").join(stats, "query_id", "left").na.fill(0).na.fill(0.0)


def token_ratio(local: Column, dynamic: Column) -> tuple[Column, Column, Column]:
    """(total, local share, dynamic share), 0 without tokens."""
    total = F.greatest(local, F.lit(0)) + F.greatest(dynamic, F.lit(0))
    share = lambda c: F.when(total == 0, 0.0).otherwise(
        F.round(F.try_divide(F.greatest(c, F.lit(0)), total), 6)
    )
    return total, share(local), share(dynamic)


def fallback_stats(
    used: Column, fetched: Column, surviving: Column, relevance: Column
) -> dict[str, Column]:
    """Fallback numbers, zeroed when the fallback was not used."""
    count = lambda c: F.when(used, F.greatest(c, F.lit(0))).otherwise(0)
    return {
        "used_fallback": used,
        "articles_fetched": count(fetched),
        "articles_surviving": count(surviving),
        "avg_fallback_relevance": F.when(used, relevance),
    }


def generation_stats(latency_ms: Column, retries: Column, passed: Column) -> dict[str, Column]:
    return {
        "latency_ms": F.greatest(latency_ms, F.lit(0.0)),
        "retry_count": F.greatest(retries, F.lit(0)),
        "validation_passed": passed,
    }
