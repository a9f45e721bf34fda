"""From ranked lists to a short, reranked and diversified result per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions import udfs, variants
from askloom.functions.rules import ENTITY_ALIASES
from askloom.operators.dense import dense_topk
from askloom.operators.lexical import LexicalIndex, lexical_topk
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS, Settings

FUSION_DIGITS = 9
SCORE_DIGITS = 6


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rounded(c: Column) -> Column:
    return F.round(c, SCORE_DIGITS)


def ranked(df: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(
        rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    )


def distinct_texts(variant_rows: DataFrame) -> DataFrame:
    """Each different text once, in its lowercase squeezed form."""
    return variant_rows.select(
        F.lower(T.squeeze(F.col("variant"))).alias("variant_key")
    ).distinct()


def numbered_texts(variant_rows: DataFrame) -> DataFrame:
    """Distinct texts with a number. The table is written, so the numbers stay."""
    texts = distinct_texts(variant_rows)
    return cut_lineage(texts.withColumn("text_id", F.monotonically_increasing_id()))


def ranked_lists(
    index: LexicalIndex, vectors: DataFrame, variant_rows: DataFrame, k: int,
    settings: Settings = DEFAULTS, embedder=None,
) -> DataFrame:
    """One dense and one lexical list per variant.

    ``variant_rows``: (query_id, variant_id, variant). A text that several
    questions share is embedded and scored once, under a number instead of the
    long text.
    """
    texts = numbered_texts(variant_rows)
    embedded = udfs.embed_column(texts, "variant_key", "embedding", embedder, settings.vector_dim)
    dense = dense_topk(vectors, embedded, k, query_key="text_id", settings=settings)
    lexical = lexical_topk(
        index, texts, k, query_key="text_id", text="variant_key", settings=settings
    )
    columns = ("text_id", "chunk_id", "rank", "similarity")
    lists = dense.select(*columns, F.lit("dense").alias("list_type")).unionByName(
        lexical.select(*columns, F.lit("lexical").alias("list_type"))
    )
    keyed = variant_rows.withColumn("variant_key", F.lower(T.squeeze(F.col("variant"))))
    asked = keyed.join(texts, "variant_key").select("query_id", "variant_id", "text_id")
    return asked.join(lists, "text_id").select(
        "query_id", "variant_id", "list_type", "rank", "chunk_id", "similarity"
    )


def rrf(lists: DataFrame, n: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Reciprocal rank fusion; each chunk keeps its highest similarity."""
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (F.lit(settings.rrf_k) + F.col("rank"))), FUSION_DIGITS).alias(
            "rrf_score"
        ),
        F.max("similarity").alias("similarity"),
    )
    return ranked(fused, F.desc("rrf_score"), F.asc("chunk_id")).filter(F.col("rank") <= n)


def grade_with_floor(rows: DataFrame, floor: int = DEFAULTS.min_relevant) -> DataFrame:
    """Keep relevant rows in order; top up to ``floor`` with the others, in order.

    ``relevant`` is an input flag. The new ``rank`` is the position in the result.
    """
    by_query = Window.partitionBy("query_id")
    counted = rows.withColumn("_relevant", F.count_if("relevant").over(by_query))
    ordered = ranked(counted, F.desc(F.col("relevant").cast("int")), F.asc("rank"), rank="_pos")
    kept = ordered.filter(F.col("_pos") <= F.greatest(F.col("_relevant"), F.lit(floor)))
    return kept.withColumn("rank", F.col("_pos")).drop("_pos", "_relevant")


def text_overlap(query: Column, text: Column) -> Column:
    """Share of question terms (14) found among the document terms (180)."""
    wanted = T.content_terms(query, 14)
    found = F.size(F.array_intersect(wanted, T.content_terms(text, 180)))
    return found / F.greatest(F.size(wanted), F.lit(1))


def metadata_alignment(
    query: Column, source_rel: Column, topic: Column, subtopic: Column, section: Column,
    aliases=ENTITY_ALIASES,
) -> Column:
    """Question terms and entities that occur in the metadata text."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    blob = F.lower(
        F.concat_ws(" ", blank(source_rel), blank(topic), blank(subtopic), blank(section))
    )
    found = lambda words: T.let(
        blob, lambda b: F.size(F.filter(words, lambda w: F.contains(b, w)))
    )
    terms = T.content_terms(query, 14)
    term_part = found(terms) / F.greatest(F.size(terms), F.lit(1))
    entity_part = F.least(found(variants.entity_hints(query, aliases)), F.lit(2)) / 2.0
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.greatest(term_part, entity_part))


def rerank(
    rows: DataFrame, top_n: int, settings: Settings = DEFAULTS, model_score: str | None = None,
    aliases=ENTITY_ALIASES,
) -> DataFrame:
    """Score the first candidates, put the best ``top_n`` first, keep the rest in order.

    Needs (query_id, query, rank, chunk_id, similarity, text, source_rel, topic,
    subtopic, section); ``model_score`` names a raw model score column.
    """
    is_candidate = F.col("rank") <= settings.rerank_candidates
    overlap = text_overlap(F.col("query"), F.col("text"))
    base = clamp(F.col("similarity"))
    if model_score is None:
        meta = metadata_alignment(
            F.col("query"), F.col("source_rel"), F.col("topic"), F.col("subtopic"),
            F.col("section"), aliases,
        )
        score = 0.60 * base + 0.25 * overlap + 0.15 * meta
    else:
        group = Window.partitionBy("query_id")
        raw = F.when(is_candidate, F.col(model_score))
        low, high = F.min(raw).over(group), F.max(raw).over(group)
        rows = rows.withColumn(
            "_model", (raw - low) / F.greatest(high - low, F.lit(1e-9))
        )
        score = 0.55 * F.col("_model") + 0.30 * base + 0.15 * overlap
    scored = rows.withColumn("rerank_score", F.when(is_candidate, rounded(clamp(score))))
    by_score = ranked(
        scored, F.desc_nulls_last("rerank_score"), F.asc("rank"), F.asc("chunk_id"),
        rank="_by_score",
    )
    in_front = is_candidate & (F.col("_by_score") <= top_n)
    placed = ranked(
        by_score.withColumn("_front", F.when(in_front, 0).otherwise(1)),
        F.asc("_front"), F.when(F.col("_front") == 0, F.col("_by_score")).otherwise(F.col("rank")),
        rank="_placed",
    )
    return placed.withColumn("rank", F.col("_placed")).drop(
        "_placed", "_front", "_by_score", "_model"
    )


def source_key(source_rel: Column, source: Column) -> Column:
    return F.lower(
        T.strip(F.coalesce(F.nullif(source_rel, F.lit("")), source, F.lit("")))
    )


def diversify(
    rows: DataFrame, limit: int, per_source: int = DEFAULTS.max_per_source
) -> DataFrame:
    """At most ``per_source`` rows of a source; a blank source counts as its own."""
    if per_source <= 0:
        kept = rows
    else:
        key = source_key(F.col("source_rel"), F.col("source"))
        own = F.when(key == "", F.concat(F.lit("\0"), F.col("chunk_id"))).otherwise(key)
        order = Window.partitionBy("query_id", "_source").orderBy("rank")
        kept = (
            rows.withColumn("_source", own)
            .withColumn("_nth", F.row_number().over(order))
            .filter(F.col("_nth") <= per_source)
            .drop("_source", "_nth")
        )
    return (
        ranked(kept, F.asc("rank"), rank="_pos")
        .filter(F.col("_pos") <= limit)
        .withColumn("rank", F.col("_pos"))
        .drop("_pos")
    )


CONTEXT_COLUMNS = (
    "query_id", "chunk_id", "chunk_type", "source", "source_rel", "topic", "subtopic",
    "section", "pages", "has_table", "doc_type", "parent_id", "text", "similarity",
    "rerank_score",
)


def with_parents(
    rows: DataFrame, parents: DataFrame, k: int, max_parents: int = DEFAULTS.max_parents
) -> DataFrame:
    """The first ``k`` children, then up to ``max_parents`` of their parents.

    A parent takes the best similarity of its children. Only the few needed
    parent rows travel: the join runs against the kept children.
    """
    children = rows.filter(F.col("rank") <= max(k, 1))
    best = (
        children.filter(F.coalesce("parent_id", F.lit("")) != "")
        .groupBy("query_id", "parent_id")
        .agg(
            F.max("similarity").alias("similarity"),
            F.min_by("doc_type", "rank").alias("doc_type"),
        )
    )
    parent_columns = [
        "parent_id", "source", "source_rel", "topic", "subtopic", "section", "pages",
        "has_table", "text",
    ]
    found = parents.select(*parent_columns).join(cut_lineage(best), "parent_id").filter(
        T.strip(F.col("text")) != ""
    )
    top = ranked(found, F.desc("similarity"), F.asc("parent_id")).filter(
        F.col("rank") <= max_parents
    )
    as_rows = top.select(
        *[
            {
                "chunk_id": F.concat(F.lit("parent::"), F.col("parent_id")).alias("chunk_id"),
                "chunk_type": F.lit("parent").alias("chunk_type"),
                "text": T.strip(F.col("text")).alias("text"),
                "rerank_score": F.lit(None).cast("double").alias("rerank_score"),
            }.get(c, F.col(c))
            for c in CONTEXT_COLUMNS
        ],
        "rank",
        F.lit(1).alias("is_parent"),
    )
    combined = children.select(*CONTEXT_COLUMNS, "rank", F.lit(0).alias("is_parent")).unionByName(
        as_rows
    )
    return (
        ranked(combined, F.asc("is_parent"), F.asc("rank"), rank="_pos")
        .withColumn("rank", F.col("_pos"))
        .drop("_pos", "is_parent")
    )


def confidence(
    rows: DataFrame, questions: DataFrame, threshold: float = DEFAULTS.confidence_threshold
) -> DataFrame:
    """(query_id, max_score, low_confidence); a question without rows scores 0."""
    proxy = 0.70 * F.col("similarity") + 0.30 * F.coalesce("rerank_score", "similarity")
    best = rows.groupBy("query_id").agg(F.max(rounded(proxy)).alias("max_score"))
    scored = questions.select("query_id").join(best, "query_id", "left")
    return scored.select(
        "query_id",
        F.coalesce("max_score", F.lit(0.0)).alias("max_score"),
        (F.coalesce("max_score", F.lit(0.0)) < threshold).alias("low_confidence"),
    )
