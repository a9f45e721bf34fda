"""Context of a question: token budget, text, coverage, abstention, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import rules, variants
from askloom.functions import text as T
from askloom.operators.fusion import clamp, rounded
from askloom.settings import DEFAULTS, Settings


def token_budget(rows: DataFrame, cap: int = DEFAULTS.max_context_tokens) -> DataFrame:
    """Keep rows while the running token sum fits: local rows first, then dynamic ones.

    Needs (query_id, is_dynamic, rank, tokens). Adds the running sum.
    """
    order = (
        Window.partitionBy("query_id")
        .orderBy("is_dynamic", "rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.withColumn("running_tokens", F.sum("tokens").over(order)).filter(
        F.col("running_tokens") <= cap
    )


def bundle_totals(kept: DataFrame) -> DataFrame:
    """Token totals and rows per question of a budgeted context."""
    part = lambda flag: F.coalesce(
        F.sum(F.when(F.col("is_dynamic") == flag, F.col("tokens"))), F.lit(0)
    )
    return kept.groupBy("query_id").agg(
        F.count("*").alias("docs"),
        part(False).alias("local_tokens"),
        part(True).alias("dynamic_tokens"),
        F.sum("tokens").alias("total_tokens"),
    )


def _label(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + "="), value)


def context_text(rows: DataFrame) -> DataFrame:
    """One text per question: sources in first-seen order, best rows first inside.

    Needs the context columns and ``rank``. A context is cut to a token budget
    before, so the rows of one question are few.
    """
    blank = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), d)
    keyed = rows.withColumn(
        "_source", T.strip(blank("source_rel", blank("source", F.lit("unknown"))))
    )
    group = Window.partitionBy("query_id", "_source")
    lead = F.first(F.struct("source", "source_rel", "topic", "subtopic", "doc_type"))
    inside = group.orderBy(
        F.desc("similarity"), F.desc(F.coalesce("rerank_score", F.lit(0.0))), F.asc("rank")
    )
    placed = (
        keyed.withColumn("_first", F.min("rank").over(group))
        .withColumn("_lead", lead.over(group.orderBy("rank")))
        .withColumn("_nth", F.row_number().over(inside))
        .withColumn(
            "_doc", F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))
        )
    )
    number = lambda c: F.format_string("%.4f", c)
    head = F.concat(
        F.lit("[Document "), F.col("_doc").cast("string"), F.lit("] "),
        F.concat_ws(
            " ",
            _label("source", F.col("_lead.source")),
            _label("source_rel", F.coalesce(F.nullif("_lead.source_rel", F.lit("")), "_source")),
            _label("topic", F.coalesce(F.nullif("_lead.topic", F.lit("")), F.lit("n/a"))),
            _label("subtopic", F.coalesce(F.nullif("_lead.subtopic", F.lit("")), F.lit("n/a"))),
            _label("doc_type", F.col("_lead.doc_type")),
        ),
    )
    chunk = F.concat(
        F.lit("  [Chunk "), F.col("_doc").cast("string"), F.lit("."),
        F.col("_nth").cast("string"), F.lit("] "),
        F.concat_ws(
            " ",
            _label("chunk_type", F.col("chunk_type")),
            _label("similarity", number(F.col("similarity"))),
            F.when(
                F.col("rerank_score").isNotNull(), _label("rerank", number(F.col("rerank_score")))
            ),
            F.when(F.col("section") != "", _label("section", F.col("section"))),
            F.when(F.col("pages") != "", _label("pages", F.col("pages"))),
            F.when(F.col("has_table"), F.lit("has_table=true")),
        ),
        F.lit("\n"), F.col("text"),
    )
    line = F.when(F.col("_nth") == 1, F.concat(head, F.lit("\n\n"), chunk)).otherwise(chunk)
    lines = placed.select("query_id", F.struct("_doc", "_nth", line.alias("line")).alias("entry"))
    return lines.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list("entry")), lambda e: e["line"]), "\n\n"
        ).alias("context")
    )


def coverage(
    rows: DataFrame, questions: DataFrame, threshold: float = DEFAULTS.confidence_threshold
) -> DataFrame:
    """Rows, strong rows, best and mean similarity, tokens; zero without rows."""
    similarity = F.greatest(F.lit(0.0), F.col("similarity"))
    part = lambda flag: F.sum(F.when(F.col("is_dynamic") == flag, F.col("tokens")))
    metrics = rows.groupBy("query_id").agg(
        F.count("*").alias("doc_count"),
        F.count_if(similarity >= threshold).alias("strong_doc_count"),
        F.round(F.max(similarity), 4).alias("max_similarity"),
        F.round(F.avg(similarity), 4).alias("avg_similarity"),
        part(False).alias("local_tokens"),
        part(True).alias("dynamic_tokens"),
    )
    joined = questions.select("query_id").join(metrics, "query_id", "left")
    filled = joined.na.fill(0).na.fill(0.0)
    return filled.withColumn("total_tokens", F.col("local_tokens") + F.col("dynamic_tokens"))


def abstention(
    metrics: DataFrame, fallback_requested: bool, settings: Settings = DEFAULTS
) -> DataFrame:
    """(abstain, reason) from coverage metrics joined with ``low_confidence``."""
    weak = F.col("low_confidence") & (F.col("strong_doc_count") == 0)
    no_fallback = F.lit(fallback_requested) & (F.col("dynamic_tokens") == 0)
    too_few = (F.col("max_similarity") < settings.confidence_threshold * 0.75) & (
        F.col("doc_count") < settings.min_relevant
    )
    reason = (
        F.when(F.col("doc_count") == 0, rules.REASON_NO_CONTEXT)
        .when(weak & no_fallback, rules.REASON_FALLBACK_EMPTY)
        .when(weak, rules.REASON_LOW_CONFIDENCE)
        .when(too_few, rules.REASON_TOO_FEW)
        .otherwise("")
    )
    return metrics.withColumn("reason", reason).withColumn("abstain", F.col("reason") != "")


def retrieval_signal(
    rows: DataFrame, questions: DataFrame, threshold: float = DEFAULTS.confidence_threshold
) -> DataFrame:
    """0.7 x mean of the best four similarities + 0.3 x share of strong rows."""
    order = Window.partitionBy("query_id").orderBy(F.desc("_s"), "chunk_id")
    ranked = rows.withColumn("_s", clamp(F.col("similarity"))).withColumn(
        "_n", F.row_number().over(order)
    )
    parts = ranked.groupBy("query_id").agg(
        F.sum(F.when(F.col("_n") <= 4, F.col("_s"))).alias("top_sum"),
        F.least(F.count("*"), F.lit(4)).alias("top_n"),
        F.count_if(F.col("_s") >= threshold).alias("strong"),
    )
    signal = clamp(
        0.7 * (F.col("top_sum") / F.col("top_n"))
        + 0.3 * F.least(F.lit(1.0), F.col("strong") / F.col("top_n"))
    )
    scored = parts.select("query_id", rounded(signal).alias("retrieval_signal"))
    return (
        questions.select("query_id").join(scored, "query_id", "left").na.fill({"retrieval_signal": 0.0})
    )


def clean_list(items: Column, max_items: int = 6, max_len: int = 220) -> Column:
    """First items, each cut, blanks dropped."""
    cut = F.transform(F.slice(items, 1, max_items), lambda x: T.truncate(x, max_len))
    return F.filter(F.coalesce(cut, F.expr(variants.NO_TEXTS)), lambda x: x != "")


def generation_signal(answer: Column) -> Column:
    """0.7 x filled main fields + 0.3 x source tags, or 0.1 for an abstention."""
    main = [answer[f] for f in rules.PRIMARY_FIELDS]
    filled = sum((F.when(T.squeeze(c) != "", 1).otherwise(0) for c in main), F.lit(0))
    blob = F.concat_ws(
        " ",
        T.squeeze(answer["brand_diagnosis"]),
        T.squeeze(answer["market_insight"]),
        *[F.array_join(clean_list(answer[f], 6, 180), " ") for f in rules.LIST_FIELDS],
    )
    tags = F.regexp_count(blob, F.lit(r"(?i)\[source=[^\n]*?\]"))
    signal = 0.7 * (filled / 5.0) + 0.3 * F.least(F.lit(1.0), tags / 3.0)
    return F.when(T.squeeze(answer["abstention_message"]) != "", F.lit(0.1)).otherwise(
        rounded(clamp(signal))
    )


def calibrated(
    retrieval: Column, generation: Column, abstained: Column, verdict: Column
) -> Column:
    """Final confidence from both signals and the grounding verdict."""
    mixed = 0.75 * retrieval + 0.25 * generation
    scaled = (
        F.when(verdict == "partial", mixed * 0.9)
        .when(verdict == "not_grounded", mixed * 0.35)
        .otherwise(mixed)
    )
    low = F.greatest(F.lit(0.05), F.least(F.lit(0.25), retrieval * 0.45))
    return rounded(F.when(abstained, low).otherwise(clamp(scaled)))


def abstained_confidence(avg_similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.2), avg_similarity))


def retry_after_abstention(
    rows: DataFrame, metrics: DataFrame, questions: DataFrame, settings: Settings = DEFAULTS,
    aliases=rules.ENTITY_ALIASES,
) -> DataFrame:
    """Should an abstention be retried: enough strong context that names an entity."""
    head = F.lower(
        F.concat(
            F.coalesce(F.nullif("source_rel", F.lit("")), "source", F.lit("")), F.lit(" "),
            F.coalesce("topic", F.lit("")), F.lit(" "),
            F.coalesce("subtopic", F.lit("")), F.lit(" "),
            F.substring(F.coalesce("text", F.lit("")), 1, 300),
        )
    )
    asked = questions.select(
        "query_id", variants.entity_hints(F.col("query"), aliases).alias("hints")
    )
    named = (
        rows.select("query_id", head.alias("head"))
        .join(asked, "query_id")
        .groupBy("query_id")
        .agg(
            F.bool_or(F.exists("hints", lambda h: F.contains(F.col("head"), h))).alias("named")
        )
    )
    enough = (F.col("doc_count") >= 2) & ~(
        (F.col("strong_doc_count") <= 0)
        & (F.col("max_similarity") < settings.confidence_threshold)
    )
    return (
        metrics.join(asked, "query_id")
        .join(named, "query_id", "left")
        .select(
            "query_id",
            "doc_count",
            "strong_doc_count",
            F.size("hints").alias("hint_count"),
            (enough & ((F.size("hints") == 0) | F.coalesce("named", F.lit(False)))).alias("retry"),
        )
    )
