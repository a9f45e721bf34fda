"""Corpus jobs: cleaning, page assembly, page statistics, topic audit, ingestion report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions import udfs


def clean_documents(docs: DataFrame, fold_unicode: bool = True) -> DataFrame:
    """Clean ``text`` and drop documents left empty."""
    raw = udfs.nfkc(F.col("text")) if fold_unicode else F.col("text")
    return T.keep_non_blank(docs, T.clean(raw))


def page_text(page: Column, text: Column, tables: Column) -> Column:
    """``[Page n]``, the page text and its labelled tables; NULL for an empty page."""
    label = F.concat(F.lit("[Page "), page.cast("string"), F.lit("]"))
    body = F.nullif(T.strip(F.coalesce(text, F.lit(""))), F.lit(""))
    blocks = F.filter(tables, lambda t: t.isNotNull() & (t != ""))
    labelled = F.transform(
        blocks,
        lambda t, i: F.concat(
            F.lit("[Table "), (i + 1).cast("string"), F.lit(" on Page "), page.cast("string"),
            F.lit("]\n"), t,
        ),
    )
    joined = F.nullif(F.array_join(labelled, "\n\n"), F.lit(""))
    return F.when(
        body.isNotNull() | (F.size(blocks) > 0), F.concat_ws("\n\n", label, body, joined)
    )


def assemble_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages (key, page, text, tables) to one text per document, pages in order."""
    parts = pages.select(
        key, "page", page_text(F.col("page"), F.col("text"), F.col("tables")).alias("part")
    ).filter("part is not null")
    ordered = F.sort_array(F.collect_list(F.struct("page", "part")))
    return parts.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["part"]), "\n\n").alias("text")
    )


def page_stats(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages, table pages and scanned-looking pages of each document."""
    has_table = F.exists(F.col("tables"), lambda t: t.isNotNull() & (t != ""))
    visible = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), f"{T.WS}+", ""))
    flags = pages.select(
        key, has_table.alias("_table"), ((visible < 50) & ~has_table).alias("_scanned")
    )
    return flags.groupBy(key).agg(
        F.count("*").alias("page_count"),
        F.count_if("_table").alias("table_page_count"),
        F.count_if("_scanned").alias("scanned_page_count"),
        F.bool_or("_table").alias("has_tables"),
    )


def topic_hits(docs: DataFrame, areas: dict[str, tuple[str, ...]], key: str = "doc_id") -> DataFrame:
    """(key, area, hits): how often the words of an area occur in a document.

    Counted inside the row: the document's words are cut to those that any area has, and each area counts
    its own among these few. Only areas that occur leave the row; nothing is shuffled.
    """
    listed = lambda words: F.array(*[F.lit(w) for w in sorted(words)]).cast("array<string>")
    known = listed({w for words in areas.values() for w in words})
    table = F.array(*[
        F.struct(F.lit(area).alias("area"), listed(set(words)).alias("words")) for area, words in sorted(areas.items())
    ])
    wanted = F.filter(T.alnum_tokens(F.col("text")), lambda w: F.array_contains(known, w))

    def counts(found: Column) -> Column:
        own = lambda a: F.size(F.filter(found, lambda w: F.array_contains(a["words"], w)))
        each = F.transform(table, lambda a: F.struct(a["area"].alias("area"), own(a).cast("bigint").alias("hits")))
        return F.filter(each, lambda a: a["hits"] > 0)

    if not areas:
        return docs.select(key, F.lit("").alias("area"), F.lit(0).cast("bigint").alias("hits")).limit(0)
    return T.each(docs, [key], T.let(wanted, counts), "hit").select(key, "hit.area", "hit.hits")


def top_areas(hits: DataFrame, n: int = 3, key: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("hits"), "area")
    return hits.withColumn("area_rank", F.row_number().over(order)).filter(F.col("area_rank") <= n)


def topic_rollup(hits: DataFrame, n: int = 3, key: str = "doc_id") -> DataFrame:
    """Per area: documents that have it among their top areas, and all its hits."""
    order = Window.partitionBy(key).orderBy(F.desc("hits"), "area")
    ranked = hits.withColumn("area_rank", F.row_number().over(order))
    return ranked.groupBy("area").agg(
        F.count_if(F.col("area_rank") <= n).alias("area_doc_count"),
        F.sum("hits").alias("area_hits"),
    )


def low_text_documents(docs: DataFrame, min_chars: int, key: str = "doc_id") -> DataFrame:
    """Documents shorter than ``min_chars`` after cleaning."""
    return docs.select(key, F.length("text").alias("char_count")).filter(
        F.col("char_count") < min_chars
    )


def ingest_report(
    loaded: DataFrame, kept: DataFrame, children: DataFrame, inserted: DataFrame,
    parents_added: DataFrame,
) -> DataFrame:
    """One row of counts. Sources are counted, not listed, so the row stays small.

    The list itself is ``distinct_sources(kept)``, a table.
    """
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = [
        one(loaded, "docs_loaded"),
        kept.agg(
            F.count("*").alias("docs_preprocessed"),
            F.count_distinct("source").alias("source_count"),
        ),
        one(children, "child_chunks_total"),
        one(inserted, "chunks_ingested"),
        one(parents_added, "parent_chunks_saved"),
    ]
    row = counts[0]
    for other in counts[1:]:
        row = row.join(F.broadcast(other))  # one row each
    return row


def distinct_sources(docs: DataFrame) -> DataFrame:
    return docs.select("source").distinct()
