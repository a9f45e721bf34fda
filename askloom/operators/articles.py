"""Article funnel: merge, quality filters, relevance, near-duplicates, recency, chunks.

Articles are rows (query_id, position, title, description, content, url, lang,
published_at); ``position`` is the order in which they were fetched. Vectors are made on
the way: of the whole text for relevance, of the title for near-duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as St

from askloom.functions import text as T
from askloom.functions import udfs
from askloom.operators.chunking import chunk_flat
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS, Settings

SCORE_DIGITS = 6
HEAD_ROWS = 8192
SLICE_ROWS = 32_768
#: Rows of the left and of the right block that are compared at a time.
LEFT_ROWS, RIGHT_ROWS = 1024, 4096
#: Lengths are compared with this much room, so that no similar pair is missed by rounding.
SLACK = 1e-9


def normalize(articles: DataFrame) -> DataFrame:
    """NULLs to '', either spelling of the publish time, and the combined text."""
    blank = lambda n: F.coalesce(F.col(n), F.lit("")) if n in articles.columns else F.lit("")
    published = F.coalesce(F.nullif(blank("publishedAt"), F.lit("")), blank("published_at"))
    texts = {n: blank(n) for n in ("title", "description", "content", "url")}
    out = articles.withColumns({**texts, "published": published})
    return out.withColumn("combined", T.strip(F.concat_ws(" ", "title", "description", "content")))


def merge_sources(primary: DataFrame, secondary: DataFrame, enough: int = 3) -> DataFrame:
    """Second source only for questions with fewer than ``enough`` first-source rows.

    Rows whose url the first source already has are left out; repeats inside the
    second source stay.
    """
    counts = primary.groupBy("query_id").agg(F.count("*").alias("_n"))
    thin = (
        secondary.join(counts, "query_id", "left")
        .filter(F.coalesce("_n", F.lit(0)) < enough)
        .drop("_n")
    )
    seen = primary.select("query_id", "url").distinct()
    return primary.unionByName(thin.join(seen, ["query_id", "url"], "left_anti"))


def language_ok(lang: Column, text: Column, wanted: str = "en") -> Column:
    return (text != "") & F.coalesce(lang == wanted, F.lit(False))


def long_enough(text: Column, words: int = 150) -> Column:
    return T.token_count(text) >= words


def readable(text: Column) -> Column:
    """Share of letters at least 0.70, mean word length at most 15."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    visible = F.length(F.regexp_replace(text, f"{T.WS}+", ""))
    words = F.greatest(T.token_count(text), F.lit(1))
    return (letters / F.greatest(F.length(text), F.lit(1)) >= 0.70) & (visible / words <= 15)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector gives 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.try_divide(dot(a, b), norms))


def centroids(vectors: DataFrame, key: str, dim: int = DEFAULTS.vector_dim) -> DataFrame:
    """(key, centroid): unit mean vector per key; one aggregate, combined on the map side."""
    means = vectors.groupBy(key).agg(
        F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(dim)]).alias("m")
    )
    norm = F.sqrt(dot(F.col("m"), F.col("m")))
    return means.withColumn("norm", norm).select(
        key,
        F.when(F.col("norm") == 0, F.col("m"))
        .otherwise(F.transform("m", lambda x: F.try_divide(x, F.col("norm"))))
        .alias("centroid"),
    )


def relevance(article: Column, query: Column, centroid: Column) -> Column:
    score = 0.6 * cosine(article, query) + 0.4 * cosine(article, F.coalesce(centroid, query))
    return F.round(score, SCORE_DIGITS)


def _greedy(threshold: float, schema: St.StructType):
    """Keep a row unless it is too similar to a kept earlier one (one bounded head)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["position", "doc_id"], kind="stable")
        unit = _unit(pdf["embedding"])
        kept: list[int] = []
        for i in range(len(unit)):
            if not kept or not ((unit[kept] @ unit[i]) > threshold).any():
                kept.append(i)
        return pdf.iloc[kept][schema.names]

    return run


def _unit(vectors: pd.Series) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _leading_dims(threshold: float, order: list[int]):
    """Dimensions of a vector that any vector more similar than ``threshold`` shares one of.

    With the dimensions in one order for all, rarest first, a vector's leading ones are cut where what
    follows has no more than ``threshold`` of its length. Two vectors that share no leading dimension
    overlap in what follows in one of them alone, so they are no more similar than that.
    """

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        ranked = _unit(vectors)[:, order] if len(vectors) else np.zeros((0, 0))
        after = np.sqrt(np.maximum(np.cumsum((ranked**2)[:, ::-1], axis=1)[:, ::-1], 0))
        leading = (after > threshold - SLACK) & (ranked != 0)
        dims = np.array(order, np.int32)
        return pd.Series([dims[row] for row in leading], index=vectors.index, dtype=object)

    return run


def _rarest_first(rows: DataFrame) -> list[int]:
    """The dimensions by how many vectors use them: as many numbers as a vector is long."""
    used = rows.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.count_if(F.col("x") != 0).alias("n"))
    return [r["dim"] for r in used.orderBy("n", "dim").collect()]


def _has_near(threshold: float):
    """Rows of the left block with a similar row in the right one that comes before them.

    Both sides are taken in order, a bounded part at a time, so rows that come later or have been found are
    not compared, and a block's scores are never held as a whole.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_row": pd.Series([], dtype="int64")})
        both = pd.concat([left[["position", "doc_id"]], right[["position", "doc_id"]]], ignore_index=True)
        place = np.empty(len(both), np.int64)
        place[both.sort_values(["position", "doc_id"], kind="stable").index] = np.arange(len(both))
        mine, theirs = place[: len(left)], place[len(left) :]
        ours, others = np.argsort(mine), np.argsort(theirs)
        mine, theirs = mine[ours], theirs[others]
        own, other = left["_row"].to_numpy()[ours], right["_row"].to_numpy()[others]
        unit, against = _unit(left["embedding"])[ours], _unit(right["embedding"])[others].T
        found = np.zeros(len(left), bool)
        for j in range(0, len(right), RIGHT_ROWS):
            later = np.searchsorted(mine, theirs[j])
            left_over = later + np.flatnonzero(~found[later:])
            for i in range(0, len(left_over), LEFT_ROWS):
                at = left_over[i : i + LEFT_ROWS]
                rows, cols = np.nonzero(unit[at] @ against[:, j : j + RIGHT_ROWS] > threshold)
                rows, cols = at[rows], cols + j
                found[rows[(theirs[cols] < mine[rows]) & (other[cols] != own[rows])]] = True
        return pd.DataFrame({"_row": own[found]})

    return run


def _near(left: DataFrame, right: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(_row) of left rows with a similar earlier row on the right; neither pairs nor large groups are made.

    Rows of a question meet where they share a leading dimension, in blocks of about ``block_rows``.
    """
    bucket = ["query_id", "dim"]
    columns = ("query_id", "position", "doc_id", "_row", "embedding")
    # columns by fresh names, as both sides may be the same rows
    sides = [df.select(*(F.col(c).alias(c) for c in columns), F.explode("dims").alias("dim")) for df in (left, right)]
    blocks = [
        side.groupBy(*bucket).agg(F.ceil(F.count("*") / block_rows).alias(name)) for side, name in zip(sides, ("_nl", "_nr"))
    ]
    counts = cut_lineage(blocks[0].join(blocks[1], bucket))
    own = lambda n: F.pmod(F.xxhash64("_row"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    keys = [*bucket, "_bl", "_br"]
    mine = sides[0].join(counts, bucket).withColumn("_bl", own("_nl")).withColumn("_br", all_of("_nr"))
    theirs = sides[1].join(counts, bucket).withColumn("_br", own("_nr")).withColumn("_bl", all_of("_nl"))
    pick = [*keys, "position", "doc_id", "_row", "embedding"]
    found = mine.select(*pick).groupBy(*keys).cogroup(theirs.select(*pick).groupBy(*keys)).applyInPandas(
        _has_near(threshold), "_row long"
    )
    return found.distinct()


def greedy_dedup(
    rows: DataFrame, threshold: float = DEFAULTS.news_dedup, head_rows: int = HEAD_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """In fetch order, drop a row that is too similar to any kept earlier row.

    Needs (query_id, position, doc_id, embedding); returns (query_id, position,
    doc_id) of the kept rows. Exact, and safe for a question with any number of
    rows: copies of one vector are reduced to the first by an aggregate; a question with up to
    ``head_rows`` different rows is settled in one bounded task. A larger one goes by rounds: a row
    without an earlier similar row among those left is kept, and rows similar to one of these drop.
    So the number of rounds follows the longest chain of rows that wait for one another, not the number
    of rows. No similar pair is ever written out.
    """
    schema = St.StructType([rows.schema[c] for c in ("query_id", "position", "doc_id", "embedding")])
    names = ("query_id", "position", "doc_id")
    rows = rows.select(*schema.names)
    first = F.min(F.struct("position", "doc_id")).alias("first")
    zero = F.forall("embedding", lambda x: x == 0)
    # a zero vector is similar to nothing, not even to its copy
    copy_key = F.when(zero, F.col("doc_id").cast("string")).otherwise("")
    remaining = cut_lineage(
        rows.withColumn("_copy", copy_key)
        .groupBy("query_id", "embedding", "_copy")
        .agg(first)
        .select("query_id", "first.position", "first.doc_id", "embedding")
    )
    sizes = remaining.groupBy("query_id").agg(F.count("*").alias("_n"))
    large = cut_lineage(sizes.where(F.col("_n") > head_rows).select("query_id"))
    few = remaining.join(large, "query_id", "left_anti")
    out = few.groupBy("query_id").applyInPandas(_greedy(threshold, schema), schema).select(*names)
    if large.isEmpty():
        return out
    for kept in _rounds(remaining.join(large, "query_id", "left_semi"), threshold, slice_rows):
        out = out.unionByName(kept.select(*names))
    return out


def _rounds(rows: DataFrame, threshold: float, block_rows: int) -> Iterator[DataFrame]:
    """What each round keeps."""
    numbered = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    waiting = cut_lineage(numbered.withColumn("dims", _leading_dims(threshold, _rarest_first(numbered))("embedding")))
    while not waiting.isEmpty():
        held = cut_lineage(_near(waiting, waiting, threshold, block_rows))
        kept = cut_lineage(waiting.join(held, "_row", "left_anti"))
        yield kept
        rest = cut_lineage(waiting.join(held, "_row", "left_semi"))
        gone = cut_lineage(_near(rest, kept, threshold, block_rows))
        waiting = cut_lineage(rest.join(gone, "_row", "left_anti"))


def recent(
    rows: DataFrame, now: Column, strict_days: int = DEFAULTS.news_max_age_days,
    relaxed_days: int = DEFAULTS.news_relaxed_days, enough: int = 2,
) -> DataFrame:
    """Rows of the strict period, or of the relaxed one where too few are left.

    Unreadable times drop. ``published`` is text or a timestamp.
    """
    at = F.try_to_timestamp(F.col("published").cast("string"))
    timed = rows.withColumn("_at", at).filter(F.col("_at").isNotNull())
    since = lambda days: now - F.make_dt_interval(days=F.lit(days))
    marked = timed.withColumn("_strict", F.col("_at") >= since(strict_days))
    counts = marked.groupBy("query_id").agg(F.count_if("_strict").alias("_n"))
    return (
        marked.join(counts, "query_id")
        .filter(
            F.when(F.col("_n") >= enough, F.col("_strict")).otherwise(
                F.col("_at") >= since(relaxed_days)
            )
        )
        .drop("_at", "_strict", "_n")
    )


def run_funnel(
    articles: DataFrame, queries: DataFrame, now: Column, settings: Settings = DEFAULTS, embedder=None
) -> tuple[DataFrame, DataFrame]:
    """(surviving articles, rows left after each stage per question).

    ``queries``: (query_id, query_vector, centroid). The row-wise stages are flags
    of one pass, in which only readable texts and relevant titles are embedded;
    near-duplicates and recency follow on the few relevant rows.
    """
    vector = lambda c: udfs.vectors_of(c, embedder, settings.vector_dim)
    flagged = normalize(articles).join(queries, "query_id")
    text = F.col("combined")
    ok = language_ok(F.col("lang"), text)
    flagged = flagged.withColumn("_language", ok)
    flagged = flagged.withColumn("_length", F.col("_language") & long_enough(text))
    flagged = flagged.withColumn("_readable", F.col("_length") & readable(text))
    flagged = flagged.withColumn("embedding", vector(F.when(F.col("_readable"), text)))
    flagged = flagged.withColumn(
        "relevance_score",
        F.when(
            F.col("_readable"),
            relevance(F.col("embedding"), F.col("query_vector"), F.col("centroid")),
        ),
    )
    flagged = flagged.withColumn(
        "_relevant", F.coalesce(F.col("relevance_score") >= settings.news_relevance, F.lit(False))
    )
    # rows that fail keep their flags for the counts, not their texts
    flags = [c for c in flagged.columns if c.startswith("_")]
    flagged = cut_lineage(
        flagged.select(
            "query_id", "position", "doc_id", "title", *flags,
            *[
                F.when(F.col("_relevant"), F.col(c)).alias(c)
                for c in ("url", "published", "combined", "embedding", "relevance_score")
            ],
        )
    )
    early = flagged.groupBy("query_id").agg(
        F.count("*").alias("fetched"),
        F.count_if("_language").alias("after_language"),
        F.count_if("_length").alias("after_length"),
        F.count_if("_readable").alias("after_gibberish"),
        F.count_if("_relevant").alias("after_relevance"),
    )
    relevant = flagged.filter(F.col("_relevant") & (F.col("title") != ""))
    titles = relevant.select("query_id", "position", "doc_id", vector(F.col("title")).alias("embedding"))
    kept = greedy_dedup(titles, settings.news_dedup)
    deduped = relevant.join(kept, ["query_id", "position", "doc_id"], "left_semi")
    final = recent(deduped, now, settings.news_max_age_days, settings.news_relaxed_days)
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    stats = (
        early.join(count(kept, "after_dedup"), "query_id", "left")
        .join(count(final, "after_recency"), "query_id", "left")
        .na.fill(0)
    )
    dropped = [c for c in final.columns if c.startswith("_")]
    return final.drop(*dropped), stats


def dynamic_chunks(
    articles: DataFrame, inserted_at: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Flat chunks of the survivors; relevance comes by url (the last article wins)."""
    source = F.coalesce(
        F.nullif("url", F.lit("")), F.concat(F.lit("dynamic://article/"), F.col("position"))
    )
    sourced = articles.withColumn("source", source)
    scores = sourced.groupBy("query_id", "source").agg(
        F.max_by("relevance_score", F.struct("position", "doc_id")).alias("relevance_score")
    )
    docs = sourced.select("query_id", "position", "doc_id", "source", F.col("combined").alias("text")).filter(
        F.col("text") != ""
    )
    chunks = chunk_flat(docs, settings.article_chunk_size, 0, doc_type="dynamic")
    return (
        chunks.join(scores, ["query_id", "source"], "left")
        .withColumn("relevance_score", F.coalesce("relevance_score", F.lit(0.0)))
        .withColumn("inserted_at", inserted_at)
    )
