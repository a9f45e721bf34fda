"""Article funnel queries. Every document is an article, fetched for the question of its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog import sqltext as S
from askloom.catalog.corpus import as_long
from askloom.catalog.registry import cte, query
from askloom.functions import rules, udfs
from askloom.functions import text as T
from askloom.functions.text import WS
from askloom.operators import articles as A
from askloom.operators import dense
from askloom.plans import views as V
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS

NOW = "2024-02-20 00:00:00"
FUNNEL = DEFAULTS


def dense_sql(name: str, text: str) -> None:
    """Vector of a text of every document, as ``functions.udfs.hashed_vectors`` makes it."""
    cte(
        f"{name}_slots",
        f"SELECT doc_id, {S.hash_slot('w')} AS slot, sum({S.hash_sign('w')}) AS v FROM "
        f"(SELECT doc_id, unnest({S.alnum_tokens(text)}) AS w FROM documents) GROUP BY ALL",
    )
    cte(
        f"{name}_vectors",
        f"""SELECT doc_id, list(coalesce(v / n, 0)::DOUBLE ORDER BY slot) AS vec FROM
  (SELECT doc_id, d::INTEGER AS slot FROM documents, range({DEFAULTS.vector_dim}) r(d)) LEFT JOIN {name}_slots USING (doc_id, slot)
  LEFT JOIN (SELECT doc_id, nullif(sqrt(sum(v * v)), 0) AS n FROM {name}_slots GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""",
        f"{name}_slots",
    )


TITLE = "split_part(text, chr(10), 1)"
dense_sql("body", S.strip(f"concat_ws(' ', {TITLE}, '', text)"))
dense_sql("title", TITLE)
cte(
    "articles",
    f"""SELECT d.source AS query_id, doc_id AS position, doc_id, {TITLE} AS title, '' AS description,
  text AS content, d.source || '/' || d.lang AS url, lang, strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS published,
  b.vec AS embedding, t.vec AS title_vector
FROM documents d JOIN body_vectors b USING (doc_id) JOIN title_vectors t USING (doc_id)
LEFT JOIN events e ON e.event_id = d.n_chars""",
    "body_vectors", "title_vectors",
)
cte(
    "fetch_queries",
    "SELECT query_id, arg_min(embedding, doc_id) AS query_vector FROM articles GROUP BY query_id",
    "articles",
)
cte(
    "source_means",
    "SELECT query_id, i, avg(x) AS m FROM (SELECT query_id, generate_subscripts(embedding, 1) AS i, "
    "unnest(embedding) AS x FROM articles) GROUP BY query_id, i",
    "articles",
)
cte(
    "label_centroids",
    "SELECT query_id, list(m / n ORDER BY i) AS centroid FROM source_means JOIN "
    "(SELECT query_id, sqrt(sum(m * m)) AS n FROM source_means GROUP BY query_id) USING (query_id) GROUP BY query_id",
    "source_means",
)


def cosine_sql(a: str, b: str) -> str:
    """A vector without words is similar to nothing."""
    cosine = f"list_cosine_similarity({a}, {b})"
    return f"CASE WHEN isfinite(coalesce({cosine}, 0)) THEN coalesce({cosine}, 0) ELSE 0 END"


COMBINED = S.strip("title || ' ' || description || ' ' || content")
cte(
    "funnel_flags",
    f"""SELECT *, is_language AND n_words >= 150 AS is_long, is_language AND n_words >= 150
  AND n_letters / greatest(length(combined), 1) >= 0.7 AND n_visible / greatest(n_words, 1) <= 15 AS is_readable
FROM (SELECT *, combined <> '' AND lang = 'en' AS is_language, len(regexp_extract_all(combined, '\\S+')) AS n_words,
    len(regexp_extract_all(combined, '\\p{{L}}')) AS n_letters, length(regexp_replace(combined, '{WS}+', '', 'g')) AS n_visible
  FROM (SELECT *, {COMBINED} AS combined FROM articles))""",
    "articles",
)
cte(
    "scored_articles",
    f"""SELECT f.*, round(0.6::DOUBLE * {cosine_sql('embedding', 'query_vector')}
  + 0.4::DOUBLE * {cosine_sql('embedding', 'centroid')}, 6) AS relevance_score
FROM funnel_flags f JOIN fetch_queries USING (query_id) JOIN label_centroids USING (query_id)""",
    "funnel_flags", "fetch_queries", "label_centroids",
)
cte(
    "relevant_articles",
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rn FROM scored_articles "
    f"WHERE is_readable AND relevance_score >= {FUNNEL.news_relevance} AND title <> ''",
    "scored_articles",
)


def greedy_sql(source: str, threshold: float) -> str:
    near = f"len(list_filter(g.vecs, lambda v: {cosine_sql('v', 'o.title_vector')} > {threshold})) > 0"
    return f"""SELECT query_id, 0::BIGINT AS rn, CAST([] AS DOUBLE[][]) AS vecs, CAST([] AS BIGINT[]) AS ids
FROM (SELECT DISTINCT query_id FROM {source})
UNION ALL
SELECT g.query_id, o.rn,
  CASE WHEN {near} THEN g.vecs ELSE list_append(g.vecs, o.title_vector) END,
  CASE WHEN {near} THEN g.ids ELSE list_append(g.ids, o.doc_id) END
FROM {{name}} g JOIN {source} o ON o.query_id = g.query_id AND o.rn = g.rn + 1"""


def greedy_cte(name: str, source: str, threshold: float) -> None:
    cte(f"{name}_steps", greedy_sql(source, threshold).format(name=f"{name}_steps"), source)
    cte(
        name,
        f"SELECT query_id, unnest(ids) AS doc_id FROM (SELECT query_id, arg_max(ids, rn) AS ids "
        f"FROM {name}_steps GROUP BY query_id)",
        f"{name}_steps",
    )


greedy_cte("deduped_ids", "relevant_articles", FUNNEL.news_dedup)
AT = "TRY_CAST(replace(replace(published, 'T', ' '), 'Z', '') AS TIMESTAMP)"


def recent_sql(source: str) -> str:
    return (
        f"SELECT * EXCLUDE (pub_at, n) FROM (SELECT *, {AT} AS pub_at, count(*) FILTER (WHERE {AT} >= TIMESTAMP '{NOW}' "
        f"- INTERVAL {FUNNEL.news_max_age_days} DAY) OVER (PARTITION BY query_id) AS n FROM {source}) "
        f"WHERE pub_at IS NOT NULL AND CASE WHEN n >= 2 THEN pub_at >= TIMESTAMP '{NOW}' - INTERVAL "
        f"{FUNNEL.news_max_age_days} DAY ELSE pub_at >= TIMESTAMP '{NOW}' - INTERVAL {FUNNEL.news_relaxed_days} DAY END"
    )


cte(
    "deduped_articles",
    "SELECT r.* FROM relevant_articles r JOIN deduped_ids USING (query_id, doc_id)",
    "relevant_articles", "deduped_ids",
)
cte("final_articles", recent_sql("deduped_articles"), "deduped_articles")


def articles(spark, sf):
    times = V.table(spark, sf, "events").select(
        F.col("event_id").alias("n_chars"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
    )
    documents = V.spread(V.table(spark, sf, "documents"), "doc_id")
    return documents.join(times, "n_chars", "left").select(
        F.col("source").alias("query_id"),
        F.col("doc_id").alias("position"),
        "doc_id",
        F.get(F.split("text", "\n", 2), F.lit(0)).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.col("text").alias("content"),
        F.concat_ws("/", "source", "lang").alias("url"),
        "lang",
        "publishedAt",
    )


def embedded(spark, sf):
    """Articles with the vector of their whole text."""
    return udfs.embed_column(A.normalize(articles(spark, sf)), "combined")


def fetch_queries(spark, sf):
    """The first article of a source stands in for its question."""
    vectors = cut_lineage(embedded(spark, sf).select("query_id", "doc_id", "embedding"))
    first = vectors.groupBy("query_id").agg(F.min_by("embedding", "doc_id").alias("query_vector"))
    return first.join(A.centroids(vectors, "query_id"), "query_id")


@query(
    "merge_sources",
    """
WITH rated AS (SELECT d.source AS query_id, d.doc_id, d.source || '/' || d.lang AS url,
    coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels USING (doc_id)),
p AS (SELECT query_id, doc_id, url FROM rated WHERE toxic = 1),
s AS (SELECT query_id, doc_id, url FROM rated WHERE toxic = 0 AND quality = 1)
SELECT * FROM p UNION ALL SELECT s.* FROM s LEFT JOIN (SELECT query_id, count(*) AS n FROM p GROUP BY query_id) USING (query_id)
WHERE coalesce(n, 0) < 3 AND NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = s.query_id AND p.url = s.url)
""",
)
def merge_sources(spark, sf):
    # documents without a label come from the second source
    rated = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("source").alias("query_id"), "doc_id", F.concat_ws("/", "source", "lang").alias("url"),
        F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )
    keep = ("query_id", "doc_id", "url")
    primary = rated.filter("toxic = 1").select(*keep)
    secondary = rated.filter("toxic = 0 and quality = 1").select(*keep)
    return A.merge_sources(primary, secondary)


@query(
    "vector_centroid",
    "SELECT i - 1 AS pos, round(m / n, 6) AS value FROM (SELECT i, avg(x) AS m FROM "
    "(SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) "
    "GROUP BY i), (SELECT sqrt(sum(m * m)) AS n FROM (SELECT avg(x) AS m FROM "
    "(SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY i))",
)
def vector_centroid(spark, sf):
    out = dense.vector_centroid(V.table(spark, sf, "embeddings"))
    return as_long(out.withColumn("value", F.round("value", 6)), "pos")


@query(
    "article_relevance",
    "SELECT query_id, doc_id, relevance_score FROM scored_articles",
    ("scored_articles",),
)
def article_relevance(spark, sf):
    joined = embedded(spark, sf).join(fetch_queries(spark, sf), "query_id")
    score = A.relevance(F.col("embedding"), F.col("query_vector"), F.col("centroid"))
    return joined.select("query_id", "doc_id", score.alias("relevance_score"))


cte(
    "all_articles_ranked",
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rn FROM articles",
    "articles",
)
greedy_cte("greedy_all", "all_articles_ranked", DEFAULTS.news_dedup)


@query("greedy_dedup", "SELECT query_id, doc_id FROM greedy_all", ("greedy_all",))
def greedy_dedup(spark, sf):
    titles = udfs.embed_column(articles(spark, sf), "title").select("query_id", "position", "doc_id", "embedding")
    return A.greedy_dedup(titles).select("query_id", "doc_id")


@query(
    "recency_fallback",
    f"SELECT query_id, doc_id, published FROM ({recent_sql('articles')})",
    ("articles",),
)
def recency_fallback(spark, sf):
    rows = A.normalize(articles(spark, sf))
    now = F.lit(NOW + "Z").cast("timestamp")
    kept = A.recent(rows, now, FUNNEL.news_max_age_days, FUNNEL.news_relaxed_days)
    return kept.select("query_id", "doc_id", "published")


def funnel(spark, sf):
    return A.run_funnel(
        articles(spark, sf), fetch_queries(spark, sf), F.lit(NOW + "Z").cast("timestamp"), FUNNEL
    )


@query(
    "article_funnel",
    f"""
SELECT query_id, fetched, after_language, after_length, after_gibberish, after_relevance,
  coalesce(after_dedup, 0) AS after_dedup, coalesce(after_recency, 0) AS after_recency
FROM (SELECT query_id, count(*) AS fetched, count(*) FILTER (WHERE is_language) AS after_language,
  count(*) FILTER (WHERE is_long) AS after_length, count(*) FILTER (WHERE is_readable) AS after_gibberish,
  count(*) FILTER (WHERE is_readable AND relevance_score >= {FUNNEL.news_relevance}) AS after_relevance
  FROM scored_articles GROUP BY query_id)
LEFT JOIN (SELECT query_id, count(*) AS after_dedup FROM deduped_ids GROUP BY query_id) USING (query_id)
LEFT JOIN (SELECT query_id, count(*) AS after_recency FROM final_articles GROUP BY query_id) USING (query_id)
""",
    ("scored_articles", "deduped_ids", "final_articles"),
)
def article_funnel(spark, sf):
    return funnel(spark, sf)[1]


@query(
    "dynamic_chunks",
    "SELECT query_id, doc_id, source, chunk_index, text, relevance_score FROM (SELECT query_id, doc_id, source, "
    "chunk_index, array_to_string(win, '') AS text FROM ("
    + S.windows(
        f"(SELECT query_id, doc_id, url AS source, {S.tokens('combined')} AS toks FROM final_articles)",
        "query_id, doc_id, source", "toks", DEFAULTS.article_chunk_size, 0, "chunk_index",
    )
    + ")) JOIN (SELECT query_id, url AS source, arg_max(relevance_score, position) AS relevance_score "
    "FROM final_articles GROUP BY ALL) USING (query_id, source)",
    ("final_articles",),
)
def dynamic_chunks(spark, sf):
    survivors = funnel(spark, sf)[0]
    out = A.dynamic_chunks(survivors, F.lit(NOW), FUNNEL)
    return as_long(
        out.select("query_id", "doc_id", "source", "chunk_index", "text", "relevance_score"),
        "chunk_index",
    )


HITS = ", ".join(
    f"{{'misses': -len(list_filter(w, lambda t: t IN ({S.quoted(words)}))), 'lang': '{lang}'}}"
    for lang, words in sorted(rules.LANGUAGE_WORDS.items())
)


@query(
    "detect_language",
    f"SELECT doc_id, CASE WHEN best.misses <= -3 THEN best.lang END AS detected FROM (SELECT doc_id, "
    f"list_min([{HITS}]) AS best FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents))",
)
def detect_language(spark, sf):
    return V.raw_docs(spark, sf).select(
        "doc_id", T.detect_language(F.col("text")).alias("detected")
    )
