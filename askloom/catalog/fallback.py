"""The fallback of questions that the local corpus answers badly, from funnel to trimmed context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askloom.catalog import sqltext as S
from askloom.catalog.articles import FUNNEL, NOW, articles, cosine_sql, greedy_cte, recent_sql
from askloom.catalog.corpus import as_long
from askloom.catalog.registry import cte, query
from askloom.catalog.retrieval import run
from askloom.plans import views as V
from askloom.plans.fallback import answer_context
from askloom.settings import DEFAULTS

# A question is asked of the news of one source: sources are numbered by name, questions go round them.
cte("source_numbers", "SELECT source, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM documents)")
cte("weak", "SELECT query_id FROM gate WHERE low_confidence", "gate")
cte(
    "weak_row_slots",
    f"SELECT query_id, rank, {S.hash_slot('w')} AS slot, sum({S.hash_sign('w')}) AS v FROM (SELECT query_id, rank, "
    f"unnest({S.alnum_tokens('text')}) AS w FROM context WHERE query_id IN (SELECT query_id FROM weak)) GROUP BY ALL",
    "context", "weak",
)
cte(
    "weak_vectors",
    f"""SELECT query_id, list(coalesce(q.v, 0)::DOUBLE ORDER BY slot) AS query_vector,
  CASE WHEN query_id IN (SELECT query_id FROM context) THEN list(coalesce(c.x, 0)::DOUBLE ORDER BY slot)
       ELSE list(coalesce(q.v, 0)::DOUBLE ORDER BY slot) END AS centroid
FROM (SELECT query_id, d::INTEGER AS slot FROM weak, range({DEFAULTS.vector_dim}) r(d))
LEFT JOIN qs_slots q USING (query_id, slot)
LEFT JOIN (SELECT query_id, slot, sum(v / n) AS x FROM weak_row_slots JOIN (SELECT query_id, rank, nullif(sqrt(sum(v * v)), 0) AS n
  FROM weak_row_slots GROUP BY query_id, rank) USING (query_id, rank) GROUP BY query_id, slot) c USING (query_id, slot)
GROUP BY query_id""",
    "weak", "qs_slots", "weak_row_slots", "context",
)
cte(
    "weak_relevant",
    f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rn FROM (
  SELECT w.query_id, f.* EXCLUDE (query_id), round(0.6::DOUBLE * {cosine_sql('embedding', 'query_vector')}
    + 0.4::DOUBLE * {cosine_sql('embedding', 'centroid')}, 6) AS relevance_score
  FROM weak_vectors w JOIN source_numbers s ON s.k = w.query_id % (SELECT count(*) FROM source_numbers)
  JOIN funnel_flags f ON f.query_id = s.source WHERE is_readable)
WHERE relevance_score >= {FUNNEL.news_relevance} AND title <> ''""",
    "weak_vectors", "source_numbers", "funnel_flags",
)
greedy_cte("weak_kept", "weak_relevant", FUNNEL.news_dedup)
cte("weak_deduped", "SELECT r.* FROM weak_relevant r JOIN weak_kept USING (query_id, doc_id)", "weak_relevant", "weak_kept")
cte("weak_final", recent_sql("weak_deduped"), "weak_deduped")
cte(
    "weak_chunks",
    "SELECT query_id, source, chunk_index, array_to_string(win, '') AS text, relevance_score, row_number() OVER "
    "(PARTITION BY query_id ORDER BY position, doc_id, chunk_index) AS rank FROM ("
    + S.windows(
        f"(SELECT query_id, position, doc_id, url AS source, {S.tokens('combined')} AS toks FROM weak_final)",
        "query_id, position, doc_id, source", "toks", DEFAULTS.article_chunk_size, 0, "chunk_index",
    )
    + ") JOIN (SELECT query_id, url AS source, arg_max(relevance_score, position) AS relevance_score "
    "FROM weak_final GROUP BY ALL) USING (query_id, source)",
    "weak_final",
)
cte(
    "answer_rows",
    f"""SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY is_dynamic, rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens
FROM (SELECT *, len({S.tokens('text')}) AS tokens FROM (
  SELECT query_id, chunk_id, doc_type, similarity, rank, text, false AS is_dynamic FROM context
  UNION ALL BY NAME
  SELECT query_id, source || '_' || chunk_index AS chunk_id, 'dynamic' AS doc_type, relevance_score AS similarity, rank, text,
    true AS is_dynamic FROM weak_chunks))""",
    "context", "weak_chunks",
)


@query(
    "fallback_context",
    "SELECT query_id, is_dynamic, rank, chunk_id, doc_type, similarity, tokens, running_tokens FROM answer_rows "
    f"WHERE running_tokens <= {DEFAULTS.max_context_tokens}",
    ("answer_rows",),
)
def fallback_context(spark, sf):
    numbers = V.table(spark, sf, "documents").select("source").distinct().withColumn(
        "k", (F.row_number().over(Window.orderBy("source")) - 1).cast("long")
    )
    asked = V.questions(spark, sf).join(F.broadcast(numbers.agg(F.count("*").alias("n"))))  # one row
    pairs = asked.select("query_id", (F.col("query_id") % F.col("n")).alias("k")).join(numbers, "k").select("query_id", "source")
    fetched = articles(spark, sf).withColumnRenamed("query_id", "source").join(pairs, "source").drop("source")
    found = answer_context(run(spark, sf), fetched, F.lit(NOW + "Z").cast("timestamp"), FUNNEL)
    out = found.context.select("query_id", "is_dynamic", "rank", "chunk_id", "doc_type", "similarity", "tokens", "running_tokens")
    return as_long(out, "rank")
