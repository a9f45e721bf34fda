"""Low confidence, articles, dynamic chunks, merged and trimmed context."""

import pytest
from pyspark.sql import functions as F

from askloom.plans import fallback, retrieve
from askloom.settings import Settings

SMALL = Settings(parent_size=60, parent_overlap=5, child_size=20, child_overlap=2, article_chunk_size=100, max_context_tokens=260)


def now():
    return F.lit("2024-02-20T00:00:00Z").cast("timestamp")


@pytest.fixture(scope="module")
def answered(spark, tmp_path_factory):
    docs = spark.createDataFrame(
        [("a", "alpha beta gamma delta " * 12, "t"), ("b", "river stone water bridge " * 10, "t")], "source string, text string, topic string"
    )
    docs = docs.withColumns({"source_rel": F.col("source"), "subtopic": F.lit("")})
    corpus = retrieve.ingest(docs, SMALL, path=str(tmp_path_factory.mktemp("fallback") / "corpus"))
    questions = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "zebra market prices"), (3, "unseen words")], "query_id long, query string")
    return retrieve.retrieve(corpus, questions, 3, SMALL)


def article(question, n, title, words, published="2024-02-18T00:00:00Z"):
    text = " ".join(f"{words} " for _ in range(80))
    return (question, n, n, title, None, text, f"http://news/{n}", "en", published)


SCHEMA = "query_id long, position int, doc_id int, title string, description string, content string, url string, lang string, publishedAt string"


def test_only_weak_questions_get_articles_behind_their_local_rows(spark, answered):
    weak = {r["query_id"] for r in answered.confidence.where("low_confidence").collect()}
    assert 1 not in weak and {2, 3} <= weak
    rows = [
        article(2, 1, "zebra prices", "zebra market prices"), article(2, 2, "zebra prices", "zebra market prices rise"),
        article(2, 3, "prices of the zebra market fall", "zebra market prices and the market"), article(1, 4, "alpha", "alpha beta gamma delta"),
        article(2, 5, "old zebra", "zebra market prices", "2015-01-01T00:00:00Z"), article(2, 6, "other", "nothing of the kind here"),
    ]
    found = fallback.answer_context(answered, spark.createDataFrame(rows, SCHEMA), now(), SMALL)
    context = [r.asDict() for r in found.context.collect()]
    dynamic = [r for r in context if r["is_dynamic"]]
    assert {r["query_id"] for r in dynamic} == {2} and {r["doc_type"] for r in dynamic} == {"dynamic"}
    assert {r["source"] for r in dynamic} <= {"http://news/1", "http://news/3"}
    for q in (1, 2, 3):
        mine = sorted((r for r in context if r["query_id"] == q), key=lambda r: r["running_tokens"])
        assert [r["is_dynamic"] for r in mine] == sorted(r["is_dynamic"] for r in mine)
        assert sum(r["tokens"] for r in mine) <= SMALL.max_context_tokens
        assert [r["rank"] for r in mine if r["is_dynamic"]] == list(range(1, 1 + sum(r["is_dynamic"] for r in mine)))
    stats = {r["query_id"]: r.asDict() for r in found.stats.collect()}
    assert set(stats) == {2} and stats[2]["fetched"] == 5 and stats[2]["after_recency"] == 2
    local = answered.context.where("query_id = 1").count()
    assert sum(r["query_id"] == 1 for r in context) == local


def test_without_articles_the_local_rows_remain(spark, answered):
    found = fallback.answer_context(answered, spark.createDataFrame([], SCHEMA), now(), SMALL)
    assert found.context.where("is_dynamic").count() == 0 and found.chunks.count() == 0
    assert found.context.count() == answered.context.count()


def test_a_question_without_local_rows_is_its_own_centroid(spark, answered):
    vectors = {r["query_id"]: r for r in fallback.question_vectors(answered, SMALL).collect()}
    rows = {r["query_id"] for r in answered.context.select("query_id").distinct().collect()}
    for q, r in vectors.items():
        assert (list(r["centroid"]) == list(r["query_vector"])) == (q not in rows)
