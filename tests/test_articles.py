import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from askloom.functions import udfs
from askloom.operators import articles as A

ROW = "query_id int, position int, doc_id int, embedding array<double>"


def loop(rows, threshold):
    kept = {}
    for q, p, d, v in sorted(rows, key=lambda r: r[:3]):
        v = np.asarray(v)
        n = np.linalg.norm(v)
        unit = v / n if n else v
        if not any(u @ unit > threshold for _, u in kept.setdefault(q, [])):
            kept[q].append((d, unit))
    return {(q, d) for q, rows in kept.items() for d, _ in rows}


def test_dedup_is_greedy_not_transitive(spark):
    a, b, c = [1.0, 0.0], [0.9, 0.436], [0.62, 0.785]
    rows = [(1, 1, 1, a), (1, 2, 2, b), (1, 3, 3, c)]
    df = spark.createDataFrame(rows, ROW)
    got = {r["doc_id"] for r in A.greedy_dedup(df, 0.85).collect()}
    assert got == {1, 3}


@pytest.mark.parametrize("head", [4, 16, 2048])
def test_dedup_against_loop_with_hot_group_and_copies(spark, head):
    rng = random.Random(7)
    base = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(12)]
    rows = []
    for i in range(150):
        q = 1 if i % 3 else rng.randint(2, 4)
        v = rng.choice(base) if rng.random() < 0.6 else [rng.uniform(-1, 1) for _ in range(4)]
        rows.append((q, i, i, [0.0] * 4 if i % 40 == 5 else v))
    df = spark.createDataFrame(rows, ROW)
    got = {(r["query_id"], r["doc_id"]) for r in A.greedy_dedup(df, 0.8, head_rows=head, slice_rows=40).collect()}
    assert got == loop(rows, 0.8)


def test_one_question_with_many_titles_takes_few_rounds(spark, monkeypatch):
    """Rounds follow the longest chain of rows that wait for one another, not the number of rows."""
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(300, 8, replace=False)) for _ in range(5000)]
    for i in rng.choice(5000, 900, replace=False):  # near copies of other titles, and copies of those
        rows[i] = [x if k else int(rng.integers(300)) for k, x in enumerate(rows[int(rng.integers(5000))])]
    for k in range(8):  # a chain: each is near the one before it, and to no other
        rows[100 + 2 * k] = list(range(2 * k, 2 * k + 8))
    vectors = np.zeros((5000, 300))
    for i, dims in enumerate(rows):
        vectors[i, dims] = rng.choice([1.0, -1.0], 8) if i % 2 else 1.0
    df = spark.createDataFrame([(1, i, i, v.tolist()) for i, v in enumerate(vectors)], ROW)
    parts, real = [], A._rounds
    monkeypatch.setattr(A, "_rounds", lambda *a: (parts.append(p) or p for p in real(*a)))
    got = {r["doc_id"] for r in A.greedy_dedup(df, 0.7, head_rows=100, slice_rows=500).collect()}
    unit, kept = vectors / np.sqrt((vectors**2).sum(1, keepdims=True)), []
    for i in range(5000):
        if not kept or not (unit[kept] @ unit[i] > 0.7).any():
            kept.append(i)
    assert got == set(kept) and len(kept) < 4900 and 2 <= len(parts) < 10


def test_merge(spark):
    schema = "query_id int, url string"
    primary = spark.createDataFrame([(1, "a"), (2, "x"), (2, "y"), (2, "z")], schema)
    secondary = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "n"), (3, "c")], schema)
    got = sorted((r[0], r[1]) for r in A.merge_sources(primary, secondary).collect())
    assert got == [(1, "a"), (1, "b"), (1, "b"), (2, "x"), (2, "y"), (2, "z"), (3, "c")]


def test_recency_falls_back_per_question(spark):
    rows = [
        (1, "2024-01-30T00:00:00Z"), (1, "2023-12-01T00:00:00Z"), (1, "bad"), (1, "2020-01-01"),
        (2, "2024-01-29"), (2, "2024-01-30T12:00:00+05:30"), (2, "2023-12-01"),
    ]
    df = spark.createDataFrame(rows, "query_id int, published string")
    kept = A.recent(df, F.lit("2024-01-31T00:00:00Z").cast("timestamp")).collect()
    assert sorted(r[1] for r in kept if r[0] == 1) == ["2023-12-01T00:00:00Z", "2024-01-30T00:00:00Z"]
    assert sorted(r[1] for r in kept if r[0] == 2) == ["2024-01-29", "2024-01-30T12:00:00+05:30"]


def test_quality_checks(value):
    text = "word " * 150
    assert value(A.long_enough(F.lit(text))) and not value(A.long_enough(F.lit("word " * 149)))
    assert value(A.readable(F.lit(text)))
    assert not value(A.readable(F.lit("1234 5678 ab")))
    assert not value(A.readable(F.lit("a" * 16)))


def test_relevance(value):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(A.relevance(v(1, 0), v(1, 0), v(0, 1))) == pytest.approx(0.6)
    assert value(A.relevance(v(0, 0), v(1, 0), v(0, 1))) == 0.0
    none = F.lit(None).cast("array<double>")
    assert value(A.relevance(v(1, 0), v(1, 0), none)) == pytest.approx(1.0)


def test_funnel_drops_repeated_titles_and_keeps_articles_without_vectors(spark):
    body = " ".join(["plain words of an article that is long enough to be read"] * 20)
    rows = [
        (1, 0, 10, "Same title here", body, "u0", "en", "2024-01-30"), (1, 1, 11, "same TITLE here", body + " more", "u1", "en", "2024-01-30"),
        (1, 2, 12, "Another subject", body, "u2", "en", "2024-01-29"), (1, 3, 13, "", body, "u3", "en", "2024-01-29"),
        (1, 4, 14, "Fremd", body, "u4", "de", "2024-01-29"), (1, 5, 15, "Too short", "few words", "u5", "en", "2024-01-29"),
    ]
    articles = spark.createDataFrame(rows, "query_id int, position int, doc_id int, title string, content string, url string, lang string, publishedAt string")
    vector = udfs.hashed_vectors(pd.Series([body]), 64)[0].tolist()
    queries = spark.createDataFrame([(1, vector, vector)], "query_id int, query_vector array<double>, centroid array<double>")
    kept, stats = A.run_funnel(articles, queries, F.lit("2024-01-31T00:00:00Z").cast("timestamp"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [10, 12]
    row = stats.first()
    assert (row["fetched"], row["after_language"], row["after_length"], row["after_relevance"], row["after_dedup"], row["after_recency"]) == (6, 5, 4, 4, 2, 2)
