import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from askloom.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, digest int, salt int, group_size string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force_with_nulls_ties_and_long_texts(spark):
    long = "wörter " * 60_000
    rows = [(1, "a"), (2, "a"), (3, "a "), (4, None), (5, ""), (6, long), (7, long), (8, long + "."), (None, "a"), (None, "z"), (9, "A")]
    rows += [(100 + i, "copy") for i in range(500)] + [(2, "a")]
    got = exact_dedup.classes(table(spark, rows).repartition(7))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_deduplicate_keeps_one_row_of_each_text_and_all_columns(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "n"), (None, "n"), (7, "b")]
    docs = table(spark, rows)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, "a"), (4, ""), (None, "n"), (7, "b")], key=str)


def test_a_weak_digest_cannot_merge_different_texts(spark):
    """Every stage compares texts: texts that share a digest are told apart, and refused."""
    weak = lambda text: F.substring(exact_dedup.sha256(text), 1, 0)
    same = exact_dedup.winners(table(spark, [(1, "a"), (2, "a")]), digest=weak).collect()
    assert [(r.keep_id, r.group_size) for r in same] == [(2, 2)]
    try:
        exact_dedup.winners(table(spark, [(1, "a"), (2, "b")]), digest=weak).collect()
    except Exception as error:
        assert "share a digest" in str(error)
    else:
        raise AssertionError("two texts were merged")


def test_empty_table(spark):
    assert exact_dedup.classes(table(spark, [])).count() == 0
    assert exact_dedup.deduplicate(table(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (exact_dedup.classes(docs), exact_dedup.deduplicate(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
