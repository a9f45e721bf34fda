import json

import pytest
from pyspark.sql import functions as F

from askloom.plans import evaluate as E
from askloom.plans import retrieve as R
from askloom.sources import benchmark, files, store


def test_text_folder(spark, tmp_path):
    for name, data in {
        "top.md": b"hello", "A b/one.TXT": b" caf\xc3\xa9 \xff ", "A b/B+/two.txt": b"x", "A b/blank.txt": b" \n ",
        "A b/skip.csv": b"no", "y.tXt": b"mixed", "z.mD": b"case",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {
        r["source_rel"]: (r["source_name"], r["source_stem"], r["source_ext"], r["topic"], r["subtopic"], r["text"], r["source"])
        for r in files.load_text_folder(spark, str(tmp_path)).collect()
    }
    root = str(tmp_path)
    assert got == {
        "top.md": ("top.md", "top", ".md", "General", "", "hello", f"{root}/top.md"),
        "y.tXt": ("y.tXt", "y", ".txt", "General", "", "mixed", f"{root}/y.tXt"),
        "z.mD": ("z.mD", "z", ".md", "General", "", "case", f"{root}/z.mD"),
        "A b/one.TXT": ("one.TXT", "one", ".txt", "A b", "", "café", f"{root}/A b/one.TXT"),
        "A b/B+/two.txt": ("two.txt", "two", ".txt", "A b", "B+", "x", f"{root}/A b/B+/two.txt"),
    }


def test_upsert_is_idempotent_and_touches_only_its_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "source string, chunk_id string, text string"
    store.write_table(spark.createDataFrame([("a", "a_0", "1"), ("a", "a_1", "2"), ("b", "b_0", "3")], schema), path, 4)
    batch = spark.createDataFrame([("a", "a_0", "new"), ("c", "c_0", "4")], schema)
    for _ in range(2):
        store.upsert_table(spark, batch, path)
        rows = sorted((r["source"], r["chunk_id"], r["text"]) for r in spark.read.parquet(path).collect())
        assert rows == [("a", "a_0", "new"), ("b", "b_0", "3"), ("c", "c_0", "4")]


def test_purge_keeps_unreadable_times(spark):
    rows = spark.createDataFrame(
        [("dynamic", "2024-01-01T00:00:00Z"), ("dynamic", "2024-01-02T11:00:00Z"), ("dynamic", "?"), ("dynamic", None), ("local", "2020-01-01")],
        "doc_type string, inserted_at string",
    )
    kept = store.purge_expired(rows, F.lit("2024-01-02T12:00:00Z").cast("timestamp"))
    assert kept.count() == 4


def test_bucket_counts_follow_the_data(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "source string, chunk_id string, text string"
    store.write_table(spark.createDataFrame([("a", "a_0", "1")], schema), path)
    assert store.bucket_count(spark, path) == 1
    monkeypatch.setattr(store, "BUCKET_BYTES", 300)
    monkeypatch.setattr(store, "GROWTH", 1)
    batch = spark.createDataFrame([(f"s{i}", f"s{i}_0", "t" * 50) for i in range(200)], schema)
    store.upsert_table(spark, batch, path)
    assert store.bucket_count(spark, path) > 4
    assert spark.read.parquet(path).count() == 201


def test_purge_rewrites_only_buckets_with_expired_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"s{i}", f"c{i}", "dynamic" if i < 3 else "local", "2024-01-01T00:00:00Z") for i in range(40)]
    rows += [("s1", "young", "dynamic", "2024-01-09T23:00:00Z"), ("odd", "x", "dynamic", "?")]
    store.write_table(spark.createDataFrame(rows, "source string, chunk_id string, doc_type string, inserted_at string"), path, 16)
    now = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    assert 1 <= store.purge_table(spark, path, now) <= 3
    left = {r["chunk_id"] for r in spark.read.parquet(path).collect()}
    assert left == {f"c{i}" for i in range(3, 40)} | {"young", "x"}
    assert store.purge_table(spark, path, now) == 0


ITEMS = {
    "benchmark_name": "b",
    "items": [
        {"query": "q one", "document_id": "Dir\\\\A.pdf", "reference_output": {"brand_diagnosis": "x  y", "confidence_score": 0.5}},
        {"query": "q two", "document_ids": ["B", " b", ""], "reference_answer": "plain  text"},
        {"query": "q three", "relevant_document_ids": ["c"], "gold_answer": '{"risks": ["r1", "r2"]}'},
        {"query": " ", "document_id": "d", "gold_answer": "x"}, {"query": "q", "gold_answer": "x"}, {"query": "q", "document_id": "d"},
    ],
}


def test_benchmark_file(spark, tmp_path):
    path = tmp_path / "bench.json"
    path.write_text(json.dumps(ITEMS))
    rows = benchmark.load_benchmark(spark, str(path)).orderBy("query_id").collect()
    assert [r["query"] for r in rows] == ["q one", "q two", "q three"]
    assert [r["document_ids"] for r in rows] == [["dir//a.pdf"], ["b"], ["c"]]
    assert [r["reference_text"] for r in rows] == ["brand_diagnosis: x y\nconfidence_score: 0.5", "plain text", "risks: r1 | r2"]
    assert [r["reference_format"] for r in rows] == ["structured", "plain_text", "structured"]
    path.write_text(json.dumps({"items": [{"query": ""}]}))
    with pytest.raises(ValueError):
        benchmark.load_benchmark(spark, str(path))


def test_evaluation_writes_results(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, f"dir/f{i}.txt", "s", "t", "", f"alpha{i} beta{i} gamma{i} common words") for i in range(6)],
        "doc_id int, source string, source_rel string, topic string, subtopic string, text string",
    )
    bench = spark.createDataFrame(
        [(1, "alpha3 beta3 gamma3", ["f3.txt"], "gamma3 common", "plain_text")],
        "query_id int, query string, document_ids array<string>, reference_text string, reference_format string",
    )
    answers = spark.createDataFrame([(1, "gamma3 common")], "query_id int, candidate string")
    summary, per_query = E.evaluate(R.ingest(docs), bench, answers)
    row = summary.first()
    assert (row["hit_at_k"], row["mrr_at_k"], row["token_f1"], row["rouge_l_f1"], row["exact_match"]) == (1, 1, 1, 1, 1)
    store.write_results(summary, per_query, str(tmp_path / "out"), F.lit("2024-01-01T00:00:00+05:30"))
    assert spark.read.json(str(tmp_path / "out/summary")).first()["generated_at"].startswith("2024")
    assert spark.read.json(str(tmp_path / "out/per_query")).count() == 1
