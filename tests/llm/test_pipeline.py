"""The pipeline's stages, each against a brute-force version over its own input."""

import corpus_pipeline
import test_exact_dedup
import test_packing
import test_simhash
from pyspark.sql import functions as F

from askloom.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), name.replace(" ", "-")))
    start, clean, exact, near, mixed, packed = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near dedup", "mixing", "packing"]
    assert all(t.columns == columns for t in tables[:-1])
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r[0] for r in rows(start)} - {r[0] for r in rows(clean)}
    assert len([i for i in gone if labels.get(i) == 0]) <= 2
    kept = {r[0] for r in test_exact_dedup.brute(rows(clean)) if r[3]}
    assert {r[0] for r in rows(exact)} == kept and exact.count() == len(kept)
    near_kept = {i for i, (_, c) in test_simhash.brute(rows(exact)).items() if c == i}
    assert {r[0] for r in rows(near)} == near_kept and near.count() == len(near_kept)
    assert mixed.count() and {r[0] for r in rows(mixed)} <= near_kept
    want = sorted(len(x) for x in test_packing.encoded([t for _, t in rows(mixed)]))
    pieces = packed.collect()
    assert sum(p.length for p in pieces) == sum(want)


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_leave_clashing_columns_alone(spark):
    """Columns named like those that the stages use inside, in any letter case, come out as they went in."""
    names = ("_key", "_Digest", "_text", "_row", "_SIZE", "_words", "_score", "size", "taken", "epochs", "digest", "keep_id", "fp", "text_key")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
