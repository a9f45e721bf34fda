"""Benchmark files: questions with relevant documents and a reference answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions.records import output_text, parse_record
from askloom.operators.metrics import normalize_doc_id

# ids and references may be arrays, objects or text, so items are read as raw JSON first
FILE_TYPE = "benchmark_name string, items array<string>"
FIELDS = "map<string, string>"


def _ids(fields: Column) -> Column:
    """Ids from ``document_ids``, else ``relevant_document_ids``, else ``document_id``."""
    lists = [
        F.when(F.size(c) > 0, c)
        for c in (
            F.from_json(fields["document_ids"], "array<string>"),
            F.from_json(fields["relevant_document_ids"], "array<string>"),
        )
    ]
    single = F.array(F.coalesce(fields["document_id"], F.lit("")))
    cleaned = F.transform(
        F.coalesce(*lists, single), lambda x: normalize_doc_id(F.coalesce(x, F.lit("")))
    )
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, document_ids, reference_text, reference_format) of the valid items.

    An item needs a question, at least one document id and a reference. A file
    without a valid item is an error.
    """
    raw = spark.read.schema(FILE_TYPE).option("multiLine", True).json(path)
    items = T.each(raw, ["benchmark_name"], F.col("items"), "item", "query_id").withColumn(
        "f", F.from_json("item", FIELDS)
    )
    fields = F.col("f")
    reference = F.coalesce(
        fields["reference_output"], fields["reference_answer"], fields["gold_answer"]
    )
    structured = T.strip(F.coalesce(reference, F.lit(""))).startswith("{") & F.try_parse_json(
        reference
    ).isNotNull()
    as_lines = output_text(parse_record(reference), F.from_json(reference, FIELDS))
    parsed = items.select(
        "query_id",
        "benchmark_name",
        T.strip(F.coalesce(fields["query"], F.lit(""))).alias("query"),
        _ids(fields).alias("document_ids"),
        F.when(structured & (as_lines != ""), as_lines)
        .otherwise(T.squeeze(reference))
        .alias("reference_text"),
        F.when(structured & (as_lines != ""), "structured").otherwise("plain_text").alias(
            "reference_format"
        ),
    )
    valid = parsed.filter(
        (F.col("query") != "") & (F.size("document_ids") > 0) & (F.col("reference_text") != "")
    )
    if valid.isEmpty():
        raise ValueError("the benchmark has no valid items")
    return valid


def judgements(benchmark: DataFrame) -> DataFrame:
    """(query_id, target) rows of the relevant documents."""
    return T.each(benchmark, ["query_id"], F.col("document_ids"), "target")
