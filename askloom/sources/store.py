"""The chunk and parent tables: replace by source, retention, re-keying, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.session import cut_lineage, drop_path

#: Bytes that a bucket should hold, and how far it may grow before the table is dealt out anew.
BUCKET_BYTES = 128 << 20
GROWTH = 4


def replace_by_source(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of all sources in the batch are replaced by the batch."""
    sources = batch.select("source").filter(F.coalesce("source", F.lit("")) != "").distinct()
    return existing.join(sources, "source", "left_anti").unionByName(batch)


def newly_added(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch keys that are not in the table once the batch's sources are removed."""
    sources = batch.select("source").distinct()
    remaining = existing.join(sources, "source", "left_anti").select(key)
    return batch.select(key).distinct().join(remaining, key, "left_anti")


def with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Partition column of the stored tables: a hash bucket of the source.

    The rebalance hint gathers each bucket into few files and splits a bucket
    that a very large source makes too big for one task.
    """
    bucketed = df.withColumn("source_bucket", F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int"))
    return bucketed.hint("rebalance", "source_bucket")


def stored_bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def bucket_count(spark: SparkSession, path: str) -> int:
    """The table's own number of buckets, kept beside it."""
    return spark.read.schema("buckets int").json(f"{path}-properties").first()["buckets"]


def write_table(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Full rebuild. Without ``buckets`` their number follows from the bytes to store."""
    spark = df.sparkSession
    if buckets is None:
        df = cut_lineage(df)
        folder = next(iter(df.inputFiles()), path).rsplit("/", 1)[0]
        buckets = max(1, -(-stored_bytes(spark, folder) // BUCKET_BYTES)) if df.inputFiles() else 1
    with_bucket(df, buckets).write.mode("overwrite").partitionBy("source_bucket").parquet(path)
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").json(f"{path}-properties")


def rewrite_buckets(spark: SparkSession, rows: DataFrame, touched: list[int], path: str) -> None:
    """Put ``rows`` in the place of the touched buckets; one that has no rows left goes."""
    left = {r[0] for r in rows.select("source_bucket").distinct().collect()}
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_bucket")
        .parquet(path)
    )
    for bucket in set(touched) - left:
        drop_path(spark, f"{path}/source_bucket={bucket}")


def upsert_table(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Replace the batch's sources on disk; only their buckets are read and rewritten.

    Buckets keep their size as the table grows: once they hold ``GROWTH`` times what they should, the
    table is dealt out over more. The merged rows go to the checkpoint folder first, since a job
    cannot overwrite files it still reads. Running the same batch again gives the same table.
    """
    buckets = bucket_count(spark, path)
    if stored_bytes(spark, path) > GROWTH * BUCKET_BYTES * buckets:
        write_table(cut_lineage(replace_by_source(spark.read.parquet(path).drop("source_bucket"), batch)), path)
        return
    incoming = with_bucket(batch, buckets)
    # at most as many numbers as the table has buckets
    touched = [r[0] for r in incoming.select("source_bucket").distinct().collect()]
    existing = spark.read.parquet(path).filter(F.col("source_bucket").isin(touched))
    rewrite_buckets(spark, cut_lineage(replace_by_source(existing, incoming)), touched, path)


def purge_table(spark: SparkSession, path: str, now: Column, hours: int = 24) -> int:
    """Drop expired dynamic rows from a stored table; only buckets that hold such rows are rewritten."""
    stored = spark.read.parquet(path)
    touched = [
        r[0] for r in stored.filter(expired(now, hours)).select("source_bucket").distinct().collect()
    ]
    if touched:
        kept = purge_expired(stored.filter(F.col("source_bucket").isin(touched)), now, hours)
        rewrite_buckets(spark, cut_lineage(kept), touched, path)
    return len(touched)


def expired(now: Column, hours: int) -> Column:
    """Dynamic rows inserted more than ``hours`` ago; unreadable times never expire."""
    inserted = F.try_to_timestamp("inserted_at")
    old = (F.col("doc_type") == "dynamic") & (inserted < now - F.make_dt_interval(hours=F.lit(hours)))
    return F.coalesce(old, F.lit(False))


def purge_expired(rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Drop dynamic rows inserted more than ``hours`` ago; unreadable times are kept."""
    return rows.filter(~expired(now, hours))


def rekey(rows: DataFrame, key: str, target: str = "record_id") -> DataFrame:
    """A fresh short id of fixed length, the same on every run."""
    return rows.withColumn(target, F.md5(F.col(key)))


def write_results(summary: DataFrame, per_query: DataFrame, path: str, generated_at: Column) -> None:
    """Evaluation results: one stamped summary row and the per-question rows, as JSON."""
    summary.withColumn("generated_at", generated_at).coalesce(1).write.mode("overwrite").json(
        f"{path}/summary"
    )
    per_query.write.mode("overwrite").json(f"{path}/per_query")
