"""BM25 for a whole batch of questions over a stored index of a chunk table.

The index keeps a term's postings in blocks: the chunks of a segment are dealt into blocks of some
``BLOCK_CHUNKS``, and a row of the index is a (term, block) with its postings as one array and, beside
it, the highest count and the shortest chunk among them. From these two follows the most that the term
can add to any score in the block, whatever the parameters and the corpus mean are by then. So a batch
first reads the slim columns alone and bounds every block for every question, scores each question's
most promising blocks, and then opens only blocks whose bound reaches what the question already has.

Rows lie in folders by a hash of their term, sorted by term: a join with the asked terms prunes the
folders while it runs. Scoring never reads a text. Partial sums per (question, chunk) are formed before
the one shuffle, and each question is cut to its best rows per task before the ranking.

An index may consist of segments, each written once; ``replaced`` says which chunks of earlier segments
no longer hold, and term counts and statistics are sums over segments, less what was replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS, Settings

SCORE_DIGITS = 6
#: Chunks of a block, on average, tokens of a task that makes blocks, and postings of a folder.
BLOCK_CHUNKS = 256
TASK_TOKENS = 4_000_000
PART_POSTINGS = 64_000_000
LEAST_PARTS = 8
#: Opened blocks of a task, on average: the sums of (question, chunk) that it holds are bounded by them.
TASK_BLOCKS = 32
#: Block numbers of a segment begin at the segment's number times this.
SEGMENT = 1 << 32


def local_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("doc_type") == "local") if "doc_type" in chunks.columns else chunks


def lexical_length(text: Column) -> Column:
    """Length of a chunk in search tokens, one at least; stored as ``doc_len``."""
    return F.greatest(F.size(T.search_tokens(text)), F.lit(1))


def tokenized(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens, doc_len) of the local chunks."""
    words = local_chunks(chunks).select(*keys, T.search_tokens(F.col("text")).alias("tokens"))
    return words.withColumn("doc_len", F.greatest(F.size("tokens"), F.lit(1)))


def corpus_stats(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: number of chunks and their length in all. A stored ``doc_len`` saves reading the texts."""
    lengths = (
        local_chunks(chunks) if "doc_len" in chunks.columns else tokenized(chunks, key)
    ).select("doc_len")
    return lengths.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_len")
    )


def question_terms(questions: DataFrame, key: str, text: str, max_terms: int = 20) -> DataFrame:
    return T.each(questions, [key], T.content_terms(F.col(text), max_terms), "term")


@dataclass(frozen=True)
class LexicalIndex:
    """Posting blocks, term counts and corpus statistics as tables."""

    #: (part, term, block, n, max_tf, min_len, entries)
    blocks: DataFrame
    #: (term, part, df) and one row (n_docs, avg_len)
    terms: DataFrame
    stats: DataFrame
    #: (chunk, below): postings of the chunk in segments below that number no longer hold.
    replaced: DataFrame | None = None
    key: str = "chunk_id"

    @property
    def postings(self) -> DataFrame:
        """(key, term, tf, doc_len) for every term of the corpus."""
        return live_entries(self, self.blocks.select("term", "block", "entries")).select(
            F.col("id").alias(self.key), "term", "tf", "doc_len"
        )


def live_entries(index: LexicalIndex, blocks: DataFrame) -> DataFrame:
    """Rows of posting blocks with one entry each, without what was replaced."""
    rows = blocks.select(*[c for c in blocks.columns if c != "entries"], F.inline("entries"))
    if index.replaced is None:
        return rows
    gone = index.replaced.select(F.col("chunk").alias("id"), "below")
    return rows.join(gone, (rows["id"] == gone["id"]) & (rows["block"] < gone["below"] * SEGMENT), "left_anti")


def posting_blocks(
    chunks: DataFrame, n_blocks: int, parts: int, segment: int = 0, key: str = "chunk_id", tasks: int = 1
) -> DataFrame:
    """(part, term, block, n, max_tf, min_len, entries) of a segment, from ``tasks`` tasks.

    The texts are dealt out by block, and that is the only shuffle: a block's tokens, counts and postings
    are made where its texts are.
    """
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)) + segment * SEGMENT
    texts = local_chunks(chunks).select(F.col(key).cast("string").alias("id"), "text", block.alias("block"))
    words = tokenized(texts.repartition(tasks, "block"), "block", "id")
    return words.groupBy("block").applyInArrow(_block_postings, POSTINGS_SCHEMA).withColumn("part", part_of(parts))


def _block_postings(chunks: pa.Table) -> pa.Table:
    """The postings of one block: a row per term with what its chunks count of it."""
    ids = chunks["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    words = chunks["tokens"].combine_chunks().flatten().dictionary_encode()
    rows, n_ids = ids.indices.to_numpy(), len(ids.dictionary)
    lengths = np.zeros(n_ids, np.int32)
    lengths[rows[::-1]] = chunks["doc_len"].to_numpy()[::-1]
    at = np.repeat(rows, pc.list_value_length(chunks["tokens"]).to_numpy())
    pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n_ids + at, return_counts=True)
    term, chunk = np.divmod(pairs, n_ids)
    tf, length = tf.astype(np.int32), lengths[chunk]
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts, len(term)).astype(np.int32)
    columns = {
        "term": words.dictionary.take(pa.array(term[starts])),
        "block": pa.array(np.full(len(starts), chunks["block"][0].as_py(), np.int64)),
        "n": pa.array(np.diff(ends)),
        "max_tf": pa.array(np.maximum.reduceat(tf, starts) if len(starts) else tf),
        "min_len": pa.array(np.minimum.reduceat(length, starts) if len(starts) else length),
        "entries": pa.ListArray.from_arrays(
            pa.array(ends), pa.StructArray.from_arrays([ids.dictionary.take(pa.array(chunk)), pa.array(tf), pa.array(length)], ["id", "tf", "doc_len"])
        ),
    }
    return pa.table(columns)


def part_of(parts: int) -> Column:
    """The folder of a term."""
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")


def write_counts(chunks: DataFrame, path: str, parts: int, key: str = "chunk_id") -> None:
    """Term counts and statistics alone: what the chunks of replaced sources no longer add."""
    corpus_stats(chunks, key).write.mode("overwrite").parquet(f"{path}/stats")
    terms = T.each(tokenized(chunks, key), [key], F.array_distinct("tokens"), "term").groupBy("term")
    terms.agg(F.count("*").alias("df")).withColumn("part", part_of(parts)).write.mode("overwrite").parquet(f"{path}/terms")


POSTINGS_SCHEMA = (
    "term string, block bigint, n int, max_tf int, min_len int, "
    "entries array<struct<id: string, tf: int, doc_len: int>>"
)
BLOCK_SCHEMA = f"{POSTINGS_SCHEMA}, part int"

TERM_SCHEMA = "term string, part int, df bigint"
STATS_SCHEMA = "n_docs bigint, total_len bigint"


def write_segment(chunks: DataFrame, path: str, segment: int = 0, parts: int | None = None, key: str = "chunk_id") -> int:
    """Write one segment of an index; returns the number of its folders.

    All segments of an index have the same folders, those of the first one.
    """
    spark = chunks.sparkSession
    corpus_stats(chunks, key).write.mode("overwrite").parquet(f"{path}/stats")
    size = spark.read.parquet(f"{path}/stats").first()
    n_blocks = max(1, -(-size["n_docs"] // BLOCK_CHUNKS))
    parts = parts or max(LEAST_PARTS, -(-size["total_len"] // PART_POSTINGS))
    tasks = max(1, -(-size["total_len"] // TASK_TOKENS))
    blocks = posting_blocks(chunks, n_blocks, parts, segment, key, tasks)
    # a task writes a file of each folder, so blocks are not moved to their folders
    (
        blocks.sortWithinPartitions("part", "term", "block")
        .write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    )
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    stored.groupBy("term", "part").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    return parts


def build_index(chunks: DataFrame, path: str, key: str = "chunk_id") -> LexicalIndex:
    """Write the index of a chunk table as a single segment and read it back."""
    write_segment(chunks, path, key=key)
    return load_index(chunks.sparkSession, [path], key=key)


def load_index(
    spark: SparkSession, segments: list[str], removed: list[str] = (), replaced: DataFrame | None = None, key: str = "chunk_id"
) -> LexicalIndex:
    """The index over segments at ``segments``; ``removed`` holds the counts of what later ones replaced."""
    read = lambda schema, name, paths: spark.read.schema(schema).parquet(*[f"{p}/{name}" for p in paths])
    parts = [spark.read.schema(BLOCK_SCHEMA).parquet(f"{p}/blocks") for p in segments]
    blocks = parts[0]
    for more in parts[1:]:
        blocks = blocks.unionByName(more)
    terms, stats = read(TERM_SCHEMA, "terms", segments), read(STATS_SCHEMA, "stats", segments)
    if removed:
        terms = terms.unionByName(read(TERM_SCHEMA, "terms", removed).withColumn("df", -F.col("df")))
        less = read(STATS_SCHEMA, "stats", removed)
        stats = stats.unionByName(less.select((-F.col("n_docs")).alias("n_docs"), (-F.col("total_len")).alias("total_len")))
    if len(segments) > 1 or removed:
        terms = terms.groupBy("term", "part").agg(F.sum("df").alias("df")).where("df > 0")
    total = stats.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")).select(
        "n_docs", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0).alias("avg_len")
    )
    return LexicalIndex(blocks, terms, total, replaced, key)


def asked_terms(index: LexicalIndex, terms: DataFrame, query_key: str) -> DataFrame:
    """Question terms with folder, weight and the corpus mean, written: small, whatever the corpus holds."""
    stats = index.stats.select(
        F.col("n_docs").cast("double").alias("n_docs"), F.greatest("avg_len", F.lit(1.0)).alias("avg_len")
    )
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = terms.select(query_key, "term").join(index.terms, "term").join(F.broadcast(stats))  # one row
    found = cut_lineage(known.select(query_key, "term", "part", idf.alias("idf"), "avg_len"))
    # true of every row; a filter on this side is what lets Spark prune folders by it
    return found.where(F.col("idf") > 0)


def impact(tf: Column, length: Column, settings: Settings) -> Column:
    """What a term adds to a score per idf. It grows with the count and falls with the length."""
    k1, b = settings.bm25_k1, settings.bm25_b
    tf = tf.cast("double")
    return tf * (k1 + 1.0) / (tf + k1 * ((1.0 - b) + b * (length / F.col("avg_len"))))


def block_bounds(index: LexicalIndex, asked: DataFrame, query_key: str, settings: Settings) -> DataFrame:
    """(query, block, bound): no chunk of the block scores more. Reads no posting."""
    heads = index.blocks.select("part", "term", "block", "max_tf", "min_len")
    most = F.col("idf") * impact(F.col("max_tf"), F.col("min_len"), settings)
    return heads.join(asked, ["part", "term"]).groupBy(query_key, "block").agg(F.sum(most).alias("bound"))


def block_scores(
    index: LexicalIndex, asked: DataFrame, query_key: str, settings: Settings, wanted: DataFrame | None = None, few: bool = False,
) -> DataFrame:
    """(query, chunk, score) of the wanted (query, block) pairs, of all blocks without them.

    Of the index, rows of asked terms in wanted blocks alone are moved, each at most once and to its block,
    whatever the number of questions; the sums of a block's chunks then stay there, in so many tasks that
    one holds the sums of some ``TASK_BLOCKS`` blocks. With ``few`` pairs the sums are moved instead, if
    Spark finds the pairs small enough to bring them to the index.
    """
    keys = [query_key, F.col("id").alias(index.key)]
    stored = index.blocks.select("part", "term", "block", "entries")
    if wanted is None:
        rows = live_entries(index, stored.join(asked, ["part", "term"]))
    else:
        asking = cut_lineage(wanted.groupBy("block").agg(F.collect_set(query_key).alias("_asking")))
        met = stored.join(asked.select("part", "term").distinct(), ["part", "term"], "left_semi")
        if not few:
            tasks = max(2, -(-asking.count() // TASK_BLOCKS))
            met, asking = met.repartition(tasks, "block"), asking.repartition(tasks, "block").hint("shuffle_hash")
        met = met.join(asking, "block")
        own = met.join(asked, ["part", "term"]).where(F.array_contains("_asking", F.col(query_key)))
        rows = live_entries(index, own.drop("_asking"))
        if index.replaced is None:  # a chunk lies in one block
            keys.append("block")
    score = F.sum(F.col("idf") * impact(F.col("tf"), F.col("doc_len"), settings))
    scored = rows.groupBy(*keys).agg(F.round(score, SCORE_DIGITS).alias("score")).filter(F.col("score") > 0)
    return scored.select(query_key, index.key, "score")


def bm25_scores(
    index: LexicalIndex, terms: DataFrame, query_key: str = "query_id",
    settings: Settings = DEFAULTS, key: str = "chunk_id", n: int | None = None,
) -> DataFrame:
    """(query, chunk, score): the best ``n`` chunks of each question, or all that share a term.

    With ``n``, blocks that cannot hold one of the best are not opened; the rows are the same. The
    asked terms are a written table: Spark broadcasts it if its size allows, and splits a hot term's
    blocks if not.

    Scores are rounded before anything ranks on them: a sum over shuffled rows may
    differ in its last bits between runs, the ranking must not.
    """
    asked = asked_terms(index, terms, query_key)
    if n is None:
        return block_scores(index, asked, query_key, settings)
    seeds, rest, first = opened_blocks(index, asked, query_key, settings, n)
    more = block_scores(index, asked, query_key, settings, rest)
    return top_k(first.unionByName(more), query_key, "score", n, key)


def opened_blocks(
    index: LexicalIndex, asked: DataFrame, query_key: str, settings: Settings, n: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks to open, as (query, block): seeds and the rest; and the scores of the seeds.

    A question's seeds are its ``n`` blocks with the highest bounds, as the best ``n`` may lie in so many.
    Their ``n``-th score is a floor: a block whose bound is below it cannot add to the best ``n``.
    """
    bounds = cut_lineage(block_bounds(index, asked, query_key, settings))
    order = Window.partitionBy(query_key).orderBy(F.desc("bound"), "block")
    placed = bounds.withColumn("nth", F.row_number().over(order))
    seeds = cut_lineage(placed.where(F.col("nth") <= n).select(query_key, "block"))
    first = cut_lineage(block_scores(index, asked, query_key, settings, seeds, few=True))
    floor = (
        top_k(first, query_key, "score", n, index.key).where(F.col("rank") == n).select(query_key, F.col("score").alias("floor"))
    )
    # a score is rounded, so it may exceed its bound by half a unit of the last digit
    able = F.coalesce(F.col("bound") + 10.0**-SCORE_DIGITS >= F.col("floor"), F.lit(True))
    rest = (
        bounds.join(floor, query_key, "left").where(able).select(query_key, "block")
        .join(seeds, [query_key, "block"], "left_anti")
    )
    return seeds, rest, first


def top_k(scored: DataFrame, query_key: str, score: str, k: int, key: str = "chunk_id") -> DataFrame:
    """Best ``k`` rows per question; Spark cuts to ``k`` per task before the shuffle."""
    order = Window.partitionBy(query_key).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_topk(
    index: LexicalIndex, questions: DataFrame, k: int, query_key: str = "query_id",
    text: str = "query", settings: Settings = DEFAULTS, key: str = "chunk_id",
) -> DataFrame:
    """Candidates per question with a similarity from score and rank."""
    terms = question_terms(questions, query_key, text)
    best = bm25_scores(index, terms, query_key, settings, key, settings.lexical_candidates(k))
    group = Window.partitionBy(query_key)
    low, high, n = F.min("score").over(group), F.max("score").over(group), F.count("*").over(group)
    scaled = (F.col("score") - low) / F.greatest(high - low, F.lit(1e-9))
    bias = 1.0 - (F.col("rank") - 1) / n
    similarity = 0.2 + 0.6 * scaled + 0.2 * bias
    return best.withColumn(
        "similarity",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)), SCORE_DIGITS),
    )
