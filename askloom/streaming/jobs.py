"""Incremental jobs: changed documents, expiring articles, running conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from askloom.operators import chunking, corpus
from askloom.operators.sessions import MAX_MESSAGES, turn_messages
from askloom.plans.retrieve import append, compact
from askloom.settings import DEFAULTS, Settings
from askloom.sources import store
from askloom.sources.files import FILE_SCHEMA, TEXT_GLOB, as_documents
from askloom.sources.pointer import read_pointer

def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def watch_text_folder(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New text files of a folder as (source, text, version) with the batch loader's metadata.

    Ids, decoding and metadata are those of ``load_text_folder``, so a stream goes on where a batch
    load ended.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", TEXT_GLOB)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return as_documents(files, folder)


def newest_versions(docs: DataFrame) -> DataFrame:
    """One row per source: the last version of a batch, with its other columns."""
    kept = [c for c in docs.columns if c not in ("source", "version")]
    newest = F.max_by(F.struct(*kept), F.struct("version", "text")).alias("_newest")
    return docs.groupBy("source").agg(newest).select("source", *(f"_newest.{c}" for c in kept))


def store_batch(
    docs: DataFrame, chunk_path: str, parent_path: str, settings: Settings = DEFAULTS,
    fold_unicode: bool = True,
) -> None:
    """Clean, chunk and store one batch; its sources replace what was stored for them.

    Running a batch twice gives the same tables.
    """
    spark = docs.sparkSession
    kept = corpus.clean_documents(newest_versions(docs), fold_unicode)
    for rows, path in (
        (chunking.chunk_parents(kept, settings), parent_path),
        (chunking.chunk_children(kept, settings), chunk_path),
    ):
        if table_exists(spark, path):
            store.upsert_table(spark, rows, path)
        else:
            store.write_table(rows, path)


def ingest_stream(
    docs: DataFrame, chunk_path: str, parent_path: str, checkpoint: str,
    settings: Settings = DEFAULTS, fold_unicode: bool = True,
) -> StreamingQuery:
    """Keep the chunk and parent tables in step with a stream of documents."""

    def run(batch: DataFrame, _: int) -> None:
        store_batch(batch, chunk_path, parent_path, settings, fold_unicode)

    return (
        docs.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def index_stream(
    docs: DataFrame, path: str, checkpoint: str, settings: Settings = DEFAULTS, embedder=None,
    fold_unicode: bool = True, compact_after: int = 32,
) -> StreamingQuery:
    """Keep a searchable corpus in step with a stream of documents.

    Every batch becomes a segment of the corpus at ``path``, whose sources replace what was stored of
    them, and is searched from then on by whoever opens the corpus. A batch that is run again after a
    failure has no further effect. Beyond ``compact_after`` segments they are merged into one.
    """

    def run(batch: DataFrame, number: int) -> None:
        kept = corpus.clean_documents(newest_versions(batch), fold_unicode)
        append(kept, path, settings, embedder, batch=(checkpoint, number))
        if len(read_pointer(batch.sparkSession, path)["segments"]) > compact_after:
            compact(batch.sparkSession, path)

    return (
        docs.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fresh_articles(articles: DataFrame, hours: int = 24) -> DataFrame:
    """Arrivals without repeats of a url under the same question; late rows drop.

    Rows are late if older than ``hours`` behind the newest. State holds the keys for the length
    of the watermark only.
    """
    key = [c for c in ("query_id", "url") if c in articles.columns]
    return articles.withWatermark("published_at", f"{hours} hours").dropDuplicatesWithinWatermark(key)


def expire_articles(spark: SparkSession, chunk_path: str, hours: int = 24, now: str | None = None) -> int:
    """Drop stored dynamic rows that are older than ``hours``: the regular job beside the streams.

    Returns how many buckets were rewritten; the others are not touched.
    """
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return store.purge_table(spark, chunk_path, at, hours)


STATE = "turns array<bigint>, parts array<int>, roles array<string>, contents array<string>, newest bigint"
TAIL = "session_id bigint, messages int, transcript string"


def _keep_tail(n: int, time_column: str | None, silent_ms: int) -> Callable:
    def update(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *columns, newest = state.get if state.exists else ([], [], [], [], 0)
        rows = list(zip(*columns))
        for batch in batches:
            new = zip(batch["turn"], batch["part"], batch["role"], batch["content"])
            # a replayed message has the same (turn, part) and replaces itself
            merged = {(r[0], r[1]): r for r in rows}
            merged.update({(int(t), int(p)): (int(t), int(p), r, c) for t, p, r, c in new})
            rows = [merged[k] for k in sorted(merged)][-n:]
            if time_column is not None and batch[time_column].notna().any():
                newest = max(newest, int(batch[time_column].max().timestamp() * 1000))
        state.update((*(list(column) for column in zip(*rows)), newest))
        if time_column is not None:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + silent_ms)
        lines = [f"{role}: {content}" for _, _, role, content in rows]
        yield pd.DataFrame(
            {"session_id": [key[0]], "messages": [len(rows)], "transcript": ["\n".join(lines)]}
        )

    return update


def conversation_tails(
    turns: DataFrame, n: int = MAX_MESSAGES, time_column: str | None = None, silent_hours: float = 24 * 30,
    late: str = "1 hour",
) -> DataFrame:
    """The last ``n`` messages of each session, re-emitted when the session gets new turns.

    ``turns`` streams (session_id, turn, user_message, assistant_message). State is at most ``n`` messages
    per session. With ``time_column``, the time of a turn, a session that was silent for ``silent_hours`` of
    the stream's own time leaves no state, and starts anew should it speak again; turns more than ``late``
    behind the newest are dropped. Time goes by the turns, so a stream that is replayed gives the same rows.
    """
    if time_column is None:
        messages, timeout = turn_messages(turns), GroupStateTimeout.NoTimeout
    else:
        messages = turn_messages(turns.withWatermark(time_column, late), (time_column,))
        timeout = GroupStateTimeout.EventTimeTimeout
    update = _keep_tail(n, time_column, int(silent_hours * 3_600_000))
    return messages.groupBy("session_id").applyInPandasWithState(update, TAIL, STATE, "update", timeout)


def transcript(messages: DataFrame) -> DataFrame:
    """Batch form of the stream's rows, from ``sessions.last_messages``."""
    ordered = F.sort_array(
        F.collect_list(F.struct("position", F.concat_ws(": ", "role", "content").alias("line")))
    )
    return messages.groupBy("session_id").agg(
        F.count("*").cast("int").alias("messages"),
        F.array_join(F.transform(ordered, lambda m: m["line"]), "\n").alias("transcript"),
    )


__all__ = [
    "conversation_tails", "expire_articles", "fresh_articles", "index_stream", "ingest_stream", "newest_versions",
    "store_batch", "transcript", "watch_text_folder",
]
