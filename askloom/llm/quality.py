"""Quality rules with host verdicts.

Each document is measured once and judged by two rules of its own. Failures are then counted per
host (the ``source`` of a document), and each host's failure rate is shrunk towards the corpus by a
beta prior that is fitted to all hosts by the method of moments: a host with few documents is
judged by the corpus, one with many by itself. A host whose shrunken rate exceeds ``host_limit`` is
rejected with all its documents.

Defined results: a null text has no words and fails the first rule; a null source is a host of its
own; a line counts as repeated if the same line stood earlier in the text; an empty table gives an
empty result. With one host, or hosts that do not vary, the prior is as strong as one average
host. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import group_key, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
HOST_LIMIT = 0.5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    if len(seen) == n:
        return 0
    runs = list(zip(*(ids[k:] for k in range(window)), strict=False))
    counts = Counter(runs)
    if len(counts) == len(runs):
        return 0
    starts = np.fromiter((counts[r] > 1 for r in runs), np.int64, len(runs))
    edges = np.zeros(n + 1, np.int64)
    edges[: len(runs)] += starts
    edges[window : window + len(runs)] -= starts
    return int((np.cumsum(edges[:n]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # bytes.split cuts at space and the controls 9 to 13
    body = b"".join(words)
    chars = len(body.translate(None, bytes(range(0x80, 0xC0))))  # a code point has one other byte
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.split(None, 1):
            seen.add(line)
    return len(words), chars, symbols, again, repeated_words(words)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the five measures of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(t.as_py()) for t in batch["text"]], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], *(pa.array(found[:, k]) for k in range(len(MEASURES)))],
                ["doc_id", "source", *MEASURES],
            )

    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, source string, " + ", ".join(f"{m} long" for m in MEASURES))


def failed(limit: int = MAX_REPEAT_PERCENT, least: int = MIN_WORDS):
    return (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > limit * F.col("n_words"))


def host_verdicts(judged: DataFrame, *, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, n_failed, shrunken rate and verdict per host of (host, base_failed) rows.

    With m the mean and v the variance of the hosts' rates, a beta prior of strength
    s = m (1 - m) / v - 1 (kept between 1 and the mean number of documents per host) gives the
    rate (n_failed + s m) / (n + s).
    """
    hosts = written(
        judged.groupBy("host").agg(
            F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
        ),
        "hosts",
    )
    rate = F.col("n_failed") / F.col("n")
    moments = hosts.agg(
        F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg("n").alias("size")
    )
    strength = F.when(
        (F.col("v") > 0) & (F.col("m") > 0) & (F.col("m") < 1),
        F.greatest(F.lit(1.0), F.least(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.greatest("size", F.lit(1.0)))),
    ).otherwise(F.col("size"))
    shrunk = (F.col("n_failed") + F.col("s") * F.col("m")) / (F.col("n") + F.col("s"))
    return (
        hosts.crossJoin(F.broadcast(moments.withColumn("s", strength)))  # one row
        .withColumn("host_rate", shrunk)
        .select("host", "n", "n_failed", "host_rate", (F.col("host_rate") <= host_limit).alias("host_kept"))
    )


def judge(docs: DataFrame, *, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Measures, base_failed, host_rate and kept of every document."""
    rows = written(
        measures(docs).withColumn("base_failed", failed()).withColumn("host", group_key(F.col("source"))), "measures"
    )
    verdicts = written(host_verdicts(rows, host_limit=host_limit).select("host", "host_rate", "host_kept"), "verdicts")
    return rows.join(verdicts, "host").select(
        "doc_id", *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept")
    )
