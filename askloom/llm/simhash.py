"""SimHash near-duplicates through pivot distance tables.

A fingerprint has 64 bits. Every *distinct* fingerprint gets a table of its Hamming distances to
``PIVOTS`` reference fingerprints. Because of the triangle inequality, two fingerprints within r
bits differ by at most r in every coordinate, so a pair is discarded as soon as one coordinate
differs by more; survivors are verified on the fingerprints themselves.

Pairs are only looked at where they can link: two fingerprints within three bits agree on at least
two of five blocks of bits, so each fingerprint goes to ten (block pair, bits) buckets of 25 to 26
bits. Buckets of one are dropped. A bucket is sorted by its first coordinate, so a row is compared
with the rows up to three distances on. Buckets above ``BLOCK`` rows are cut into blocks and every
pair of blocks is a group of its own, so no task holds an unbounded bucket; nothing is left out.
Inside a task, pairs that are connected already are skipped and only links that join two
components go out, at most one fewer than rows.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links
like any other; rows that repeat an id are separate rows. A component's id is the smallest id in
it; null only if all its ids are null. An empty table gives an empty result. Other columns are not
read by :func:`classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import discard, spare, written
from askloom.llm.components import components

RADIUS = 3
PIVOTS = 32
BLOCK = 8192
#: Widths of the five blocks of bits, lowest first.
WIDTHS = (13, 13, 13, 13, 12)


def fingerprint_words(words: list[bytes], width: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    n = len(words)
    if not n:
        return 0
    if n < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, n) + 1
        ends = np.cumsum(lengths)
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(joined[i:j], 42)
            for i, j in zip(starts[: n - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
        ]
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 15):
        part = values[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (counts * 2 > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """SimHash of the words of a text (A-Z lower-cased), as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        # bytes.lower folds A-Z only, bytes.split cuts at space and the controls 9 to 13
        found = np.fromiter(
            (fingerprint_words(t.lower().split()) for t in texts), np.uint64, len(texts)
        )
        return pd.Series(found.view(np.int64))

    return prints(F.coalesce(text, F.lit("")).cast("binary"))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2 ..."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 42) for i in range(n)], np.uint64)


def bucket_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: two of its five blocks, and which two."""
    parts, at = [], 0
    for width in WIDTHS:
        parts.append(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    keys = []
    for i in range(5):
        for j in range(i + 1, 5):
            keys.append(F.shiftleft(parts[i] * F.lit(1 << 13) + parts[j], 4) + F.lit(len(keys)))
    return F.array(*keys)


class Forest:
    """Union-find over the rows of one batch."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            above = self.parent[found]
            if (above == found).all():
                return found
            found = above

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.roots(np.array([a]))[0]), int(self.roots(np.array([b]))[0])
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def flatten(self) -> None:
        self.parent = self.roots(np.arange(len(self.parent)))


def linked(fp: np.ndarray, group: np.ndarray, side: np.ndarray, mixed: np.ndarray) -> list[tuple[int, int]]:
    """Row pairs that join components. Rows are sorted by (group, first coordinate).

    ``side``: the row's block; where ``mixed``, only rows of different blocks are compared.
    """
    n = len(fp)
    refs = pivots()
    table = np.stack([np.bitwise_count(fp ^ p) for p in refs]).astype(np.int8)
    forest, out = Forest(n), []
    rows = np.arange(n)
    step = 0
    while len(rows):
        step += 1
        rows = rows[rows + step < n]
        near = (group[rows] == group[rows + step]) & (table[0][rows + step] - table[0][rows] <= RADIUS)
        rows = rows[near]  # sorted: a row that is too far now stays too far
        if not len(rows):
            break
        i, j = rows, rows + step
        wanted = (side[i] != side[j]) | ~mixed[i]
        i, j = i[wanted], j[wanted]
        open_ = forest.parent[i] != forest.parent[j]
        i, j = i[open_], j[open_]
        for k in range(1, len(refs)):
            if not len(i):
                break
            close = np.abs(table[k][i] - table[k][j]) <= RADIUS
            i, j = i[close], j[close]
        if len(i):
            close = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
            joined = [(a, b) for a, b in zip(i[close].tolist(), j[close].tolist(), strict=True) if forest.join(a, b)]
            if joined:
                out += joined
                forest.flatten()
    return out


def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups of one partition; rows come sorted by group and first coordinate."""
    names = ("key", "lo", "hi", "block", "fp")

    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(rows["fp"]), bool)
        for name in ("key", "lo", "hi"):
            change[1:] |= rows[name][1:] != rows[name][:-1]
        fp = rows["fp"].view(np.uint64)
        pairs = linked(fp, np.cumsum(change), rows["block"], rows["lo"] != rows["hi"])
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(rows["fp"][x]) for x in (a, b)], ["a", "b"])

    held: dict[str, list[np.ndarray]] = {name: [] for name in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in names}
        last = np.ones(batch.num_rows, bool)
        for name in ("key", "lo", "hi"):
            last &= rows[name] == rows[name][-1]
        start = int(np.argmax(last))  # the last group may go on in the next batch
        same = held["fp"] and all(held[name][-1][-1] == rows[name][0] for name in ("key", "lo", "hi"))
        if start or (held["fp"] and not same):
            full = {name: np.concatenate([*held[name], rows[name][:start]]) for name in names}
            if len(full["fp"]):
                yield solve(full)
            held = {name: [rows[name][start:]] for name in names}
        else:
            for name in names:
                held[name].append(rows[name])
    if held["fp"]:
        yield solve({name: np.concatenate(held[name]) for name in names})


def links(prints: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that keep all components connected."""
    keyed = prints.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    placed = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key",
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        "block",
        "fp",
        F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(pivots(1).view(np.int64)[0])))).alias("first"),
    )
    return (
        dealt.repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi", "first")
        .mapInArrow(links_of, "a long, b long")
    )


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp, component_id) of every row; text_key is a hash of the text."""
    rows = written(
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), fingerprint(F.col("text")).alias("fp")),
        "fingerprints",
    )
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    found = written(links(prints), "found")
    labels = components(found)
    discard(found)
    labelled = written(
        prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first_id", F.coalesce("label", "fp").alias("label")
        ),
        "labelled",
    )
    smallest = written(labelled.groupBy("label").agg(F.min("first_id").alias("component_id")), "components")
    known = written(labelled.join(smallest, "label").select("fp", "component_id"), "known")
    discard(prints, labels, labelled, smallest)
    return rows.join(known, "fp").select("doc_id", "text_key", "fp", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every row."""
    return members(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id, with all its columns.

    Rows that repeat that id with the same text are one document.
    """
    as_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key, text = spare(docs, "_key", "_text")
    stay = (
        members(docs)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(as_key.alias(key), F.col("text_key").alias(text))
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return (
        docs.withColumns({key: as_key, text: F.xxhash64("text")})
        .join(stay, [key, text], "left_semi")
        .dropDuplicates([key, text])
        .select(*columns)
    )
