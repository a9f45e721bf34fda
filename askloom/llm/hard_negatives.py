"""Hard negatives by exact inner-product search with lists shared by clusters of anchors.

Anchors that point the same way are put into blocks of at most ``Settings.members``. A block has a
centre and an opening angle, the largest between the centre and a member; so no member's angle to a
candidate is smaller than the centre's less the opening, and the candidate's length times the cosine of
that is an upper bound of what it scores per length of the anchor. The candidates of a slab are sorted by
this bound once for a block. Every member of the block walks that list, and stops for good where the
bound times its own length can no longer reach the last row it would keep: the rest is certified.

Candidates are packed into slabs of ``Settings.slab_rows`` rows, written once and never moved again.
Blocks are brought to them in groups of at most ``Settings.group_rows`` anchors, a broadcast of bounded
size, one pass over the slabs per group. A task keeps the best rows of a member over all its slabs, so
only a few rows per anchor and task are shuffled. The first passes find the positives, the second ones
the negatives in the score bands that the positives set. All scores are exact integers.

Defined results: rows with a null id, label or vector, or with a component that is null or not finite
(also after scaling), take no part. Scaled components beyond the range of a long are taken at its ends,
and so are scores. Where vectors differ in length, the shorter ones count as zero beyond their end.
Repeated ids are rows of their own: each anchor row gets its result, a copy is another row, and what
ties in score and id is one and the same in the result. Without anchors, positives or negatives there
are no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askloom.llm.common import discard, written
from askloom.session import scratch_path

LONG = np.iinfo(np.int64)
#: Whole numbers up to this are exact as doubles.
EXACT = float(1 << 53)
#: Angles are widened by this, far above the error of an arc cosine.
SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    #: A negative scores between these percentages of its positive, both included.
    band: tuple[int, int] = (30, 90)
    #: Whole-number scale of the components.
    scale: int = 256
    slab_rows: int = 4096
    members: int = 256
    group_rows: int = 16_384
    #: Centres are found on a sample of at most this many anchors, and are at most this many.
    sample: int = 16_384
    centres: int = 1024
    rounds: int = 8
    #: Length of a walk's first step; steps double up to a slab.
    step: int = 256


def usable(rows: DataFrame, vec_id: str, label: Column, vector: str, scale: int) -> DataFrame:
    """id, label and whole-number vector of the rows that take part."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    fine = ~F.exists("scaled", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("scaled"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("scaled").isNotNull() & fine)
        .select("id", "label", F.transform("scaled", lambda x: F.floor(x)).alias("vector"))
    )


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers, short ones filled up with zeros."""
    sizes = np.asarray(vectors.value_lengths())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def narrow(values: np.ndarray) -> bytes:
    """A matrix as bytes, two a component where they fit."""
    small = not values.size or (values.min() >= -(1 << 15) and values.max() < 1 << 15)
    return (b"\2" if small else b"\10") + values.astype(np.int16 if small else np.int64).tobytes()


def widened(raw: bytes, rows: int) -> np.ndarray:
    """The matrix again, as 64-bit whole numbers."""
    return np.frombuffer(raw, np.int16 if raw[:1] == b"\2" else np.int64, offset=1).reshape(rows, -1).astype(np.int64)


PACKED = "slab long, n int, ids binary, labels binary, vectors binary"


def pack(rows: DataFrame, slab_rows: int) -> DataFrame:
    """The rows as slabs: ids, labels and vectors of up to ``slab_rows`` rows in a row of binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 20  # a partition has fewer than a million slabs
        held: list[pa.RecordBatch] = []

        def slab(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            vectors = whole["vector"].combine_chunks()
            return pa.RecordBatch.from_pydict({
                "slab": pa.array([at], pa.int64()), "n": pa.array([len(whole)], pa.int32()),
                "ids": pa.array([whole["id"].to_numpy().tobytes()], pa.binary()),
                "labels": pa.array([whole["label"].to_numpy().tobytes()], pa.binary()),
                "vectors": pa.array([narrow(matrix(vectors))], pa.binary()),
            })

        for batch in batches:
            while batch.num_rows:
                room = slab_rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == slab_rows:
                    yield slab(held)
                    held, at = [], at + 1
        if held:
            yield slab(held)

    return rows.mapInArrow(run, PACKED)


def anchor_rows(slabs: DataFrame, every: int) -> DataFrame:
    """row, id, label, vector of the anchors: rows whose id ``every`` divides; ``row`` names a row of a slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ids = np.frombuffer(s["ids"], np.int64)
                own = np.flatnonzero(ids % every == 0)
                vectors = widened(s["vectors"], s["n"])[own]
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(place_of(s["slab"], own)), "id": pa.array(ids[own]),
                    "label": pa.array(np.frombuffer(s["labels"], np.int64)[own]),
                    "vector": pa.array(list(vectors), pa.list_(pa.int64())),
                })

    return slabs.mapInArrow(run, "row long, id long, label long, vector array<bigint>")


def place_of(slab: int, rows: np.ndarray) -> np.ndarray:
    """A number for a row: its slab's partition and number there, then its place. Slabs have at most 65,536 rows."""
    return (np.int64(slab) << 16) + rows.astype(np.int64)


def directions(vectors: np.ndarray, width: int) -> np.ndarray:
    """Vectors of length one, ``width`` wide; zero vectors stay."""
    out = np.zeros((len(vectors), width))
    have = min(width, vectors.shape[1])
    out[:, :have] = vectors[:, :have]
    top = np.abs(out).max(1, initial=0, keepdims=True)
    out /= np.where(top > 0, top, 1)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def find_centres(sample: np.ndarray, wanted: int, rounds: int) -> np.ndarray:
    """Centres of directions: k-means on the sphere from evenly drawn rows."""
    points = directions(sample, sample.shape[1])
    if not len(points):
        return points
    centres = points[np.linspace(0, len(points) - 1, min(wanted, len(points))).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate([(p @ centres.T).argmax(1) for p in np.array_split(points, -(-len(points) // 1024))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


BLOCK = "block long, n int, rows binary, ids binary, labels binary, vectors binary"


def anchor_blocks(anchors: DataFrame, settings: Settings) -> DataFrame:
    """Blocks of anchors that point the same way, written: (block, members as binary columns)."""
    spark = anchors.sparkSession
    n = anchors.count()
    drawn = anchors.orderBy(F.xxhash64("id", "row"), "row").limit(settings.sample).select("vector").toArrow()
    sample = matrix(drawn["vector"].combine_chunks()) if drawn.num_rows else np.zeros((0, 1))
    wanted = max(1, min(settings.centres, -(-n // settings.members)))
    centres = spark.sparkContext.broadcast(find_centres(sample, wanted, settings.rounds))

    @F.arrow_udf("int")
    def cluster(vectors: pa.Array) -> pa.Array:
        if not len(vectors) or not len(centres.value):
            return pa.array(np.zeros(len(vectors), np.int32))
        points = directions(matrix(vectors), centres.value.shape[1])
        return pa.array((points @ centres.value.T).argmax(1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held, kind = [], None

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            cells = {c: pa.array([whole[c].to_numpy().tobytes()], pa.binary()) for c in ("row", "id", "label")}
            return pa.RecordBatch.from_arrays([
                pa.array([at], pa.int64()), pa.array([len(whole)], pa.int32()), cells["row"], cells["id"], cells["label"],
                pa.array([narrow(matrix(whole["vector"].combine_chunks()))], pa.binary()),
            ], names=["block", "n", "rows", "ids", "labels", "vectors"])

        for batch in batches:
            kinds = batch["cluster"].to_numpy()
            cuts = np.flatnonzero(np.diff(kinds, prepend=kinds[:1])).tolist() if len(kinds) else []
            for start, end in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
                part = batch.slice(start, end - start)
                if part.num_rows and kind != kinds[start]:
                    if held:
                        yield block(held)
                        at += 1
                    held, kind = [], kinds[start]
                while part.num_rows:
                    room = settings.members - sum(b.num_rows for b in held)
                    held.append(part.slice(0, room))
                    part = part.slice(room)
                    if sum(b.num_rows for b in held) == settings.members:
                        yield block(held)
                        held, at = [], at + 1
        if held:
            yield block(held)

    grouped = (
        anchors.withColumn("cluster", cluster("vector"))
        .repartitionByRange("cluster", "row")
        .sortWithinPartitions("cluster", "row")
    )
    return written(grouped.mapInArrow(run, BLOCK), "anchor-blocks")


def groups_of(blocks: DataFrame, settings: Settings) -> list[tuple[int, int]]:
    """Ranges of blocks with at most ``group_rows`` anchors; the driver sees a number per block."""
    out: list[tuple[int, int]] = []
    held = 0
    for block, n in blocks.select("block", "n").orderBy("block").toLocalIterator():
        if not out or held + n > settings.group_rows:
            out.append((block, block))
            held = 0
        out[-1] = (out[-1][0], block)
        held += n
    return out


@dataclass
class Block:
    """Members of a block in a task, with the best rows of each so far."""

    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    centre: np.ndarray
    opening: float
    #: Whose list it is (a member may have several), and the scores it may hold.
    owner: np.ndarray
    least: np.ndarray
    most: np.ndarray
    #: Best rows so far: of whom, score, id.
    best: tuple[np.ndarray, np.ndarray, np.ndarray]
    #: Score that a new row must reach, by list.
    bar: np.ndarray

    @staticmethod
    def of(record: dict, bands: dict[int, list[tuple[int, int]]] | None) -> Block:
        rows = np.frombuffer(record["rows"], np.int64)
        vectors = widened(record["vectors"], record["n"])
        points = directions(vectors, vectors.shape[1])
        centre = directions(points.sum(0, keepdims=True), points.shape[1])[0]
        angles = np.arccos(np.clip(points @ centre, -1, 1))
        lists = [(i, LONG.min, LONG.max) for i in range(len(rows))] if bands is None else [
            (i, *band) for i, row in enumerate(rows.tolist()) for band in bands.get(row, [])
        ]
        owner = np.array([x[0] for x in lists], np.int64)
        least, most = (np.array([x[k] for x in lists], np.int64) for k in (1, 2))
        none = np.zeros(0, np.int64)
        return Block(
            rows, np.frombuffer(record["labels"], np.int64), vectors, lengths(vectors), centre,
            float(angles.max(initial=0)) + SLACK, owner, least, most, (none, none, none), least.copy(),
        )


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, a little too long rather than too short."""
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * max(width, 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)  # Python's whole numbers have no largest
    return np.clip(exact, int(LONG.min), int(LONG.max)).astype(np.int64)


def keep_best(block: Block, entrants: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> None:
    """Take entrants (list, score, id) into the best ``k`` of their lists, and raise the bars."""
    who, score, ids = (np.concatenate(x) for x in zip(block.best, entrants, strict=True))
    # ~score falls as the score rises, without overflow
    order = np.lexsort((ids, ~score, who))
    who, score, ids = who[order], score[order], ids[order]
    first = np.searchsorted(who, who)
    place = np.arange(len(who)) - first
    kept = place < k
    block.best = who[kept], score[kept], ids[kept]
    last = place == k - 1
    block.bar[who[last]] = np.maximum(block.bar[who[last]], score[last])


class Slab:
    """The rows of a slab in a task."""

    def __init__(self, record: dict) -> None:
        self.ids, self.labels = (np.frombuffer(record[c], np.int64) for c in ("ids", "labels"))
        self.vectors = widened(record["vectors"], record["n"])
        self.places = place_of(record["slab"], np.arange(record["n"]))
        self.points, self.lengths = directions(self.vectors, self.vectors.shape[1]), lengths(self.vectors)


def walk(block: Block, slab: Slab, k: int, same_label: bool, step: int) -> int:
    """Members of the block walk the slab's list; returns how many rows of it were scored."""
    if not len(block.owner):
        return 0
    width = min(slab.points.shape[1], len(block.centre))
    angle = np.arccos(np.clip(slab.points[:, :width] @ block.centre[:width], -1, 1))
    bound = slab.lengths * np.cos(np.maximum(angle - block.opening, 0))
    order = np.argsort(-bound, kind="stable")
    at, lists = 0, np.arange(len(block.owner))
    while at < len(order):
        # a list is certified once the bound of what is left cannot reach its bar
        top = bound[order[at]] * block.lengths[block.owner[lists]]
        lists = lists[top + np.abs(top) * 1e-9 + 1e-3 >= block.bar[lists].astype(np.float64)]
        if not len(lists):
            break
        part = order[at : at + step]
        members, which = np.unique(block.owner[lists], return_inverse=True)
        found = scores(block.vectors[members], slab.vectors[part])
        fits = (block.labels[members][:, None] == slab.labels[part]) == same_label
        fits &= block.rows[members][:, None] != slab.places[part]
        mine = found[which]
        entering = fits[which] & (mine >= block.bar[lists][:, None]) & (mine <= block.most[lists][:, None])
        one, other = np.nonzero(entering)
        if len(one):
            keep_best(block, (lists[one], mine[one, other], slab.ids[part][other]), k)
        at += len(part)
        step *= 2
    return at


def search(
    slabs: DataFrame, blocks: DataFrame, settings: Settings, k: int, same_label: bool, bands: DataFrame | None = None
) -> DataFrame:
    """The best ``k`` rows of every list: (row, low, high, id, score), ranked and written.

    ``bands`` (row, low, high) gives the lists of an anchor; without it each anchor has one, open to both sides.
    """
    spark = slabs.sparkSession
    path = scratch_path(spark, "found")
    schema = "row long, low long, high long, id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for first, last in groups_of(blocks, settings):
        group = F.col("block").between(first, last)
        records = [r.asDict() for r in blocks.where(group).collect()]  # at most group_rows anchors
        limits: dict[int, list[tuple[int, int]]] | None = None
        if bands is not None:
            limits = {}
            members = spark.createDataFrame(
                pd.DataFrame({"row": np.concatenate([np.frombuffer(r["rows"], np.int64) for r in records])}), "row long"
            )
            for row, low, high in bands.join(F.broadcast(members), "row").collect():  # a few per anchor
                limits.setdefault(row, []).append((low, high))
        found = _pass(slabs, records, limits, settings.step, k, same_label)
        found.write.mode("append").parquet(path)
    parts = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("row", "low", "high").orderBy(F.desc("score"), "id")
    best = written(parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    discard(parts)
    return best


def _pass(slabs: DataFrame, records: list[dict], limits: dict | None, step: int, k: int, same_label: bool) -> DataFrame:
    """One pass of a group of blocks over the slabs: the best rows of each list by task."""
    sent = slabs.sparkSession.sparkContext.broadcast((records, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, limits = sent.value
        blocks = [Block.of(r, limits) for r in records]
        for batch in batches:
            for record in batch.to_pylist():
                slab = Slab(record)
                for block in blocks:
                    walk(block, slab, k, same_label, step)
        for block in blocks:
            who, score, ids = block.best
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (block.rows[block.owner[who]], block.least[who], block.most[who], ids, score)],
                names=["row", "low", "high", "id", "score"],
            )

    return slabs.mapInArrow(run, "row long, low long, high long, id long, score long")


def band_of(score: Column, band: tuple[int, int]) -> tuple[Column, Column]:
    """Smallest and largest whole negative score with low * score <= 100 * negative <= high * score."""
    exact = score.cast("decimal(25,0)")
    low, high = (exact * F.lit(p).cast("decimal(4,0)") for p in band)
    whole = lambda x, f: f(x / F.lit(100).cast("decimal(4,0)")).cast("decimal(38,0)").cast("long")
    return whole(low, F.ceil), whole(high, F.floor)


def mine(
    rows: DataFrame, *, vec_id: str = "vec_id", label: Column | None = None, vector: str = "embedding",
    anchors_every: int = 100, settings: Settings = Settings(),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark: SparkSession = rows.sparkSession
    clean = usable(rows, vec_id, F.col("label") if label is None else label, vector, settings.scale)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a slab is one value: dealt out evenly, so that the passes use all cores
    slabs = written(pack(clean, settings.slab_rows).repartition(parts), "slabs")
    anchors = written(anchor_rows(slabs, anchors_every), "anchors")
    blocks = anchor_blocks(anchors, settings)
    near = search(slabs, blocks, settings, settings.positives, True)
    low, high = band_of(F.col("score"), settings.band)
    positives = written(
        near.select(
            "row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth"),
            low.alias("low"), high.alias("high"),
        ).where(F.col("low") <= F.col("high")),
        "positives",
    )
    bands = positives.select("row", "low", "high").distinct()
    found = search(slabs, blocks, settings, settings.negatives, False, bands)
    named = anchors.select("row", F.col("id").alias("anchor_id"))
    out = written(
        positives.join(found, ["row", "low", "high"])
        .join(named, "row")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ),
        "hard-negatives",
    )
    discard(slabs, anchors, blocks, near, positives, found)
    return out
