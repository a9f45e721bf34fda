"""Vector top-k for a batch of questions: exact over resident blocks, and approximate by cells.

Vectors are stored as blocks, some thousand rows in a row with one binary matrix. A block is scored
where it lies: the questions come to it, in groups of bounded size, and only the best rows per question
and task leave. No vector is shuffled and no pair table is ever built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as St
from pyspark.sql.pandas.types import to_arrow_type

from askloom.operators.lexical import SCORE_DIGITS, SEGMENT, top_k
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS, Settings

#: Rows of a vector block, and cells of a score matrix.
BLOCK_ROWS = 4096
MAX_SCORE_CELLS = 1_000_000
#: Cells of the approximate search: rows that centres are found on, most cells, rounds of k-means.
CELL_SAMPLE, MOST_CELLS, CELL_ROUNDS = 32_768, 16_384, 2
#: Rows of a folder of cells, and how many folders there are at least and at most.
FOLDER_ROWS, LEAST_FOLDERS, MOST_FOLDERS = 100_000, 8, 4096
#: Rows that a question meets: this share of all, or so many for each wanted row.
PROBE_SHARE, PROBE_LEAST = (195, 1000), 20
#: Scores against centres are rounded to so many digits before they are compared.
CELL_DIGITS = 9


def _matrix(vectors: pd.Series) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _cut(rows: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best ``k`` entries per row by (value desc, id asc)."""
    id_order = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((id_order, -values, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows, side="left")
    return order[np.arange(len(order)) - first < k]


def _best(
    queries: np.ndarray, doc_ids: np.ndarray, docs: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, doc id, rounded cosine): top ``k`` of ``docs`` for each query row.

    Questions are taken in slices, so the score matrix, which is rounded and negated in place, stays small.
    """
    step = max(1, MAX_SCORE_CELLS // max(len(doc_ids), 1))
    parts = []
    for start in range(0, len(queries), step):
        scores = queries[start : start + step] @ docs.T
        np.round(scores, SCORE_DIGITS, out=scores)
        np.negative(scores, out=scores)
        if scores.shape[1] > k:
            # all rows that reach the k-th score; ties are settled by the cut
            floor = np.partition(scores, k - 1, axis=1)[:, k - 1 : k].copy()
            rows, cols = np.nonzero(scores <= floor)
        else:
            rows, cols = np.nonzero(np.ones(scores.shape, dtype=bool))
        values = 0.0 - scores[rows, cols]
        del scores
        # copies of a text tie by the thousand: ids are ordered once for each document, not for each hit
        used = np.flatnonzero(np.bincount(cols, minlength=len(doc_ids)))
        places = np.zeros(len(doc_ids), np.int32)
        places[used] = np.unique(doc_ids[used], return_inverse=True)[1]
        keep = _cut(rows, places[cols], values, k)
        parts.append((rows[keep] + start, doc_ids[cols[keep]], values[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def pack_vectors(
    vectors: DataFrame, key: str = "chunk_id", segment: int = 0, rows: int = BLOCK_ROWS, by: str | None = None
) -> DataFrame:
    """(block, n, ids, vectors): up to ``rows`` rows of (key, embedding) in one, as they lie in their task.

    A block's number holds the segment, the task and the place there; vectors are doubles, row by row.
    With ``by``, a whole-number column that the rows are sorted by, a block has rows of one value, its column.
    """
    schema = (
        St.StructType().add("block", St.LongType()).add("n", St.IntegerType())
        .add("ids", St.ArrayType(vectors.schema[key].dataType)).add("vectors", St.BinaryType())
    )
    if by is not None:
        schema = schema.add(by, St.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = segment * SEGMENT + (TaskContext.get().partitionId() << 12)
        held, total, kind = [], 0, None

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole[key].combine_chunks()
            flat = whole["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cells = [
                pa.array([at], pa.int64()), pa.array([len(ids)], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([flat.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cells + ([] if by is None else [pa.array([kind], pa.int32())]), names=schema.names)

        for batch in batches:
            for value, part in _runs(batch, by):
                if held and value != kind:
                    yield block()
                    held, total, at = [], 0, at + 1
                kind = value
                while part.num_rows:
                    held.append(part.slice(0, rows - total))
                    part = part.slice(rows - total)
                    total += held[-1].num_rows
                    if total == rows:
                        yield block()
                        held, total, at = [], 0, at + 1
        if held:
            yield block()

    columns = [key, "embedding"] if by is None else [key, "embedding", by]
    return vectors.select(*columns).mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch, by: str | None) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """The batch cut where the value of ``by`` changes."""
    if by is None or not batch.num_rows:
        yield None, batch
        return
    values = batch[by].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    for start, end in zip(cuts, cuts[1:]):
        yield int(values[start]), batch.slice(start, end - start)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of each block, without the places named in ``gone``."""
    for batch in batches:
        gone = batch["gone"] if "gone" in batch.schema.names else None
        for i in range(batch.num_rows):
            ids = batch["ids"][i].values
            matrix = np.frombuffer(batch["vectors"][i].as_buffer(), np.float64).reshape(len(ids), -1)
            dead = None if gone is None else gone[i].as_py()
            if dead:
                keep = np.setdiff1d(np.arange(len(ids)), dead)
                ids, matrix = ids.take(pa.array(keep)), matrix[keep]
            yield ids, matrix


def holes(blocks: DataFrame, replaced: DataFrame) -> DataFrame:
    """(block, gone): places in stored blocks whose row a later segment replaced. Reads no vector.

    ``replaced`` is (chunk, below): the chunk's rows in segments below that number no longer hold.
    """
    rows = blocks.select("block", F.posexplode("ids").alias("place", "chunk"))
    dead = rows.join(replaced, "chunk").where(F.col("block") < F.col("below") * SEGMENT)
    return dead.groupBy("block").agg(F.collect_set("place").alias("gone"))


class _Questions:
    """A bounded group of questions in a task, with the best rows of each so far."""

    def __init__(self, vectors: np.ndarray, n: int) -> None:
        self.vectors, self.n = vectors, n
        self.best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def take(self, ids: np.ndarray, vectors: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Score a block for the questions numbered ``asking``, for all without."""
        asked = self.vectors if asking is None else self.vectors[asking]
        if not len(ids) or not len(asked):
            return
        rows, found, values = _best(asked, ids, vectors, self.n)
        new = (rows if asking is None else asking[rows], found, values)
        if self.best is not None:
            new = tuple(np.concatenate(x) for x in zip(self.best, new))
            keep = _cut(new[0], new[1], new[2], self.n)
            new = tuple(x[keep] for x in new)
        self.best = new


def _score_blocks(blocks: DataFrame, group: pa.Table, n: int, query_key: str, key: str, schema: St.StructType) -> DataFrame:
    """One pass of a group of questions over the blocks: the best ``n`` of each by task.

    If the questions name ``probes``, a block is scored for those that probe its cell.
    """
    ids_type = _arrow_type(blocks)
    probes = group["probes"].to_pylist() if "probes" in group.column_names else None
    sent = blocks.sparkSession.sparkContext.broadcast(
        (group[query_key].combine_chunks(), _matrix(group["embedding"].to_pandas()), probes)
    )
    columns = [c for c in ("ids", "vectors", "gone", "cell") if c in blocks.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vectors, probes = sent.value
        best = _Questions(vectors, n)
        asking: dict[int, list[int]] = {}
        for i, cells in enumerate(probes or []):
            for c in cells:
                asking.setdefault(c, []).append(i)
        for batch in batches:
            if probes is not None:
                wanted = pa.array([c in asking for c in batch["cell"].to_pylist()], pa.bool_())
                batch = batch.filter(wanted)
            kinds = batch["cell"].to_pylist() if probes is not None else []
            for i, (ids, matrix) in enumerate(_decoded(iter([batch]))):
                best.take(ids.to_numpy(zero_copy_only=False), matrix, np.array(asking[kinds[i]]) if kinds else None)
        if best.best is not None:
            rows, ids, values = best.best
            yield pa.RecordBatch.from_arrays(
                [asked.take(pa.array(rows)), pa.array(ids, ids_type), pa.array(values)], names=[query_key, key, "score"]
            )

    return blocks.select(*columns).mapInArrow(run, schema)


def _arrow_type(blocks: DataFrame) -> pa.DataType:
    return to_arrow_type(blocks.schema["ids"].dataType.elementType)


def question_groups(queries: DataFrame, query_key: str, rows: int, more: tuple[str, ...] = ()) -> Iterator[pa.Table]:
    """The questions in groups of about ``rows``, by a hash of their key; one group at a time is on the driver."""
    queries = cut_lineage(queries.select(query_key, "embedding", *more))
    n = max(1, math.ceil(queries.count() / rows))
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64(query_key), F.lit(n)) == i).toArrow()


def nearest(
    docs: DataFrame, queries: DataFrame, n: int, query_key: str = "query_id",
    key: str = "chunk_id", settings: Settings = DEFAULTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query, doc, score, rank): exact ``n`` nearest by cosine of unit vectors.

    ``docs`` are stored blocks, or rows of (key, embedding), which are packed on the way. Every group of
    ``settings.query_block_rows`` questions is one pass over the blocks, which stay where they are.
    """
    blocks = docs if "vectors" in docs.columns else pack_vectors(docs, key, rows=block_rows)
    ids = blocks.schema["ids"].dataType.elementType
    schema = St.StructType().add(query_key, queries.schema[query_key].dataType).add(key, ids).add("score", St.DoubleType())
    found = None
    for group in question_groups(queries, query_key, settings.query_block_rows):
        part = _score_blocks(blocks, group, n, query_key, key, schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found, query_key, "score", n, key)


def dense_topk(
    chunks: DataFrame, queries: DataFrame, k: int, query_key: str = "query_id",
    key: str = "chunk_id", settings: Settings = DEFAULTS,
) -> DataFrame:
    """Candidates per question; similarity is the cosine, clamped. No filter on doc_type."""
    found = nearest(chunks, queries, settings.dense_candidates(k), query_key, key, settings)
    return found.withColumn(
        "similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    )


@dataclass(frozen=True)
class CellIndex:
    """Vectors by cell: ``cells`` (cell, part, n, embedding), one row per cell, and ``blocks`` as in :func:`pack_vectors`."""

    cells: DataFrame
    blocks: DataFrame


def _nearest_cell(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row; ties go to the smallest number."""
    step = max(1, MAX_SCORE_CELLS // max(len(centres), 1))
    parts = [np.round(vectors[i : i + step] @ centres.T, CELL_DIGITS).argmax(1) for i in range(0, len(vectors), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _find_centres(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """K-means on the sphere; the first rows of the sample are the first centres."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        np.add.at(sums, _nearest_cell(sample, centres), sample)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norms > 0, np.round(np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0), CELL_DIGITS), centres)
    return centres


def unpack_vectors(blocks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, embedding) rows of vector blocks, without the places named in ``gone``."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = St.StructType().add(key, kind).add("embedding", St.ArrayType(St.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _decoded(batches):
            width = vectors.shape[1] if len(vectors) else 0
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=[key, "embedding"])

    return blocks.mapInArrow(run, schema)


def draw_rows(rows: DataFrame, key: str, sample: int, count: int) -> DataFrame:
    """The first ``sample`` of ``count`` rows by the MD5 of their key.

    Only MD5s below a bound that leaves about twice the sample are sorted, so a task does not send a sample
    of its own; all are, if the bound should leave too few.
    """
    drawn = rows.withColumn("_md5", F.md5(F.col(key).cast("string")))
    if count > 4 * sample:
        bound = f"{2 * sample * 16**8 // count:08x}"
        below = drawn.where(F.col("_md5").isNull() | (F.col("_md5") < bound))
        drawn = below if below.select("_md5").count() >= sample else drawn
    return drawn.orderBy("_md5", key).limit(sample).drop("_md5")


def build_cells(
    vectors: DataFrame, path: str, key: str = "chunk_id", sample: int = CELL_SAMPLE, most: int = MOST_CELLS, rounds: int = CELL_ROUNDS,
) -> CellIndex:
    """Write an inverted file over vector blocks, or over rows of (key, embedding), and read it back.

    There are four times as many cells as the root of the number of rows, ``most`` at most. Their centres come
    from the first ``sample`` rows by the MD5 of their key; every row then goes to its nearest centre. Rows of
    a cell lie together, in blocks of bounded size and in folders of neighbouring cells.
    """
    spark = vectors.sparkSession
    rows = unpack_vectors(vectors, key) if "vectors" in vectors.columns else vectors.select(key, "embedding")
    count = rows.select(key).count()
    drawn = draw_rows(rows, key, sample, count).toArrow()
    points = _matrix(drawn["embedding"].to_pandas())
    wanted = min(max(1, math.ceil(4 * math.sqrt(count))), most, max(len(points), 1))
    centres = _find_centres(points, wanted, rounds) if len(points) else np.zeros((1, 0))
    sent = spark.sparkContext.broadcast(centres)
    parts = min(max(LEAST_FOLDERS, -(-count // FOLDER_ROWS)), MOST_FOLDERS, len(centres))

    @F.pandas_udf("int")
    def cell(batch: pd.Series) -> pd.Series:
        return pd.Series(_nearest_cell(_matrix(batch), sent.value).astype(np.int32))

    placed = (
        rows.withColumn("cell", cell("embedding")).repartitionByRange("cell", key).sortWithinPartitions("cell", key)
    )
    packed = pack_vectors(placed, key, by="cell")
    part = (F.col("cell") * parts / len(centres)).cast("int")
    foldered = packed.withColumn("part", part)
    foldered.write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    blocks = spark.read.schema(foldered.schema).parquet(f"{path}/blocks")
    table = spark.createDataFrame(list(enumerate(centres.tolist())), "cell int, embedding array<double>").withColumn("part", part)
    sizes = blocks.groupBy("cell").agg(F.sum("n").alias("n"))
    (
        table.join(sizes, "cell", "left").select("cell", "part", F.coalesce("n", F.lit(0)).alias("n"), "embedding")
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    )
    return open_cells(spark, path, foldered.schema)


def open_cells(spark: SparkSession, path: str, schema: St.StructType | None = None) -> CellIndex:
    read = spark.read if schema is None else spark.read.schema(schema)
    return CellIndex(spark.read.parquet(f"{path}/cells"), read.parquet(f"{path}/blocks"))


def probe_cells(cells: DataFrame, queries: DataFrame, n: int, share: tuple[int, int] = PROBE_SHARE) -> DataFrame:
    """The questions with ``probes``: their nearest cells, as many as hold the asked share of all rows.

    The budget is that share, or ``PROBE_LEAST`` rows for each wanted one if this is more; the nearest cell
    is always in. There are ``MOST_CELLS`` cells at most, so the table fits a broadcast.
    """
    known = cells.orderBy("cell").toArrow()
    sizes, centres = known["n"].to_numpy(), _matrix(known["embedding"].to_pandas())
    budget = max(-(-int(sizes.sum()) * share[0] // share[1]), PROBE_LEAST * n)
    sent = queries.sparkSession.sparkContext.broadcast((sizes, centres, budget))

    @F.pandas_udf("array<int>")
    def probes(batch: pd.Series) -> pd.Series:
        sizes, centres, budget = sent.value
        out = []
        for row in _matrix(batch):
            order = np.argsort(-np.round(centres @ row, CELL_DIGITS), kind="stable")
            inside = np.cumsum(sizes[order]) <= budget
            inside[0] = True
            out.append(order[inside].astype(np.int32))
        return pd.Series(out, dtype=object)

    return queries.withColumn("probes", probes("embedding"))


def ann_topk(
    index: CellIndex, queries: DataFrame, n: int, query_key: str = "query_id", key: str = "chunk_id",
    settings: Settings = DEFAULTS, share: tuple[int, int] = PROBE_SHARE,
) -> DataFrame:
    """Approximate ``n`` nearest: a question meets the rows of its nearest cells, scored exactly.

    Folders without a probed cell are not read, blocks without one not scored.
    """
    asked = probe_cells(index.cells, queries, n, share)
    kind = index.blocks.schema["ids"].dataType.elementType
    schema = St.StructType().add(query_key, queries.schema[query_key].dataType).add(key, kind).add("score", St.DoubleType())
    folder = dict(index.cells.select("cell", "part").toPandas().itertuples(index=False))  # MOST_CELLS at most
    found = None
    for group in question_groups(asked, query_key, settings.query_block_rows, ("probes",)):
        probed = np.unique(np.concatenate([np.zeros(0, np.int64), *(p.values.to_numpy() for p in group["probes"])]))
        folders = sorted({int(folder[c]) for c in probed})
        part = _score_blocks(index.blocks.where(F.col("part").isin(folders)), group, n, query_key, key, schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found, query_key, "score", n, key)


def vector_centroid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(pos, value): the unit mean vector, one row per dimension."""
    means = (
        vectors.select(F.posexplode(column).alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
    )
    norm = means.agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    return means.join(F.broadcast(norm)).select(  # norm is one row
        "pos",
        F.when(F.col("norm") == 0, F.col("mean"))
        .otherwise(F.col("mean") / F.col("norm"))
        .alias("value"),
    )
