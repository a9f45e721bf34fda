import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score string, id string, scaled int"
SMALL = H.Settings(positives=3, negatives=4, slab_rows=16, members=5, group_rows=10, step=4, centres=4)


def brute(rows, settings=SMALL, every=10):
    """Every anchor against every row, in Python's whole numbers."""
    clean = []
    for i, (vec_id, vector, label) in enumerate(rows):
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        scaled = np.floor(np.float64(np.array(vector, np.float32)) * settings.scale)
        if np.isfinite(scaled).all():
            clean.append((i, vec_id, [int(x) for x in scaled], label))
    out = []
    for i, vec_id, vector, label in clean:
        if vec_id % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, w, strict=False)), u, j, m) for j, u, w, m in clean if j != i)
        for minus, positive, _, _ in [x for x in scored if x[3] == label][: settings.positives]:
            low, high = (-minus * p for p in settings.band)
            fit = [(u, -s) for s, u, _, m in scored if m != label and low <= -100 * s <= high][: settings.negatives]
            out += [(vec_id, positive, n + 1, u, -minus, s) for n, (u, s) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, settings=SMALL, every=10):
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA).repartition(3)
    got = H.mine(df, anchors_every=every, settings=settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, seed, width=6, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, width))
    kind = rng.integers(0, 5, n)
    vectors = centres[kind] + rng.normal(0, spread, (n, width))
    return [(int(i), [float(np.float32(x)) for x in v], int(rng.integers(0, 3))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_pair(spark, seed):
    rows = clustered(230, seed)
    expected = brute(rows)
    assert len(expected) > 100 and mined(spark, rows) == expected


def test_ties_copies_and_repeated_ids(spark):
    rows = clustered(90, 3)
    rows += [(i, rows[20][1], rows[20][2]) for i in range(100, 190)]  # one vector for half the table
    rows += [rows[30], rows[30], (40, rows[7][1], 2)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(60, 4)
    rows += [(None, [1.0] * 6, 1), (70, None, 1), (80, [1.0] * 6, None), (90, [1.0, None], 1), (100, [float("nan")] * 6, 1),
             (110, [float("inf")] * 6, 1), (120, [], 1), (130, [0.0] * 6, 1), (140, [0.5, 0.25], 2), (150, [0.5] * 9, 1), (-20, [0.1] * 6, 0)]
    assert mined(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 3e5, 4)], int(i % 2)) for i in range(60)]
    assert mined(spark, rows) == brute(rows)
    rows += [(200, [3e38, 1.0, 1.0, 1.0], 1)]
    assert all(abs(x) <= 1 << 63 for r in mined(spark, rows) for x in r)


def test_nothing_to_mine(spark):
    rows = clustered(20, 6)
    assert mined(spark, []) == []
    assert mined(spark, [r for r in rows if r[0] % 10]) == []
    assert mined(spark, [(i, v, 1) for i, v, _ in rows]) == []
    assert mined(spark, [(i, v, i) for i, v, _ in rows]) == []


def test_walks_end_early_where_the_bound_allows():
    """On clustered vectors a list is left long before its end, without losing a row."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (40, 16))
    centres /= np.sqrt((centres**2).sum(1, keepdims=True))
    kind = rng.integers(0, 40, 4000)
    vectors = np.floor((centres[kind] + rng.normal(0, 0.02, (4000, 16))) * 256).astype(np.int64)
    members = np.flatnonzero(kind == 3)[:50]
    slab = H.Slab({"slab": 0, "n": 4000, "ids": np.arange(4000).tobytes(), "labels": np.zeros(4000, np.int64).tobytes(), "vectors": H.narrow(vectors)})
    block = H.Block.of({"rows": members.tobytes(), "labels": np.zeros(50, np.int64).tobytes(), "n": 50, "vectors": H.narrow(vectors[members])}, None)
    assert H.walk(block, slab, 5, True, 64) < 1000
    exact = vectors[members] @ vectors.T
    exact[np.arange(50), members] = -(1 << 40)
    who, score, _ = block.best
    for i in range(50):
        assert score[who == i].tolist() == sorted(exact[i], reverse=True)[:5]


def test_groups_and_blocks_are_bounded(spark):
    rows = [(i * 10, [1.0, 0.5], i % 3) for i in range(57)]  # all anchors, all in one cluster
    df = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)
    slabs = H.pack(H.usable(df, "vec_id", F.col("label"), "embedding", 256), 16)
    blocks = H.anchor_blocks(H.anchor_rows(slabs, 10), SMALL)
    sizes = [r.n for r in blocks.collect()]
    assert sum(sizes) == 57 and max(sizes) <= SMALL.members
    groups = H.groups_of(blocks, SMALL)
    for first, last in groups:
        assert blocks.where(F.col("block").between(first, last)).agg(F.sum("n")).first()[0] <= SMALL.group_rows
