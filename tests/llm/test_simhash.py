"""SimHash links and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from askloom.llm import components, simhash

DOCS = "doc_id long, text string, component_id string, fp int"


def brute(rows):
    """doc_id -> (fingerprint, smallest reachable id), comparing all pairs."""
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    near = [[j for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(rows))]
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        for j in group:
            out[rows[j][0]] = (f"{prints[j]:016x}", min(rows[k][0] for k in group))
    return out


def test_classes_match_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == brute(rows)


def test_odd_texts_and_clashing_columns(spark):
    long = "wort " * 40_000
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "two words"), (7, "a b c d"), (8, "a b c d"),
        (9, long), (10, long + "x"), (11, "Ärger ÄRGER ärger"), (12, "non breaking one two"),
    ]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == brute(rows)
    stay = simhash.deduplicate(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({c for _, c in got.values()})


def test_empty_table_and_null_ids(spark):
    assert simhash.classes(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, "a b c", "", 0), (None, "a b c", "", 0), (4, "a b c", "", 0)], DOCS)
    assert {r.component_id for r in simhash.classes(docs).collect()} == {4}
    assert [r.doc_id for r in simhash.deduplicate(docs).collect()] == [4]


@pytest.mark.parametrize("block", [4, 8192])
def test_links_connect_what_brute_force_connects(spark, block):
    """A dense ball, chains and strangers; small blocks force the split of hot buckets."""
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 1 << 63))
    ball = {center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (80, 3))}
    chain = [int(rng.integers(0, 1 << 63))]
    for step in range(20):
        chain.append(chain[-1] ^ (7 << (3 * step)))
    prints = sorted(ball | set(chain) | {int(x) for x in rng.integers(0, 1 << 63, 200)})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([Row(fp=x) for x in signed]), block=block)
    labels = {r.node: r.label for r in components.components(found).collect()}
    todo, want = set(signed), {}
    as_bits = dict(zip(signed, prints, strict=True))
    while todo:
        group, queue = set(), [todo.pop()]
        while queue:
            x = queue.pop()
            group.add(x)
            close = {y for y in todo if (as_bits[x] ^ as_bits[y]).bit_count() <= 3}
            todo -= close
            queue += close
        want |= {x: min(group) for x in group}
    assert {x: labels.get(x, x) for x in signed} == want


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame(path + star, "a long, b long")
    labels = {r.node: r.label for r in components.components(links).collect()}
    assert all(labels[i] == 0 for i in range(301)) and all(labels[1000 + i] == 1000 for i in range(200))
    assert components.components(links.where("a < 0")).count() == 0


def test_batches_that_split_groups_give_the_same_links():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    fp = np.sort(rng.integers(0, 8, 60)).astype(np.int64)
    first = np.bitwise_count(fp.view(np.uint64) ^ simhash.pivots(1)[0])
    key = np.repeat([1, 2, 3], 20)
    order = np.lexsort((first, key))
    cols = [key[order], np.zeros(60, int), np.zeros(60, int), np.zeros(60, int), fp[order]]
    names = ["key", "lo", "hi", "block", "fp"]
    whole = pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names)

    def solved(size):
        parts = [whole.slice(i, size) for i in range(0, 60, size)]
        return sorted(
            (int(a), int(b)) for batch in simhash.links_of(iter(parts))
            for a, b in zip(batch["a"].to_numpy(), batch["b"].to_numpy(), strict=True)
        )

    joins = lambda pairs: {frozenset(p) for p in pairs if p[0] != p[1]}
    assert joins(solved(60)) == joins(solved(7)) == joins(solved(1))
