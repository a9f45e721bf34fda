import re

import pytest

from askloom.llm import mixing
from askloom.llm.common import prefix_sums

SCHEMA = "doc_id long, source string, text string, size string, target int, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1, len(t or "")) for i, s, t in rows], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by rounds of sharing, as the rule reads."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + left * weight[s] / total >= most * sizes[s]}
        if not full:
            for s in open_:
                target[s] += left * weight[s] / total
            return target
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = float(most * sizes[s])
        open_ -= full
    return target


ROWS = (
    [(i, "hot", "w " * (i % 40)) for i in range(300)]
    + [(1000 + i, f"s{i % 7}", "w " * (i % 23)) for i in range(200)]
    + [(2000 + i, None, "n " * 5) for i in range(30)]
    + [(3000, "tiny", "one"), (3001, "empty", None), (3002, "empty", ""), (3003, "Zed", "w " * 30_000)]
)


def test_targets_and_budgets(spark):
    got = mixing.shares(table(spark, ROWS).repartition(5)).collect()
    sizes = {}
    for _, s, t in ROWS:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = filled(sizes)
    source = {i: s for i, s, _ in ROWS}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(ROWS)
    assert all(taken[s] == int(want[s] + 1e-6) or abs(taken[s] - want[s]) < 1 for s in sizes)


def test_reruns_agree_whatever_the_partitions(spark):
    runs = [
        sorted((r.doc_id, r.taken) for r in mixing.shares(table(spark, ROWS).repartition(n)).collect()) for n in (1, 9)
    ]
    assert runs[0] == runs[1]


def test_mix_repeats_and_cuts_texts(spark):
    docs = table(spark, ROWS)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.shares(docs).collect()}
    got, text = {}, {i: t for i, _, t in ROWS}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
        assert (text[r.doc_id] or "").startswith(r.text or "")
        assert r.n_chars == len(r.text or "")
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, "b", "z"), (None, None, None)]
    assert mixing.shares(table(spark, rows)).count() == 4
    assert mixing.mix(table(spark, rows)).count() >= 1
    assert mixing.shares(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [])).count() == 0


def test_prefix_sums_over_a_hot_group(spark):
    rows = [("h" if i % 3 else "k", i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(6)
    got = {(r.g, r.o): (r.v_before, r.v_total) for r in prefix_sums(df, "g", ["o"], {"v": "v"}).collect()}
    for g in "hk":
        before, total = 0, sum(v for x, _, v in rows if x == g)
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[g, o] == (before, total)
            before += v
