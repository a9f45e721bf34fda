import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import nbsvm

SMALL = nbsvm.Settings(rows_per_class=200, bits=14)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, good int, quality int, draw int"


def seen(settings):
    return np.zeros(1 << settings.bits, bool)


def row(text, settings=SMALL):
    return nbsvm.buckets(np.frombuffer(text.encode(), np.uint8), settings, seen(settings))


def corpus(spark, n=600):
    """Every third text is bad: half of those by signs, half by words said again and again."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(8, 60)))]
        if i % 6 == 0:
            words = [w + "%%" for w in words]
        if i % 6 == 3:
            words = [w for w in words[:9] for _ in range(4)]
        rows.append((i, " ".join(words), "xx" if i % 2 else "en", "s", 1, "c", 1, 2, 3))
        labels.append((i, int(i % 3 != 0)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_rows_are_scored_well_and_never_learned_from(spark):
    docs, labels, truth = corpus(spark)
    got = nbsvm.scores(docs, labels, settings=SMALL)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    turned = labels.withColumn("quality", F.when(nbsvm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in nbsvm.scores(docs, turned, settings=SMALL).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = nbsvm.scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == c] for c in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.99 and np.mean([r.predicted for r in bad]) < 0.1


def test_descent_reaches_the_optimum_of_the_dual():
    """The duality gap closes: no other weights have a lower hinge loss."""
    rng = np.random.default_rng(3)
    settings = nbsvm.Settings(bits=6, tolerance=1e-7, epochs=5000)
    rows = [np.sort(rng.choice(64, 12, replace=False)) for _ in range(80)]
    good = np.array([(r < 32).sum() + rng.normal(0, 1.5) > 6 for r in rows])
    values = [rng.random(12) for _ in rows]
    weights, constant = nbsvm.descend(rows, values, good, settings)
    sign, share = np.where(good, 1, -1), good.mean()
    cost = np.where(good, 0.5 / share, 0.5 / (1 - share))

    def primal(w):
        margin = np.array([w[:-1][r] @ v + w[-1] for r, v in zip(rows, values, strict=True)]) * sign
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - margin)).sum()

    best = np.append(weights, constant)
    least = primal(best)
    for size in (1e-1, 1e-2, 1e-3):
        assert all(primal(best + rng.normal(0, size, 65)) >= least - 1e-6 for _ in range(200))


def test_ratios_are_of_indicators():
    rows, good = [row("aa aa"), row("aa bb"), row("bb")], np.array([True, True, False])
    ratios = nbsvm.log_ratios(rows, good, SMALL)
    n = 1 << SMALL.bits
    p = np.bincount(np.concatenate(rows[:2]), minlength=n) + 1.0
    q = np.bincount(rows[2], minlength=n) + 1.0
    assert np.allclose(ratios, np.log(p / p.sum()) - np.log(q / q.sum()))


def test_features_against_a_plain_version(monkeypatch):
    """Bytes and echoes, whatever the size of a block."""

    def plain(text):
        raw, found = text.encode(), set()
        for order in (1, 2, 3, 4):
            for i in range(len(raw) - order + 1):
                code = np.array([sum(raw[i + j] << 8 * j for j in range(order))], np.uint32)
                found.add(int(nbsvm.mixed(code, order, SMALL.bits)[0]))
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in "".join(c if ord(c) > 32 else " " for c in text).split(" ") if w]
        marks = [next((b for b in (1, 2, 3) if b <= i and words[i - b] == w), 0) for i, w in enumerate(words)]
        for order in (1, 2, 3, 4):
            for i in range(len(marks) - order + 1):
                code = 0
                for m in marks[i : i + order]:
                    code = code * 4 + m
                found.add(int(nbsvm.mixed(np.array([code], np.uint32), 8 + order, SMALL.bits)[0]))
        return sorted(found)

    rng = np.random.default_rng(9)
    texts = ["", " ", "a", "Ab ab  AB\nc", "été Été x\tx x y x", *(" ".join(rng.choice(["to", "To", "x", "é", "\n"], 40)) for _ in range(30))]
    for block in (1 << 20, 7):
        monkeypatch.setattr(nbsvm, "BLOCK", block)
        for text in texts:
            assert row(text).tolist() == plain(text)


def test_odd_rows(spark):
    docs, labels, _ = corpus(spark, 120)
    rows = [(None, "a%%", None, None, None, None, None, None, None), (900, None, "qq", "s", 1, "c", 1, 2, 3), (901, "", "en", "s", 1, "c", 1, 2, 3),
            (903, "word " * 900_000, "en", "s", 1, "c", 1, 2, 3), (900, "abc", "en", "s", 1, "c", 1, 2, 3), (904, "x" * 3_000_000, "en", "s", 1, "c", 1, 2, 3)]
    odd = spark.createDataFrame(rows, SCHEMA)
    known = labels.union(spark.createDataFrame([(5, None), (None, 1), (77777, 1)], "doc_id long, quality int"))
    got = nbsvm.scores(docs.union(odd), known, settings=SMALL).collect()
    mine = [r for r in got if r.doc_id is None or r.doc_id >= 900]
    assert len(mine) == 6 and all(0 <= r.score <= 1 for r in mine)
    assert len({r.score for r in mine if r.doc_id == 901} | {r.score for r in mine if r.doc_id == 900}) == 2


def test_without_labels_or_documents(spark):
    docs, labels, _ = corpus(spark, 12)
    assert {r.score for r in nbsvm.scores(docs, labels.where("quality > 5"), settings=SMALL).collect()} == {0.0}
    assert {r.score for r in nbsvm.scores(docs, labels.withColumn("quality", F.lit(1)), settings=SMALL).collect()} == {1.0}
    assert nbsvm.scores(docs.where("doc_id < 0"), labels, settings=SMALL).count() == 0


@pytest.mark.parametrize("good", [[1, 0], [1, 0, 0, 1]])
def test_tiny_samples(good):
    model = nbsvm.fit([row("abc") if g else row("%%% %%%") for g in good], good, list(range(len(good))), SMALL)
    assert model.score(row("abc")) > model.score(row("%%% %%%"))
