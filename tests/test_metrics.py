import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askloom.functions import udfs
from askloom.operators import metrics


def test_one_relevant_document_at_rank_three(spark):
    sources = spark.createDataFrame([(1, f"d/{c}", i) for i, c in enumerate("abcde", 1)], "query_id int, source string, source_rank int")
    qrels = spark.createDataFrame([(1, "c"), (2, "x")], "query_id int, target string")
    matched = metrics.matched_ranks(sources, qrels)
    got = {r["query_id"]: r for r in metrics.retrieval_metrics(matched, qrels, 5).collect()}
    r = got[1]
    assert (r["precision_at_k"], r["recall_at_k"], r["ndcg_at_k"], r["first_hit_rank"]) == (0.2, 1.0, 0.5, 3)
    assert r["ap_at_k"] == r["mrr_at_k"] == pytest.approx(1 / 3, abs=1e-6)
    assert got[2]["hit_at_k"] == 0.0 and got[2]["first_hit_rank"] is None
    summary = metrics.macro_means(metrics.retrieval_metrics(matched, qrels, 5), ("hit_at_k",)).first()
    assert (summary["query_count"], summary["hit_at_k"]) == (2, 0.5)


def test_each_target_is_taken_once(spark):
    sources = spark.createDataFrame([(1, "x/a", 1), (1, "y/a", 2), (1, "z/a", 3)], "query_id int, source string, source_rank int")
    qrels = spark.createDataFrame([(1, "a"), (1, "k/y/a")], "query_id int, target string")
    got = sorted((r["source_rank"], r["target"]) for r in metrics.matched_ranks(sources, qrels).collect())
    assert got == [(1, "a"), (2, "k/y/a")]


def test_unique_sources(spark):
    rows = spark.createDataFrame([(1, 1, "A"), (1, 2, "a "), (1, 3, ""), (1, 4, "b"), (1, 6, "c")], "query_id int, rank int, source string")
    got = sorted((r["source_rank"], r["source"]) for r in metrics.unique_sources(rows, 5).collect())
    assert got == [(1, "a"), (2, "b")]


def test_doc_id_match(spark):
    c = spark.createDataFrame([("a/b/c.pdf",), ("c.pdf",), ("xc.pdf",)], "candidate string")
    t = spark.createDataFrame([("c.pdf",), ("b/c.pdf",)], "target string")
    got = {tuple(r) for r in metrics.match_doc_ids(c, t).select("candidate", "target").collect()}
    assert got == {("a/b/c.pdf", "c.pdf"), ("a/b/c.pdf", "b/c.pdf"), ("c.pdf", "c.pdf"), ("c.pdf", "b/c.pdf")}


def grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def loop_scores(ref, cand):
    r, c = ref.split(), cand.split()
    out = {}
    for n in (1, 2):
        o = sum((grams(r, n) & grams(c, n)).values())
        total = sum(grams(r, n).values()) + sum(grams(c, n).values())
        out[f"f{n}"] = 2 * o / total if o else 0.0
    logs = []
    for n in range(1, 5):
        o, total = sum((grams(r, n) & grams(c, n)).values()), max(sum(grams(c, n).values()), 1)
        logs.append(math.log((o or 0.1) / total))
    bp = 1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c)) if c else 0.0
    hit = sum((grams(r, 1) & grams(c, 1)).values()) > 0
    out["b1"] = bp * math.exp(logs[0]) if hit else 0.0
    out["b4"] = bp * math.exp(sum(logs) / 4) if hit else 0.0
    return out


def test_answer_scores_against_loop(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9)))
    rows = [(i, text(), text()) for i in range(60)] + [(99, "a b c d e", "a b c d e")]
    df = spark.createDataFrame(rows, "id int, reference string, candidate string")
    for r in metrics.ngram_scores(df, ("id",)).collect():
        _, ref, cand = next(x for x in rows if x[0] == r["id"])
        want = loop_scores(ref, cand)
        got = (r["token_f1"], r["rouge_2_f1"], r["bleu_1"], r["bleu_4"])
        assert got == pytest.approx((want["f1"], want["f2"], want["b1"], want["b4"]), abs=1e-6)


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_against_table(spark):
    rng = random.Random(4)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 90))], [rng.choice("abc") for _ in range(rng.randint(0, 90))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r["n"] for r in df.select(udfs.lcs_length("a", "b").alias("n")).collect()]
    assert got == [lcs(a, b) for a, b in rows]


def test_exact_match(value):
    assert value(metrics.exact_match(F.lit("A, b!"), F.lit("a B"))) == 1.0
    assert value(metrics.exact_match(F.lit("!"), F.lit(""))) == 1.0
    assert value(metrics.exact_match(F.lit("a"), F.lit("b"))) == 0.0
