import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.catalog import retrieval as catalog_retrieval
from askloom.functions import udfs
from askloom.operators import context, dense, fusion, lexical, matching
from askloom.plans import retrieve, views
from askloom.plans import retrieve as R
from askloom.settings import DEFAULTS, Settings

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]


def corpus_rows(n=60, seed=1):
    rng = random.Random(seed)
    return [
        (f"c{i:03d}", " ".join(rng.choice(WORDS[: rng.choice([4, 36])]) for _ in range(rng.randint(1, 30))))
        for i in range(n)
    ]


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string").withColumn("doc_type", F.lit("local"))


def loop_bm25(rows, terms):
    tokens = {c: t.split() for c, t in rows}
    n, avg = len(tokens), max(sum(max(len(t), 1) for t in tokens.values()) / len(tokens), 1)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = {}
    for c, t in tokens.items():
        tf, score = Counter(t), 0.0
        for term in terms:
            if tf[term]:
                idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                score += idf * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if score > 0:
            out[c] = round(score, 6)
    return out


def test_bm25_against_loop(spark, tmp_path):
    rows = corpus_rows()
    chunks = chunk_frame(spark, rows)
    questions = spark.createDataFrame([(1, "waa waa wbc"), (2, "zzz"), (3, "the wff waa")], "query_id int, query string")
    terms = lexical.question_terms(questions, "query_id", "query")
    want = {(q, c): s for q, ts in ((1, ["waa", "wbc"]), (3, ["wff", "waa"])) for c, s in loop_bm25(rows, ts).items()}
    index = lexical.build_index(chunks, str(tmp_path / "index"))
    assert index.postings.columns == ["chunk_id", "term", "tf", "doc_len"]
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.bm25_scores(index, terms).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    best = lexical.bm25_scores(index, terms, n=2).collect()
    for q in (1, 3):
        own = sorted(((-s, c) for (x, c), s in got.items() if x == q))[:2]
        assert [(-r["score"], r["chunk_id"]) for r in sorted(best, key=lambda r: r["rank"]) if r["query_id"] == q] == own


def skewed_rows(n=1200):
    """Half of the chunks have ``common``, in different numbers; ``rare`` is in eight of them."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 40))]
        words += ["common"] * (rng.choice([1, 1, 1, 2, 9]) if i % 2 else 0) + ["rare"] * (i % 150 == 7)
        rows.append((f"c{i:04d}", " ".join(words)))
    return rows


def test_blocks_that_cannot_win_are_not_opened(spark, tmp_path, monkeypatch):
    """The best rows are those of the exhaustive path, from a part of the postings."""
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 16)
    index = lexical.build_index(chunk_frame(spark, skewed_rows()), str(tmp_path / "index"))
    questions = spark.createDataFrame([(1, "common rare"), (2, "common"), (3, "rare waa"), (4, "common wbb wcc"), (5, "nothing")], "query_id int, query string")
    terms = lexical.question_terms(questions, "query_id", "query")
    every = {}
    for r in lexical.bm25_scores(index, terms).collect():
        every.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
    for n in (3, 8, 5000):
        best = {}
        for r in lexical.bm25_scores(index, terms, n=n).orderBy("rank").collect():
            best.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
        assert best == {q: sorted(rows)[:n] for q, rows in every.items()}
    asked = lexical.asked_terms(index, terms, "query_id")
    seeds, rest, _ = lexical.opened_blocks(index, asked, "query_id", DEFAULTS, 8)
    pairs = asked.join(seeds.unionByName(rest), "query_id")
    opened = index.blocks.join(pairs, ["part", "term", "block"]).groupBy("query_id").agg(F.sum("n")).collect()
    whole = index.blocks.join(asked, ["part", "term"]).groupBy("query_id").agg(F.sum("n")).collect()
    opened, whole = dict(map(tuple, opened)), dict(map(tuple, whole))
    assert all(opened[q] < whole[q] / 3 for q in (1, 3)) and all(opened[q] <= whole[q] for q in opened)


def test_bounds_hold_for_every_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 20)
    index = lexical.build_index(chunk_frame(spark, corpus_rows(200)), str(tmp_path / "index"))
    questions = spark.createDataFrame([(1, "waa wab wbc"), (2, "wff wcd")], "query_id int, query string")
    for settings in (DEFAULTS, Settings(bm25_k1=0.4, bm25_b=0.2)):
        asked = lexical.asked_terms(index, lexical.question_terms(questions, "query_id", "query"), "query_id")
        bounds = lexical.block_bounds(index, asked, "query_id", settings)
        place = index.blocks.select("block", F.inline("entries")).select("block", F.col("id").alias("chunk_id")).distinct()
        scores = lexical.block_scores(index, asked, "query_id", settings).join(place, "chunk_id")
        both = scores.join(bounds, ["query_id", "block"])
        assert both.count() == scores.count() > 100 and both.where("score > bound + 1e-6").count() == 0


def test_a_rare_term_reads_one_folder(spark, tmp_path):
    index = lexical.build_index(chunk_frame(spark, skewed_rows()), str(tmp_path / "index"))
    asked = lexical.asked_terms(index, spark.createDataFrame([(1, "rare")], "query_id int, term string"), "query_id")
    found = lexical.block_bounds(index, asked, "query_id", DEFAULTS)
    assert found.count() > 0
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert index.blocks.where("term = 'rare'").select("part").distinct().count() == 1
    assert index.blocks.select("part").distinct().count() > 4


def test_a_term_of_every_chunk_is_split(spark, tmp_path):
    """A term in every chunk scores in all of them, by a join whose hot side may be split."""
    chunks = chunk_frame(spark, [(f"c{i:04d}", f"everywhere w{i % 7}") for i in range(2000)])
    index = lexical.build_index(chunks, str(tmp_path / "index"))
    questions = spark.createDataFrame([(i, f"everywhere w{i}") for i in range(7)], "query_id int, query string")
    scored = lexical.bm25_scores(index, lexical.question_terms(questions, "query_id", "query"))
    assert scored.count() == 7 * 2000
    assert lexical.lexical_topk(index, questions, 5).where("rank = 1").count() == 7


@pytest.mark.parametrize("passage", ["", "a", "ai", "use", "we use ai", "we use ai daily here now", "é d", " x", "not there"])
def test_passages_of_any_length_are_found(spark, passage):
    bodies = spark.createDataFrame([("1", "we use ai daily here now"), ("2", "café d'or x"), ("3", "")], "target string, body string")
    asked = spark.createDataFrame([(1, passage)], "query_id int, query string")
    want = {t for t, b in (("1", "we use ai daily here now"), ("2", "café d'or x"), ("3", "")) if passage in b}
    assert {r["target"] for r in matching.containing(bodies, asked).collect()} == want


def test_many_passages_against_each_text(spark, monkeypatch):
    """Nested, repeated, overlapping, empty, null and long passages, in several groups; no pair of tables is joined."""
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    bodies = [(f"b{i}", draw(rng.choice([0, 5, 60, 300]))) for i in range(40)] + [("null", None), ("b0", draw(50))]
    passages = [(i, draw(rng.choice([1, 2, 3, 4, 6]))) for i in range(80)] + [(900, ""), (901, None), (3, "ab"), (3, "ab")]
    passages += [(1000 + i, bodies[i][1][2:250]) for i in range(12)] + [(1100 + i, bodies[i][1][1:] + "z") for i in range(5)]
    want = sorted((q, t) for t, b in bodies for q, p in set(passages) if b is not None and p is not None and p in b)
    monkeypatch.setattr(matching, "HEAD_CHARS", 4)
    monkeypatch.setattr(matching, "GROUP_HEADS", 60)
    monkeypatch.setattr(matching.Passages.__init__, "__defaults__", (4,))
    found = matching.containing(
        spark.createDataFrame(bodies, "target string, body string").repartition(3), spark.createDataFrame(passages, "query_id int, query string")
    )
    assert sorted((r["query_id"], r["target"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") > 3 and "Join" not in plan and "Cartesian" not in plan


def test_no_passages(spark):
    bodies = spark.createDataFrame([("b", "text")], "target string, body string")
    assert matching.containing(bodies, spark.createDataFrame([], "query_id int, query string")).count() == 0


def test_the_stored_corpus_is_built_once_and_opened_after(spark):
    sf = "/root/testdata/sf0.001"
    first, second = views.retrieval_corpus(spark, sf), views.retrieval_corpus(spark, sf)
    assert first.path == second.path
    opened = retrieve.Corpus.open(spark, first.path)
    assert opened.chunks.count() == opened.vectors.agg(F.sum("n")).first()[0] > 0
    plan = fusion.ranked_lists(
        opened.index, opened.vectors, retrieve.first_variants(views.questions(spark, sf)), 5
    )._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_type" not in plan and "parent_id" not in plan  # no chunk row is read for scoring


def test_single_lexical_candidate_scores_04(spark, tmp_path):
    chunks = chunk_frame(spark, [("a", "alpha beta"), ("b", "gamma")])
    q = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    index = lexical.build_index(chunks, str(tmp_path / "index"))
    assert lexical.lexical_topk(index, q, 5).first()["similarity"] == pytest.approx(0.4)


def vectors(spark, n, name, seed, dim=8):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(f"{name}{i:04d}", v.tolist()) for i, v in enumerate(m)]
    key = "chunk_id" if name == "d" else "query_id"
    return m, spark.createDataFrame(rows, f"{key} string, embedding array<double>")


def brute(qm, dm, k):
    scores = np.round(qm @ dm.T, 6)
    out = set()
    for i, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]
        out |= {(f"q{i:04d}", f"d{j:04d}", r + 1) for r, j in enumerate(best)}
    return out


def as_set(df):
    return {(r["query_id"], r["chunk_id"], r["rank"]) for r in df.collect()}


def test_exact_nearest_both_paths(spark):
    dm, docs = vectors(spark, 300, "d", 1)
    qm, queries = vectors(spark, 23, "q", 2)
    want = brute(qm, dm, 7)
    assert as_set(dense.nearest(docs.repartition(5), queries, 7)) == want
    blocks = Settings(query_block_rows=5)
    assert as_set(dense.nearest(docs, queries, 7, settings=blocks, block_rows=70)) == want


def test_ann_recall(spark, tmp_path):
    """Nine in ten of the nearest, and under a third of the rows scored."""
    dm, docs = vectors(spark, 3000, "d", 3)
    qm, queries = vectors(spark, 30, "q", 4)
    exact = {x[:2] for x in brute(qm, dm, 5)}
    index = dense.build_cells(docs, str(tmp_path / "cells"))
    found = {x[:2] for x in as_set(dense.ann_topk(index, queries, 5, settings=Settings(query_block_rows=7)))}
    assert len(exact & found) / len(exact) >= 0.9
    sizes = {r["cell"]: r["n"] for r in index.cells.collect()}
    assert sum(sizes.values()) == 3000
    for r in dense.probe_cells(index.cells, queries, 5).collect():
        assert len(r["probes"]) >= 1 and sum(sizes[c] for c in r["probes"]) <= 0.195 * 3000 + 1


def test_cells_of_equal_and_few_rows(spark, tmp_path):
    """One vector for all rows: one cell holds them in several blocks, and all are found."""
    docs = spark.createDataFrame([(f"d{i:04d}", [1.0, 0.0]) for i in range(100)], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [0.6, 0.8])], "query_id string, embedding array<double>")
    index = dense.build_cells(docs, str(tmp_path / "same"))
    assert [r["chunk_id"] for r in dense.ann_topk(index, queries, 3).orderBy("rank").collect()] == ["d0000", "d0001", "d0002"]
    few = dense.build_cells(docs.limit(2), str(tmp_path / "few"))
    assert dense.ann_topk(few, queries, 3).count() == 2


def test_packed_vectors_stay_where_they_are(spark, tmp_path):
    """Stored blocks give the same rows, and the plan has no exchange below the scoring."""
    dm, docs = vectors(spark, 500, "d", 5)
    qm, queries = vectors(spark, 9, "q", 6)
    dense.pack_vectors(docs, rows=64).write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    assert blocks.agg(F.max("n"), F.sum("n")).first() == (64, 500)
    found = dense.nearest(blocks, queries, 7)
    assert as_set(found) == brute(qm, dm, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.rindex("MapInArrow"):]
    rows = {r["chunk_id"]: r["embedding"] for r in dense.unpack_vectors(blocks).collect()}
    assert rows == {r["chunk_id"]: r["embedding"] for r in docs.collect()}


def test_hashed_vectors_are_unit_length(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    got = [np.linalg.norm(r["embedding"]) for r in udfs.embed_column(df, "t").collect()]
    assert got == pytest.approx([1, 0, 0])


def lists_frame(spark, lists):
    rows = [(1, v, "dense", r, c, s) for v, l in enumerate(lists) for r, (c, s) in enumerate(l, 1)]
    return spark.createDataFrame(rows, "query_id int, variant_id int, list_type string, rank int, chunk_id string, similarity double")


def test_rrf_does_not_depend_on_list_order(spark):
    lists = [[("a", 0.9), ("b", 0.5)], [("b", 0.8), ("c", 0.1)], [("c", 0.3)]]
    results = []
    for order in (lists, lists[::-1]):
        out = fusion.rrf(lists_frame(spark, order), 5).orderBy("rank").collect()
        results.append([(r["chunk_id"], r["rrf_score"], r["similarity"]) for r in out])
    assert results[0] == results[1]
    assert [x[0] for x in results[0]] == ["b", "c", "a"]
    assert results[0][0][1:] == (round(1 / 62 + 1 / 61, 9), 0.8)


def graded(spark, flags, floor=2):
    rows = [(1, f"c{i}", i, f) for i, f in enumerate(flags, 1)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, relevant boolean")
    return [r["chunk_id"] for r in fusion.grade_with_floor(df, floor).orderBy("rank").collect()]


def test_grading_floor(spark):
    assert graded(spark, [False] * 5) == ["c1", "c2"]
    assert graded(spark, [False, False, False, True, False]) == ["c4", "c1"]
    assert graded(spark, [True, False, True, True]) == ["c1", "c3", "c4"]
    assert graded(spark, [False]) == ["c1"]


def candidate_rows(spark, n, sources, sims):
    rows = [
        (1, "brand trust", i, f"c{i}", "d", s, "", "", "", "", False, "local", f"p{i % 2}", "brand words" if i % 2 else "other", sim, None)
        for i, (s, sim) in enumerate(zip(sources, sims), 1)
    ]
    assert len(rows) == n
    return spark.createDataFrame(
        rows,
        "query_id int, query string, rank int, chunk_id string, source string, source_rel string, topic string, "
        "subtopic string, section string, pages string, has_table boolean, doc_type string, parent_id string, "
        "text string, similarity double, rerank_score double",
    ).withColumn("chunk_type", F.lit("child"))


def test_rerank_puts_best_first_and_keeps_the_tail(spark):
    rows = candidate_rows(spark, 5, ["s"] * 5, [0.1, 0.9, 0.2, 0.8, 0.3])
    out = fusion.rerank(rows.drop("rerank_score"), 2, Settings(rerank_candidates=4)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["c2", "c4", "c1", "c3", "c5"]
    assert out[0]["rerank_score"] == pytest.approx(0.54) and out[-1]["rerank_score"] is None
    assert out[2]["rerank_score"] == pytest.approx(0.6 * 0.1 + 0.25 * 0.5)


def test_diversify(spark):
    rows = candidate_rows(spark, 6, ["A", "a ", "a", "", "", "b"], [0.5] * 6)
    rows = rows.withColumn("source", F.lit(""))
    pick = lambda **kw: [r["chunk_id"] for r in fusion.diversify(rows, **kw).orderBy("rank").collect()]
    assert pick(limit=10) == ["c1", "c2", "c4", "c5", "c6"]
    assert pick(limit=3) == ["c1", "c2", "c4"]
    assert pick(limit=3, per_source=0) == ["c1", "c2", "c3"]


def test_parents_follow_children(spark):
    rows = candidate_rows(spark, 4, ["s"] * 4, [0.5, 0.6, 0.7, 0.9])
    parents = spark.createDataFrame(
        [("p0", "d", "s", "", "", "", "", False, "zero"), ("p1", "d", "s", "", "", "", "", False, " one ")],
        "parent_id string, source string, source_rel string, topic string, subtopic string, section string, "
        "pages string, has_table boolean, text string",
    )
    out = fusion.with_parents(rows, parents, 3, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["c1", "c2", "c3", "parent::p1", "parent::p0"]
    assert [r["similarity"] for r in out[3:]] == [0.7, 0.6]
    assert out[3]["text"] == "one"


def test_budget(spark):
    rows = spark.createDataFrame(
        [(1, False, 1, 4), (1, False, 2, 5), (1, True, 1, 2), (1, True, 2, 1)],
        "query_id int, is_dynamic boolean, rank int, tokens int",
    )
    kept = context.token_budget(rows, 10).collect()
    assert sorted((r["is_dynamic"], r["rank"]) for r in kept) == [(False, 1), (False, 2)]
    totals = context.bundle_totals(context.token_budget(rows, 11)).first()
    assert (totals["local_tokens"], totals["dynamic_tokens"], totals["total_tokens"]) == (9, 2, 11)


def test_whole_pipeline_on_a_small_corpus(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus_rows(40, 5))]
    docs = spark.createDataFrame(rows, "doc_id int, text string").select(
        "doc_id", F.concat(F.lit("s/"), F.col("doc_id").cast("string")).alias("source"),
        F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("source_rel"),
        F.lit("t").alias("topic"), F.lit("").alias("subtopic"), "text",
    )
    corpus = R.ingest(docs)
    questions = spark.createDataFrame([(1, "waa wab wac wad"), (2, "zzzzzz yyyyyy")], "query_id int, query string")
    result = R.retrieve(corpus, questions, 4, relevant=F.lit(False), corrective_below=3)
    out = result.context.orderBy("query_id", "rank").collect()
    per_source = Counter((r["query_id"], r["source_rel"]) for r in out if r["chunk_type"] != "parent")
    assert per_source and max(per_source.values()) <= 2
    assert {r["query_id"] for r in result.corrected.collect()} == {1, 2}
    assert len([r for r in out if r["chunk_type"] == "parent"]) > 0
    diag = {r["query_id"]: r for r in R.diagnostics(result).collect()}
    assert diag[1]["corrective_pass_used"] and diag[1]["fused_rows"] == 7 and diag[1]["graded_rows"] == 2
    assert diag[2]["lexical_candidates"] == 0
    again = R.retrieve(corpus, questions, 4)
    assert again.corrected.count() == 0 and again.confidence.count() == 2


def test_signals(spark, value):
    rows = spark.createDataFrame(
        [(1, f"c{i}", s) for i, s in enumerate([0.9, 0.5, 0.4, 0.2, 0.1])], "query_id int, chunk_id string, similarity double"
    )
    questions = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r[0]: r[1] for r in context.retrieval_signal(rows, questions).collect()}
    assert got == {1: pytest.approx(0.7 * 0.5 + 0.3 * 0.5), 2: 0.0}
    calibrated = lambda *a: value(context.calibrated(*[F.lit(x) for x in a]))
    assert calibrated(0.8, 0.4, False, "partial") == pytest.approx(0.63)
    assert calibrated(0.8, 0.4, False, "not_grounded") == pytest.approx(0.245)
    assert calibrated(0.02, 0.4, True, None) == 0.05
    assert calibrated(0.9, 0.4, True, None) == 0.25


def test_ann_recall_of_the_registered_parameters(spark):
    sf = "/root/testdata/sf0.01"
    exact = dense.nearest(
        views.retrieval_corpus(spark, sf).vectors, catalog_retrieval.embedded_questions(spark, sf),
        DEFAULTS.dense_candidates(views.K),
    )
    want = {x[:2] for x in as_set(exact)}
    found = {x[:2] for x in as_set(catalog_retrieval.ann_topk(spark, sf))}
    assert len(want & found) / len(want) >= 0.9
