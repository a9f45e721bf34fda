"""Steps whose memory and shuffles must not grow faster than their input."""

from __future__ import annotations

import re
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as St

from askloom import session
from askloom.functions import text as T
from askloom.functions import udfs
from askloom.operators import articles, chunking, dense, lexical, matching
from askloom.plans.retrieve import ingest
from askloom.settings import DEFAULTS


def peak_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hashing_lists_the_words_of_a_slice_only():
    texts = pd.Series([" ".join(f"word{(i * 7 + j) % 5000}" for j in range(300)) for i in range(3000)] + [None, ""])
    found, peak = peak_mb(lambda: udfs.hashed_vectors(texts, 16))
    assert peak < 15
    alone = np.concatenate([udfs.hashed_vectors(texts.iloc[[i]], 16) for i in (0, 1500, 2999, 3000, 3001)])
    assert (found[[0, 1500, 2999, 3000, 3001]] == alone).all()
    assert udfs.hashed_vectors(pd.Series([], dtype=object), 16).shape == (0, 16)


def test_folding_holds_a_slice_only():
    texts = [None if i % 500 == 3 else f"ﬁne ① {i} " + "é" * 3000 for i in range(3000)]
    batch = pa.array(texts)
    found, peak = peak_mb(lambda: udfs.nfkc.func(batch))
    assert peak < 10
    assert found.to_pylist() == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_an_embedder_gets_bounded_batches(spark):
    def model(batch):
        assert len(batch) <= udfs.EMBED_ROWS
        return np.array([[len(t or ""), 1.0] for t in batch])

    df = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") % 100 > 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("t"))
    got = udfs.embed_column(df, "t", embedder=model).collect()
    assert [r["embedding"] for r in got] == [[float(len(r["t"] or "")), 1.0] for r in got]


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def test_postings_are_made_by_one_shuffle(spark, tmp_path, monkeypatch):
    """Texts are dealt out by block once; repeated and null ids, empty and null texts count as they did."""
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 8)
    monkeypatch.setattr(lexical, "TASK_TOKENS", 100)
    rows = [(f"c{i}", f"alpha beta{i % 5} beta{i % 5} gamma{i}") for i in range(60)]
    rows += [("c7", "alpha beta2 beta2 gamma7"), ("empty", ""), ("none", None), (None, "alpha omega")]
    chunks = chunk_frame(spark, rows)
    plan = plan_of(lexical.posting_blocks(chunks, 8, 8, tasks=4))
    assert plan.count("Exchange") == 1
    index = lexical.build_index(chunks, str(tmp_path / "index"))
    counts, length = Counter(), {}
    for key, text in rows:
        counts.update((key, w) for w in (text or "").split())
        length.setdefault(key, max(len((text or "").split()), 1))
    got = {(r["chunk_id"], r["term"]): (r["tf"], r["doc_len"]) for r in index.postings.collect()}
    assert got == {(k, w): (n, length[k]) for (k, w), n in counts.items()} and index.postings.count() == len(got)
    for r in index.blocks.collect():
        tfs, lens = [e["tf"] for e in r["entries"]], [e["doc_len"] for e in r["entries"]]
        assert (r["n"], r["max_tf"], r["min_len"]) == (len(tfs), max(tfs), min(lens))


def test_opened_blocks_are_summed_where_they_are(spark, tmp_path, monkeypatch):
    """However many pairs there are, entries move to their block once and no sum of a chunk moves."""
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 16)
    chunks = chunk_frame(spark, [(f"c{i:03d}", f"waa wb{i % 3} wc{i % 11}") for i in range(300)])
    index = lexical.build_index(chunks, str(tmp_path / "index"))
    questions = spark.createDataFrame([(i, f"waa wb{i} wc{i}") for i in range(3)], "query_id int, query string")
    asked = lexical.asked_terms(index, lexical.question_terms(questions, "query_id", "query"), "query_id")
    pairs = index.blocks.join(asked, ["part", "term"]).select("query_id", "block").distinct()
    scored = lexical.block_scores(index, asked, "query_id", DEFAULTS, pairs)
    plan = plan_of(scored)
    assert "hashpartitioning(block" in plan and "hashpartitioning(query_id" not in plan
    as_set = lambda df: {(r["query_id"], r["chunk_id"], r["score"]) for r in df.collect()}
    whole = as_set(lexical.block_scores(index, asked, "query_id", DEFAULTS))
    few = as_set(lexical.block_scores(index, asked, "query_id", DEFAULTS, pairs, few=True))
    assert as_set(scored) == few == whole and len(whole) == 900


def test_the_drawn_rows_are_the_first_by_md5(spark):
    rows = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    order = [r["chunk_id"] for r in rows.orderBy(F.md5("chunk_id"), "chunk_id").limit(50).collect()]
    drawn = dense.draw_rows(rows, "chunk_id", 50, 4000)
    assert [r["chunk_id"] for r in drawn.collect()] == order
    assert "< 06666666" in plan_of(drawn)
    # a bound that leaves too few rows is not used
    assert [r["chunk_id"] for r in dense.draw_rows(rows, "chunk_id", 50, 1 << 20).collect()] == order


def test_large_blocks_are_compared_in_parts():
    """A group of 30,000 rows is one block, which no row is sent to twice, in bounded memory."""
    rng = np.random.default_rng(3)
    n = 12_000
    vectors = (rng.random((n, 16)) < 0.2) * rng.integers(1, 4, (n, 16)).astype(float)
    rows = pd.DataFrame({"position": rng.permutation(n) // 2, "doc_id": np.arange(n), "_row": np.arange(n), "embedding": list(vectors)})
    left, right = rows.sample(n - 500, random_state=1), rows.sample(n - 700, random_state=2)
    got, peak = peak_mb(lambda: articles._has_near(0.97)(left, right))
    assert articles.SLICE_ROWS >= 30_000 and peak < 90
    unit, want = articles._unit(rows["embedding"]), set()
    order = np.lexsort((rows["doc_id"], rows["position"]))
    place = np.empty(n, int)
    place[order] = np.arange(n)
    earlier = np.sort(right["_row"].to_numpy())
    for row in left["_row"].sample(300, random_state=4):
        near = earlier[(unit[earlier] @ unit[row] > 0.97) & (place[earlier] < place[row])]
        assert (row in set(got["_row"])) == bool(len(near))


def test_folding_copies_no_ascii_batch():
    """A batch of ASCII texts stays as it is; among others only those that may change become Python strings."""
    plain = pa.array(["plain text " * 50, None, ""] * 1000)
    held = pa.total_allocated_bytes()
    assert udfs.nfkc.func(plain).equals(plain) and pa.total_allocated_bytes() == held
    mixed = pa.array([None if i % 7 == 3 else "" if i % 7 == 4 else f"x{i}" + "\ufb01\u2460" * (i % 3) for i in range(1000)])
    for batch in (mixed, mixed.slice(5, 600), mixed.slice(0, 0)):
        assert udfs.nfkc.func(batch).to_pylist() == [t and unicodedata.normalize("NFKC", t) for t in batch.to_pylist()]


def test_scores_of_many_questions_are_made_in_small_slices():
    rng = np.random.default_rng(5)
    docs = np.round(rng.normal(size=(4096, 16)), 1)
    docs[7] = 0.0
    ids = np.array([f"c{i:05d}" for i in rng.permutation(len(docs))], dtype=object)
    asked = np.concatenate([np.round(rng.normal(size=(2000, 16)), 1), np.zeros((1, 16))])
    (rows, found, values), peak = peak_mb(lambda: dense._best(asked, ids, docs, 5))
    assert peak < 40
    for q in (0, 999, 2000):
        scores = np.round(docs @ asked[q], 6) + 0.0
        order = np.lexsort((ids, -scores))[:5]
        got = sorted(zip(found[rows == q], values[rows == q]), key=lambda x: (-x[1], x[0]))
        assert got == list(zip(ids[order], scores[order])) and not np.signbit(values[values == 0]).any()


def test_a_task_sums_a_bounded_number_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 16)
    monkeypatch.setattr(lexical, "TASK_BLOCKS", 3)
    index = lexical.build_index(chunk_frame(spark, [(f"c{i:03d}", f"waa wb{i % 3}") for i in range(300)]), str(tmp_path / "index"))
    questions = spark.createDataFrame([(i, f"waa wb{i}") for i in range(3)], "query_id int, query string")
    asked = lexical.asked_terms(index, lexical.question_terms(questions, "query_id", "query"), "query_id")
    pairs = index.blocks.join(asked, ["part", "term"]).select("query_id", "block").distinct()
    scored = lexical.block_scores(index, asked, "query_id", DEFAULTS, pairs)
    tasks = -(-pairs.select("block").distinct().count() // 3)
    assert set(re.findall(r"hashpartitioning\(block#\d+L, (\d+)\)", plan_of(scored))) == {str(tasks)} and tasks > 4
    as_set = lambda df: {(r["query_id"], r["chunk_id"], r["score"]) for r in df.collect()}
    assert as_set(scored) == as_set(lexical.block_scores(index, asked, "query_id", DEFAULTS))
    none = lexical.block_scores(index, asked, "query_id", DEFAULTS, pairs.limit(0))
    assert none.count() == 0


def test_texts_of_one_window_are_not_split(spark, monkeypatch):
    texts = ["a", " a  b ", "", " \t\n", None, "a\u00a0b c\x85", "a\r\n\fb\x0b", "\u2028 x y z", "a b c d e", "a  b   c  d    e   f g ",
             "aaaa bbbb", "\x1c \x1c", "word " * 40, "1 2 3 4 5 6 7 8"]
    rows = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "doc_id int, source string, text string")
    want = set()
    for i, t in enumerate(texts):
        words = re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", t or "")
        count = 0 if not words else -(-max(len(words) - 4, 0) // 3) + 1
        want |= {(i, n, "".join(words[n * 3 : n * 3 + 4])) for n in range(count)}
    got = chunking.chunk_flat(rows, 4, 1).select("doc_id", "chunk_index", "text")
    assert {tuple(r) for r in got.collect()} == want
    monkeypatch.setattr(T, "tokens", lambda c: F.raise_error(F.lit("split")).cast("array<string>"))
    short = rows.where(F.col("doc_id").isin(0, 1, 5, 6, 10, 11))
    assert chunking.chunk_flat(short, 4, 1).count() == 6


def test_written_tables_get_small_batches(spark):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "n"])

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("t"))
    before = spark.conf.get(conf, None)
    got = session.cut_lineage(texts.mapInArrow(sizes, "bytes long, n long")).collect()
    assert sum(r["n"] for r in got) == 3000 and max(r["bytes"] for r in got) < 1.5 * session.BATCH_BYTES
    spark.conf.set(conf, "7m")
    try:
        with pytest.raises(ValueError), session.small_batches(spark):
            assert spark.conf.get(conf) == str(session.BATCH_BYTES)
            raise ValueError
        assert spark.conf.get(conf) == "7m"
    finally:
        spark.conf.unset(conf)
    assert spark.conf.get(conf, None) == before


def test_ingest_sends_small_batches_to_python(spark, tmp_path):
    def model(batch):
        return np.array([[batch.str.len().sum(), len(batch)]] * len(batch), dtype=np.float64)

    docs = spark.range(0, 1500, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s/"), F.col("id")).alias("source"), F.lit("a").alias("source_rel"),
        F.lit("a").alias("topic"), F.lit("en").alias("subtopic"), F.repeat(F.lit("abcdefg "), 480).alias("text"),
    )
    store = ingest(docs, path=str(tmp_path / "corpus"), embedder=model)
    vectors = [r["embedding"] for r in dense.unpack_vectors(store.vectors).collect()]
    assert len(vectors) == store.chunks.count() == 1500
    assert max(v[0] for v in vectors) < 1.5 * session.BATCH_BYTES


def test_ids_are_ordered_by_document_not_by_hit():
    """Copies of a text tie with one another for every question."""
    ids = np.array([f"c{i:05d}" for i in np.random.default_rng(3).permutation(4096)], dtype=object)
    assert len(ids) * 244 < dense.MAX_SCORE_CELLS
    asked = np.eye(4)[np.arange(1000) % 4]
    (rows, found, values), peak = peak_mb(lambda: dense._best(asked, ids, np.tile([[1.0, 0.0, 0.0, 0.0]], (4096, 1)), 3))
    assert peak < 75
    assert found.tolist() == ["c00000", "c00001", "c00002"] * 1000 and rows.tolist() == np.repeat(np.arange(1000), 3).tolist()
    assert values.tolist() == np.repeat(np.arange(1000) % 4 == 0, 3).astype(float).tolist()


def test_pairs_of_common_passages_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(matching, "PAIR_ROWS", 100)
    asked = pd.DataFrame({"query_id": range(30), "query": ["", "a", "ab", "not there", "b a"] * 6})
    schema = St.StructType().add("query_id", St.LongType()).add("target", St.StringType())
    run = matching._search(spark, asked, schema, "body", "query")
    texts = ["ab ab", "", None, "b a"] * 50
    held = [(f"t{i}", t) for i, t in enumerate(texts) if t is not None]
    batch = pa.RecordBatch.from_pydict({"target": [t for t, _ in held], "body": [b for _, b in held]})
    parts = list(run(iter([batch, batch.slice(0, 2)])))
    # a batch ends with the text that fills it
    assert len(parts) > 20 and max(p.num_rows for p in parts) < 100 + len(asked)
    got = Counter((k, t) for p in parts for k, t in zip(p["query_id"].to_pylist(), p["target"].to_pylist()))
    pairs = zip(asked["query_id"], asked["query"])
    assert got == Counter((k, t) for k, q in pairs for t, b in [*held, *held[:2]] if q in b)
