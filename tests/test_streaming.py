from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from askloom.functions import udfs
from askloom.operators import chunking, corpus, dense, lexical, sessions
from askloom.plans import retrieve
from askloom.settings import Settings
from askloom.sources import files, store
from askloom.sources.pointer import read_pointer
from askloom.streaming import jobs

SMALL = Settings(parent_size=6, parent_overlap=1, child_size=3, child_overlap=0)
DOC = "source string, text string, version int"


def test_ingest_stream_equals_batch(spark, tmp_path):
    feed, chunk_path, parent_path = (str(tmp_path / n) for n in ("feed", "chunks", "parents"))
    first = [(f"f{i}", f"word{i} " * (i + 3), 1) for i in range(6)]
    second = [("f1", "changed text now here", 2), ("f1", "older", 1), ("f9", "brand new file", 2), ("f2", " ", 2)]
    for batch in (first, second, second):
        spark.createDataFrame(batch, DOC).coalesce(1).write.mode("append").json(feed)
        stream = spark.readStream.schema(DOC).json(feed)
        jobs.ingest_stream(stream, chunk_path, parent_path, str(tmp_path / "cp"), SMALL, False).awaitTermination()
    final = {s: t for s, t, _ in first} | {"f1": "changed text now here", "f9": "brand new file"}
    docs = corpus.clean_documents(spark.createDataFrame(list(final.items()), "source string, text string"), False)
    for path, rows in ((chunk_path, chunking.chunk_children(docs, SMALL)), (parent_path, chunking.chunk_parents(docs, SMALL))):
        stored = spark.read.parquet(path).drop("source_bucket").select(*rows.columns)
        assert stored.exceptAll(rows).count() == 0 and rows.exceptAll(stored).count() == 0


def test_watch_text_folder(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "a.txt").write_text("line one\nline two")
    (folder / "b.csv").write_text("no")
    query = jobs.watch_text_folder(spark, str(folder)).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sql("select source, text from watched").collect()
    assert [(r["source"].endswith("/sub/a.txt"), r["text"]) for r in rows] == [(True, "line one\nline two")]


def test_a_stream_goes_on_where_a_batch_load_ended(spark, tmp_path):
    folder, chunk_path, parent_path = (tmp_path / n for n in ("docs +x", "chunks", "parents"))
    (folder / "a b").mkdir(parents=True)
    (folder / "a b" / "x.txt").write_text("first words of the file")
    (folder / "y.MD").write_bytes(b"bytes \xff here")
    jobs.store_batch(files.load_text_folder(spark, str(folder)).withColumn("version", F.lit(0).cast("timestamp")), str(chunk_path), str(parent_path), SMALL)
    (folder / "a b" / "x.txt").write_text("second words now")
    jobs.ingest_stream(jobs.watch_text_folder(spark, str(folder)), str(chunk_path), str(parent_path), str(tmp_path / "cp"), SMALL).awaitTermination()
    rows = spark.read.parquet(str(parent_path)).collect()
    assert sorted((r["source"], r["topic"], r["text"]) for r in rows) == [
        (f"{folder}/a b/x.txt", "a b", "second words now"), (f"{folder}/y.MD", "General", "bytes  here"),
    ]


def test_expired_articles_go(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("u1", "a", "dynamic", "2024-01-01T00:00:00Z"), ("u2", "b", "dynamic", "2024-01-09T20:00:00Z"), ("f", "c", "local", None)]
    store.write_table(spark.createDataFrame(rows, "source string, chunk_id string, doc_type string, inserted_at string"), path, 8)
    assert jobs.expire_articles(spark, path, 24, "2024-01-10T00:00:00Z") == 1
    assert sorted(r["chunk_id"] for r in spark.read.parquet(path).collect()) == ["b", "c"]


def test_one_url_counts_for_every_question(spark, tmp_path):
    feed, schema = str(tmp_path / "feed"), "query_id long, url string, published_at timestamp"
    rows = [(1, "a", "2024-01-10"), (2, "a", "2024-01-10"), (1, "a", "2024-01-10")]
    spark.createDataFrame(rows, "query_id long, url string, t string").select("query_id", "url", F.col("t").cast("timestamp").alias("published_at")).coalesce(1).write.json(feed)
    stream = jobs.fresh_articles(spark.readStream.schema(schema).json(feed))
    query = stream.writeStream.format("memory").queryName("per_question").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["query_id"], r["url"]) for r in spark.sql("select * from per_question").collect()) == [(1, "a"), (2, "a")]


def test_fresh_articles(spark, tmp_path):
    feed = str(tmp_path / "feed")
    schema = "url string, published_at timestamp"
    put = lambda rows: spark.createDataFrame(rows, "url string, t string").select(
        "url", F.col("t").cast("timestamp").alias("published_at")
    ).coalesce(1).write.mode("append").json(feed)
    put([("a", "2024-01-10 00:00:00"), ("b", "2024-01-10 01:00:00"), ("a", "2024-01-10 02:00:00")])
    source = spark.readStream.schema(schema).json(feed)
    query = jobs.fresh_articles(source).writeStream.format("memory").queryName("fresh").outputMode("append").start()
    try:
        query.processAllAvailable()
        put([("c", "2024-01-12 00:00:00"), ("b", "2024-01-10 03:00:00")])
        query.processAllAvailable()
        put([("late", "2024-01-10 05:00:00"), ("d", "2024-01-11 12:00:00")])
        query.processAllAvailable()
        urls = sorted(r["url"] for r in spark.sql("select url from fresh").collect())
    finally:
        query.stop()
    assert urls == ["a", "b", "c", "d"]


def test_tails_equal_batch(spark, tmp_path):
    feed = str(tmp_path / "feed")
    schema = "session_id long, turn long, user_message string, assistant_message string"
    turns = [(s, t, f"u{s}.{t}", "" if t % 4 == 0 else f"a{s}.{t}") for s in range(3) for t in range(5 + s * 4)]
    query = None
    for part in (turns[::2], turns[1::2], turns[:3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(feed)
        stream = jobs.conversation_tails(spark.readStream.schema(schema).json(feed), 5)
        if query is None:
            query = stream.writeStream.format("memory").queryName("tails").outputMode("update").start()
        query.processAllAvailable()
    emitted = spark.sql("select * from tails").collect()
    query.stop()
    last = {r["session_id"]: (r["messages"], r["transcript"]) for r in emitted}
    batch = sessions.last_messages(sessions.turn_messages(spark.createDataFrame(turns, schema)), 5)
    want = {r["session_id"]: (r["messages"], r["transcript"]) for r in jobs.transcript(batch).collect()}
    assert last == want


def scores_of(corpus_version, spark):
    questions = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta word3 omega"), (3, "changed alpha")], "query_id int, query string")
    terms = lexical.question_terms(questions, "query_id", "query")
    every = {tuple(r) for r in lexical.bm25_scores(corpus_version.index, terms).collect()}
    best = {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in lexical.bm25_scores(corpus_version.index, terms, n=4).collect()}
    asked = udfs.embed_column(questions, "query")
    near = {(r["query_id"], r["chunk_id"], r["rank"]) for r in dense.nearest(corpus_version.vectors, asked, 5).collect()}
    return every, best, near


def tables_of(version):
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    return (
        rows(version.chunks, "chunk_id", "text"), rows(version.parents, "parent_id", "text"),
        rows(version.index.postings, "chunk_id", "term", "tf"), rows(version.index.terms, "term", "df"),
        [(r[0], round(r[1], 9)) for r in version.index.stats.collect()],
        sorted(r["chunk_id"] for r in dense.unpack_vectors(version.vectors).collect()),
    )


def test_a_stream_of_changed_files_equals_a_fresh_ingest(spark, tmp_path):
    """Segments less what was replaced, and the same after they are merged."""
    feed, path = str(tmp_path / "feed"), str(tmp_path / "corpus")
    first = [(f"f{i}", f"alpha beta word{i} delta word3 " * (i + 3), 1) for i in range(6)]
    second = [("f1", "changed text now here alpha", 2), ("f1", "older gamma", 1), ("f9", "brand new file omega omega", 2), ("f2", " ", 2)]
    third = [("f1", "gamma gamma alpha", 3), ("f3", "short delta", 3)]
    for batch in (first, second, second, third):
        spark.createDataFrame(batch, DOC).coalesce(1).write.mode("append").json(feed)
        stream = spark.readStream.schema(DOC).json(feed)
        jobs.index_stream(stream, path, str(tmp_path / "cp"), SMALL, fold_unicode=False).awaitTermination()
    final = {s: t for s, t, _ in first} | {"f9": "brand new file omega omega", "f1": "gamma gamma alpha", "f3": "short delta"}
    docs = corpus.clean_documents(spark.createDataFrame(list(final.items()), "source string, text string"), False)
    fresh = retrieve.ingest(docs, SMALL, path=str(tmp_path / "fresh"))
    streamed = retrieve.Corpus.open(spark, path)
    assert len(read_pointer(spark, path)["segments"]) == 4
    assert tables_of(streamed) == tables_of(fresh) and scores_of(streamed, spark) == scores_of(fresh, spark)
    merged = retrieve.compact(spark, path)
    assert len(read_pointer(spark, path)["segments"]) == 1
    assert tables_of(merged) == tables_of(fresh) and scores_of(merged, spark) == scores_of(fresh, spark)
    # and the stream goes on over the merged version
    retrieve.append(docs.where("source = 'f1'").withColumn("text", F.lit("delta")), path, SMALL)
    assert retrieve.Corpus.open(spark, path).chunks.where("source = 'f1'").select("text").collect() == [("delta",)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "corpus")
    docs = spark.createDataFrame([("a", "one two"), ("b", "three")], "source string, text string")
    retrieve.append(docs, path, SMALL, batch=("s", 0))
    before = read_pointer(spark, path)
    retrieve.append(docs.limit(1), path, SMALL, batch=("s", 0))
    assert read_pointer(spark, path) == before


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A job that stops between two tables leaves the version before it; an unfinished first one cannot be opened."""
    path = str(tmp_path / "corpus")
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "three")], "source string, text string")
    stop = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped"))
    with monkeypatch.context() as m:
        m.setattr(retrieve, "write_segment", stop)
        with pytest.raises(RuntimeError):
            retrieve.ingest(docs, SMALL, path=path)
    with pytest.raises(ValueError):
        retrieve.Corpus.open(spark, path)
    retrieve.ingest(docs, SMALL, path=path)
    before = tables_of(retrieve.Corpus.open(spark, path))
    changed = spark.createDataFrame([("a", "entirely new"), ("c", "more")], "source string, text string")
    for step in ("write_segment", "write_counts", "write_pointer"):
        with monkeypatch.context() as m:
            m.setattr(retrieve, step, stop)
            with pytest.raises(RuntimeError):
                retrieve.append(changed, path, SMALL)
        found = retrieve.Corpus.open(spark, path)
        assert tables_of(found) == before
        orphans = found.chunks.join(found.parents.select("parent_id"), "parent_id", "left_anti")
        assert orphans.count() == 0
    after = tables_of(retrieve.append(changed, path, SMALL))
    assert after != before and {t for _, t in after[0]} >= {"entirely new", "more", "three"}


def test_a_new_ingest_takes_the_place_of_the_old_version(spark, tmp_path):
    path = str(tmp_path / "corpus")
    retrieve.ingest(spark.createDataFrame([("a", "one")], "source string, text string"), SMALL, path=path)
    version = retrieve.ingest(spark.createDataFrame([("b", "two")], "source string, text string"), SMALL, path=path)
    assert [r["source"] for r in version.chunks.collect()] == ["b"]
    assert not (tmp_path / "corpus" / "segment-0").exists()


def test_a_silent_session_leaves_no_state(spark, tmp_path):
    feed, checkpoint = str(tmp_path / "feed"), str(tmp_path / "cp")
    schema = "session_id long, turn long, user_message string, assistant_message string, created_at timestamp"
    seen = []

    def run(*rows):
        timed = [(*r[:-1], datetime(2024, 1, 1) + timedelta(hours=r[-1])) for r in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.mode("append").json(feed)
        tails = jobs.conversation_tails(spark.readStream.schema(schema).json(feed), 5, "created_at", silent_hours=10)
        query = (
            tails.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
            .option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(90)

    def kept():
        state = spark.read.format("statestore").load(checkpoint)
        return {r["session_id"] for r in state.selectExpr("key.session_id").collect()}

    run((1, 1, "hello", "hi", 0), (2, 1, "a", "b", 0))
    assert kept() == {1, 2}
    run((1, 2, "again", "yes", 5))  # in time: goes on
    assert (seen[-1]["session_id"], seen[-1]["messages"]) == (1, 4)
    run((3, 1, "new", "one", 12.5))  # session 2 is silent for 12.5 hours, session 1 for 7.5
    assert kept() == {1, 3}
    run((4, 1, "far", "ahead", 100))
    assert kept() == {4}
    run((1, 3, "back", "welcome", 101))
    assert (seen[-1]["session_id"], seen[-1]["messages"]) == (1, 2)
