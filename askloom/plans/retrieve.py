"""The whole retrieval of a batch of questions as one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions import udfs, variants
from askloom.functions.rules import ENTITY_ALIASES
from askloom.operators import chunking, fusion
from askloom.operators.dense import holes, pack_vectors, unpack_vectors
from askloom.operators.lexical import LexicalIndex, lexical_length, load_index, write_counts, write_segment
from askloom.session import cut_lineage, drop_path, scratch_path, small_batches
from askloom.settings import DEFAULTS, Settings
from askloom.sources.pointer import read_pointer, write_pointer

CHUNK_COLUMNS = (
    "chunk_id", "chunk_type", "doc_type", "source", "source_rel", "topic", "subtopic",
    "section", "pages", "has_table", "parent_id", "text",
)
ROW_COLUMNS = ("query_id", "query", "rank", "rrf_score", "similarity")


@dataclass(frozen=True)
class Corpus:
    """One version of an ingested corpus: stored tables under one path.

    ``chunks`` have text and metadata; vectors, parents and the lexical index are tables of
    their own, so that a question batch reads neither texts for scoring nor vectors for texts.

    The tables lie in segments, each written once by :func:`ingest`, :func:`append` or :func:`compact`. A
    pointer file names the segments of the current version. It is replaced when all of a version's tables
    are there, so chunks, parents, vectors and index always belong together, and a version that was never
    finished cannot be opened.
    """

    path: str
    chunks: DataFrame
    vectors: DataFrame
    parents: DataFrame
    index: LexicalIndex

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Corpus:
        state = read_pointer(spark, path)
        if state is None:
            raise ValueError(f"{path} holds no finished corpus version")
        return _opened(spark, path, state["segments"])


def _folder(path: str, segment: int) -> str:
    return f"{path}/segment-{segment}"


def _stored(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """A table of several segments, with the columns of the first; more columns may be missing elsewhere."""
    parts = [spark.read.parquet(f"{f}/{name}") for f in folders]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _opened(spark: SparkSession, path: str, segments: list[int]) -> Corpus:
    """The tables of some segments, without what later ones of them replaced."""
    folders = [_folder(path, s) for s in segments]
    chunks, parents, vectors = (_stored(spark, folders, name) for name in ("chunks", "parents", "vectors"))
    indexes = [f"{f}/index" for f in folders]
    if len(segments) == 1:
        return Corpus(path, chunks, vectors, parents, load_index(spark, indexes))
    later = folders[1:]
    sources, replaced, gone = (_stored(spark, later, name) for name in ("sources", "replaced", "holes"))
    # the segment that last named a source holds its rows; a few numbers per changed source
    last = sources.groupBy("source").agg(F.max("below").alias("below"))

    def live(rows: DataFrame) -> DataFrame:
        marked = rows.join(last, "source", "left")
        return marked.where(F.coalesce(F.col("segment") >= F.col("below"), F.lit(True))).drop("below")

    dead = replaced.groupBy("chunk").agg(F.max("below").alias("below"))
    index = load_index(spark, indexes, [f"{f}/removed" for f in later], dead)
    holes = gone.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    return Corpus(path, live(chunks), vectors.join(holes, "block", "left"), live(parents), index)


def _write_segment(
    spark: SparkSession, docs: DataFrame, folder: str, segment: int, parts: int | None, settings: Settings,
    embedder, extra: DataFrame | None,
) -> int:
    """All tables of one segment; returns the number of folders of its index."""
    number = F.lit(segment).cast("long")
    chunking.chunk_parents(docs, settings).withColumn("segment", number).write.mode("overwrite").parquet(f"{folder}/parents")
    children = chunking.children_of(spark.read.parquet(f"{folder}/parents"), settings)
    if extra is not None:
        children = children.join(extra, "doc_id", "left")
    children = children.withColumn("segment", number).withColumn("doc_len", lexical_length(F.col("text")))
    children.write.mode("overwrite").parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    packed = pack_vectors(embed_chunks(chunks, embedder, settings), segment=segment)
    packed.write.mode("overwrite").parquet(f"{folder}/vectors")
    return write_segment(chunks, f"{folder}/index", segment, parts)


def ingest(
    docs: DataFrame, settings: Settings = DEFAULTS, embedder=None, extra: DataFrame | None = None,
    path: str | None = None,
) -> Corpus:
    """Chunk, embed and index cleaned documents once, under ``path``.

    ``extra`` adds columns by ``doc_id``. Children are cut from the stored parents, so the texts
    are read once. Without a path the version lives as long as the application. A path that already holds
    a corpus gets a new version that takes the place of the old one.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "corpus")
    old = read_pointer(spark, path) or {"next": 0, "segments": [], "batches": {}}
    segment = old["next"]
    with small_batches(spark):
        parts = _write_segment(spark, docs, _folder(path, segment), segment, None, settings, embedder, extra)
    _switch(spark, path, {"segments": [segment], "next": segment + 1, "parts": parts, "batches": old["batches"]}, old)
    return Corpus.open(spark, path)


def _switch(spark: SparkSession, path: str, state: dict, old: dict | None = None) -> None:
    """Make ``state`` current; segments that only the version before it had are deleted after that."""
    write_pointer(spark, path, state)
    for segment in set((old or {}).get("segments", [])) - set(state["segments"]):
        drop_path(spark, _folder(path, segment))


def append(
    docs: DataFrame, path: str, settings: Settings = DEFAULTS, embedder=None, extra: DataFrame | None = None,
    batch: tuple[str, int] | None = None,
) -> Corpus:
    """Add cleaned documents as a segment; their sources replace what earlier segments hold of them.

    Nothing older is rewritten. Beside its own tables the segment notes which chunks no longer hold, what
    their terms no longer count, and where their vectors lie. A path without a corpus gets its first
    segment. ``batch`` (stream, number) makes a repeated batch of a stream a step without effect.
    """
    spark = docs.sparkSession
    state = read_pointer(spark, path)
    if state is not None and batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
        return Corpus.open(spark, path)
    if state is None:
        state = {"next": 0, "segments": [], "parts": None, "batches": {}}
    segment, folder = state["next"], _folder(path, state["next"])
    with small_batches(spark):
        parts = _write_segment(spark, docs, folder, segment, state["parts"], settings, embedder, extra)
    if state["segments"]:
        before = _opened(spark, path, state["segments"])
        below = F.lit(segment).cast("long").alias("below")
        named = spark.read.parquet(f"{folder}/parents").select("source").distinct()
        named.select("source", below).write.mode("overwrite").parquet(f"{folder}/sources")
        named = spark.read.parquet(f"{folder}/sources").select("source")
        dead = cut_lineage(before.chunks.join(named, "source", "left_semi"))
        dead.select(F.col("chunk_id").alias("chunk"), below).write.mode("overwrite").parquet(f"{folder}/replaced")
        write_counts(dead, f"{folder}/removed", parts)
        gone = holes(before.vectors.select("block", "ids"), spark.read.parquet(f"{folder}/replaced"))
        gone.write.mode("overwrite").parquet(f"{folder}/holes")
    batches = state["batches"] | ({} if batch is None else {batch[0]: batch[1]})
    _switch(spark, path, {"segments": [*state["segments"], segment], "next": segment + 1, "parts": parts, "batches": batches})
    return Corpus.open(spark, path)


def compact(spark: SparkSession, path: str) -> Corpus:
    """Merge all segments into one without the replaced rows. Nothing is chunked or embedded again."""
    state = read_pointer(spark, path)
    corpus = Corpus.open(spark, path)
    if len(state["segments"]) == 1:
        return corpus
    segment, folder = state["next"], _folder(path, state["next"])
    number = F.lit(segment).cast("long")
    corpus.parents.withColumn("segment", number).write.mode("overwrite").parquet(f"{folder}/parents")
    corpus.chunks.withColumn("segment", number).write.mode("overwrite").parquet(f"{folder}/chunks")
    with small_batches(spark):
        pack_vectors(unpack_vectors(corpus.vectors), segment=segment).write.mode("overwrite").parquet(f"{folder}/vectors")
        parts = write_segment(spark.read.parquet(f"{folder}/chunks"), f"{folder}/index", segment)
    _switch(spark, path, {"segments": [segment], "next": segment + 1, "parts": parts, "batches": state["batches"]}, state)
    return Corpus.open(spark, path)


@dataclass(frozen=True)
class Retrieval:
    """Stage results; every frame is keyed by ``query_id``."""

    questions: DataFrame
    lists: DataFrame
    fused: DataFrame
    graded: DataFrame
    first_fused: DataFrame
    first_graded: DataFrame
    corrected: DataFrame
    reranked: DataFrame
    diversified: DataFrame
    context: DataFrame
    confidence: DataFrame


def embed_chunks(chunks: DataFrame, embedder=None, settings: Settings = DEFAULTS) -> DataFrame:
    return udfs.embed_column(
        chunks.select("chunk_id", "text"), "text", "embedding", embedder, settings.vector_dim
    ).select("chunk_id", "embedding")


def explode_variants(questions: DataFrame, texts: Column) -> DataFrame:
    return T.each(questions, ["query_id"], texts, "variant", "variant_id")


def first_variants(
    questions: DataFrame, settings: Settings = DEFAULTS, aliases=ENTITY_ALIASES
) -> DataFrame:
    generated = F.col("generated") if "generated" in questions.columns else None
    return explode_variants(
        questions,
        variants.assembled_variants(F.col("query"), generated, settings, aliases),
    )


def second_variants(
    questions: DataFrame, settings: Settings = DEFAULTS, aliases=ENTITY_ALIASES
) -> DataFrame:
    generated = F.col("generated") if "generated" in questions.columns else None
    used = variants.assembled_variants(F.col("query"), generated, settings, aliases)
    return explode_variants(
        questions, variants.corrective_variants(F.col("query"), used, settings)
    )


def attach(
    rows: DataFrame, corpus: Corpus, questions: DataFrame, relevant: Column | None
) -> DataFrame:
    """Bring text and metadata to the fused rows.

    The wanted ids are a written table, so Spark knows its size: as long as they are few, it scans
    the corpus against them and does not move it.
    """
    wanted = rows.join(questions.select("query_id", "query"), "query_id")
    joined = corpus.chunks.join(cut_lineage(wanted), "chunk_id")
    flag = F.lit(True) if relevant is None else F.coalesce(relevant, F.lit(False))
    return joined.select(*CHUNK_COLUMNS, *ROW_COLUMNS, flag.alias("relevant"))


def retrieve(
    corpus: Corpus, questions: DataFrame, k: int, settings: Settings = DEFAULTS,
    relevant: Column | None = None, embedder=None, aliases=ENTITY_ALIASES,
    corrective_below: int | None = None,
) -> Retrieval:
    """Variants, ranked lists, fusion, grading, rerank, second pass, diversify, parents, gate.

    ``relevant`` is a boolean column over the chunk columns and ``query`` that
    takes the place of a model's judgement; without it every row passes, as when
    grading is off. ``corrective_below`` sets how few graded rows start the
    second pass.
    """
    if corrective_below is None:
        corrective_below = max(1, min(settings.min_relevant, k))
    fused_n = max(k + settings.max_parents, k)
    asked = cut_lineage(first_variants(questions, settings, aliases))
    lists = cut_lineage(
        fusion.ranked_lists(
            corpus.index, corpus.vectors, asked, k, settings, embedder
        )
    )
    fused = fusion.rrf(lists, fused_n, settings)
    rows = cut_lineage(attach(fused, corpus, questions, relevant))
    graded = fusion.grade_with_floor(rows, settings.min_relevant)
    first_rows, first_graded = rows, graded

    found = graded.groupBy("query_id").agg(F.count("*").alias("found"))
    failing = cut_lineage(
        questions.join(found, "query_id", "left").filter(
            F.coalesce("found", F.lit(0)) < corrective_below
        )
    )
    if not failing.isEmpty():
        # numbered after the variants of the first pass
        again = cut_lineage(
            second_variants(failing, settings, aliases).withColumn(
                "variant_id", F.col("variant_id") + settings.variant_limit
            )
        )
        more = cut_lineage(
            fusion.ranked_lists(
                corpus.index, corpus.vectors, again, k, settings, embedder
            )
        )
        # only questions whose second pass found something are fused again
        redone = more.select("query_id").distinct()
        old = rows.join(redone, "query_id", "left_semi").select(
            "query_id", F.lit(-1).alias("variant_id"), F.lit("fused").alias("list_type"),
            "rank", "chunk_id", "similarity",
        )
        wide = fusion.rrf(old.unionByName(more), fused_n + 2, settings)
        new_rows = cut_lineage(attach(wide, corpus, questions, relevant))
        new_graded = fusion.grade_with_floor(new_rows, settings.min_relevant)
        rows = rows.join(redone, "query_id", "left_anti").unionByName(new_rows)
        graded = graded.join(redone, "query_id", "left_anti").unionByName(new_graded)
        failing, lists = redone, lists.unionByName(more)

    reranked = fusion.rerank(graded, max(2 * k, k), settings, aliases=aliases)
    diversified = fusion.diversify(reranked, max(2 * k, k), settings.max_per_source)
    context = cut_lineage(
        fusion.with_parents(diversified, corpus.parents, k, max(settings.max_parents, 1))
    )
    gate = fusion.confidence(context, questions, settings.confidence_threshold)
    return Retrieval(
        questions, lists, rows, graded, first_rows, first_graded,
        failing.select("query_id").distinct(), reranked, diversified, context, gate,
    )


def question_notes(
    questions: DataFrame, corrected: DataFrame, settings: Settings = DEFAULTS, aliases=ENTITY_ALIASES
) -> DataFrame:
    """Intent, entity hints, variants and, after a second pass, corrective variants of each question."""
    generated = F.col("generated") if "generated" in questions.columns else None
    used = variants.assembled_variants(F.col("query"), generated, settings, aliases)
    noted = questions.select(
        "query_id",
        variants.intent(F.col("query")).alias("query_intent"),
        variants.entity_hints(F.col("query"), aliases).alias("entity_hints"),
        used.alias("query_variants"),
        variants.corrective_variants(F.col("query"), used, settings).alias("_fresh"),
    )
    mark = corrected.withColumn("corrective_pass_used", F.lit(True))
    return (
        noted.join(mark, "query_id", "left")
        .na.fill({"corrective_pass_used": False})
        .withColumn(
            "corrective_query_variants",
            F.when(F.col("corrective_pass_used"), F.col("_fresh")).otherwise(F.expr("cast(array() as array<string>)")),
        )
        .drop("_fresh")
    )


def diagnostics(
    result: Retrieval, settings: Settings = DEFAULTS, aliases=ENTITY_ALIASES
) -> DataFrame:
    """What was asked and the rows at each stage, per question."""

    def per_query(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        counted = F.count("*") if condition is None else F.count_if(condition)
        return df.groupBy("query_id").agg(counted.alias(name))

    is_parent = F.col("chunk_type") == "parent"
    stages = [
        per_query(result.lists, "dense_candidates", F.col("list_type") == "dense"),
        per_query(result.lists, "lexical_candidates", F.col("list_type") == "lexical"),
        per_query(result.first_fused, "fused_rows"),
        per_query(result.first_graded, "first_graded_rows"),
        per_query(result.graded, "graded_rows"),
        per_query(result.reranked, "reranked_rows"),
        per_query(result.diversified, "diversified_rows"),
        per_query(result.context, "child_rows", ~is_parent),
        per_query(result.context, "parent_rows", is_parent),
    ]
    report = result.questions.select("query_id")
    for stage in stages:
        report = report.join(stage, "query_id", "left")
    report = report.na.fill(0)
    notes = question_notes(result.questions, result.corrected, settings, aliases)
    return (
        report.join(notes, "query_id")
        .join(result.confidence, "query_id", "left")
        .withColumn("max_score", F.round("max_score", 4))
    )
