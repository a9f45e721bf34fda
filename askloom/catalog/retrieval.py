"""Retrieval queries: index, lexical and dense top-k, fusion to context, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog import sqltext as S
from askloom.catalog.corpus import as_long
from askloom.catalog.questions import ALIASES
from askloom.catalog.registry import cte, query
from askloom.functions import text as T
from askloom.functions import udfs
from askloom.operators import context, dense, fusion, lexical
from askloom.plans import retrieve as R
from askloom.plans import views as V
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS

K = V.K
# Questions with fewer graded rows than this take the second pass.
SECOND_PASS_BELOW = max(1, min(DEFAULTS.min_relevant, K))

# ---- index -------------------------------------------------------------------------------

cte(
    "chunk_tokens",
    f"SELECT chunk_id, w, greatest(len(w), 1) AS doc_len FROM "
    f"(SELECT chunk_id, {S.search_tokens('text')} AS w FROM chunks)",
    "chunks",
)
cte(
    "postings",
    "SELECT chunk_id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM "
    "(SELECT chunk_id, doc_len, unnest(w) AS term FROM chunk_tokens) GROUP BY chunk_id, term",
    "chunk_tokens",
)
cte("term_df", "SELECT term, count(*) AS df FROM postings GROUP BY term", "postings")
cte(
    "corpus_stats",
    "SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM chunk_tokens",
    "chunk_tokens",
)
cte(
    "chunk_slots",
    f"SELECT chunk_id, {S.hash_slot('w')} AS slot, sum({S.hash_sign('w')}) AS v FROM "
    f"(SELECT chunk_id, unnest({S.alnum_tokens('text')}) AS w FROM chunks) GROUP BY ALL",
    "chunks",
)
cte(
    "chunk_norms",
    "SELECT chunk_id, sqrt(sum(v * v)) AS norm FROM chunk_slots GROUP BY chunk_id",
    "chunk_slots",
)


def scoring_ctes(p: str, texts: str, key: str, text: str) -> None:
    """BM25 and vector candidates for every text of a table."""
    cte(
        f"{p}_terms",
        f"SELECT {key}, unnest({S.content_terms(text, 20)}) AS term FROM {texts}",
        texts,
    )
    cte(
        f"{p}_bm25",
        f"""SELECT {key}, chunk_id, round(sum(
  ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE
  / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (doc_len / greatest(avg_len, 1.0::DOUBLE)))))), 6) AS score
FROM {p}_terms JOIN postings USING (term) JOIN term_df USING (term), corpus_stats GROUP BY {key}, chunk_id""",
        f"{p}_terms", "postings", "term_df", "corpus_stats",
    )
    cte(
        f"{p}_lexical",
        f"""SELECT {key}, chunk_id, score, rank, round(greatest(0::DOUBLE, least(1::DOUBLE,
  0.2::DOUBLE + 0.6::DOUBLE * ((score - min(score) OVER g) / greatest(max(score) OVER g - min(score) OVER g, 1e-9))
  + 0.2::DOUBLE * (1::DOUBLE - (rank - 1) / count(*) OVER g))), 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, chunk_id) AS rank
      FROM {p}_bm25 WHERE score > 0) WHERE rank <= {DEFAULTS.lexical_candidates(K)}
WINDOW g AS (PARTITION BY {key})""",
        f"{p}_bm25",
    )
    cte(
        f"{p}_slots",
        f"SELECT {key}, {S.hash_slot('w')} AS slot, sum({S.hash_sign('w')}) AS v FROM "
        f"(SELECT {key}, unnest({S.alnum_tokens(text)}) AS w FROM {texts}) GROUP BY ALL",
        texts,
    )
    cte(
        f"{p}_dense",
        f"""SELECT {key}, chunk_id, score, rank, greatest(0::DOUBLE, least(1::DOUBLE, score)) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT t.{key}, c.chunk_id, round(coalesce(d.dot / (n.norm * m.norm), 0), 6) + 0::DOUBLE AS score
    FROM (SELECT DISTINCT {key} FROM {texts}) t CROSS JOIN chunks c
    LEFT JOIN (SELECT a.{key}, b.chunk_id, sum(a.v * b.v) AS dot FROM {p}_slots a
               JOIN chunk_slots b USING (slot) GROUP BY a.{key}, b.chunk_id) d
      ON d.{key} = t.{key} AND d.chunk_id = c.chunk_id
    LEFT JOIN (SELECT {key}, sqrt(sum(v * v)) AS norm FROM {p}_slots GROUP BY {key}) n ON n.{key} = t.{key}
    LEFT JOIN chunk_norms m ON m.chunk_id = c.chunk_id))
WHERE rank <= {DEFAULTS.dense_candidates(K)}""",
        f"{p}_slots", "chunk_slots", "chunk_norms", "chunks", texts,
    )


scoring_ctes("qs", "questions", "query_id", "query")
scoring_ctes("vk", "variant_keys", "variant_key", "variant_key")


@query("bm25_postings", "SELECT chunk_id, term, tf, doc_len FROM postings", ("postings",))
def bm25_postings(spark, sf):
    return as_long(V.retrieval_corpus(spark, sf).index.postings, "tf", "doc_len")


@query("bm25_df", "SELECT term, df FROM term_df", ("term_df",))
def bm25_df(spark, sf):
    return V.retrieval_corpus(spark, sf).index.terms.select("term", "df")


@query(
    "corpus_stats", "SELECT n_docs, round(avg_len, 6) AS avg_len FROM corpus_stats",
    ("corpus_stats",),
)
def corpus_stats(spark, sf):
    return V.retrieval_corpus(spark, sf).index.stats.withColumn("avg_len", F.round("avg_len", 6))


@query("bm25_scores", "SELECT query_id, chunk_id, score FROM qs_lexical", ("qs_lexical",))
def bm25_scores(spark, sf):
    terms = lexical.question_terms(V.questions(spark, sf), "query_id", "query")
    index = V.retrieval_corpus(spark, sf).index
    found = lexical.bm25_scores(index, terms, n=DEFAULTS.lexical_candidates(K))
    return found.select("query_id", "chunk_id", "score")


TOP_OUT = ("query_id", "chunk_id", "score", "rank", "similarity")


@query("lexical_topk", f"SELECT {', '.join(TOP_OUT)} FROM qs_lexical", ("qs_lexical",))
def lexical_topk(spark, sf):
    found = lexical.lexical_topk(V.retrieval_corpus(spark, sf).index, V.questions(spark, sf), K)
    return as_long(found.select(*TOP_OUT), "rank")


def embedded_questions(spark, sf):
    return udfs.embed_column(V.questions(spark, sf), "query")


@query("dense_topk", f"SELECT {', '.join(TOP_OUT)} FROM qs_dense", ("qs_dense",))
def dense_topk(spark, sf):
    vectors = V.retrieval_corpus(spark, sf).vectors
    found = dense.dense_topk(vectors, embedded_questions(spark, sf), K)
    return as_long(found.select(*TOP_OUT), "rank")


# The inverted file: the first rows by MD5 are the first centres, two rounds of k-means move them.
cte(
    "cell_sample",
    f"SELECT chunk_id, row_number() OVER (ORDER BY md5(chunk_id), chunk_id) - 1 AS place FROM chunks "
    f"QUALIFY place < {dense.CELL_SAMPLE}",
    "chunks",
)
cte(
    "cell_count",
    f"SELECT count(*) AS rows, least(count(*), {dense.CELL_SAMPLE}, {dense.MOST_CELLS}, "
    "CAST(ceil(4 * sqrt(count(*))) AS BIGINT)) AS cells FROM chunks",
    "chunks",
)
cte(
    "chunk_units",
    "SELECT chunk_id, slot, v / norm AS x FROM chunk_slots JOIN chunk_norms USING (chunk_id) WHERE norm > 0",
    "chunk_slots", "chunk_norms",
)
cte(
    "centres_0",
    "SELECT place AS cell, slot, x FROM cell_sample JOIN chunk_units USING (chunk_id) WHERE place < (SELECT cells FROM cell_count)",
    "cell_sample", "chunk_units", "cell_count",
)


def to_cells(rows: str, centres: str) -> str:
    """(chunk_id, cell): the nearest centre of every row."""
    return (
        f"SELECT r.chunk_id, g.cell FROM (SELECT chunk_id FROM {rows}) r CROSS JOIN "
        "(SELECT unnest(range(cells)) AS cell FROM cell_count) g LEFT JOIN "
        f"(SELECT a.chunk_id, b.cell, sum(a.x * b.x) AS dot FROM chunk_units a JOIN {centres} b USING (slot) "
        "GROUP BY a.chunk_id, b.cell) d ON d.chunk_id = r.chunk_id AND d.cell = g.cell QUALIFY row_number() OVER "
        f"(PARTITION BY r.chunk_id ORDER BY round(coalesce(dot, 0), {dense.CELL_DIGITS}) DESC, g.cell) = 1"
    )


for _round in range(dense.CELL_ROUNDS):
    _old, _in, _new = f"centres_{_round}", f"members_{_round}", f"centres_{_round + 1}"
    cte(_in, to_cells("cell_sample", _old), "cell_sample", "cell_count", "chunk_units", _old)
    cte(
        f"sums_{_round}",
        f"SELECT cell, slot, sum(x) AS s FROM {_in} JOIN chunk_units USING (chunk_id) GROUP BY cell, slot",
        _in, "chunk_units",
    )
    cte(
        _new,
        f"WITH sizes AS (SELECT cell, sqrt(sum(s * s)) AS size FROM sums_{_round} GROUP BY cell HAVING size > 0) "
        f"SELECT cell, slot, round(s / size, {dense.CELL_DIGITS}) AS x FROM sums_{_round} JOIN sizes USING (cell) UNION ALL "
        f"SELECT cell, slot, x FROM {_old} WHERE cell NOT IN (SELECT cell FROM sizes)",
        f"sums_{_round}", _old,
    )
CENTRES = f"centres_{dense.CELL_ROUNDS}"
cte("chunk_cells", to_cells("chunks", CENTRES), "chunks", "cell_count", "chunk_units", CENTRES)
cte(
    "ann_pairs",
    f"""SELECT query_id, chunk_id FROM (
  SELECT q.query_id, g.cell, sum(coalesce(n, 0)) OVER o AS met, row_number() OVER o AS nth
  FROM questions q CROSS JOIN (SELECT unnest(range(cells)) AS cell FROM cell_count) g
  LEFT JOIN (SELECT cell, count(*) AS n FROM chunk_cells GROUP BY cell) s ON s.cell = g.cell
  LEFT JOIN (SELECT a.query_id, b.cell, sum(a.v / z.norm * b.x) AS dot FROM qs_slots a JOIN {CENTRES} b USING (slot)
             JOIN (SELECT query_id, sqrt(sum(v * v)) AS norm FROM qs_slots GROUP BY query_id) z ON z.query_id = a.query_id
             WHERE z.norm > 0 GROUP BY a.query_id, b.cell) d ON d.query_id = q.query_id AND d.cell = g.cell
  WINDOW o AS (PARTITION BY q.query_id ORDER BY round(coalesce(dot, 0), {dense.CELL_DIGITS}) DESC, g.cell
               ROWS UNBOUNDED PRECEDING)) p JOIN chunk_cells USING (cell)
WHERE nth = 1 OR met <= (SELECT greatest((rows * {dense.PROBE_SHARE[0]} + {dense.PROBE_SHARE[1] - 1}) // {dense.PROBE_SHARE[1]},
                                         {dense.PROBE_LEAST * DEFAULTS.dense_candidates(K)}) FROM cell_count)""",
    "questions", "cell_count", "chunk_cells", "qs_slots", CENTRES,
)


@query(
    "ann_topk",
    f"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT p.query_id, p.chunk_id, round(coalesce(d.dot / (n.norm * m.norm), 0), 6) + 0::DOUBLE AS score FROM ann_pairs p
  LEFT JOIN (SELECT a.query_id, b.chunk_id, sum(a.v * b.v) AS dot FROM qs_slots a
             JOIN chunk_slots b USING (slot) GROUP BY a.query_id, b.chunk_id) d USING (query_id, chunk_id)
  LEFT JOIN (SELECT query_id, sqrt(sum(v * v)) AS norm FROM qs_slots GROUP BY query_id) n USING (query_id)
  LEFT JOIN chunk_norms m USING (chunk_id))) WHERE rank <= {DEFAULTS.dense_candidates(K)}""",
    ("ann_pairs", "qs_slots", "chunk_slots", "chunk_norms"),
)
def ann_topk(spark, sf):
    found = dense.ann_topk(V.vector_cells(spark, sf), embedded_questions(spark, sf), DEFAULTS.dense_candidates(K))
    return as_long(found, "rank")


# ---- fusion to context -------------------------------------------------------------------

LISTS = (
    "SELECT query_id, variant_id, list_type, rank, chunk_id, similarity FROM {v} JOIN ("
    "SELECT variant_key, 'dense' AS list_type, rank, chunk_id, similarity FROM {p}_dense UNION ALL "
    "SELECT variant_key, 'lexical', rank, chunk_id, similarity FROM {p}_lexical) USING (variant_key)"
)
cte("lists", LISTS.format(v="variant_keys", p="vk"), "variant_keys", "vk_dense", "vk_lexical")
FUSE = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) "
    "AS rank FROM (SELECT query_id, chunk_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS rrf_score, "
    "max(similarity) AS similarity FROM {t} GROUP BY query_id, chunk_id)) WHERE rank <= {n}"
)
cte("fused", FUSE.format(t="lists", n=K + DEFAULTS.max_parents), "lists")
CHUNK_META = (
    "chunk_id, chunk_type, doc_type, source, source_rel, topic, subtopic, section, pages, "
    "has_table, parent_id, text"
)
ATTACH = (
    "SELECT query_id, query, rank, rrf_score, similarity, c.*, "
    "coalesce(quality = 1, false) AS relevant FROM {t} JOIN questions USING (query_id) JOIN "
    f"(SELECT doc_id, {CHUNK_META} FROM chunks) c USING (chunk_id) LEFT JOIN labels USING (doc_id)"
)
cte("rows_first", ATTACH.format(t="fused"), "fused", "questions", "chunks")
GRADE = (
    "SELECT * EXCLUDE (pos, rank, n_rel), pos AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY CAST(relevant AS INT) DESC, rank) AS pos, "
    "count(*) FILTER (WHERE relevant) OVER (PARTITION BY query_id) AS n_rel FROM {t}) "
    f"WHERE pos <= greatest(n_rel, {DEFAULTS.min_relevant})"
)
cte("graded_first", GRADE.format(t="rows_first"), "rows_first")
cte(
    "failing",
    f"SELECT query_id FROM questions LEFT JOIN (SELECT query_id, count(*) AS n FROM graded_first "
    f"GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) < {SECOND_PASS_BELOW}",
    "questions", "graded_first",
)
cte(
    "second_keys",
    "SELECT query_id, generate_subscripts(fresh, 1) - 1 AS variant_id, "
    f"unnest(list_transform(fresh, lambda f: lower({S.squeeze('f')}))) AS variant_key "
    "FROM q_corrective WHERE query_id IN (SELECT query_id FROM failing)",
    "q_corrective", "failing",
)
scoring_ctes("sk", "second_keys", "variant_key", "variant_key")
cte(
    "second_lists", LISTS.format(v="second_keys", p="sk"), "second_keys", "sk_dense", "sk_lexical"
)
cte("corrected", "SELECT DISTINCT query_id FROM second_lists", "second_lists")
cte(
    "all_lists",
    "SELECT * FROM lists UNION ALL SELECT * FROM second_lists",
    "lists", "second_lists",
)
cte(
    "second_input",
    "SELECT query_id, rank, chunk_id, similarity FROM second_lists UNION ALL SELECT query_id, rank, "
    "chunk_id, similarity FROM rows_first WHERE query_id IN (SELECT query_id FROM corrected)",
    "second_lists", "rows_first", "corrected",
)
cte("second_fused", FUSE.format(t="second_input", n=K + DEFAULTS.max_parents + 2), "second_input")
cte("second_rows", ATTACH.format(t="second_fused"), "second_fused", "questions", "chunks")
cte("second_graded", GRADE.format(t="second_rows"), "second_rows")
cte(
    "graded",
    "SELECT * FROM graded_first WHERE query_id NOT IN (SELECT query_id FROM corrected) "
    "UNION ALL BY NAME SELECT * FROM second_graded",
    "graded_first", "second_graded", "corrected",
)
OVERLAP = (
    f"len(list_intersect({S.content_terms('query', 14)}, {S.content_terms('text', 180)})) "
    f"/ greatest(len({S.content_terms('query', 14)}), 1)"
)


def meta_sql(section: str) -> str:
    blob = f"lower(source_rel || ' ' || topic || ' ' || subtopic || ' ' || {section})"
    terms = S.content_terms("query", 14)
    hints = S.entity_hints(S.squeeze("query"), f"lower({S.squeeze('query')})", ALIASES)
    return (
        f"CASE WHEN len({terms}) = 0 THEN 0 ELSE greatest(len(list_filter({terms}, "
        f"lambda t: contains({blob}, t))) / greatest(len({terms}), 1), "
        f"least(len(list_filter({hints}, lambda h: contains({blob}, h))), 2) / 2) END"
    )


PLACE = (
    "SELECT * EXCLUDE (rank, by_score), row_number() OVER (PARTITION BY query_id ORDER BY "
    f"CASE WHEN by_score <= {2 * K} THEN 0 ELSE 1 END, "
    f"CASE WHEN by_score <= {2 * K} THEN by_score ELSE rank END) AS rank FROM ("
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS by_score "
    "FROM ({t}))"
)
cte(
    "reranked",
    PLACE.format(
        t="SELECT *, round(greatest(0::DOUBLE, least(1::DOUBLE, 0.6::DOUBLE * similarity + "
        f"0.25::DOUBLE * ({OVERLAP}) + 0.15::DOUBLE * ({meta_sql('section')}))), 6) AS rerank_score "
        "FROM graded"
    ),
    "graded",
)
cte(
    "diversified",
    "SELECT * EXCLUDE (rank, nth, pos), pos AS rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY rank) AS pos FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id, source_rel ORDER BY rank) AS nth FROM reranked) WHERE nth <= 2) "
    f"WHERE pos <= {2 * K}",
    "reranked",
)
CONTEXT_COLUMNS = ", ".join(fusion.CONTEXT_COLUMNS)
cte(
    "context",
    f"""SELECT {CONTEXT_COLUMNS}, row_number() OVER (PARTITION BY query_id ORDER BY is_parent, rank) AS rank FROM (
  SELECT {CONTEXT_COLUMNS}, rank, 0 AS is_parent FROM diversified WHERE rank <= {K}
  UNION ALL BY NAME
  SELECT * FROM (SELECT query_id, 'parent::' || parent_id AS chunk_id, 'parent' AS chunk_type, p.source, p.source_rel,
    p.topic, p.subtopic, p.section, p.pages, p.has_table, 'local' AS doc_type, parent_id,
    {S.strip('p.text')} AS text, similarity, NULL::DOUBLE AS rerank_score,
    row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, parent_id) AS rank, 1 AS is_parent
    FROM (SELECT query_id, parent_id, max(similarity) AS similarity FROM diversified WHERE rank <= {K}
          GROUP BY query_id, parent_id) JOIN parents p USING (parent_id)) WHERE rank <= 3)""",
    "diversified", "parents",
)
cte(
    "gate",
    "SELECT query_id, coalesce(s, 0) AS max_score, coalesce(s, 0) < 0.45 AS low_confidence FROM questions "
    "LEFT JOIN (SELECT query_id, max(round(0.7::DOUBLE * similarity + 0.3::DOUBLE * "
    "coalesce(rerank_score, similarity), 6)) AS s FROM context GROUP BY query_id) USING (query_id)",
    "questions", "context",
)


def run(spark, sf, corpus: R.Corpus | None = None) -> R.Retrieval:
    return R.retrieve(
        corpus or V.retrieval_corpus(spark, sf), V.questions(spark, sf), K,
        relevant=F.col("quality") == 1,
    )


def first_lists(spark, sf):
    corpus = V.retrieval_corpus(spark, sf)
    variants = cut_lineage(R.first_variants(V.questions(spark, sf), DEFAULTS, ALIASES))
    return corpus, fusion.ranked_lists(corpus.index, corpus.vectors, variants, K)


def first_rows(spark, sf):
    corpus, lists = first_lists(spark, sf)
    fused = cut_lineage(fusion.rrf(lists, K + DEFAULTS.max_parents))
    return R.attach(fused, corpus, V.questions(spark, sf), F.col("quality") == 1)


@query("ranked_lists", "SELECT * FROM lists", ("lists",))
def ranked_lists(spark, sf):
    return as_long(first_lists(spark, sf)[1], "variant_id", "rank")


@query("rrf_fusion", "SELECT query_id, chunk_id, rrf_score, similarity, rank FROM fused", ("fused",))
def rrf_fusion(spark, sf):
    return as_long(fusion.rrf(first_lists(spark, sf)[1], K + DEFAULTS.max_parents), "rank")


@query(
    "grade_topup", "SELECT query_id, chunk_id, relevant, rank FROM graded_first", ("graded_first",)
)
def grade_topup(spark, sf):
    graded = fusion.grade_with_floor(first_rows(spark, sf))
    return as_long(graded.select("query_id", "chunk_id", "relevant", "rank"), "rank")


@query(
    "text_overlap",
    f"SELECT query_id, chunk_id, round({OVERLAP}, 6) AS overlap FROM rows_first",
    ("rows_first",),
)
def text_overlap(spark, sf):
    return first_rows(spark, sf).select(
        "query_id", "chunk_id",
        F.round(fusion.text_overlap(F.col("query"), F.col("text")), 6).alias("overlap"),
    )


@query(
    "metadata_alignment",
    "SELECT query_id, chunk_id, round("
    + meta_sql("split_part(text, chr(10), 1)")
    + ", 6) AS alignment FROM rows_first",
    ("rows_first",),
)
def metadata_alignment(spark, sf):
    # the first line of a chunk stands in for its section heading
    heading = F.get(F.split("text", "\n", 2), F.lit(0))
    score = fusion.metadata_alignment(
        F.col("query"), F.col("source_rel"), F.col("topic"), F.col("subtopic"), heading, ALIASES
    )
    return first_rows(spark, sf).select("query_id", "chunk_id", F.round(score, 6).alias("alignment"))


RANKED_OUT = ("query_id", "chunk_id", "similarity", "rerank_score", "rank")


@query("rerank_heuristic", f"SELECT {', '.join(RANKED_OUT)} FROM reranked", ("reranked",))
def rerank_heuristic(spark, sf):
    return as_long(run(spark, sf).reranked.select(*RANKED_OUT), "rank")


@query(
    "rerank_model_score",
    f"SELECT {', '.join(RANKED_OUT)} FROM ("
    + PLACE.format(
        t="SELECT *, round(greatest(0::DOUBLE, least(1::DOUBLE, 0.55::DOUBLE * ((rrf_score - "
        "min(rrf_score) OVER g) / greatest(max(rrf_score) OVER g - min(rrf_score) OVER g, 1e-9)) + "
        f"0.3::DOUBLE * similarity + 0.15::DOUBLE * ({OVERLAP}))), 6) AS rerank_score "
        "FROM graded_first WINDOW g AS (PARTITION BY query_id)"
    )
    + ")",
    ("graded_first",),
)
def rerank_model_score(spark, sf):
    # the fusion score stands in for the raw score of a pair model
    graded = fusion.grade_with_floor(first_rows(spark, sf))
    scored = fusion.rerank(graded, 2 * K, model_score="rrf_score", aliases=ALIASES)
    return as_long(scored.select(*RANKED_OUT), "rank")


@query(
    "corrective_pass",
    "SELECT query_id, chunk_id, rrf_score, similarity, relevant, rank, "
    "query_id IN (SELECT query_id FROM corrected) AS corrected FROM graded",
    ("graded", "corrected"),
)
def corrective_pass(spark, sf):
    result = run(spark, sf)
    mark = result.corrected.withColumn("corrected", F.lit(True))
    rows = result.graded.select(
        "query_id", "chunk_id", "rrf_score", "similarity", "relevant", "rank"
    )
    return as_long(rows.join(mark, "query_id", "left").na.fill({"corrected": False}), "rank")


@query(
    "diversify_by_source",
    "SELECT query_id, chunk_id, source_rel, rerank_score, rank FROM diversified",
    ("diversified",),
)
def diversify_by_source(spark, sf):
    out = run(spark, sf).diversified
    return as_long(out.select("query_id", "chunk_id", "source_rel", "rerank_score", "rank"), "rank")


@query(
    "parent_context",
    "SELECT query_id, chunk_id, chunk_type, parent_id, similarity, rerank_score, rank, text FROM context",
    ("context",),
)
def parent_context(spark, sf):
    out = run(spark, sf).context.select(
        "query_id", "chunk_id", "chunk_type", "parent_id", "similarity", "rerank_score", "rank",
        "text",
    )
    return as_long(out, "rank")


@query("confidence_gate", "SELECT * FROM gate", ("gate",))
def confidence_gate(spark, sf):
    return run(spark, sf).confidence


def stage_sql(table: str, name: str, condition: str = "true") -> str:
    return (
        f"LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE {condition}) AS {name} FROM {table} "
        "GROUP BY query_id) USING (query_id)"
    )


STAGES = (
    ("all_lists", "dense_candidates", "list_type = 'dense'"),
    ("all_lists", "lexical_candidates", "list_type = 'lexical'"),
    ("rows_first", "fused_rows", "true"),
    ("graded_first", "first_graded_rows", "true"),
    ("graded", "graded_rows", "true"),
    ("reranked", "reranked_rows", "true"),
    ("diversified", "diversified_rows", "true"),
    ("context", "child_rows", "chunk_type <> 'parent'"),
    ("context", "parent_rows", "chunk_type = 'parent'"),
)


@query(
    "retrieval_diag",
    "SELECT query_id, "
    + ", ".join(f"coalesce({n}, 0) AS {n}" for _, n, _ in STAGES)
    + ", query_id IN (SELECT query_id FROM corrected) AS corrective_pass_used, "
    f"{S.intent('lowered')} AS query_intent, array_to_string(hints, ' | ') AS entity_hints, "
    "array_to_string(used, ' | ') AS query_variants, CASE WHEN query_id IN (SELECT query_id FROM corrected) "
    "THEN array_to_string(fresh, ' | ') ELSE '' END AS corrective_query_variants, "
    "CAST(round(CAST(max_score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS max_score, low_confidence FROM questions "
    + " ".join(stage_sql(*s) for s in STAGES)
    + " JOIN gate USING (query_id) JOIN (SELECT query_id, lowered, hints, used, fresh FROM q_corrective) USING (query_id)",
    ("questions", "gate", "corrected", "all_lists", "q_corrective"),
)
def retrieval_diag(spark, sf):
    shown = R.diagnostics(run(spark, sf))
    names = ("entity_hints", "query_variants", "corrective_query_variants")
    return shown.withColumns({n: F.array_join(n, " | ") for n in names})


# The lexical hits of the plain question stand in for the article rows of the fallback.
cte(
    "bundle",
    f"""SELECT *, len({S.tokens('text')}) AS tokens FROM (
  SELECT {CONTEXT_COLUMNS}, rank, false AS is_dynamic FROM context
  UNION ALL BY NAME
  SELECT query_id, chunk_id, 'dynamic' AS chunk_type, source, source_rel, topic, subtopic, section, pages,
    has_table, 'dynamic' AS doc_type, NULL AS parent_id, text, similarity, NULL::DOUBLE AS rerank_score, rank,
    true AS is_dynamic
  FROM lists JOIN chunks USING (chunk_id) WHERE variant_id = 0 AND list_type = 'lexical' AND rank <= {K})""",
    "context", "lists", "chunks",
)
cte(
    "budgeted",
    "SELECT * FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY is_dynamic, rank "
    "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens FROM bundle) "
    f"WHERE running_tokens <= {DEFAULTS.max_context_tokens}",
    "bundle",
)


def bundle_rows(corpus: R.Corpus, result: R.Retrieval):
    local = result.context.withColumn("is_dynamic", F.lit(False))
    hits = result.lists.filter(
        (F.col("variant_id") == 0) & (F.col("list_type") == "lexical") & (F.col("rank") <= K)
    )
    dynamic = (
        corpus.chunks.join(hits, "chunk_id")
        .withColumn("chunk_type", F.lit("dynamic"))
        .withColumn("doc_type", F.lit("dynamic"))
        .withColumn("parent_id", F.lit(None).cast("string"))
        .withColumn("rerank_score", F.lit(None).cast("double"))
        .withColumn("is_dynamic", F.lit(True))
        .select(*local.columns)
    )
    return local.unionByName(dynamic).withColumn("tokens", T.token_count(F.col("text")).cast("long"))


def budgeted(spark, sf):
    """The retrieval result and its context within the token budget."""
    corpus = V.retrieval_corpus(spark, sf)
    result = run(spark, sf, corpus)
    return result, context.token_budget(bundle_rows(corpus, result))


@query(
    "token_budget",
    "SELECT query_id, chunk_id, is_dynamic, rank, tokens, running_tokens FROM budgeted",
    ("budgeted",),
)
def token_budget(spark, sf):
    out = budgeted(spark, sf)[1].select(
        "query_id", "chunk_id", "is_dynamic", "rank", "tokens", "running_tokens"
    )
    return as_long(out, "rank")


NUMBER = "CAST(CAST(round(CAST({x} AS DECIMAL(18, 6)), 4) AS DECIMAL(18, 4)) AS VARCHAR)"


@query(
    "context_text",
    f"""
SELECT query_id, string_agg(CASE WHEN nth = 1 THEN '[Document ' || doc || '] source=' || lead.source || ' source_rel='
    || lead.source_rel || ' topic=' || lead.topic || ' subtopic=' || lead.subtopic || ' doc_type=' || lead.doc_type
    || chr(10) || chr(10) ELSE '' END
  || '  [Chunk ' || doc || '.' || nth || '] chunk_type=' || chunk_type || ' similarity=' || {NUMBER.format(x='similarity')}
  || coalesce(' rerank=' || {NUMBER.format(x='rerank_score')}, '')
  || CASE WHEN section <> '' THEN ' section=' || section ELSE '' END
  || CASE WHEN pages <> '' THEN ' pages=' || pages ELSE '' END
  || CASE WHEN has_table THEN ' has_table=true' ELSE '' END || chr(10) || text,
  chr(10) || chr(10) ORDER BY doc, nth) AS context
FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first_rank) AS doc FROM (
  SELECT *, min(rank) OVER s AS first_rank,
    first_value({{'source': source, 'source_rel': source_rel, 'topic': topic, 'subtopic': subtopic, 'doc_type': doc_type}})
      OVER (PARTITION BY query_id, source_rel ORDER BY rank) AS lead,
    row_number() OVER (PARTITION BY query_id, source_rel
      ORDER BY similarity DESC, coalesce(rerank_score, 0) DESC, rank) AS nth
  FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY is_dynamic, rank) AS rank) FROM budgeted)
  WINDOW s AS (PARTITION BY query_id, source_rel)))
GROUP BY query_id
""",
    ("budgeted",),
)
def context_text(spark, sf):
    rows = fusion.ranked(
        budgeted(spark, sf)[1], F.asc("is_dynamic"), F.asc("rank"), rank="position"
    )
    return context.context_text(rows.withColumn("rank", F.col("position")))


HYBRID_OUT = (
    "query_id, rank, chunk_id, chunk_type, source, source_rel, similarity, rerank_score, "
    "max_score, low_confidence"
)


@query(
    "hybrid_retrieve",
    f"SELECT {HYBRID_OUT} FROM context JOIN gate USING (query_id)",
    ("context", "gate"),
)
def hybrid_retrieve(spark, sf):
    result = run(spark, sf)
    out = result.context.join(result.confidence, "query_id")
    return as_long(out.select(*HYBRID_OUT.split(", ")), "rank")
