"""Corpus queries: sources, cleaning, chunking, replace-by-source, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog import sqltext as S
from askloom.catalog.registry import cte, query
from askloom.functions import text as T
from askloom.functions import udfs
from askloom.operators import chunking, corpus
from askloom.plans import views as V
from askloom.settings import DEFAULTS
from askloom.sources import files, store

DOC_COLUMNS = "doc_id, source, source_rel, topic, subtopic"

cte(
    "raw_docs",
    "SELECT doc_id, source || '/' || doc_id AS source, source AS source_rel, source AS topic, "
    "lang AS subtopic, text FROM documents",
)
cte(
    "docs",
    f"SELECT * FROM (SELECT {DOC_COLUMNS}, {S.clean('text')} AS text FROM raw_docs) "
    "WHERE text <> ''",
    "raw_docs",
)
cte("doc_tokens", f"SELECT *, {S.tokens('text')} AS toks FROM docs", "docs")


def hierarchy(prefix: str, settings) -> None:
    cte(
        f"{prefix}parents",
        f"SELECT *, source || '::parent::' || parent_index AS parent_id, "
        f"{S.section_header('text')} AS section, {S.page_range('text')} AS pages, "
        f"{S.has_table('text')} AS has_table FROM (SELECT *, array_to_string(win, '') AS text "
        f"FROM ({S.windows('doc_tokens', DOC_COLUMNS, 'toks', settings.parent_size, settings.parent_overlap, 'parent_index')}))",
        "doc_tokens",
    )
    cte(
        f"{prefix}chunks",
        f"SELECT *, source || '_' || chunk_index AS chunk_id, 'child' AS chunk_type, "
        f"'local' AS doc_type FROM (SELECT {DOC_COLUMNS}, parent_id, section, pages, has_table, "
        "parent_index, child_index, array_to_string(win, '') AS text, "
        "row_number() OVER (PARTITION BY doc_id ORDER BY parent_index, child_index) - 1 "
        "AS chunk_index FROM ("
        + S.windows(
            f"(SELECT * RENAME (win AS ptoks) FROM {prefix}parents)",
            f"{DOC_COLUMNS}, parent_id, section, pages, has_table, parent_index", "ptoks",
            settings.child_size, settings.child_overlap, "child_index",
        )
        + "))",
        f"{prefix}parents",
    )


hierarchy("", DEFAULTS)
hierarchy("small_", V.SMALL)

PAGES_CTE = f"""
SELECT doc_id, page, CASE WHEN nb >= 2 THEN '' ELSE line END AS text,
  CASE WHEN nb >= 2 THEN
    '| ' || array_to_string(list_transform(cells, lambda c, i: 'c' || i), ' | ') || ' |' || chr(10)
    || '| ' || array_to_string(list_transform(cells, lambda c: '---'), ' | ') || ' |' || chr(10)
    || '| ' || array_to_string(list_transform(cells, lambda c: {S.strip('c')}), ' | ') || ' |'
  END AS tbl
FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS page,
        {S.bars('unnest(lines)')} AS nb, string_split(unnest(lines), '|') AS cells
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
"""
cte("doc_pages", PAGES_CTE)
cte(
    "assembled",
    "SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY page) AS text FROM ("
    f"SELECT doc_id, page, '[Page ' || page || ']' "
    f"|| CASE WHEN {S.strip('text')} <> '' THEN chr(10) || chr(10) || {S.strip('text')} ELSE '' END "
    "|| CASE WHEN tbl IS NOT NULL THEN chr(10) || chr(10) || '[Table 1 on Page ' || page || ']' "
    f"|| chr(10) || tbl ELSE '' END AS part FROM doc_pages "
    f"WHERE {S.strip('text')} <> '' OR tbl IS NOT NULL) GROUP BY doc_id",
    "doc_pages",
)


@query(
    "load_documents",
    f"SELECT {DOC_COLUMNS}, {S.strip('text')} AS text FROM raw_docs WHERE {S.strip('text')} <> ''",
    ("raw_docs",),
)
def load_documents(spark, sf):
    return files.drop_blank(V.raw_docs(spark, sf))


@query(
    "path_metadata",
    """
SELECT page_id, path AS source_rel, parts[-1] AS source_name,
  CASE WHEN regexp_matches(parts[-1], '^.+\\.[^.]+$') THEN regexp_replace(parts[-1], '\\.[^.]+$', '')
       ELSE parts[-1] END AS source_stem,
  CASE WHEN regexp_matches(parts[-1], '^.+\\.[^.]+$')
       THEN lower(regexp_extract(parts[-1], '\\.[^.]+$')) ELSE '' END AS source_ext,
  CASE WHEN len(parts) > 1 THEN parts[1] ELSE 'General' END AS topic,
  CASE WHEN len(parts) > 2 THEN parts[2] ELSE '' END AS subtopic
FROM (SELECT *, string_split(path, '/') AS parts FROM
  (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages))
""",
)
def path_metadata(spark, sf):
    pages = V.table(spark, sf, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return files.with_path_metadata(pages.select("page_id", path.alias("path"))).drop("path")


@query("strip_control", f"SELECT doc_id, {S.strip_control('text')} AS text FROM documents")
def strip_control(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", T.strip_control(F.col("text")).alias("text")
    )


@query("informative_lines", f"SELECT doc_id, {S.informative_text('text')} AS text FROM documents")
def informative_lines(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", T.informative_text(F.col("text")).alias("text")
    )


@query("clean_documents", f"SELECT {DOC_COLUMNS}, text FROM docs", ("docs",))
def clean_documents(spark, sf):
    return V.docs(spark, sf)


@query(
    "token_counts",
    "SELECT doc_id, len(toks) AS tokens, length(text) AS chars FROM doc_tokens",
    ("doc_tokens",),
)
def token_counts(spark, sf):
    return V.docs(spark, sf).select(
        "doc_id",
        T.token_count(F.col("text")).cast("long").alias("tokens"),
        F.length("text").cast("long").alias("chars"),
    )


@query(
    "chunk_windows",
    "SELECT doc_id, window_index, len(win) AS tokens, array_to_string(win, '') AS text FROM ("
    + S.windows("doc_tokens", "doc_id", "toks", 100, 25, "window_index") + ")",
    ("doc_tokens",),
)
def chunk_windows(spark, sf):
    tokenized = V.docs(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("toks"))
    return tokenized.select(
        "doc_id",
        F.posexplode(chunking.token_windows(F.col("toks"), 100, 25)).alias("window_index", "win"),
    ).select(
        "doc_id",
        F.col("window_index").cast("long").alias("window_index"),
        F.size("win").cast("long").alias("tokens"),
        F.array_join("win", "").alias("text"),
    )


@query(
    "flat_chunks",
    "SELECT doc_id, source || '_' || chunk_index AS chunk_id, chunk_index, 'local' AS doc_type, "
    "array_to_string(win, '') AS text FROM ("
    + S.windows(
        "doc_tokens", "doc_id, source", "toks", DEFAULTS.flat_size, DEFAULTS.flat_overlap,
        "chunk_index",
    )
    + ")",
    ("doc_tokens",),
)
def flat_chunks(spark, sf):
    return chunking.chunk_flat(V.docs(spark, sf)).select(
        "doc_id", "chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "doc_type",
        "text",
    )


PARENT_OUT = "doc_id, source, parent_id, parent_index, text, section, pages, has_table"
CHILD_OUT = (
    "doc_id, source, chunk_id, chunk_index, parent_id, parent_index, child_index, chunk_type, "
    "doc_type, text, section, pages, has_table"
)


def as_long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query("hier_parents", f"SELECT {PARENT_OUT} FROM small_parents", ("small_parents",))
def hier_parents(spark, sf):
    out = chunking.chunk_parents(V.docs(spark, sf), V.SMALL).select(*PARENT_OUT.split(", "))
    return as_long(out, "parent_index")


@query("hier_children", f"SELECT {CHILD_OUT} FROM small_chunks", ("small_chunks",))
def hier_children(spark, sf):
    out = chunking.chunk_children(V.docs(spark, sf), V.SMALL).select(*CHILD_OUT.split(", "))
    return as_long(out, "chunk_index", "parent_index", "child_index")


@query(
    "section_header",
    f"SELECT doc_id, {S.section_header('headed')} AS section FROM "
    "(SELECT doc_id, split_part(text, chr(10), 1) || chr(10) || upper(lang) || ' Section ' || doc_id "
    "|| ': ' || source || chr(10) || text AS headed FROM documents)",
)
def section_header(spark, sf):
    # a heading after the first line; behind a long first line it is out of reach
    headed = F.concat(
        F.get(F.split("text", "\n", 2), F.lit(0)), F.lit("\n"), F.upper("lang"), F.lit(" Section "),
        F.col("doc_id").cast("string"), F.lit(": "), F.col("source"), F.lit("\n"), F.col("text"),
    )
    return V.table(spark, sf, "documents").select(
        "doc_id", T.section_header(headed).alias("section")
    )


@query(
    "page_range",
    f"SELECT doc_id, window_index, {S.page_range('text')} AS pages FROM "
    "(SELECT doc_id, window_index, array_to_string(win, '') AS text FROM ("
    + S.windows(
        f"(SELECT *, {S.tokens('text')} AS toks FROM assembled)", "doc_id", "toks", 120, 20,
        "window_index",
    )
    + "))",
    ("assembled",),
)
def page_range(spark, sf):
    texts = corpus.assemble_pages(V.doc_pages(spark, sf)).withColumn("source", F.lit(""))
    return chunking.chunk_flat(texts, 120, 20).select(
        "doc_id",
        F.col("chunk_index").cast("long").alias("window_index"),
        T.page_range(F.col("text")).alias("pages"),
    )


@query("assemble_pages", "SELECT doc_id, text FROM assembled", ("assembled",))
def assemble_pages(spark, sf):
    return corpus.assemble_pages(V.doc_pages(spark, sf))


@query(
    "page_stats",
    """
SELECT doc_id, count(*) AS page_count, count(tbl) AS table_page_count,
  count(*) FILTER (WHERE tbl IS NULL AND length(regexp_replace(text, '%s+', '', 'g')) < 50)
    AS scanned_page_count,
  count(tbl) > 0 AS has_tables
FROM doc_pages GROUP BY doc_id
""" % T.WS,
    ("doc_pages",),
)
def page_stats(spark, sf):
    return corpus.page_stats(V.doc_pages(spark, sf))


@query(
    "table_markdown",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F'
  THEN '| ' || o_orderkey || ' | ' || o_orderstatus || '\\|' || o_orderpriority || ' |' || chr(10)
    || '| --- | --- |'
  ELSE '| order | status\\|priority |' || chr(10) || '| --- | --- |' || chr(10)
    || '| ' || o_orderkey || ' | ' || o_orderstatus || '\\|' || o_orderpriority || ' |'
    || chr(10) || '| ' || o_custkey || ' |  |' END AS markdown
FROM orders
""",
)
def table_markdown(spark, sf):
    key = F.col("o_orderkey").cast("string")
    detail = F.concat_ws("|", "o_orderstatus", "o_orderpriority")
    blank_header = F.array(F.array(F.lit(" "), F.lit(None).cast("string")), F.array(key, detail))
    ragged = F.array(
        F.array(F.lit("order"), F.lit(" status|priority")),
        F.array(key, F.concat(F.lit("\n"), detail)),
        F.array(F.col("o_custkey").cast("string")),
    )
    rows = F.when(F.col("o_orderstatus") == "F", blank_header).otherwise(ragged)
    return V.table(spark, sf, "orders").select(
        "o_orderkey", T.table_markdown(rows).alias("markdown")
    )


AREAS = {
    "english_function_words": ("the", "of", "and", "with", "that"),
    "french_function_words": ("le", "la", "les", "de", "que"),
    "german_function_words": ("der", "die", "und", "den", "ein"),
    "spanish_function_words": ("el", "la", "los", "de", "que"),
    "license_terms": ("license", "copyright", "licensed", "rights"),
    "contact_details": ("email", "phone", "com", "www", "http", "https"),
}
AREA_ROWS = ", ".join(f"('{w}', '{a}')" for a, ws in sorted(AREAS.items()) for w in ws)
cte(
    "topic_hits",
    f"SELECT doc_id, area, count(*) AS hits FROM (SELECT doc_id, unnest({S.alnum_tokens('text')}) AS w "
    f"FROM docs) JOIN (VALUES {AREA_ROWS}) l(w, area) USING (w) GROUP BY ALL",
    "docs",
)
cte(
    "topic_ranked",
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, area) AS area_rank "
    "FROM topic_hits",
    "topic_hits",
)


@query(
    "topic_audit",
    "SELECT area, count(*) FILTER (WHERE area_rank <= 3) AS area_doc_count, "
    "CAST(sum(hits) AS BIGINT) AS area_hits FROM topic_ranked GROUP BY area",
    ("topic_ranked",),
)
def topic_audit(spark, sf):
    hits = corpus.topic_hits(V.docs(spark, sf), AREAS)
    return corpus.topic_rollup(hits)


@query(
    "topic_top_areas",
    "SELECT doc_id, area, hits, area_rank FROM topic_ranked WHERE area_rank <= 3",
    ("topic_ranked",),
)
def topic_top_areas(spark, sf):
    hits = corpus.topic_hits(V.docs(spark, sf), AREAS)
    return as_long(corpus.top_areas(hits), "area_rank")


@query(
    "low_text_documents",
    "SELECT doc_id, length(text) AS char_count FROM docs WHERE length(text) < 600",
    ("docs",),
)
def low_text_documents(spark, sf):
    return as_long(corpus.low_text_documents(V.docs(spark, sf), 600), "char_count")


# The store holds every document in flat chunks; the batch re-ingests the labelled
# documents with larger windows.
cte(
    "stored",
    "SELECT source, source || '_' || chunk_index AS chunk_id, array_to_string(win, '') AS text FROM ("
    + S.windows("doc_tokens", "source", "toks", 200, 20, "chunk_index") + ")",
    "doc_tokens",
)
cte(
    "batch",
    "SELECT source, source || '_' || chunk_index AS chunk_id, array_to_string(win, '') AS text FROM ("
    + S.windows(
        "(SELECT * FROM doc_tokens WHERE doc_id IN (SELECT doc_id FROM labels))", "source",
        "toks", 400, 40, "chunk_index",
    )
    + ")",
    "doc_tokens",
)


def labelled(spark, sf):
    return V.docs(spark, sf).join(V.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query(
    "replace_by_source",
    "SELECT * FROM stored WHERE source NOT IN (SELECT source FROM batch) "
    "UNION ALL SELECT * FROM batch",
    ("stored", "batch"),
)
def replace_by_source(spark, sf):
    columns = ("source", "chunk_id", "text")
    existing = chunking.chunk_flat(V.docs(spark, sf), 200, 20).select(*columns)
    batch = chunking.chunk_flat(labelled(spark, sf), 400, 40).select(*columns)
    return store.replace_by_source(existing, batch)


cte(
    "new_parents",
    "SELECT source, parent_id FROM small_parents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "small_parents",
)


@query(
    "parent_replace_added",
    "SELECT (SELECT count(*) FROM parents) AS stored_before, "
    "(SELECT count(*) FROM new_parents) AS batch_rows, "
    "(SELECT count(DISTINCT parent_id) FROM new_parents WHERE parent_id NOT IN "
    "(SELECT parent_id FROM parents WHERE source NOT IN (SELECT source FROM new_parents))) AS added",
    ("parents", "new_parents"),
)
def parent_replace_added(spark, sf):
    existing = chunking.chunk_parents(V.docs(spark, sf)).select("source", "parent_id")
    batch = chunking.chunk_parents(labelled(spark, sf), V.SMALL).select("source", "parent_id")
    added = store.newly_added(existing, batch, "parent_id").agg(F.count("*").alias("added"))
    return (
        existing.agg(F.count("*").alias("stored_before"))
        .join(F.broadcast(batch.agg(F.count("*").alias("batch_rows"))))
        .join(F.broadcast(added))
    )


TTL_NOW = "2024-01-20 12:00:00"


@query(
    "ttl_purge",
    f"""
SELECT event_id, doc_type, inserted_at FROM (
  SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'dynamic' ELSE 'local' END AS doc_type,
    CASE WHEN event_type = 'view' AND value < 5 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END
      AS inserted_at FROM events)
WHERE NOT (doc_type = 'dynamic' AND coalesce(
  TRY_CAST(replace(replace(inserted_at, 'T', ' '), 'Z', '') AS TIMESTAMP)
    < TIMESTAMP '{TTL_NOW}' - INTERVAL 24 HOUR, false))
""",
)
def ttl_purge(spark, sf):
    rows = V.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("click", "view"), "dynamic").otherwise("local").alias("doc_type"),
        F.when((F.col("event_type") == "view") & (F.col("value") < 5), "not a time")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("inserted_at"),
    )
    return store.purge_expired(rows, F.lit(TTL_NOW + "Z").cast("timestamp"), 24)


@query("rekey", "SELECT md5(source || '_' || chunk_index) AS record_id, chunk_id, text FROM chunks", ("chunks",))
def rekey(spark, sf):
    return store.rekey(V.chunks(spark, sf).select("chunk_id", "text"), "chunk_id")


@query(
    "ingest_report",
    "SELECT (SELECT count(*) FROM documents) AS docs_loaded, "
    "(SELECT count(*) FROM docs) AS docs_preprocessed, "
    "(SELECT count(DISTINCT source) FROM docs) AS source_count, "
    "(SELECT count(*) FROM small_chunks) AS child_chunks_total, "
    "(SELECT count(*) FROM small_chunks) AS chunks_ingested, "
    "(SELECT count(*) FROM small_parents) AS parent_chunks_saved",
    ("docs", "small_chunks", "small_parents"),
)
def ingest_report(spark, sf):
    kept = V.docs(spark, sf)
    children = chunking.chunk_children(kept, V.SMALL)
    parents = chunking.chunk_parents(kept, V.SMALL)
    return corpus.ingest_report(V.raw_docs(spark, sf), kept, children, children, parents)
