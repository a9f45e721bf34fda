"""One registered query per operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import (
    exact_dedup,
    hard_negatives,
    html,
    licenses,
    line_dedup,
    mixing,
    nbsvm,
    packing,
    phrases,
    quality,
    simhash,
    toxicity,
    warc,
)
from askloom.llm.common import table
from askloom.llm.registry import ORACLE, QUERIES, query, tokenizer_path
from askloom.session import scratch_path

__all__ = ["ORACLE", "QUERIES"]


@query(
    "op1_warc",
    """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload,
         from_hex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits
  FROM pages),
ranked AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM payloads)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           16 * substr(bits, i + 1, 1)::INT + 8 * substr(bits, i + 2, 1)::INT + 4 * substr(bits, i + 3, 1)::INT
           + 2 * substr(bits, i + 4, 1)::INT + substr(bits, i + 5, 1)::INT + 1, 1) FOR i IN range(0, 160, 5)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM ranked
""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


@query(
    "op2_mixing",
    r"""
WITH docs AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('11:' || doc_id), 1, 16) AS draw
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
rated AS (
  SELECT source, source_size, 3 * source_size AS most,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
          WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight
  FROM sources),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY most::DOUBLE / weight::DOUBLE, source NULLS LAST) AS place FROM rated),
level AS (
  SELECT max(((SELECT sum(source_size) FROM sources)
              - coalesce((SELECT sum(b.most) FROM ranked b WHERE b.place < a.place), 0))::DOUBLE
             / ((SELECT sum(weight) FROM ranked)
                - coalesce((SELECT sum(b.weight) FROM ranked b WHERE b.place < a.place), 0))::DOUBLE) AS v
  FROM ranked a),
goals AS (SELECT r.*, least(most::DOUBLE, v * weight::DOUBLE) AS target FROM ranked r, level),
budgets AS (
  SELECT *, floor(target)::BIGINT AS whole,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goals),
placed AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM docs d)
SELECT p.doc_id, p.size, b.source_size, b.target, b.epochs,
       (b.epochs * p.size
        + greatest(0, least(p.size, b.whole - b.epochs * b.source_size - p.earlier)))::BIGINT AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
""",
)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


@query(
    "op3_exact_dedup",
    """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op5_host_quality",
    r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
places AS (
  SELECT doc_id, pos, array_to_string(words[pos : pos + 4], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM docs)),
again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS n FROM places) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, d.source, len(d.words)::BIGINT AS n_words,
         length(array_to_string(d.words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM judged GROUP BY source),
moments AS (
  SELECT avg(failed / n) AS m, var_samp(failed / n) AS v, avg(n) AS size FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > 0 AND m > 0 AND m < 1
                 THEN greatest(1.0::DOUBLE, least(m * (1 - m) / v - 1, greatest(size, 1.0::DOUBLE))) ELSE size END AS s
  FROM moments),
verdicts AS (SELECT source, (failed + s * m) / (n + s) <= 0.5 AS host_kept FROM hosts, prior)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
       NOT j.base_failed AND v.host_kept AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
""",
)
def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("host_rate")


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path()).drop("ids")


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(table(spark, sf_dir, "pages"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@query(
    "op10_line_dedup",
    r"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
runs AS (
  SELECT doc_id, pos, array_to_string(lines[pos : pos + 2], chr(10)) AS run
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM lines)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER o AS nth, first_value(doc_id) OVER o AS first_doc, first_value(pos) OVER o AS first_pos
  FROM runs WHERE regexp_matches(run, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY run ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, range(3) r(k)
  WHERE nth > 1 AND NOT (first_doc = doc_id AND pos + k < first_pos + 3)),
flat AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM lines)
SELECT f.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       coalesce(string_agg(f.line, chr(10) ORDER BY f.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.pos = g.pos
GROUP BY f.doc_id
""",
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(table(spark, sf_dir, "documents"))


@query(
    "op11_hard_negatives",
    """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v, row_number() OVER () AS place
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.place, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.place <> b.place WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT place, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS nth
  FROM scored WHERE same QUALIFY nth <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.place, p.nth ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n USING (place)
  WHERE NOT n.same AND 100 * n.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
""",
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=moved)


@query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op13_phrases",
    r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM places, range(1, 5) x(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
         CAST(2000000::HUGEINT * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(w[s : s + q - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, range(2, 4) x(q), range(1, 4) y(s) WHERE q < m AND s + q - 1 <= m GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b LEFT JOIN around o USING (lang, phrase)
  WHERE NOT coalesce(100::HUGEINT * o.longer >= 80::HUGEINT * b.a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
