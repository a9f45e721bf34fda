"""Evaluation queries: rank metrics, answer metrics, coverage, abstention, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog import sqltext as S
from askloom.catalog.corpus import as_long
from askloom.catalog.questions import ALIASES
from askloom.catalog.registry import cte, query
from askloom.catalog.retrieval import K, embedded_questions
from askloom.functions import rules, variants
from askloom.functions import text as T
from askloom.operators import context, dense, fusion, lexical, metrics
from askloom.plans import views as V
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS

cte(
    "qrels",
    "SELECT item_id AS query_id, d.source || '/' || d.doc_id AS target FROM benchmark b "
    "JOIN documents d ON contains(d.text, b.text)",
)
cte(
    "top_rows",
    f"SELECT query_id, rank, similarity, c.* FROM qs_lexical JOIN chunks c USING (chunk_id) "
    f"WHERE rank <= {K}",
    "qs_lexical", "chunks",
)
cte(
    "sources",
    "SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY r) AS source_rank FROM "
    "(SELECT query_id, lower(source) AS source, min(rank) AS r FROM top_rows GROUP BY ALL)",
    "top_rows",
)
cte(
    "matched",
    "SELECT query_id, source_rank, target FROM sources JOIN qrels USING (query_id) WHERE source = target",
    "sources", "qrels",
)
cte(
    "rank_metrics",
    f"""
SELECT query_id, relevant_count, coalesce(hits, 0) AS hits, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_k,
  round(coalesce(hits, 0) / {K}::DOUBLE, 6) AS precision_at_k, round(coalesce(hits, 0) / relevant_count::DOUBLE, 6) AS recall_at_k,
  round(coalesce(ap, 0) / relevant_count, 6) AS ap_at_k, round(coalesce(1::DOUBLE / first_hit_rank, 0), 6) AS mrr_at_k,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant_count, {K}) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_k,
  first_hit_rank
FROM (SELECT query_id, count(DISTINCT target) AS relevant_count FROM qrels GROUP BY query_id)
LEFT JOIN (SELECT query_id, count(*) AS hits, min(source_rank) AS first_hit_rank, sum(nth / source_rank) AS ap,
    sum(1 / log2(source_rank + 1)) AS dcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_rank) AS nth FROM matched) GROUP BY query_id)
USING (query_id)""",
    "qrels", "matched",
)


def top_rows(spark, sf):
    """The best lexical rows of every question, with chunk columns."""
    corpus = V.retrieval_corpus(spark, sf)
    chunks = corpus.chunks
    found = lexical.lexical_topk(corpus.index, V.questions(spark, sf), K).filter(F.col("rank") <= K)
    found = cut_lineage(found.select("query_id", "chunk_id", "rank", "similarity"))
    return chunks.join(found, "chunk_id")


@query("unique_sources", "SELECT * FROM sources", ("sources",))
def unique_sources(spark, sf):
    return as_long(metrics.unique_sources(top_rows(spark, sf), K), "source_rank")


def matches(spark, sf):
    """The matched ranks and the judgements they were matched against."""
    qrels = cut_lineage(V.qrels(spark, sf))
    sources = metrics.unique_sources(top_rows(spark, sf), K)
    return metrics.matched_ranks(sources, qrels), qrels


@query("matched_ranks", "SELECT * FROM matched", ("matched",))
def matched_ranks(spark, sf):
    return as_long(matches(spark, sf)[0], "source_rank")


@query("retrieval_metrics", "SELECT * FROM rank_metrics", ("rank_metrics",))
def retrieval_metrics(spark, sf):
    return as_long(metrics.retrieval_metrics(*matches(spark, sf), K), "hits", "first_hit_rank")


MEANS = ("hit_at_k", "precision_at_k", "recall_at_k", "ap_at_k", "mrr_at_k", "ndcg_at_k")


@query(
    "benchmark_summary",
    "SELECT count(*) AS query_count, "
    + ", ".join(f"round(avg({m}), 6) AS {m}" for m in MEANS)
    + " FROM rank_metrics",
    ("rank_metrics",),
)
def benchmark_summary(spark, sf):
    per_query = metrics.retrieval_metrics(*matches(spark, sf), K)
    return metrics.macro_means(per_query, MEANS)


@query(
    "doc_id_match",
    """
SELECT page_id, target FROM
  (SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''))) AS candidate FROM pages),
  (SELECT lower(lang || '/' || doc_id) AS target FROM documents)
WHERE candidate = target OR ends_with(candidate, '/' || target) OR ends_with(target, '/' || candidate)
""",
)
def doc_id_match(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    candidates = V.table(spark, sf, "pages").select(
        "page_id", metrics.normalize_doc_id(path).alias("candidate")
    )
    targets = V.table(spark, sf, "documents").select(
        metrics.normalize_doc_id(F.concat_ws("/", "lang", "doc_id")).alias("target")
    )
    return metrics.match_doc_ids(candidates, targets).select("page_id", "target")


# ---- answer metrics ----------------------------------------------------------------------

cte(
    "answer_pairs",
    "SELECT u.conv_id, u.turn, u.text AS reference, a.text AS candidate FROM conversations u JOIN "
    "conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "WHERE u.role = 'user' AND a.role = 'assistant'",
)
GRAMS = " UNION ALL ".join(
    f"SELECT conv_id, turn, {n} AS n, side, unnest(list_transform(range(1, len(w) - {n - 2}), "
    f"lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) AS gram FROM pair_tokens"
    for n in range(1, 5)
)
cte(
    "pair_tokens",
    f"SELECT conv_id, turn, 'r' AS side, {S.alnum_tokens('reference')} AS w FROM answer_pairs UNION ALL "
    f"SELECT conv_id, turn, 'c', {S.alnum_tokens('candidate')} FROM answer_pairs",
    "answer_pairs",
)
cte("pair_grams", GRAMS, "pair_tokens")
cte(
    "pair_overlap",
    "SELECT conv_id, turn, n, sum(least(r, c)) AS o, sum(r) AS rt, sum(c) AS ct FROM (SELECT conv_id, turn, n, "
    "gram, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'c') AS c FROM pair_grams "
    "GROUP BY ALL) GROUP BY ALL",
    "pair_grams",
)


def gram_value(column: str, n: int) -> str:
    return f"coalesce(max({column}) FILTER (WHERE n = {n}), 0)"


def log_p(n: int) -> str:
    o = gram_value("o", n)
    return (
        f"ln((CASE WHEN {o} = 0 THEN 0.1::DOUBLE ELSE {o} END) / "
        f"greatest({gram_value('ct', n)}, 1)::DOUBLE)"
    )


BREVITY = (
    f"CASE WHEN {gram_value('ct', 1)} > {gram_value('rt', 1)} THEN 1 ELSE "
    f"exp(1 - {gram_value('rt', 1)} / {gram_value('ct', 1)}::DOUBLE) END"
)


def f1_sql(n: int) -> str:
    return (
        f"CASE WHEN {gram_value('o', n)} > 0 THEN 2::DOUBLE * {gram_value('o', n)} / "
        f"({gram_value('rt', n)} + {gram_value('ct', n)}) ELSE 0 END"
    )


cte(
    "pair_scores",
    "SELECT conv_id, turn, coalesce(token_f1, 0) AS token_f1, coalesce(rouge_2_f1, 0) AS rouge_2_f1, "
    "coalesce(bleu_1, 0) AS bleu_1, coalesce(bleu_4, 0) AS bleu_4 FROM answer_pairs LEFT JOIN ("
    f"SELECT conv_id, turn, round({f1_sql(1)}, 6) AS token_f1, round({f1_sql(2)}, 6) AS rouge_2_f1, "
    f"round(CASE WHEN {gram_value('o', 1)} > 0 THEN ({BREVITY}) * exp({log_p(1)}) ELSE 0 END, 6) AS bleu_1, "
    f"round(CASE WHEN {gram_value('o', 1)} > 0 THEN ({BREVITY}) * exp("
    + " + ".join(f"0.25::DOUBLE * {log_p(n)}" for n in range(1, 5))
    + ") ELSE 0 END, 6) AS bleu_4 FROM pair_overlap GROUP BY conv_id, turn) USING (conv_id, turn)",
    "answer_pairs", "pair_overlap",
)
KEYS = ("conv_id", "turn")


def answer_pairs(spark, sf):
    turns = V.table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select(*KEYS, F.col("text").alias("reference"))
    said = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate")
    )
    return asked.join(said, list(KEYS))


@query("token_f1", "SELECT conv_id, turn, token_f1 FROM pair_scores", ("pair_scores",))
def token_f1(spark, sf):
    pairs = answer_pairs(spark, sf)
    found = metrics.ngram_overlap(pairs, KEYS, 1)
    score = metrics.f_measure(F.col("overlap"), F.col("ref_total"), F.col("cand_total"))
    scored = found.select(*KEYS, F.round(score, 6).alias("token_f1"))
    return pairs.select(*KEYS).join(scored, list(KEYS), "left").na.fill({"token_f1": 0.0})


@query(
    "exact_match",
    "SELECT conv_id, turn, CASE WHEN array_to_string("
    + S.alnum_tokens("reference") + ", ' ') = array_to_string(" + S.alnum_tokens("candidate")
    + ", ' ') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match FROM answer_pairs",
    ("answer_pairs",),
)
def exact_match(spark, sf):
    score = metrics.exact_match(F.col("reference"), F.col("candidate"))
    return answer_pairs(spark, sf).select(*KEYS, score.alias("exact_match"))


@query(
    "rouge_n",
    "SELECT conv_id, turn, token_f1 AS rouge_1_f1, rouge_2_f1 FROM pair_scores",
    ("pair_scores",),
)
def rouge_n(spark, sf):
    pairs = answer_pairs(spark, sf)
    found = metrics.ngram_overlap(pairs, KEYS, 2)
    score = metrics.f_measure(F.col("overlap"), F.col("ref_total"), F.col("cand_total"))
    pick = lambda n: F.round(F.max(F.when(F.col("n") == n, score)), 6)
    scored = found.groupBy(*KEYS).agg(pick(1).alias("rouge_1_f1"), pick(2).alias("rouge_2_f1"))
    return pairs.select(*KEYS).join(scored, list(KEYS), "left").na.fill(0.0)


cte(
    "ref_tokens",
    "SELECT conv_id, turn, generate_subscripts(r, 1) AS j, unnest(r) AS w FROM "
    f"(SELECT conv_id, turn, {S.alnum_tokens('reference')} AS r FROM answer_pairs)",
    "answer_pairs",
)
cte(
    "cand_tokens",
    "SELECT conv_id, turn, generate_subscripts(c, 1) AS i, unnest(c) AS w FROM "
    f"(SELECT conv_id, turn, {S.alnum_tokens('candidate')} AS c FROM answer_pairs)",
    "answer_pairs",
)
# One step per candidate token: the next row of the table of common subsequence lengths.
cte(
    "lcs_rows",
    """SELECT conv_id, turn, 0::BIGINT AS i, j, 0::BIGINT AS v FROM ref_tokens
UNION ALL
SELECT conv_id, turn, i, j, max(greatest(old, CASE WHEN hit THEN before + 1 ELSE 0 END))
  OVER (PARTITION BY conv_id, turn ORDER BY j) FROM (
  SELECT l.conv_id, l.turn, c.i, l.j, l.v AS old, r.w = c.w AS hit,
    coalesce(lag(l.v) OVER (PARTITION BY l.conv_id, l.turn ORDER BY l.j), 0) AS before
  FROM lcs_rows l JOIN cand_tokens c ON c.conv_id = l.conv_id AND c.turn = l.turn AND c.i = l.i + 1
  JOIN ref_tokens r ON r.conv_id = l.conv_id AND r.turn = l.turn AND r.j = l.j)""",
    "ref_tokens", "cand_tokens",
)


@query(
    "rouge_l",
    "SELECT conv_id, turn, round(CASE WHEN o > 0 THEN 2::DOUBLE * o / (rt + ct) ELSE 0 END, 6) AS rouge_l_f1 FROM ("
    f"SELECT conv_id, turn, len({S.alnum_tokens('reference')}) AS rt, len({S.alnum_tokens('candidate')}) AS ct, "
    "coalesce(v, 0) AS o FROM answer_pairs LEFT JOIN "
    "(SELECT conv_id, turn, max(v) AS v FROM lcs_rows GROUP BY conv_id, turn) USING (conv_id, turn))",
    ("answer_pairs", "lcs_rows"),
)
def rouge_l(spark, sf):
    score = metrics.rouge_l(F.col("reference"), F.col("candidate"))
    return answer_pairs(spark, sf).select(*KEYS, score.alias("rouge_l_f1"))


@query("bleu", "SELECT conv_id, turn, bleu_1, bleu_4 FROM pair_scores", ("pair_scores",))
def bleu(spark, sf):
    return metrics.ngram_scores(answer_pairs(spark, sf), KEYS).select(*KEYS, "bleu_1", "bleu_4")


ANSWER_MEANS = ("token_f1", "rouge_2_f1", "bleu_1", "bleu_4")


@query(
    "answer_summary",
    "SELECT count(*) AS query_count, "
    + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ANSWER_MEANS)
    + " FROM pair_scores",
    ("pair_scores",),
)
def answer_summary(spark, sf):
    return metrics.macro_means(metrics.ngram_scores(answer_pairs(spark, sf), KEYS), ANSWER_MEANS)


# ---- coverage and confidence -------------------------------------------------------------

# Local rows: the best lexical rows. Dynamic rows: the three nearest chunks by vector.
cte(
    "small_bundle",
    f"""SELECT *, len({S.tokens('text')}) AS tokens FROM (
  SELECT query_id, chunk_id, rank, similarity, source, source_rel, topic, subtopic, text, false AS is_dynamic FROM top_rows
  UNION ALL BY NAME SELECT query_id, chunk_id, rank, similarity, source, source_rel, topic, subtopic, text, true AS is_dynamic
  FROM qs_dense JOIN chunks USING (chunk_id) WHERE rank <= 3)""",
    "top_rows", "qs_dense", "chunks",
)
cte(
    "small_budget",
    "SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY is_dynamic, rank "
    f"ROWS UNBOUNDED PRECEDING) AS running FROM small_bundle) WHERE running <= {DEFAULTS.max_context_tokens}",
    "small_bundle",
)
R4 = "CAST(round(CAST({x} AS DECIMAL(20, 10)), 4) AS DOUBLE)"
cte(
    "coverage",
    f"""SELECT query_id, coalesce(doc_count, 0) AS doc_count, coalesce(strong_doc_count, 0) AS strong_doc_count,
  coalesce(max_similarity, 0) AS max_similarity, coalesce(avg_similarity, 0) AS avg_similarity,
  coalesce(lt, 0) AS local_tokens, coalesce(dt, 0) AS dynamic_tokens, coalesce(lt, 0) + coalesce(dt, 0) AS total_tokens
FROM questions LEFT JOIN (SELECT query_id, count(*) AS doc_count, count(*) FILTER (WHERE similarity >= 0.45) AS strong_doc_count,
  {R4.format(x='max(similarity)')} AS max_similarity, {R4.format(x='avg(similarity)')} AS avg_similarity,
  CAST(sum(tokens) FILTER (WHERE NOT is_dynamic) AS BIGINT) AS lt, CAST(sum(tokens) FILTER (WHERE is_dynamic) AS BIGINT) AS dt
  FROM small_budget GROUP BY query_id) USING (query_id)""",
    "questions", "small_budget",
)
cte(
    "small_gate",
    "SELECT query_id, coalesce(max(similarity), 0) < 0.45 AS low_confidence FROM questions "
    "LEFT JOIN small_budget USING (query_id) GROUP BY query_id",
    "questions", "small_budget",
)
cte(
    "signals",
    """SELECT query_id, coalesce(round(greatest(0::DOUBLE, least(1::DOUBLE, 0.7::DOUBLE * (top_sum / top_n)
  + 0.3::DOUBLE * least(1::DOUBLE, strong / top_n))), 6), 0) AS retrieval_signal
FROM questions LEFT JOIN (SELECT query_id, sum(s) FILTER (WHERE n <= 4) AS top_sum, least(count(*), 4)::DOUBLE AS top_n,
  count(*) FILTER (WHERE s >= 0.45) AS strong FROM (SELECT query_id, greatest(0, least(1, similarity)) AS s,
    row_number() OVER (PARTITION BY query_id ORDER BY greatest(0, least(1, similarity)) DESC, chunk_id) AS n FROM small_budget)
  GROUP BY query_id) USING (query_id)""",
    "questions", "small_budget",
)


def small_budget(spark, sf):
    corpus = V.retrieval_corpus(spark, sf)
    columns = ("source", "source_rel", "topic", "subtopic", "text")
    local = top_rows(spark, sf).withColumn("is_dynamic", F.lit(False))
    near = dense.nearest(corpus.vectors, embedded_questions(spark, sf), 3)
    near = cut_lineage(
        near.select(
            "query_id", "chunk_id", "rank", fusion.clamp(F.col("score")).alias("similarity")
        )
    )
    near = corpus.chunks.join(near, "chunk_id")
    keep = ("query_id", "chunk_id", "rank", "similarity", *columns, "is_dynamic")
    rows = local.select(*keep).unionByName(
        near.withColumn("is_dynamic", F.lit(True)).select(*keep)
    )
    counted = rows.withColumn("tokens", T.token_count(F.col("text")).cast("long"))
    return context.token_budget(counted)


@query("coverage_metrics", "SELECT * FROM coverage", ("coverage",))
def coverage_metrics(spark, sf):
    return context.coverage(small_budget(spark, sf), V.questions(spark, sf))


def abstain_sql(fallback: bool) -> str:
    weak = "low_confidence AND strong_doc_count = 0"
    q = lambda s: "'" + s + "'"
    first = (
        f"WHEN {weak} AND dynamic_tokens = 0 THEN {q(rules.REASON_FALLBACK_EMPTY)} "
        if fallback else ""
    )
    return (
        f"CASE WHEN doc_count = 0 THEN {q(rules.REASON_NO_CONTEXT)} {first}"
        f"WHEN {weak} THEN {q(rules.REASON_LOW_CONFIDENCE)} "
        f"WHEN max_similarity < 0.3375 AND doc_count < 2 THEN {q(rules.REASON_TOO_FEW)} ELSE '' END"
    )


cte(
    "decisions",
    f"SELECT query_id, doc_count, low_confidence, {abstain_sql(True)} AS reason, {abstain_sql(True)} <> '' "
    "AS abstain, avg_similarity FROM coverage JOIN small_gate USING (query_id)",
    "coverage", "small_gate",
)


def decisions(spark, sf):
    budget = small_budget(spark, sf)
    questions = V.questions(spark, sf)
    gate = budget.groupBy("query_id").agg(F.max("similarity").alias("best"))
    low = F.coalesce("best", F.lit(0.0)) < 0.45
    measured = context.coverage(budget, questions).join(gate, "query_id", "left")
    return context.abstention(measured.withColumn("low_confidence", low), fallback_requested=True)


@query(
    "abstain_decision",
    "SELECT query_id, doc_count, low_confidence, abstain, reason FROM decisions",
    ("decisions",),
)
def abstain_decision(spark, sf):
    return decisions(spark, sf).select(
        "query_id", "doc_count", "low_confidence", "abstain", "reason"
    )


@query("retrieval_signal", "SELECT * FROM signals", ("signals",))
def retrieval_signal(spark, sf):
    return context.retrieval_signal(small_budget(spark, sf), V.questions(spark, sf))


# Answer records from the assistant turns: sentences become the fields in order.
cte(
    "answers",
    """SELECT conv_id, turn, CASE WHEN length(text) < 60 THEN text END AS abstention_message,
  s[1] || ' [source=conv' || conv_id || ']' AS brand_diagnosis, s[2] AS market_insight, s[3] AS final_positioning,
  s[4] AS target_audience, s[5] AS chosen_strategy,
  list_transform(list_slice(s, 6, 8), lambda x: x || ' [SOURCE=list]') AS suggested_positioning,
  list_slice(s, 9, 16) AS risks, list_slice(s, 17, 19) AS opportunities, list_slice(s, 20, 21) AS trade_offs
FROM (SELECT conv_id, turn, text, string_split_regex(text, '[.]\\s+') AS s FROM conversations WHERE role = 'assistant')""",
)


def answers(spark, sf):
    said = V.table(spark, sf, "conversations").filter("role = 'assistant'")
    parts = said.select("conv_id", "turn", "text", F.split("text", r"[.]\s+", -1).alias("s"))
    nth = lambda i: F.get("s", F.lit(i))
    mark = lambda c: F.concat(c, F.lit(" [source=conv"), F.col("conv_id").cast("string"), F.lit("]"))
    return parts.select(
        "conv_id", "turn",
        F.struct(
            F.when(F.length("text") < 60, F.col("text")).alias("abstention_message"),
            mark(nth(0)).alias("brand_diagnosis"),
            nth(1).alias("market_insight"),
            nth(2).alias("final_positioning"),
            nth(3).alias("target_audience"),
            nth(4).alias("chosen_strategy"),
            F.transform(F.slice("s", 6, 3), lambda x: F.concat(x, F.lit(" [SOURCE=list]"))).alias(
                "suggested_positioning"
            ),
            F.slice("s", 9, 8).alias("risks"),
            F.slice("s", 17, 3).alias("opportunities"),
            F.slice("s", 20, 2).alias("trade_offs"),
        ).alias("answer"),
    )


FILLED = " + ".join(
    f"CASE WHEN {S.squeeze(f)} <> '' THEN 1 ELSE 0 END" for f in rules.PRIMARY_FIELDS
)


def clean_list_sql(x: str, n: int, size: int) -> str:
    return (
        f"list_filter(list_transform(list_slice({x}, 1, {n}), lambda t: {S.truncate('t', size)}), "
        "lambda t: t <> '')"
    )


EVIDENCE = " || ' ' || ".join(
    [S.squeeze("brand_diagnosis"), S.squeeze("market_insight")]
    + [f"array_to_string({clean_list_sql(f, 6, 180)}, ' ')" for f in rules.LIST_FIELDS]
)
cte(
    "generation",
    f"""SELECT conv_id, turn, {S.squeeze('abstention_message')} <> '' AS abstained,
  CASE WHEN {S.squeeze('abstention_message')} <> '' THEN 0.1::DOUBLE ELSE round(greatest(0::DOUBLE, least(1::DOUBLE,
    0.7::DOUBLE * (({FILLED}) / 5::DOUBLE) + 0.3::DOUBLE * least(1::DOUBLE,
    len(regexp_extract_all({EVIDENCE}, '(?i)\\[source=[^\\n]*?\\]')) / 3::DOUBLE))), 6) END AS generation_signal
FROM answers""",
    "answers",
)


@query("generation_signal", "SELECT * FROM generation", ("generation",))
def generation_signal(spark, sf):
    return answers(spark, sf).select(
        "conv_id", "turn",
        (T.squeeze(F.col("answer.abstention_message")) != "").alias("abstained"),
        context.generation_signal(F.col("answer")).alias("generation_signal"),
    )


VERDICT = (
    "CASE WHEN event_type = 'view' THEN 'partial' WHEN event_type = 'error' THEN 'not_grounded' "
    "WHEN event_type = 'click' THEN 'grounded' END"
)


@query(
    "calibrated_confidence",
    f"""
SELECT event_id, round(CASE WHEN abstained THEN greatest(0.05::DOUBLE, least(0.25::DOUBLE, r * 0.45::DOUBLE))
  ELSE greatest(0::DOUBLE, least(1::DOUBLE, (0.75::DOUBLE * r + 0.25::DOUBLE * g) * CASE verdict WHEN 'partial' THEN 0.9::DOUBLE
    WHEN 'not_grounded' THEN 0.35::DOUBLE ELSE 1::DOUBLE END)) END, 6) AS confidence,
  greatest(0::DOUBLE, least(0.2::DOUBLE, r)) AS abstained_confidence
FROM (SELECT event_id, least(1::DOUBLE, value / 131) AS r, user_id / 151 AS g, event_type = 'signup' AS abstained,
  {VERDICT} AS verdict FROM events)
""",
)
def calibrated_confidence(spark, sf):
    verdict = (
        F.when(F.col("event_type") == "view", "partial")
        .when(F.col("event_type") == "error", "not_grounded")
        .when(F.col("event_type") == "click", "grounded")
    )
    signal = F.least(F.lit(1.0), F.col("value") / 131)
    return V.table(spark, sf, "events").select(
        "event_id",
        context.calibrated(
            signal, F.col("user_id") / 151, F.col("event_type") == "signup", verdict
        ).alias("confidence"),
        context.abstained_confidence(signal).alias("abstained_confidence"),
    )


HINTS = S.entity_hints(S.squeeze("query"), f"lower({S.squeeze('query')})", ALIASES)
HEAD = (
    "lower(coalesce(nullif(source_rel, ''), source) || ' ' || topic || ' ' || subtopic || ' ' || "
    "substr(text, 1, 300))"
)


@query(
    "retry_after_abstain",
    f"""
SELECT query_id, doc_count, strong_doc_count, len(hints) AS hint_count,
  doc_count >= 2 AND NOT (strong_doc_count <= 0 AND max_similarity < 0.45)
  AND (len(hints) = 0 OR coalesce(named, false)) AS retry
FROM coverage JOIN (SELECT query_id, {HINTS} AS hints FROM questions) USING (query_id)
LEFT JOIN (SELECT query_id, bool_or(len(list_filter(hints, lambda h: contains(head, h))) > 0) AS named
  FROM (SELECT query_id, {HEAD} AS head FROM small_budget) JOIN (SELECT query_id, {HINTS} AS hints FROM questions) USING (query_id)
  GROUP BY query_id) USING (query_id)
""",
    ("coverage", "small_budget", "questions"),
)
def retry_after_abstain(spark, sf):
    budget = small_budget(spark, sf)
    questions = V.questions(spark, sf)
    measured = context.coverage(budget, questions)
    return as_long(
        context.retry_after_abstention(budget, measured, questions, aliases=ALIASES), "hint_count"
    )


@query(
    "similarity_stats",
    """
SELECT query_id, coalesce(mn, 0) AS min_similarity, coalesce(mx, 0) AS max_similarity, coalesce(av, 0) AS mean_similarity,
  coalesce(ab, 0) AS above_threshold, coalesce(n, 0) AS total FROM questions LEFT JOIN (SELECT query_id, min(similarity) AS mn,
  max(similarity) AS mx, round(avg(similarity), 6) AS av, count(*) FILTER (WHERE similarity > 0.45) AS ab, count(*) AS n
  FROM top_rows GROUP BY query_id) USING (query_id)
""",
    ("questions", "top_rows"),
)
def similarity_stats(spark, sf):
    return metrics.similarity_stats(top_rows(spark, sf), V.questions(spark, sf))


@query(
    "token_ratio",
    "SELECT query_id, total_tokens, CASE WHEN total_tokens = 0 THEN 0::DOUBLE ELSE round(local_tokens / "
    "total_tokens::DOUBLE, 6) END AS local_ratio, CASE WHEN total_tokens = 0 THEN 0::DOUBLE ELSE "
    "round(dynamic_tokens / total_tokens::DOUBLE, 6) END AS dynamic_ratio FROM coverage",
    ("coverage",),
)
def token_ratio(spark, sf):
    measured = context.coverage(small_budget(spark, sf), V.questions(spark, sf))
    total, local, dynamic = metrics.token_ratio(F.col("local_tokens"), F.col("dynamic_tokens"))
    return measured.select(
        "query_id", total.alias("total_tokens"), local.alias("local_ratio"),
        dynamic.alias("dynamic_ratio"),
    )


@query(
    "fallback_stats",
    """
SELECT event_id, used_fallback, CASE WHEN used_fallback THEN greatest(k - 50, 0) ELSE 0 END AS articles_fetched,
  CASE WHEN used_fallback THEN greatest(k - 70, 0) ELSE 0 END AS articles_surviving,
  CASE WHEN used_fallback THEN k / 100 END AS avg_fallback_relevance,
  greatest(value - 10, 0) AS latency_ms, greatest(k - 90, 0) AS retry_count, event_type <> 'error' AS validation_passed
FROM (SELECT *, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k, event_type = 'click' AS used_fallback FROM events)
""",
)
def fallback_stats(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    used = F.col("event_type") == "click"
    return V.table(spark, sf, "events").select(
        "event_id",
        *[
            c.alias(n)
            for n, c in {
                **metrics.fallback_stats(used, k - 50, k - 70, k / 100),
                **metrics.generation_stats(
                    F.col("value") - 10, k - 90, F.col("event_type") != "error"
                ),
            }.items()
        ],
    )
