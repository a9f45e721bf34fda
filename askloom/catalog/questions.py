"""Question analysis: terms, intent, entities, variants, follow-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.catalog import sqltext as S
from askloom.catalog.registry import cte, query
from askloom.functions import rules, variants
from askloom.functions import text as T
from askloom.operators import fusion
from askloom.plans import retrieve
from askloom.plans import views as V
from askloom.settings import DEFAULTS

ALIASES = rules.ENTITY_ALIASES
# The texts hold none of the default aliases; the alias queries take some that occur in them.
OWN_ALIASES = rules.ENTITY_ALIASES + (("of the", "ofthe"), ("in", "inn"), ("de", "du"))

cte("questions", "SELECT item_id AS query_id, text AS query FROM benchmark")
cte(
    "q",
    f"SELECT *, lower(text) AS lowered FROM (SELECT query_id, query, {S.squeeze('query')} AS text "
    "FROM questions)",
    "questions",
)
cte(
    "q_hints",
    f"SELECT *, {S.entity_hints('text', 'lowered', ALIASES)} AS hints FROM q",
    "q",
)
cte(
    "q_parts",
    f"SELECT *, {S.deterministic_variants('text', 'lowered', DEFAULTS.multi_query_count)} AS det, "
    f"{S.deterministic_variants('text', 'lowered', DEFAULTS.multi_query_count + 4)} AS det_more, "
    f"{S.alias_variants('lowered', ALIASES)} AS ali, "
    f"{S.concept_expansions('text', 'lowered', 'hints')} AS con FROM q_hints",
    "q_hints",
)
POOL = S.concat("list_slice(det, 2, 4)", "ali", "con")
VALID = (
    f"list_filter(list_transform({POOL}, lambda v: {S.squeeze('v')}), "
    f"lambda v: {S.is_valid('v', 'text')})"
)
cte(
    "q_variants",
    f"SELECT *, list_slice({S.distinct_ignore_case(S.concat('[text]', VALID))}, 1, "
    f"{DEFAULTS.variant_limit}) AS used FROM q_parts",
    "q_parts",
)
MORE = (
    "list_transform("
    + S.concat(
        "det_more", "[" + ", ".join(f"query || ' {s}'" for s in rules.CORRECTIVE_SUFFIXES) + "]"
    )
    + f", lambda v: {S.squeeze('v')})"
)
FRESH = (
    f"list_filter({MORE}, lambda v: NOT list_contains(list_transform(used, lambda u: lower(u)), "
    "lower(v)))"
)
cte(
    "q_corrective",
    f"SELECT *, list_slice({S.distinct_ignore_case(FRESH)}, 1, "
    f"{max(DEFAULTS.multi_query_count, 2)}) AS fresh FROM q_variants",
    "q_variants",
)


def long_form(list_column: str, table: str) -> str:
    return (
        f"SELECT query_id, generate_subscripts({list_column}, 1) - 1 AS variant_id, "
        f"unnest({list_column}) AS variant FROM {table}"
    )


cte("variant_rows", long_form("used", "q_variants"), "q_variants")


def exploded(df, texts):
    out = retrieve.explode_variants(df, texts)
    return out.withColumn("variant_id", F.col("variant_id").cast("long"))


@query(
    "bm25_tokens",
    f"SELECT doc_id, len(w) AS token_count, array_to_string(w, ' ') AS tokens FROM "
    f"(SELECT doc_id, {S.search_tokens('text')} AS w FROM docs)",
    ("docs",),
)
def bm25_tokens(spark, sf):
    words = V.docs(spark, sf).select("doc_id", T.search_tokens(F.col("text")).alias("w"))
    return words.select(
        "doc_id", F.size("w").cast("long").alias("token_count"),
        F.array_join("w", " ").alias("tokens"),
    )


@query(
    "content_terms",
    f"SELECT query_id, array_to_string({S.content_terms('query', 20)}, ' ') AS search_terms, "
    f"array_to_string({S.content_terms('query', 14)}, ' ') AS overlap_terms, "
    f"array_to_string({S.content_terms('query', 12)}, ' ') AS default_terms FROM questions",
    ("questions",),
)
def content_terms(spark, sf):
    terms = lambda n: F.array_join(T.content_terms(F.col("query"), n), " ")
    return V.questions(spark, sf).select(
        "query_id", terms(20).alias("search_terms"), terms(14).alias("overlap_terms"),
        terms(12).alias("default_terms"),
    )


cte(
    "user_turns",
    "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'",
)


def user_turns(spark, sf):
    return V.table(spark, sf, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", "text"
    )


@query(
    "query_intent",
    "SELECT doc_id, "
    f"{S.intent('t')} AS intent, {S.intent('t', rules.ANSWER_INFERENTIAL_MARKERS)} AS answer_intent "
    f"FROM (SELECT doc_id, lower({S.squeeze('text')}) AS t FROM documents)",
)
def query_intent(spark, sf):
    # whole documents as questions: the short question texts hold no markers
    return V.raw_docs(spark, sf).select(
        "doc_id",
        variants.intent(F.col("text")).alias("intent"),
        variants.intent(F.col("text"), rules.ANSWER_INFERENTIAL_MARKERS).alias("answer_intent"),
    )


@query(
    "entity_hints",
    f"SELECT doc_id, array_to_string({S.entity_hints('text', 'lowered', OWN_ALIASES)}, '; ') AS hints "
    f"FROM (SELECT doc_id, {S.squeeze('text')} AS text, lower({S.squeeze('text')}) AS lowered "
    "FROM documents)",
)
def entity_hints(spark, sf):
    return V.raw_docs(spark, sf).select(
        "doc_id", F.array_join(variants.entity_hints(F.col("text"), OWN_ALIASES), "; ").alias("hints")
    )


@query(
    "alias_variants",
    long_form("ali", f"(SELECT query_id, {S.alias_variants('lowered', OWN_ALIASES)} AS ali FROM q)"),
    ("q",),
)
def alias_variants(spark, sf):
    return exploded(V.questions(spark, sf), variants.alias_variants(F.col("query"), OWN_ALIASES))


@query(
    "query_variants",
    f"SELECT v.query_id, v.variant_id, v.variant, {S.is_valid('v.variant', 'q.text')} AS is_valid "
    f"FROM ({long_form('det_more', 'q_parts')}) v JOIN q USING (query_id)",
    ("q_parts",),
)
def query_variants(spark, sf):
    questions = V.questions(spark, sf)
    rows = questions.select(
        "query_id", "query",
        F.posexplode(
            variants.deterministic_variants(F.col("query"), DEFAULTS.multi_query_count + 4)
        ).alias("variant_id", "variant"),
    )
    return rows.select(
        "query_id", F.col("variant_id").cast("long").alias("variant_id"), "variant",
        variants.is_valid_variant(F.col("variant"), F.col("query")).alias("is_valid"),
    )


@query("concept_expansion", long_form("con", "q_parts"), ("q_parts",))
def concept_expansion(spark, sf):
    return exploded(V.questions(spark, sf), variants.concept_expansions(F.col("query"), ALIASES))


@query("assembled_variants", "SELECT * FROM variant_rows", ("variant_rows",))
def assembled_variants(spark, sf):
    rows = retrieve.first_variants(V.questions(spark, sf), DEFAULTS, ALIASES)
    return rows.withColumn("variant_id", F.col("variant_id").cast("long"))


@query("corrective_variants", long_form("fresh", "q_corrective"), ("q_corrective",))
def corrective_variants(spark, sf):
    rows = retrieve.second_variants(V.questions(spark, sf), DEFAULTS, ALIASES)
    return rows.withColumn("variant_id", F.col("variant_id").cast("long"))


cte(
    "variant_keys",
    f"SELECT query_id, variant_id, lower({S.squeeze('variant')}) AS variant_key FROM variant_rows",
    "variant_rows",
)


@query(
    "distinct_queries",
    f"SELECT DISTINCT lower({S.squeeze('text')}) AS variant_key FROM "
    "(SELECT variant AS text FROM variant_rows UNION ALL SELECT text FROM user_turns)",
    ("variant_rows", "user_turns"),
)
def distinct_queries(spark, sf):
    rows = retrieve.first_variants(V.questions(spark, sf), DEFAULTS, ALIASES).select("variant")
    asked = user_turns(spark, sf).select(F.col("text").alias("variant"))
    return fusion.distinct_texts(rows.unionByName(asked))


FOLLOW = (
    "(n <= 6 OR regexp_matches(t, '^(?:" + "|".join(rules.FOLLOW_UP_OPENERS) + ")') OR (n < 14 AND "
    + S.has_word("t", "|".join(rules.FOLLOW_UP_PRONOUNS)) + "))"
)
cte(
    "follow_ups",
    f"SELECT conv_id, turn, text, n, {FOLLOW} AS needs_context FROM (SELECT *, "
    f"len(regexp_extract_all(t, '[a-z0-9]+')) AS n FROM (SELECT conv_id, turn, text, "
    f"lower({S.squeeze('text')}) AS t FROM user_turns))",
    "user_turns",
)


@query("followup_flag", "SELECT conv_id, turn, needs_context FROM follow_ups", ("follow_ups",))
def followup_flag(spark, sf):
    return user_turns(spark, sf).select(
        "conv_id", "turn", variants.follow_up_needs_context(F.col("text")).alias("needs_context")
    )
