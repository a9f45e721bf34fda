"""Session and evaluation-log reports, conversations, answer records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from askloom.catalog import sqltext as S
from askloom.catalog.corpus import as_long
from askloom.catalog.evaluation import answers, clean_list_sql
from askloom.catalog.evaluation import top_rows as best_rows
from askloom.catalog.registry import cte, query
from askloom.functions import records, rules
from askloom.functions import text as T
from askloom.operators import context, sessions
from askloom.plans import views as V
from askloom.settings import DEFAULTS

cte(
    "events_k",
    "SELECT *, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) AS k FROM events",
)
cte(
    "sess",
    "SELECT event_id AS session_id, user_id, ts AS created_at, event_type || ' question ' || event_id AS idea_text, "
    "value / 500 AS confidence FROM events_k",
    "events_k",
)
cte(
    "logs",
    """SELECT event_id AS session_id, event_id AS log_id, user_id, ts AS created_at,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN ' fallback_completed '
    ELSE 'skipped' END AS status,
  event_type = 'click' AS used_fallback, value / 487 AS similarity, k AS articles_surviving, value / 0.97::DOUBLE AS latency_ms,
  k // 30 AS retry_count, value / 491 AS context_precision, value / 499 AS context_recall,
  CASE WHEN k > 20 THEN k / 101 END AS faithfulness, k / 103 AS answer_relevance FROM events_k""",
    "events_k",
)
cte(
    "acts",
    "SELECT event_id AS session_id, event_id * 10 + i AS action_id, event_type || ' task ' || i AS title, "
    "ts + INTERVAL 1 MINUTE * i AS created_at FROM (SELECT *, unnest(range(1, length(event_type) - 2)) AS i FROM events)",
)
MASK = (
    "CASE WHEN trim(status) = 'fallback_completed' THEN 'failed' ELSE trim(status) END AS status, "
    + ", ".join(f"CASE WHEN status = 'completed' THEN {c} END AS {c}" for c in sessions.SCORES)
)


def events(spark, sf):
    return V.table(spark, sf, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    )


def session_rows(spark, sf):
    return events(spark, sf).select(
        F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("created_at"),
        F.concat("event_type", F.lit(" question "), F.col("event_id").cast("string")).alias("idea_text"),
        (F.col("value") / 500).alias("confidence"),
    )


def log_rows(spark, sf):
    status = (
        F.when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", " fallback_completed ")
        .otherwise("skipped")
    )
    return events(spark, sf).select(
        F.col("event_id").alias("session_id"), F.col("event_id").alias("log_id"), "user_id",
        F.col("ts").alias("created_at"), status.alias("status"),
        (F.col("event_type") == "click").alias("used_fallback"),
        (F.col("value") / 487).alias("similarity"), F.col("k").alias("articles_surviving"),
        (F.col("value") / 0.97).alias("latency_ms"), F.expr("k div 30").alias("retry_count"),
        (F.col("value") / 491).alias("context_precision"),
        (F.col("value") / 499).alias("context_recall"),
        F.when(F.col("k") > 20, F.col("k") / 101).alias("faithfulness"),
        (F.col("k") / 103).alias("answer_relevance"),
    )


def action_rows(spark, sf):
    numbers = F.filter(
        F.sequence(F.lit(1), F.length("event_type")), lambda i: i <= F.length("event_type") - 3
    )
    rows = T.each(
        V.table(spark, sf, "events"), ["event_id", "event_type", "ts"], numbers, "i"
    )
    return rows.select(
        F.col("event_id").alias("session_id"),
        (F.col("event_id") * 10 + F.col("i")).alias("action_id"),
        F.concat("event_type", F.lit(" task "), F.col("i").cast("string")).alias("title"),
        (F.col("ts") + F.make_dt_interval(mins=F.col("i"))).alias("created_at"),
    )


@query(
    "session_count",
    "SELECT user_id, count(*) AS sessions FROM sess GROUP BY user_id",
    ("sess",),
)
def session_count(spark, sf):
    return sessions.session_counts(session_rows(spark, sf))


PAGED = (
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, session_id) AS position FROM sess"
)


@query(
    "session_page",
    f"SELECT user_id, session_id, idea_text, position FROM ({PAGED}) WHERE position BETWEEN 21 AND 40",
    ("sess",),
)
def session_page(spark, sf):
    out = sessions.page(session_rows(spark, sf), "user_id", 2, 20, "created_at", "session_id")
    return as_long(out.select("user_id", "session_id", "idea_text", "position"), "position")


LIST_COLUMNS = (
    "user_id, session_id, position, idea_text, actions_taken, similarity, used_fallback, "
    "latency_ms, retry_count, articles_surviving, status, " + ", ".join(sessions.SCORES)
)


@query(
    "session_listing",
    f"""
SELECT {LIST_COLUMNS} FROM (SELECT user_id, session_id, position, idea_text, coalesce(n, 0) AS actions_taken, similarity,
  used_fallback, latency_ms, retry_count, articles_surviving, {MASK}
FROM ({PAGED}) JOIN (SELECT * EXCLUDE (user_id, created_at) FROM logs) USING (session_id)
LEFT JOIN (SELECT session_id, count(*) AS n FROM acts GROUP BY session_id) USING (session_id) WHERE position <= 20)
""",
    ("sess", "logs", "acts"),
)
def session_listing(spark, sf):
    out = sessions.listing(
        session_rows(spark, sf), log_rows(spark, sf), action_rows(spark, sf), 1, 20
    )
    return as_long(out.select(*LIST_COLUMNS.split(", ")), "position")


@query(
    "session_detail",
    """
SELECT session_id, user_id, idea_text, kind, position, content FROM sess LEFT JOIN (
  SELECT session_id, 'action' AS kind, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, action_id) AS position,
    title AS content FROM acts
  UNION ALL
  SELECT conv_id AS session_id, 'turn', row_number() OVER (PARTITION BY conv_id ORDER BY turn), text FROM conversations)
USING (session_id)
""",
    ("sess", "acts"),
)
def session_detail(spark, sf):
    turns = V.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("message")
    )
    out = sessions.detail(session_rows(spark, sf), action_rows(spark, sf), turns)
    return as_long(
        out.select("session_id", "user_id", "idea_text", "kind", "position", "content"), "position"
    )


@query(
    "eval_summary",
    "SELECT s.user_id, count(*) AS total_sessions, count(*) FILTER (WHERE status = 'completed') AS sessions_scored, "
    "round(coalesce(avg(similarity), 0), 6) AS avg_similarity, "
    "round(coalesce(avg(CAST(used_fallback AS INT)) * 100, 0), 6) AS fallback_rate, "
    "round(coalesce(avg(articles_surviving), 0), 6) AS avg_articles_surviving, "
    "round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms, round(coalesce(avg(retry_count), 0), 6) AS avg_retry_count, "
    + ", ".join(
        f"round(avg({c}) FILTER (WHERE status = 'completed'), 6) AS avg_{c}" for c in sessions.SCORES
    )
    + " FROM logs l JOIN sess s USING (session_id) GROUP BY s.user_id",
    ("logs", "sess"),
)
def eval_summary(spark, sf):
    return sessions.summary(session_rows(spark, sf), log_rows(spark, sf))


@query(
    "eval_filtered",
    "SELECT session_id, user_id, status, used_fallback FROM logs WHERE status = 'completed' AND NOT used_fallback "
    "AND created_at >= TIMESTAMP '2024-01-05 00:00:00' - INTERVAL '5 hours 30 minutes' "
    "AND created_at < TIMESTAMP '2024-01-21 00:00:00' - INTERVAL '5 hours 30 minutes'",
    ("logs",),
)
def eval_filtered(spark, sf):
    kept = sessions.filtered(
        log_rows(spark, sf), "completed", False, date(2024, 1, 5), date(2024, 1, 20)
    )
    return kept.select("session_id", "user_id", "status", "used_fallback")


@query(
    "masked_scores",
    f"SELECT session_id, {MASK} FROM logs",
    ("logs",),
)
def masked_scores(spark, sf):
    return sessions.masked_scores(log_rows(spark, sf)).select(
        "session_id", "status", *sessions.SCORES
    )


@query(
    "latest_eval_log",
    "SELECT user_id, log_id, status, latency_ms, "
    + ", ".join(f"CASE WHEN n = 1 THEN {c} END AS {c}" for c in sessions.SCORES)
    + " FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, log_id DESC) AS rn, "
    "count(*) OVER (PARTITION BY user_id) AS n FROM logs) WHERE rn = 1",
    ("logs",),
)
def latest_eval_log(spark, sf):
    # every user keeps one log: the user stands in for the session that is asked again
    out = sessions.latest_log(log_rows(spark, sf), "user_id")
    return out.select("user_id", "log_id", "status", "latency_ms", *sessions.SCORES)


@query(
    "select_by_index",
    """
SELECT session_id, i - 1 AS index, title FROM (SELECT event_id AS session_id, unnest(range(1, length(event_type) - 2)) AS i,
  event_type FROM events) JOIN (SELECT session_id, CAST(right(title, 1) AS BIGINT) AS i, title FROM acts) USING (session_id, i)
WHERE i - 1 IN (0, 2)
""",
    ("acts",),
)
def select_by_index(spark, sf):
    titles = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.length("event_type")), lambda i: i <= F.length("event_type") - 3
        ),
        lambda i: F.concat(F.col("event_type"), F.lit(" task "), i.cast("string")),
    )
    rows = V.table(spark, sf, "events").select(
        F.col("event_id").alias("session_id"), titles.alias("titles")
    )
    picked = spark.createDataFrame([(0,), (2,)], "index int")
    return as_long(
        sessions.select_by_index(rows, "titles", picked).withColumnRenamed("element", "title"),
        "index",
    )


@query(
    "cascade_delete",
    "SELECT 'logs' AS child, session_id FROM logs WHERE session_id NOT IN (SELECT session_id FROM logs WHERE status = 'failed') "
    "UNION ALL SELECT 'actions', session_id FROM acts WHERE session_id NOT IN (SELECT session_id FROM logs WHERE status = 'failed')",
    ("logs", "acts"),
)
def cascade_delete(spark, sf):
    logs = log_rows(spark, sf)
    deleted = logs.filter("status = 'failed'").select("session_id")
    left = lambda rows, name: sessions.cascade(rows, deleted).select(
        F.lit(name).alias("child"), "session_id"
    )
    return left(logs, "logs").unionByName(left(action_rows(spark, sf), "actions"))


# ---- conversations -----------------------------------------------------------------------

cte(
    "paired",
    "SELECT u.conv_id AS session_id, u.turn, u.text AS user_message, a.text AS assistant_message FROM conversations u "
    "LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'",
)
cte(
    "messages",
    f"""SELECT * FROM (SELECT session_id, turn, 0 AS part, 'user' AS role, substr({S.strip('user_message')}, 1, 2000) AS content FROM paired
UNION ALL SELECT session_id, turn, 1, 'assistant', substr({S.strip("coalesce(assistant_message, '')")}, 1, 2000) FROM paired)
WHERE content <> ''""",
    "paired",
)


def tail_sql(n: int) -> str:
    return (
        "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn, part) AS position, role, content "
        "FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, part DESC) AS back FROM messages) "
        f"WHERE back <= {n}"
    )


def paired(spark, sf):
    rows = V.table(spark, sf, "conversations")
    asked = rows.filter("role = 'user'").select(
        F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("user_message")
    )
    said = rows.filter("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("turn"),
        F.col("text").alias("assistant_message"),
    )
    return asked.join(said, ["session_id", "turn"], "left")


@query("conversation_tail", tail_sql(sessions.MAX_MESSAGES), ("messages",))
def conversation_tail(spark, sf):
    out = sessions.last_messages(sessions.turn_messages(paired(spark, sf)))
    return as_long(out.select("session_id", "position", "role", "content"), "position")


@query(
    "conversation_fallback",
    f"""
WITH t AS ({tail_sql(20)})
SELECT c_custkey AS session_id, position, role, content FROM customer JOIN t ON t.session_id = c_custkey
UNION ALL
SELECT c_custkey, u.position, u.role, u.content FROM (SELECT *, unnest(CASE c_mktsegment
  WHEN 'MACHINERY' THEN [{{'position': 1::BIGINT, 'role': 'user', 'content': c_name}}, {{'position': 2::BIGINT, 'role': 'assistant', 'content': 'nation ' || c_nationkey}}]
  ELSE [{{'position': 1::BIGINT, 'role': 'user', 'content': CASE WHEN c_mktsegment = 'BUILDING' THEN '{rules.DEFAULT_QUESTION}' ELSE c_name END}},
        {{'position': 2::BIGINT, 'role': 'assistant', 'content': CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_name || ' insight' ELSE '{rules.DEFAULT_SUMMARY}' END}}]
  END) AS u FROM customer WHERE c_custkey NOT IN (SELECT session_id FROM t))
""",
    ("messages",),
)
def conversation_fallback(spark, sf):
    customer = V.table(spark, sf, "customer")
    legacy = F.to_json(
        F.struct(
            F.array(
                F.struct(F.lit("User").alias("role"), F.concat(F.lit(" "), "c_name").alias("content")),
                F.struct(F.lit("system").alias("role"), F.lit("skipped").alias("content")),
                F.struct(F.lit("user").alias("role"), F.lit("  ").alias("content")),
                F.struct(
                    F.lit("assistant ").alias("role"),
                    F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("content"),
                ),
            ).alias("_conversation")
        )
    )
    insight = F.to_json(
        F.struct(
            F.lit(" ").alias("abstention_message"),
            F.concat("c_name", F.lit(" insight")).alias("market_insight"),
        )
    )
    segment = F.col("c_mktsegment")
    rows = customer.select(
        F.col("c_custkey").alias("session_id"),
        F.when(segment == "BUILDING", " ").otherwise(F.col("c_name")).alias("idea_text"),
        F.when(segment == "MACHINERY", legacy)
        .when(segment == "HOUSEHOLD", insight)
        .otherwise("{}")
        .alias("raw_output"),
    )
    return as_long(sessions.conversation(rows, paired(spark, sf)), "position")


@query(
    "first_nonempty",
    f"SELECT conv_id, turn, coalesce(nullif({S.strip('abstention_message')}, ''), nullif({S.strip('market_insight')}, ''), "
    f"nullif({S.strip('brand_diagnosis')}, ''), '{rules.DEFAULT_FOLLOW_UP}') AS shown FROM answers",
    ("answers",),
)
def first_nonempty(spark, sf):
    names = ("abstention_message", "market_insight", "brand_diagnosis")
    shown = F.coalesce(
        T.first_non_empty(*[F.col(f"answer.{n}") for n in names]), F.lit(rules.DEFAULT_FOLLOW_UP)
    )
    return answers(spark, sf).select("conv_id", "turn", shown.alias("shown"))


@query(
    "retrieved_sources",
    "SELECT query_id, string_agg(s, ', ' ORDER BY s) AS sources FROM "
    "(SELECT DISTINCT query_id, source_rel AS s FROM top_rows) GROUP BY query_id",
    ("top_rows",),
)
def retrieved_sources(spark, sf):
    return sessions.sources_of(best_rows(spark, sf)).withColumn(
        "sources", F.array_join("sources", ", ")
    )


NEEDS = (
    "(n <= 6 OR regexp_matches(t, '^(?:" + "|".join(rules.FOLLOW_UP_OPENERS) + ")') OR (n < 14 AND "
    + S.has_word("t", "|".join(rules.FOLLOW_UP_PRONOUNS)) + "))"
)


@query(
    "chat_retrieval_query",
    f"""
WITH asked AS (SELECT * FROM (SELECT session_id, turn, message, lower({S.squeeze('message')}) AS t,
    row_number() OVER (PARTITION BY session_id ORDER BY turn) AS nth
  FROM (SELECT session_id, turn, coalesce({S.strip('user_message')}, '') AS message FROM paired)) WHERE message <> ''),
f AS (SELECT *, len(regexp_extract_all(t, '[a-z0-9]+')) AS n,
  (SELECT string_agg('- ' || b.message, chr(10) ORDER BY b.nth) FROM asked b
   WHERE b.session_id = a.session_id AND b.nth BETWEEN a.nth - 3 AND a.nth - 1) AS history FROM asked a),
i AS (SELECT conv_id, arg_min(text, turn) AS idea_text FROM conversations GROUP BY conv_id)
SELECT session_id, turn, CASE WHEN {NEEDS} THEN 'Original decision question: ' || {S.strip('idea_text')}
  || coalesce(chr(10) || 'Recent follow-up questions:' || chr(10) || history, '')
  || chr(10) || 'Current follow-up question: ' || message ELSE message END AS retrieval_query,
  CASE WHEN {NEEDS} THEN 'contextual' ELSE 'current_only' END AS mode
FROM f JOIN i ON i.conv_id = f.session_id
""",
    ("paired",),
)
def chat_retrieval_query(spark, sf):
    ideas = (
        V.table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("session_id"))
        .agg(F.min_by("text", "turn").alias("idea_text"))
    )
    return sessions.chat_retrieval_query(paired(spark, sf), ideas)


@query(
    "eval_sample",
    f"SELECT event_id FROM events WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) "
    f"% {DEFAULTS.eval_sample_rate} = 0",
)
def eval_sample(spark, sf):
    return sessions.sampled(V.table(spark, sf, "events").select("event_id"), "event_id")


def iso_sql(x: str) -> str:
    return (
        f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({x}) % 1000000 = 0 THEN '' ELSE "
        f"strftime({x}, '.%f') END || '+05:30'"
    )


@query(
    "ist_time",
    f"SELECT event_id, {iso_sql('(ts + INTERVAL 330 MINUTE)')} AS from_utc, {iso_sql('ts')} AS from_naive FROM events",
)
def ist_time(spark, sf):
    at = F.col("ts")
    return V.table(spark, sf, "events").select(
        "event_id",
        sessions.iso_time(sessions.to_local(at)).alias("from_utc"),
        sessions.iso_time(at).alias("from_naive"),
    )


# ---- answer records ----------------------------------------------------------------------


@query(
    "json_payload",
    """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN '{"k": ' || k || '}' ELSE
  CASE event_type WHEN 'purchase' THEN '[' || k || ', 1]' ELSE props END END AS payload FROM events_k
""",
    ("events_k",),
)
def json_payload(spark, sf):
    props, kind = F.col("props"), F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("  "), props, F.lit("\n")))
        .when(kind == "view", F.concat(F.lit("Result:\n```JSON\n"), props, F.lit("\n```\nend")))
        .when(kind == "signup", F.concat(F.lit("I think [ see {"), F.lit("} "), F.lit("x: [1, {\"k\": "), F.col("k").cast("string"), F.lit("}] ok")))
        .when(kind == "purchase", F.concat(F.lit("values are ["), F.col("k").cast("string"), F.lit(", 1] and more")))
        .otherwise("no payload { here")
    )
    # an empty object would win in the signup text, so it is written with a blank value
    noisy = F.replace(text, F.lit("see {} "), F.lit("see { "))
    return events(spark, sf).select("event_id", records.json_payload(noisy).alias("payload"))


cte(
    "drafts",
    """SELECT event_id, event_type AS et, k, value,
  CASE WHEN k < 90 THEN k / 80 END AS score,
  list_transform(range(1, length(event_type) + 1), lambda i: 'risk ' || i) AS risks,
  CASE event_type WHEN 'click' THEN 'urgent' ELSE 'high' END AS priority,
  CASE WHEN k % 2 = 0 THEN 'pricing' ELSE 'price' END AS decision
FROM events_k""",
    "events_k",
)


def draft_json(spark, sf):
    """Answer records as JSON text: old and new field names, valid and broken values."""
    k, kind = F.col("k"), F.col("event_type")
    numbers = F.sequence(F.lit(1), F.length("event_type"))
    action = F.struct(
        F.lit("task").alias("type"),
        F.concat(F.lit("Plan  "), kind).alias("title"),
        F.when(kind != "view", F.lit(" do it ")).alias("description"),
        F.when(kind == "click", "urgent").otherwise("high").alias("priority"),
        F.when(k % 2 == 0, "pricing").otherwise("price").alias("decision_type"),
    )
    record = F.struct(
        F.concat(F.lit("diagnosis "), kind).alias("idea_summary"),
        F.lit(" ").alias("market_insight"),
        F.when(kind == "view", F.array(F.lit("lead  now"), F.lit(" "))).alias("recommendations"),
        F.transform(numbers, lambda i: F.concat(F.lit("risk "), i.cast("string"))).alias("risks"),
        F.array(action).alias("actions"),
        F.when(k < 90, k / 80).alias("confidence_score"),
        F.struct(
            F.substring("event_type", 1, 2).alias("name"),
            F.when(kind == "signup", "high").otherwise("High").alias("risk_level"),
            k.alias("confidence_score"),
            F.array(kind, F.lit("tag")).alias("tags"),
        ).alias("database_metadata"),
        F.concat(F.lit(" extra "), kind).alias("zz_note"),
        F.lit("second").alias("aa_note"),
    )
    return events(spark, sf).select("event_id", "k", "event_type", F.to_json(record).alias("json"))


@query(
    "record_validation",
    """
SELECT event_id, array_to_string(list_filter([
  CASE WHEN score IS NULL THEN 'confidence_score: missing' END,
  CASE WHEN score > 1 THEN 'confidence_score: range' END,
  CASE WHEN len(risks) > 6 THEN 'risks: too many' END,
  CASE WHEN et = 'view' THEN 'actions.description: missing' END,
  CASE WHEN priority = 'urgent' THEN 'actions.priority: value' END,
  CASE WHEN decision = 'price' THEN 'actions.decision_type: value' END,
  'database_metadata.name: length',
  CASE WHEN et = 'signup' THEN 'database_metadata.brand_risk_level: value' END
], lambda v: v IS NOT NULL), '; ') AS violations FROM drafts
""",
    ("drafts",),
)
def record_validation(spark, sf):
    record = records.parse_record(F.col("json"))
    rows = draft_json(spark, sf).withColumn("record", record)
    return rows.select(
        "event_id", F.array_join(records.violations(F.col("record")), "; ").alias("violations")
    )


@query(
    "output_text",
    """
SELECT event_id, 'brand_diagnosis: diagnosis ' || et || chr(10)
  || CASE WHEN et = 'view' THEN 'suggested_positioning: lead now' || chr(10) ELSE '' END
  || 'risks: ' || array_to_string(risks, ' | ') || chr(10)
  || 'actions: title=Plan ' || et || CASE WHEN et <> 'view' THEN ' ; description=do it' ELSE '' END
  || ' ; priority=' || priority || ' ; decision_type=' || decision || chr(10)
  || CASE WHEN score > 0 THEN 'confidence_score: ' || CAST(score AS VARCHAR) || chr(10) ELSE '' END
  || 'database_metadata: name=' || substr(et, 1, 2) || ' ; brand_risk_level='
  || CASE WHEN et = 'signup' THEN 'high' ELSE 'High' END
  || CASE WHEN k > 0 THEN ' ; confidence_score=' || k ELSE '' END || ' ; tags=' || et || ' | tag' || chr(10)
  || 'aa_note: second' || chr(10) || 'idea_summary: diagnosis ' || et
  || CASE WHEN et = 'view' THEN chr(10) || 'recommendations: ["lead now"," "]' ELSE '' END
  || chr(10) || 'zz_note: extra ' || et AS output
FROM drafts
""",
    ("drafts",),
)
def output_text(spark, sf):
    rows = draft_json(spark, sf).withColumn("record", records.parse_record(F.col("json")))
    extra = F.from_json("json", "map<string, string>")
    return rows.select("event_id", records.output_text(F.col("record"), extra).alias("output"))


RAW = "'raw answer ' || conv_id"
EVAL_LINES = (
    [f"CASE WHEN {S.strip(n)} <> '' THEN '{n}: ' || {S.strip(n)} END" for n in rules.PRIMARY_FIELDS]
    + [
        f"CASE WHEN len({n}) > 0 THEN '{n}: ' || array_to_string(list_transform(list_slice({n}, 1, 4), "
        f"lambda x: {S.strip('x')}), '; ') END"
        for n in rules.LIST_FIELDS
    ]
)
EVAL_BODY = (
    f"coalesce(nullif({S.strip('abstention_message')}, ''), "
    f"nullif(concat_ws(chr(10), {', '.join(EVAL_LINES)}), ''), {RAW})"
)


@query(
    "eval_payload",
    f"SELECT conv_id, turn, {S.truncate_tight(EVAL_BODY, DEFAULTS.eval_answer_chars)} AS answer_text, "
    f"array_to_string(list_transform(list_slice(risks, 1, 4), lambda x: {S.truncate_tight('x', DEFAULTS.eval_context_chars)}), chr(10)) "
    "AS contexts FROM answers",
    ("answers",),
)
def eval_payload(spark, sf):
    raw = F.concat(F.lit("raw answer "), F.col("conv_id").cast("string"))
    return answers(spark, sf).select(
        "conv_id", "turn",
        records.eval_answer(F.col("answer"), raw).alias("answer_text"),
        F.array_join(records.eval_contexts(F.col("answer.risks")), "\n").alias("contexts"),
    )


@query(
    "truncate_text",
    f"SELECT doc_id, {S.truncate('text', 500)} AS loose, {S.truncate_tight('text', 500)} AS tight FROM documents",
)
def truncate_text(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", T.truncate(F.col("text"), 500).alias("loose"),
        T.truncate_tight(F.col("text"), 500).alias("tight"),
    )


TAG_SOURCE = "lower(concat_ws(' ', " + ", ".join(
    [S.squeeze(f) for f in rules.PRIMARY_FIELDS]
    + [
        f"array_to_string({clean_list_sql(f, 6, 120)}, ' ')"
        for f in ("opportunities", "suggested_positioning", "trade_offs")
    ]
) + "))"
TAG_CASES = ", ".join(
    f"CASE WHEN contains(src, '{k}') THEN '{t}' END" for k, t in rules.KEYWORD_TAGS
)


@query(
    "keyword_tags",
    f"SELECT conv_id, turn, array_to_string(list_slice(list_filter([{TAG_CASES}, 'brand-strategy', 'execution'], "
    f"lambda t: t IS NOT NULL), 1, 8), ', ') AS tags FROM (SELECT conv_id, turn, {TAG_SOURCE} AS src FROM answers)",
    ("answers",),
)
def keyword_tags(spark, sf):
    part = lambda n: F.array_join(context.clean_list(F.col(f"answer.{n}"), 6, 120), " ")
    source = F.concat_ws(
        " ",
        *[T.squeeze(F.col(f"answer.{n}")) for n in rules.PRIMARY_FIELDS],
        *[part(n) for n in ("opportunities", "suggested_positioning", "trade_offs")],
    )
    return answers(spark, sf).select(
        "conv_id", "turn", F.array_join(records.keyword_tags(source), ", ").alias("tags")
    )
