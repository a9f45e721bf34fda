"""Reports over sessions, evaluation logs, actions and chat turns."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import rules
from askloom.functions import text as T
from askloom.functions.variants import follow_up_needs_context
from askloom.operators.ordering import numbered
from askloom.session import cut_lineage
from askloom.settings import DEFAULTS

OFFSET = "+05:30"
OFFSET_INTERVAL = "INTERVAL '05:30' HOUR TO MINUTE"
SCORES = ("context_precision", "context_recall", "faithfulness", "answer_relevance")
MAX_MESSAGES = 20
MAX_MESSAGE_CHARS = 2000


def iso_time(local: Column) -> Column:
    """ISO text with the fixed offset; a fraction only where there is one."""
    whole = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(local, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit(OFFSET))


def to_local(utc: Column) -> Column:
    return F.from_utc_timestamp(utc, OFFSET)


def normalized_status(status: Column) -> Column:
    s = T.strip(F.coalesce(status, F.lit("")))
    return F.when(s == "fallback_completed", "failed").otherwise(s)


def masked_scores(logs: DataFrame) -> DataFrame:
    """Normal status; the four scores show only when it is ``completed``."""
    done = F.col("status") == "completed"
    return logs.withColumn("status", normalized_status(F.col("status"))).withColumns(
        {c: F.when(done, F.col(c)) for c in SCORES}
    )


def latest_log(logs: DataFrame, key: str) -> DataFrame:
    """One log per session: the newest, with its four scores cleared when it replaced another.

    An aggregate, so a session with very many logs is combined on the map side.
    """
    columns = [c for c in logs.columns if c != key]
    newest = logs.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct("created_at", "log_id")).alias("_log"),
        F.count("*").alias("_n"),
    )
    flat = newest.select(key, "_log.*", "_n")
    return flat.withColumns(
        {c: F.when(F.col("_n") == 1, F.col(c)) for c in SCORES}
    ).drop("_n")


def page(rows: DataFrame, key: str, number: int, size: int, newest: str, tie: str) -> DataFrame:
    """One page per ``key``, newest first. Tasks keep only the rows up to the page's end."""
    order = Window.partitionBy(key).orderBy(F.desc(newest), F.asc(tie))
    end = number * size
    return (
        rows.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= end)
        .filter(F.col("position") > end - size)
    )


def session_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"))


def listing(
    sessions: DataFrame, logs: DataFrame, actions: DataFrame, number: int, size: int
) -> DataFrame:
    """A page of sessions with their log and number of actions, by two left joins."""
    shown = page(sessions, "user_id", number, size, "created_at", "session_id")
    taken = actions.groupBy("session_id").agg(F.count("*").alias("actions_taken"))
    log_columns = [c for c in logs.columns if c not in ("user_id", "created_at")]
    return (
        shown.join(masked_scores(logs.select(*log_columns)), "session_id", "left")
        .join(taken, "session_id", "left")
        .na.fill({"actions_taken": 0})
    )


def detail(sessions: DataFrame, actions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with their children as ordered rows: actions newest first, turns oldest first.

    One row per child, numbered, instead of a nested list: a session may have any
    number of children.
    """
    columns = ("session_id", "kind", "position", "content")
    recent_first = actions.withColumn("_age", -F.col("created_at").cast("timestamp").cast("double"))
    child_actions = numbered(recent_first, "session_id", ("_age", "action_id"), "position").select(
        "session_id", F.lit("action").alias("kind"), "position", F.col("title").alias("content")
    )
    child_turns = numbered(turns, "session_id", ("turn",), "position").select(
        "session_id", F.lit("turn").alias("kind"), "position", F.col("message").alias("content")
    )
    children = child_actions.select(*columns).unionByName(child_turns.select(*columns))
    # a left join could not split a session with most of the rows
    with_children = sessions.join(cut_lineage(children), "session_id")
    without = sessions.join(
        actions.select("session_id").unionByName(turns.select("session_id")), "session_id", "left_anti"
    )
    return with_children.unionByName(without, allowMissingColumns=True)


def summary(sessions: DataFrame, logs: DataFrame) -> DataFrame:
    """Per user: counts, means and rates in one aggregate. Empty means are 0, empty scores NULL."""
    joined = logs.drop("user_id").join(sessions.select("session_id", "user_id"), "session_id")
    done = F.col("status") == "completed"
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return joined.groupBy("user_id").agg(
        F.count("*").alias("total_sessions"),
        F.count_if(done).alias("sessions_scored"),
        mean("similarity").alias("avg_similarity"),
        mean(F.col("used_fallback").cast("double") * 100).alias("fallback_rate"),
        mean("articles_surviving").alias("avg_articles_surviving"),
        mean("latency_ms").alias("avg_latency_ms"),
        mean("retry_count").alias("avg_retry_count"),
        *[F.round(F.avg(F.when(done, F.col(c))), 6).alias(f"avg_{c}") for c in SCORES],
    )


def filtered(
    logs: DataFrame, status: str | None = None, used_fallback: bool | None = None,
    date_from: date | None = None, date_to: date | None = None,
) -> DataFrame:
    """Logs that meet all given conditions; days are days at the fixed offset, both included."""
    midnight = lambda d, days: (
        F.lit(str(d)).cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(days))
        - F.expr(OFFSET_INTERVAL)
    )
    conditions = []
    if status:
        conditions.append(F.col("status") == status)
    if used_fallback is not None:
        conditions.append(F.col("used_fallback") == used_fallback)
    if date_from is not None:
        conditions.append(F.col("created_at") >= midnight(date_from, 0))
    if date_to is not None:
        conditions.append(F.col("created_at") < midnight(date_to, 1))
    return logs.filter(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def select_by_index(rows: DataFrame, array: str, indices: DataFrame) -> DataFrame:
    """Elements of an array column whose position is in ``indices``."""
    others = [c for c in rows.columns if c != array]
    return T.each(rows, others, F.col(array), "element", "index").join(
        indices, "index", "left_semi"
    )


def cascade(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of a child table that remain once the sessions are gone."""
    return rows.join(deleted, "session_id", "left_anti")


def turn_messages(turns: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Turns (session_id, turn, user_message, assistant_message) as single messages, cut, no blanks."""
    entry = lambda part, role, c: F.struct(
        F.lit(part).alias("part"), F.lit(role).alias("role"),
        F.substring(T.strip(F.coalesce(F.col(c), F.lit(""))), 1, MAX_MESSAGE_CHARS).alias("content"),
    )
    both = F.array(entry(0, "user", "user_message"), entry(1, "assistant", "assistant_message"))
    kept = F.filter(both, lambda m: m["content"] != "")
    return T.each(turns, ["session_id", "turn", *carried], kept, "m").select("session_id", "turn", "m.*", *carried)


def last_messages(messages: DataFrame, n: int = MAX_MESSAGES) -> DataFrame:
    """The last ``n`` messages of each session with their position among them."""
    back = Window.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("part"))
    kept = messages.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n)
    forward = Window.partitionBy("session_id").orderBy("turn", "part")
    return kept.withColumn("position", F.row_number().over(forward)).drop("_back")


LEGACY = "struct<_conversation: array<struct<role: string, content: string>>>"


def conversation(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages of each session: from its turns, else from its stored record, else a default pair.

    ``sessions``: (session_id, idea_text, raw_output as JSON text).
    """
    columns = ("session_id", "position", "role", "content")
    known = sessions.select("session_id")
    from_turns = last_messages(turn_messages(turns.join(known, "session_id", "left_semi")))
    without = sessions.join(from_turns.select("session_id").distinct(), "session_id", "left_anti")

    stored = F.from_json("raw_output", LEGACY)["_conversation"]
    cleaned = F.transform(
        stored,
        lambda m: F.struct(
            F.lower(T.strip(F.coalesce(m["role"], F.lit("")))).alias("role"),
            F.substring(T.strip(F.coalesce(m["content"], F.lit(""))), 1, MAX_MESSAGE_CHARS).alias(
                "content"
            ),
        ),
    )
    usable = F.filter(
        cleaned, lambda m: m["role"].isin("user", "assistant") & (m["content"] != "")
    )
    tail = F.slice(usable, F.greatest(F.size(usable) - (MAX_MESSAGES - 1), F.lit(1)), MAX_MESSAGES)
    legacy = T.let(F.coalesce(tail, F.expr("cast(array() as array<struct<role: string, content: string>>)")), lambda x: x)

    fields = F.from_json(
        "raw_output",
        "struct<abstention_message: string, market_insight: string, brand_diagnosis: string, "
        "idea_summary: string>",
    )
    said = F.coalesce(
        T.first_non_empty(
            *[fields[n] for n in ("abstention_message", "market_insight", "brand_diagnosis", "idea_summary")]
        ),
        F.lit(rules.DEFAULT_SUMMARY),
    )
    asked = F.coalesce(T.first_non_empty(F.col("idea_text")), F.lit(rules.DEFAULT_QUESTION))
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.substring(asked, 1, MAX_MESSAGE_CHARS).alias("content")),
        F.struct(
            F.lit("assistant").alias("role"), F.substring(said, 1, MAX_MESSAGE_CHARS).alias("content")
        ),
    )
    picked = without.withColumn("_legacy", legacy).withColumn(
        "_m", F.when(F.size("_legacy") > 0, F.col("_legacy")).otherwise(pair)
    )
    others = T.each(picked, ["session_id"], F.col("_m"), "m", "pos").select(
        "session_id", (F.col("pos") + 1).alias("position"), "m.role", "m.content"
    )
    return from_turns.select(*columns).unionByName(others.select(*columns))


def chat_retrieval_query(turns: DataFrame, sessions: DataFrame, recent: int = 3) -> DataFrame:
    """(session_id, turn, retrieval_query, mode) for every user message.

    A message that needs its conversation gets the session's question and the
    last ``recent`` user messages in front; blank ones count among these but are not
    shown. Messages are numbered without a hot key in one task; each is sent to the
    ``recent`` places after it.
    """
    every = numbered(
        turns.select(
            "session_id", "turn", T.strip(F.coalesce("user_message", F.lit(""))).alias("message")
        ),
        "session_id", ("turn",), "_n",
    )
    asked = every.filter(F.col("message") != "")
    sent = asked.select(
        "session_id",
        F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + recent)).alias("_n"),
        F.struct(F.col("_n").alias("at"), "message").alias("earlier"),
    )
    # at most ``recent`` entries arrive at one place
    history = sent.groupBy("session_id", "_n").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list("earlier")),
                lambda e: F.concat(F.lit("- "), e["message"]),
            ),
            "\n",
        ).alias("history")
    )
    rows = asked.join(history, ["session_id", "_n"], "left").join(
        sessions.select("session_id", "idea_text"), "session_id", "left"
    )
    contextual = F.concat_ws(
        "\n",
        F.concat(F.lit("Original decision question: "), T.strip(F.coalesce("idea_text", F.lit("")))),
        F.when(F.col("history").isNotNull(), F.lit("Recent follow-up questions:")),
        F.col("history"),
        F.concat(F.lit("Current follow-up question: "), F.col("message")),
    )
    needs = follow_up_needs_context(F.col("message"))
    return rows.select(
        "session_id", "turn",
        F.when(needs, contextual).otherwise(F.col("message")).alias("retrieval_query"),
        F.when(needs, "contextual").otherwise("current_only").alias("mode"),
    )


def sampled(rows: DataFrame, key: str, rate: int = DEFAULTS.eval_sample_rate) -> DataFrame:
    """One row in ``rate``, decided by a hash of the key, so a rerun picks the same rows."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return rows.filter(F.pmod(number, F.lit(max(rate, 1))) == 0)


def sources_of(rows: DataFrame) -> DataFrame:
    """Distinct sources of each short result, sorted."""
    name = F.coalesce(F.nullif("source_rel", F.lit("")), "source")
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_set(name)).alias("sources"))
