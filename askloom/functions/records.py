"""Answer records: JSON recovery, validation, texts, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions import rules, udfs
from askloom.functions import text as T
from askloom.settings import DEFAULTS, Settings

ACTION_TYPE = (
    "struct<type: string, title: string, description: string, priority: string, "
    "decision_type: string, impact: string>"
)
METADATA_TYPE = (
    "struct<name: string, brand_positioning: string, idea_description: string, "
    "brand_risk_level: string, risk_level: string, confidence_score: string, tags: array<string>>"
)
RECORD_TYPE = (
    "struct<abstention_message: string, brand_diagnosis: string, idea_summary: string, "
    "market_insight: string, suggested_positioning: array<string>, recommendations: array<string>, "
    "risks: array<string>, opportunities: array<string>, final_positioning: string, "
    "target_audience: string, chosen_strategy: string, rejected_directions: array<string>, "
    "trade_offs: array<string>, tradeoffs: array<string>, "
    f"actions: array<{ACTION_TYPE}>, confidence_score: double, notion_page_content: string, "
    f"database_metadata: {METADATA_TYPE}>"
)
LIST_NAMES = (
    "suggested_positioning", "risks", "opportunities", "rejected_directions", "trade_offs",
)


def json_payload(text: Column) -> Column:
    """JSON text of the first object in a noisy text, else of the first array, else NULL.

    Tried in order: the whole text, fenced blocks, values that start inside the text. A text that is a
    value as a whole, or in a fence, is read in the JVM; the Python scan gets only texts that hold no
    such object and still have a bracket that could open a value.
    """
    whole = T.strip(F.coalesce(text, F.lit("")))
    valid = lambda c, mark: c.startswith(mark) & F.try_parse_json(c).isNotNull()
    # the pattern is searched for only where a fence stands
    fences = F.when(
        whole.contains("```"),
        F.transform(F.regexp_extract_all(whole, F.lit(r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"), F.lit(1)), T.strip),
    )
    first = lambda mark: F.get(F.filter(fences, lambda c: valid(c, mark)), F.lit(0))
    plain_object = F.when(valid(whole, "{"), whole).otherwise(first("{"))
    plain_array = F.when(valid(whole, "["), whole).otherwise(first("["))
    # without an opening brace the scan could only find an array
    open_ended = whole.contains("{") | (whole.contains("[") & plain_array.isNull())
    inner = udfs.embedded_json(F.when(open_ended & plain_object.isNull(), whole))
    return F.coalesce(plain_object, F.when(inner.startswith("{"), inner), plain_array, inner)


def lenient_int(text: Column) -> Column:
    """Whole number from a number or a digit text: fractions are cut, booleans are NULL."""
    s = T.strip(text)
    return F.when(
        s.rlike(r"^[0-9]+$") | s.rlike(r"^-?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$"),
        s.try_cast("double").try_cast("bigint"),
    )


def parse_record(json_text: Column) -> Column:
    """The record as a struct, older field names folded into the current ones."""

    def folded(r: Column) -> Column:
        meta = r["database_metadata"]
        pick = lambda s, name, old: F.coalesce(s[name], s[old]).alias(name)
        metadata = F.when(
            meta.isNotNull(),
            F.struct(
                meta["name"].alias("name"),
                *[pick(meta, name, old) for name, old in rules.METADATA_ALIASES.items()],
                lenient_int(meta["confidence_score"]).cast("int").alias("confidence_score"),
                meta["tags"].alias("tags"),
            ),
        )
        fields = []
        for name in rules.ANSWER_FIELDS:
            if name in rules.FIELD_ALIASES:
                fields.append(pick(r, name, rules.FIELD_ALIASES[name]))
            elif name == "database_metadata":
                fields.append(metadata.alias(name))
            else:
                fields.append(r[name].alias(name))
        return F.struct(*fields)

    return T.let(F.from_json(json_text, RECORD_TYPE), folded)


def violations(record: Column) -> Column:
    """Names of the broken rules, in a fixed order; empty for a valid record."""
    score, actions, meta = record["confidence_score"], record["actions"], record["database_metadata"]
    bad = lambda values, allowed: F.exists(
        values, lambda v: v.isNotNull() & ~v.isin(*allowed)
    )
    of = lambda name: F.transform(actions, lambda a: a[name])
    length = lambda c, low, high: c.isNotNull() & ~F.length(c).between(low, high)
    checks = [
        ("confidence_score: missing", score.isNull()),
        ("confidence_score: range", ~score.between(0.0, 1.0)),
        *[(f"{n}: too many", F.size(record[n]) > 6) for n in LIST_NAMES],
        ("actions: too many", F.size(actions) > 6),
        *[
            (f"actions.{n}: missing", F.exists(of(n), lambda v: v.isNull()))
            for n in ("type", "title", "description", "priority")
        ],
        ("actions.type: value", bad(of("type"), rules.ACTION_TYPES)),
        ("actions.priority: value", bad(of("priority"), rules.LEVELS)),
        ("actions.decision_type: value", bad(of("decision_type"), rules.DECISION_TYPES)),
        ("actions.impact: value", bad(of("impact"), rules.LEVELS)),
        ("database_metadata.name: length", length(meta["name"], 3, 120)),
        ("database_metadata.brand_positioning: length", length(meta["brand_positioning"], 10, 300)),
        (
            "database_metadata.brand_risk_level: value",
            ~meta["brand_risk_level"].isin(*rules.RISK_LEVELS),
        ),
        ("database_metadata.confidence_score: range", ~meta["confidence_score"].between(0, 100)),
        ("database_metadata.tags: too many", F.size(meta["tags"]) > 8),
    ]
    named = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks])
    return F.filter(named, lambda v: v.isNotNull())


def _joined(items: Column, separator: str) -> Column:
    kept = F.filter(F.transform(items, T.squeeze), lambda x: x != "")
    return F.array_join(kept, separator)


def _number(c: Column) -> Column:
    """A number as text; zero counts as empty."""
    return F.when(F.coalesce(c, F.lit(0)) == 0, "").otherwise(c.cast("string"))


def _labelled(pairs: list[tuple[str, Column]], joint: str, separator: str) -> Column:
    shown = [F.when(c != "", F.concat(F.lit(n + joint), c)) for n, c in pairs]
    return F.concat_ws(separator, *shown)


def output_text(record: Column, extra: Column | None = None) -> Column:
    """The record as lines ``field: value`` in a fixed field order.

    ``extra`` is a map of further fields; they follow, sorted by name.
    """
    actions = F.filter(
        F.transform(
            record["actions"],
            lambda a: _labelled([(n, T.squeeze(a[n])) for n in rules.ACTION_FIELDS], "=", " ; "),
        ),
        lambda x: x != "",
    )
    meta = record["database_metadata"]

    def metadata_value(name: str) -> Column:
        if name == "tags":
            return F.coalesce(_joined(meta[name], " | "), F.lit(""))
        if name == "confidence_score":
            return _number(meta[name])
        return T.squeeze(meta[name])

    metadata = _labelled([(n, metadata_value(n)) for n in rules.METADATA_FIELDS], "=", " ; ")

    def value(name: str) -> Column:
        if name == "actions":
            return F.coalesce(F.array_join(actions, " || "), F.lit(""))
        if name == "database_metadata":
            return metadata
        if name == "confidence_score":
            return _number(record[name])
        if name in LIST_NAMES:
            return F.coalesce(_joined(record[name], " | "), F.lit(""))
        return T.squeeze(record[name])

    main = _labelled([(n, value(n)) for n in rules.ANSWER_FIELDS], ": ", "\n")
    if extra is None:
        return main
    known = F.array(*[F.lit(n) for n in rules.ANSWER_FIELDS])
    entries = F.filter(
        F.sort_array(F.map_entries(extra)),
        lambda e: ~F.array_contains(known, e["key"]) & (T.squeeze(e["value"]) != ""),
    )
    more = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), T.squeeze(e["value"]))), "\n"
    )
    return F.concat_ws("\n", F.nullif(main, F.lit("")), F.nullif(more, F.lit("")))


def eval_answer(record: Column, raw: Column, settings: Settings = DEFAULTS) -> Column:
    """What a scorer gets to see of an answer: the abstention, or the main fields, or the raw text."""
    plain = [
        F.when(T.strip(record[n]) != "", F.concat(F.lit(n + ": "), T.strip(record[n])))
        for n in rules.PRIMARY_FIELDS
    ]
    lists = [
        F.when(
            F.size(record[n]) > 0,
            F.concat(
                F.lit(n + ": "),
                F.array_join(F.transform(F.slice(record[n], 1, 4), T.strip), "; "),
            ),
        )
        for n in rules.LIST_FIELDS
    ]
    lines = F.concat_ws("\n", *plain, *lists)
    body = F.coalesce(
        F.nullif(T.strip(record["abstention_message"]), F.lit("")), F.nullif(lines, F.lit("")), raw
    )
    return T.truncate_tight(body, settings.eval_answer_chars)


def eval_contexts(texts: Column, settings: Settings = DEFAULTS) -> Column:
    """The first context texts, each cut."""
    limit = max(settings.eval_context_chars, 200)
    first = F.slice(texts, 1, max(settings.eval_context_docs, 1))
    return F.transform(first, lambda t: T.truncate_tight(t, limit))


def keyword_tags(source: Column) -> Column:
    """Tags whose keyword occurs in the text, then two fixed ones, at most eight."""
    tags = lambda s: F.array(
        *[F.when(F.contains(s, F.lit(k)), F.lit(t)) for k, t in rules.KEYWORD_TAGS],
        *[F.lit(t) for t in rules.CLOSING_TAGS],
    )
    found = T.let(F.lower(source), lambda s: F.filter(tags(s), lambda t: t.isNotNull()))
    return F.slice(F.array_distinct(found), 1, 8)
