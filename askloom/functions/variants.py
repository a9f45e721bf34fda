"""Query analysis and query variants, one row per question, all in-row arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions import rules
from askloom.functions.text import (
    contains_any,
    distinct_ignore_case,
    let,
    squeeze,
    strip,
    whole_word,
)
from askloom.settings import DEFAULTS, Settings

Aliases = tuple[tuple[str, str], ...]
NO_TEXTS = "cast(array() as array<string>)"


def intent(
    query: Column, inferential: tuple[str, ...] = rules.INFERENTIAL_MARKERS
) -> Column:
    text = F.lower(squeeze(query))
    return (
        F.when(contains_any(text, rules.FACTUAL_MARKERS), "factual")
        .when(contains_any(text, inferential), "inferential")
        .otherwise("analytical")
    )


def _when_array(condition: Column, values: list[Column]) -> Column:
    return F.when(condition, F.array(*values)).otherwise(F.expr(NO_TEXTS))


def entity_hints(query: Column, aliases: Aliases = rules.ENTITY_ALIASES) -> Column:
    """Canonical alias names, then Title-Case runs, at most six."""
    text = squeeze(query)
    lowered = F.lower(text)
    named = F.concat(
        *[_when_array(F.rlike(lowered, F.lit(whole_word(p))), [F.lit(name)]) for p, name in aliases]
    )
    runs = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), F.lit(0))
    titles = F.array_distinct(F.transform(runs, lambda x: F.lower(squeeze(x))))
    return let(
        named,
        lambda known: F.slice(
            F.concat(known, F.filter(titles, lambda t: ~F.array_contains(known, t))), 1, 6
        ),
    )


def alias_variants(query: Column, aliases: Aliases = rules.ENTITY_ALIASES) -> Column:
    """The lowercase question with one alias rule applied, for each rule that changes it."""
    lowered = F.lower(squeeze(query))

    def changed(text: Column) -> Column:
        rewritten = [F.regexp_replace(text, whole_word(p), name) for p, name in aliases]
        return F.filter(F.array(*rewritten), lambda x: (x != text) & (x != ""))

    return F.slice(let(lowered, changed), 1, 3)


def deterministic_variants(query: Column, n: int) -> Column:
    """The question, its parts and its key terms; first ``n + 1`` distinct texts."""
    text = squeeze(query)
    unquoted = strip(F.regexp_replace(text, "[\"'`]", ""))
    splits = F.split(text, rf"(?i){whole_word('and')}|&|/|,", -1)
    parts = F.filter(F.transform(splits, strip), lambda p: F.contains(p, F.lit(" ")))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{4,}"), F.lit(0))
    key_terms = F.array_distinct(
        F.filter(
            words, lambda t: ~t.isin(*[w for w in rules.CONDENSE_STOPWORDS if len(w) > 3])
        )
    )
    candidates = F.concat(
        F.array(text, unquoted),
        parts,
        F.array(F.array_join(F.slice(key_terms, 1, 10), " ")),
        F.array(*[F.concat(text, F.lit(" " + s)) for s in rules.VARIANT_SUFFIXES]),
    )
    limited = F.slice(distinct_ignore_case(candidates), 1, max(n + 1, 1))
    return F.when(text == "", F.expr(NO_TEXTS)).otherwise(limited)


def is_valid_variant(candidate: Column, original: Column) -> Column:
    text = squeeze(candidate)
    lowered = F.lower(text)
    return (
        (F.length(text) >= 8)
        & ~lowered.isin(*rules.PLACEHOLDERS)
        & (lowered != F.lower(squeeze(original)))
        & (F.regexp_count(text, F.lit("[A-Za-z0-9]+")) >= 2)
    )


def concept_expansions(query: Column, aliases: Aliases = rules.ENTITY_ALIASES) -> Column:
    """Suffix forms from trigger words, the intent and the first two entities; at most six."""
    text = squeeze(query)
    lowered = F.lower(text)
    with_suffix = lambda s: F.concat(text, F.lit(" " + s))
    triggered = [
        _when_array(contains_any(lowered, words), [with_suffix(s) for s in suffixes])
        for words, suffixes in rules.CONCEPT_TRIGGERS
    ]
    kind = intent(query)
    suffix = F.when(kind == "inferential", rules.INTENT_SUFFIXES["inferential"]).when(
        kind == "factual", rules.INTENT_SUFFIXES["factual"]
    ).otherwise(rules.INTENT_SUFFIXES["analytical"])
    by_entity = F.transform(
        F.slice(entity_hints(query, aliases), 1, 2),
        lambda e: F.concat(e, F.lit(" " + rules.ENTITY_SUFFIX)),
    )
    return F.slice(
        F.concat(*triggered, F.array(F.concat(text, F.lit(" "), suffix)), by_entity), 1, 6
    )


def assembled_variants(
    query: Column,
    generated: Column | None = None,
    settings: Settings = DEFAULTS,
    aliases: Aliases = rules.ENTITY_ALIASES,
) -> Column:
    """The question first, then valid variants, distinct and limited.

    ``generated`` is an optional array of paraphrases from a model; without it
    the deterministic variants take their place.
    """
    text = squeeze(query)
    if not settings.expand_queries:
        # reduced form: no validity test, at most two texts
        plain = distinct_ignore_case(F.concat(F.array(text), alias_variants(query, aliases)))
        limited = F.slice(plain, 1, 2)
        return F.when(F.size(limited) > 0, limited).otherwise(F.array(text))
    if settings.multi_query_count <= 1:
        return F.array(text)
    deterministic = deterministic_variants(query, settings.multi_query_count)
    base = F.slice(deterministic, 2, settings.multi_query_count)
    if generated is not None:
        base = F.coalesce(generated, base)
    pool = F.transform(
        F.concat(base, alias_variants(query, aliases), concept_expansions(query, aliases)), squeeze
    )
    valid = let(text, lambda t: F.filter(pool, lambda v: is_valid_variant(v, t)))
    unique = distinct_ignore_case(F.concat(F.array(text), valid))
    return F.slice(unique, 1, settings.variant_limit)


def corrective_variants(query: Column, used: Column, settings: Settings = DEFAULTS) -> Column:
    """Further variants for a question whose first pass found too little."""
    pool = F.transform(
        F.concat(
            deterministic_variants(query, settings.multi_query_count + 4),
            F.array(*[F.concat(query, F.lit(" " + s)) for s in rules.CORRECTIVE_SUFFIXES]),
        ),
        squeeze,
    )
    fresh = let(
        F.transform(used, F.lower),
        lambda taken: F.filter(pool, lambda v: ~F.array_contains(taken, F.lower(v))),
    )
    return F.slice(distinct_ignore_case(fresh), 1, max(settings.multi_query_count, 2))


def follow_up_needs_context(message: Column) -> Column:
    text = F.lower(squeeze(message))
    n = F.regexp_count(text, F.lit("[a-z0-9]+"))
    opener = F.rlike(text, F.lit("^(?:" + "|".join(rules.FOLLOW_UP_OPENERS) + ")"))
    pronoun = F.rlike(text, F.lit(whole_word("|".join(rules.FOLLOW_UP_PRONOUNS))))
    return (n <= 6) | opener | ((n < 14) & pronoun)
