"""SQL spellings of the text functions, for the checks."""

from __future__ import annotations

from askloom.functions import rules
from askloom.functions.text import CONTROL, LINE_BREAK, WORD_CHAR, WS


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip_control(x: str) -> str:
    return f"regexp_replace({x}, '{CONTROL}', '', 'g')"


def bars(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '|', '')))"


def informative(x: str) -> str:
    alnum = f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]'))"
    return (
        f"(starts_with({x}, '[Page ') OR {bars(x)} >= 2 OR (length({x}) > 2 AND {alnum} > 0 "
        f"AND {alnum} * 4 >= length({x})))"
    )


def informative_text(x: str) -> str:
    lines = f"list_transform(string_split_regex({x}, '{LINE_BREAK}'), lambda l: {strip('l')})"
    return (
        f"array_to_string(list_filter({lines}, lambda l: l = '' OR {informative('l')}), chr(10))"
    )


def clean(x: str) -> str:
    return strip(
        f"regexp_replace({informative_text(strip_control(x))}, '\\n{{2,}}', "
        "chr(10) || chr(10), 'g')"
    )


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '\\s*\\S+')"


def window_count(n: str, size: int, overlap: int) -> str:
    step = max(size - overlap, 1)
    return (
        f"(CASE WHEN {n} = 0 THEN 0 ELSE "
        f"CAST(ceil(greatest({n} - {size}, 0) / {step}) AS BIGINT) + 1 END)"
    )


def windows(source: str, columns: str, toks: str, size: int, overlap: int, index: str) -> str:
    """Rows of ``source`` times their token windows; the window list is ``win``."""
    step = max(size - overlap, 1)
    return (
        f"SELECT {columns}, {index}, "
        f"list_slice({toks}, {index} * {step} + 1, {index} * {step} + {size}) AS win "
        f"FROM (SELECT *, unnest(range(0, {window_count(f'len({toks})', size, overlap)})) "
        f"AS {index} FROM {source})"
    )


def alnum_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def search_tokens(x: str) -> str:
    return (
        f"list_filter({alnum_tokens(x)}, lambda t: length(t) > 2 "
        f"AND t NOT IN ({quoted(rules.QUERY_STOPWORDS)}))"
    )


def first_seen(arr: str) -> str:
    return (
        f"list_transform([{arr}], lambda fv: list_filter(fv, lambda fx, fi: "
        "list_position(fv, fx) = fi))[1]"
    )


def distinct_ignore_case(arr: str) -> str:
    return (
        f"list_transform([{arr}], lambda dv: list_filter(dv, lambda dx, di: dx <> '' AND "
        "list_position(list_transform(dv, lambda dy: lower(dy)), lower(dx)) = di))[1]"
    )


def content_terms(x: str, n: int) -> str:
    return f"list_slice({first_seen(search_tokens(x))}, 1, {n})"


def truncate(x: str, n: int) -> str:
    s = squeeze(x)
    return (
        f"CASE WHEN length({s}) <= {n} THEN {s} "
        f"ELSE regexp_replace(substr({s}, 1, {n - 1}), '{WS}+$', '') || '...' END"
    )


def truncate_tight(x: str, n: int) -> str:
    s = strip(f"coalesce({x}, '')")
    return (
        f"CASE WHEN length({s}) <= {n} THEN {s} "
        f"ELSE regexp_replace(substr({s}, 1, {n - 3}), '{WS}+$', '') || '...' END"
    )


def section_header(x: str) -> str:
    head = f"substr({x}, 1, 600)"
    found = ", ".join(
        f"nullif(regexp_extract({head}, '{p}', 0), '')" for p in rules.SECTION_HEADINGS
    )
    return f"substr({strip(f'coalesce({found}, {chr(39) * 2})')}, 1, 120)"


def page_range(x: str) -> str:
    nums = (
        f"list_transform(regexp_extract_all({x}, '\\[Page\\s+(\\d+)\\]', 1), "
        "lambda p: TRY_CAST(p AS BIGINT))"
    )
    return (
        f"CASE WHEN len({nums}) = 0 THEN '' WHEN list_min({nums}) = list_max({nums}) "
        f"THEN CAST(list_min({nums}) AS VARCHAR) "
        f"ELSE list_min({nums}) || '-' || list_max({nums}) END"
    )


def has_table(x: str) -> str:
    return f"(contains({x}, '|') AND contains({x}, '---'))"


def has_word(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '(^|[^{WORD_CHAR[1:-1]}])(?:{pattern})([^{WORD_CHAR[1:-1]}]|$)')"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


NOT_WORD = f"[^{WORD_CHAR[1:-1]}]"


def replace_word(x: str, pattern: str, value: str) -> str:
    """Twice, because two neighbouring matches share the character between them."""
    once = lambda y: (
        f"regexp_replace({y}, '(^|{NOT_WORD})(?:{pattern})({NOT_WORD}|$)', "
        f"'\\1{value}\\2', 'g')"
    )
    return once(once(x))


def intent(lowered: str, inferential=rules.INFERENTIAL_MARKERS) -> str:
    return (
        f"CASE WHEN {contains_any(lowered, rules.FACTUAL_MARKERS)} THEN 'factual' "
        f"WHEN {contains_any(lowered, inferential)} THEN 'inferential' ELSE 'analytical' END"
    )


def concat(*arrays: str) -> str:
    out = arrays[0]
    for a in arrays[1:]:
        out = f"list_concat({out}, {a})"
    return out


NO_TEXTS = "CAST([] AS VARCHAR[])"


def entity_hints(text: str, lowered: str, aliases) -> str:
    named = concat(
        *[f"CASE WHEN {has_word(lowered, p)} THEN ['{n}'] ELSE {NO_TEXTS} END" for p, n in aliases]
    )
    runs = f"regexp_extract_all({text}, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+')"
    titles = first_seen(f"list_transform({runs}, lambda r: lower({squeeze('r')}))")
    fresh = f"list_filter({titles}, lambda t: NOT list_contains({named}, t))"
    return f"list_slice({concat(named, fresh)}, 1, 6)"


def alias_variants(lowered: str, aliases) -> str:
    arr = "[" + ", ".join(replace_word(lowered, p, n) for p, n in aliases) + "]"
    return f"list_slice(list_filter({arr}, lambda a: a <> {lowered} AND a <> ''), 1, 3)"


def deterministic_variants(text: str, lowered: str, n: int) -> str:
    marked = (
        f"regexp_replace(regexp_replace({text}, '(^|{NOT_WORD})and({NOT_WORD}|$)', "
        f"'\\1\x02\\2', 'gi'), '(^|{NOT_WORD})and({NOT_WORD}|$)', '\\1\x02\\2', 'gi')"
    ).replace("\x02", "@@")
    parts = (
        f"list_filter(list_transform(string_split_regex({marked}, '@@|&|/|,'), "
        f"lambda p: {strip('p')}), lambda p: contains(p, ' '))"
    )
    keys = first_seen(
        f"list_filter(regexp_extract_all({lowered}, '[a-z0-9]+'), lambda t: length(t) > 3 "
        f"AND t NOT IN ({quoted(rules.CONDENSE_STOPWORDS)}))"
    )
    unquoted = strip(f"regexp_replace({text}, '[\"''`]', '', 'g')")
    suffixes = ", ".join(f"{text} || ' {s}'" for s in rules.VARIANT_SUFFIXES)
    arr = concat(
        f"[{text}, {unquoted}]", parts,
        f"[array_to_string(list_slice({keys}, 1, 10), ' ')]", f"[{suffixes}]",
    )
    return f"list_slice({distinct_ignore_case(arr)}, 1, {max(n + 1, 1)})"


def is_valid(v: str, text: str) -> str:
    s = squeeze(v)
    return (
        f"(length({s}) >= 8 AND lower({s}) NOT IN ({quoted(rules.PLACEHOLDERS)}) "
        f"AND lower({s}) <> lower({text}) AND len(regexp_extract_all({s}, '[A-Za-z0-9]+')) >= 2)"
    )


def concept_expansions(text: str, lowered: str, hints: str) -> str:
    arrays = []
    for words, suffixes in rules.CONCEPT_TRIGGERS:
        values = ", ".join(f"{text} || ' {s}'" for s in suffixes)
        arrays.append(f"CASE WHEN {contains_any(lowered, words)} THEN [{values}] ELSE {NO_TEXTS} END")
    kind = intent(lowered)
    suffix = (
        f"CASE {kind} WHEN 'factual' THEN '{rules.INTENT_SUFFIXES['factual']}' "
        f"WHEN 'inferential' THEN '{rules.INTENT_SUFFIXES['inferential']}' "
        f"ELSE '{rules.INTENT_SUFFIXES['analytical']}' END"
    )
    arrays.append(f"[{text} || ' ' || {suffix}]")
    arrays.append(
        f"list_transform(list_slice({hints}, 1, 2), lambda e: e || ' {rules.ENTITY_SUFFIX}')"
    )
    return f"list_slice({concat(*arrays)}, 1, 6)"


def hash_slot(word: str, dim: int = 64) -> str:
    return f"CAST('0x' || substr(md5({word}), 1, 4) AS INTEGER) % {dim}"


def hash_sign(word: str) -> str:
    return f"CASE WHEN substr(md5({word}), 5, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
