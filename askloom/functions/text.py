"""Text columns: cleaning, tokens, headings, page marks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions import rules

# Unicode white space, spelled out because Java's \s covers ASCII only.
WS_CHARS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)
WS = f"[{WS_CHARS}]"
# The same characters as a list, for trimming without a regular expression.
WS_LIST = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
WORD_CHAR = r"[\p{L}\p{N}_]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
LINE_BREAK = r"\r\n|[\n\r\x{85}\x{2028}\x{2029}]"
TOKEN = r"\s*\S+"
TOKEN_SPACE = " \t\n\x0b\f\r"


def whole_word(pattern: str) -> str:
    """``pattern`` bounded by non-word characters, Unicode letters included."""
    return rf"(?<!{WORD_CHAR})(?:{pattern})(?!{WORD_CHAR})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once even where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_LIST))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_LIST))


def squeeze(c: Column) -> Column:
    """White-space runs become one blank; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def is_informative(line: Column) -> Column:
    """Keep page marks, table rows, and lines with enough letters or digits."""
    alnum = F.length(F.regexp_replace(line, r"[^\p{L}\p{N}]+", ""))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return (
        line.startswith("[Page ")
        | (bars >= 2)
        | ((F.length(line) > 2) & (alnum * 4 >= F.length(line)))
    )


def informative_text(c: Column) -> Column:
    """Strip lines and drop the uninformative ones; blank lines stay."""
    lines = F.transform(F.split(c, LINE_BREAK, -1), strip)
    return F.array_join(F.filter(lines, lambda x: (x == "") | is_informative(x)), "\n")


def collapse_blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{2,}", "\n\n"))


def clean(c: Column) -> Column:
    """Cleaning without Unicode folding (see ``udfs.nfkc`` for that step)."""
    return collapse_blank_lines(informative_text(strip_control(c)))


def tokens(c: Column) -> Column:
    """Tokens that join back to the text: leading space plus a word."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def rstrip_ascii(c: Column) -> Column:
    """Without the white space that no token has behind it: of ASCII alone, as in ``TOKEN``."""
    return F.rtrim(c, F.lit(TOKEN_SPACE))


def at_most_tokens(c: Column, n: int) -> Column:
    """True only of texts with ``n`` tokens or fewer, found without splitting them; some of these are missed."""
    spaces = [F.length(c) - F.length(F.replace(c, F.lit(s), F.lit(""))) for s in TOKEN_SPACE]
    return (F.length(c) < 2 * n) | (reduce(lambda a, b: a + b, spaces) < n)


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def search_tokens(c: Column, stopwords: tuple[str, ...] = rules.QUERY_STOPWORDS) -> Column:
    """Tokens longer than two characters that are no stop words."""
    words = F.regexp_extract_all(
        F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)
    )
    return F.filter(words, lambda t: ~t.isin(*[w for w in stopwords if len(w) > 2]))


def content_terms(
    c: Column, max_terms: int = 12, stopwords: tuple[str, ...] = rules.QUERY_STOPWORDS
) -> Column:
    """Distinct search tokens in first-seen order, at most ``max_terms``."""
    return F.slice(F.array_distinct(search_tokens(c, stopwords)), 1, max_terms)


def truncate(c: Column, max_len: int) -> Column:
    """Cut to ``max_len - 1`` characters plus dots, on squeezed text."""
    return let(
        squeeze(c),
        lambda s: F.when(F.length(s) <= max_len, s).otherwise(
            F.concat(rstrip(F.substring(s, 1, max_len - 1)), F.lit("..."))
        ),
    )


def truncate_tight(c: Column, limit: int) -> Column:
    """Cut so that the result with dots fits into ``limit``; 0 means no cut."""
    text = strip(F.coalesce(c, F.lit("")))
    if limit <= 0:
        return text
    return let(
        text,
        lambda s: F.when(F.length(s) <= limit, s).otherwise(
            F.concat(rstrip(F.substring(s, 1, max(limit - 3, 0))), F.lit("..."))
        ),
    )


def section_header(c: Column) -> Column:
    """First heading in the first 600 characters, by order of the heading list."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 600)
    found = [
        F.nullif(F.regexp_extract(head, pattern, 0), F.lit(""))
        for pattern in rules.SECTION_HEADINGS
    ]
    return F.substring(strip(F.coalesce(*found, F.lit(""))), 1, 120)


def page_range(c: Column) -> Column:
    """``n`` or ``min-max`` over the ``[Page n]`` marks of a text."""
    marks = F.regexp_extract_all(c, F.lit(r"\[Page\s+(\d+)\]"), F.lit(1))
    pages = F.transform(marks, lambda x: x.try_cast("bigint"))
    low, high = F.array_min(pages), F.array_max(pages)
    return (
        F.when(low.isNull(), "")
        .when(low == high, low.cast("string"))
        .otherwise(F.concat_ws("-", low, high))
    )


def has_table(c: Column) -> Column:
    return F.contains(c, F.lit("|")) & F.contains(c, F.lit("---"))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols])


def distinct_ignore_case(arr: Column) -> Column:
    """Drop blanks and later repeats that differ in case only."""
    first_of = lambda texts, lowered: F.filter(
        texts, lambda x, i: (x != "") & (F.array_position(lowered, F.lower(x)) == i + 1)
    )
    return let(
        arr, lambda texts: let(F.transform(texts, F.lower), lambda low: first_of(texts, low))
    )


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def detect_language(c: Column, min_hits: int = 3) -> Column:
    """Language whose frequent words occur most often; NULL below ``min_hits`` words.

    A light stand-in where articles come without a language.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    hits = lambda w: F.array(
        *[
            F.struct(
                (-F.size(F.filter(w, lambda t: t.isin(*profile)))).alias("misses"),
                F.lit(lang).alias("lang"),
            )
            for lang, profile in sorted(rules.LANGUAGE_WORDS.items())
        ]
    )
    best = let(words, lambda w: F.array_min(hits(w)))
    return let(best, lambda b: F.when(b["misses"] <= -min_hits, b["lang"]))


def _markdown_row(cells: Column) -> Column:
    escaped = F.transform(cells, lambda x: F.replace(x, F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))


def _markdown(rows: Column) -> Column:
    """Rows of equal width; a blank first row makes the second row the header."""
    blank = lambda r: F.forall(r, lambda x: x == "")
    start = F.when(blank(F.get(rows, F.lit(0))), 2).otherwise(1)
    header = F.get(rows, start - 1)
    rule = F.transform(header, lambda x: F.lit("---"))
    body = F.transform(F.slice(rows, start + 1, F.size(rows)), _markdown_row)
    table = F.array_join(
        F.concat(F.array(_markdown_row(header), _markdown_row(rule)), body), "\n"
    )
    return F.when((F.size(rows) < 2) | blank(header), "").otherwise(table)


def table_markdown(rows: Column) -> Column:
    """Cells (array of arrays, ragged allowed) as a Markdown table, '' if too small."""
    cell = lambda x: strip(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))
    filled = F.transform(
        F.filter(rows, lambda r: r.isNotNull() & (F.size(r) > 0)), lambda r: F.transform(r, cell)
    )
    pad = lambda all_rows, width: F.transform(
        all_rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    )
    padded = let(
        filled,
        lambda all_rows: let(
            F.array_max(F.transform(all_rows, F.size)), lambda width: pad(all_rows, width)
        ),
    )
    return let(padded, _markdown)


def each(df: DataFrame, columns: list[str], array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element, next to ``columns``; empty arrays give no row.

    A plain explode makes Spark add a filter on the array's size, which computes
    an expensive array twice. The outer form does not; its NULL rows are dropped.
    """
    if pos is None:
        out = df.select(*columns, F.explode_outer(array).alias(name))
    else:
        out = df.select(*columns, F.posexplode_outer(array).alias(pos, name))
    return out.filter(F.col(name).isNotNull())


def keep_non_blank(df: DataFrame, value: Column, name: str = "text") -> DataFrame:
    """Set ``name`` to ``value`` and drop rows where it is '', computing it once.

    A filter on a computed text would be pushed below the projection and compute
    the text twice.
    """
    kept = F.filter(F.array(value), lambda x: x != "")
    return each(df, [c for c in df.columns if c != name], kept, name)
