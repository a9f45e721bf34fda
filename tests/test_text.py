import unicodedata

import pytest
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions import udfs, variants


@pytest.mark.parametrize(
    ("line", "keep"),
    [
        ("[Page 3]", True), ("| a | b |", True), ("ab", False), ("abc", True), ("----------a", False),
        ("***", False), ("a-------", False), ("ab------", True), ("ไทย", True),
    ],
)
def test_informative_line(value, line, keep):
    assert value(T.is_informative(F.lit(line))) is keep


def test_clean_keeps_paragraphs_and_drops_noise(value):
    raw = "\x00 Title \r\n\r\n\n ***** \n body text next\x0b line\n\n\n\nend  "
    assert value(T.clean(F.lit(raw))) == "Title\n\nbody text\nnext line\n\nend"


def test_strip_matches_python(value):
    text = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert value(T.strip(F.lit(text + "x" + text))) == "x"
    assert value(T.squeeze(F.lit(f"a{text}b"))) == "a b"


def test_nfkc(spark):
    texts = ["ﬁne", "①", "é", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(udfs.nfkc("t").alias("n"))
    assert [r["n"] for r in df.collect()] == [
        t and unicodedata.normalize("NFKC", t) for t in texts
    ]


def test_section_header_takes_pattern_order(value):
    text = "Section 4: Later rule\nChapter IV: First rule\n"
    assert value(T.section_header(F.lit(text))) == "Chapter IV: First rule"
    assert value(T.section_header(F.lit("nothing here"))) == ""
    assert value(T.section_header(F.lit("Appendix B - " + "x" * 300))) == ("Appendix B - " + "x" * 300)[:120]
    assert value(T.section_header(F.lit("y" * 600 + "Section 1: a"))) == ""


@pytest.mark.parametrize(
    ("text", "pages"),
    [("none", ""), ("[Page 7] x", "7"), ("[Page 9] [Page  2] [Page 4]", "2-9"), ("[Page 2][Page 2]", "2")],
)
def test_page_range(value, text, pages):
    assert value(T.page_range(F.lit(text))) == pages


def cells(*rows):
    as_row = lambda r: F.array(*[F.lit(c).cast("string") for c in r])
    return F.array(*[as_row(r) for r in rows])


@pytest.mark.parametrize(
    ("rows", "table"),
    [
        ([["a", "b"], ["1"]], "| a | b |\n| --- | --- |\n| 1 |  |"),
        ([["", None], ["h", "x|y"], ["1", "2\n3"]], "| h | x\\|y |\n| --- | --- |\n| 1 | 2 3 |"),
        ([["a", "b"]], ""),
        ([["", ""], ["", ""]], ""),
    ],
)
def test_table_markdown(value, rows, table):
    assert value(T.table_markdown(cells(*rows))) == table


def test_truncate_lengths(value):
    assert value(T.truncate(F.lit("abcdef"), 6)) == "abcdef"
    assert value(T.truncate(F.lit("abcde fgh"), 7)) == "abcde..."
    assert value(T.truncate_tight(F.lit("abcdefghij"), 8)) == "abcde..."
    assert value(T.truncate_tight(F.lit("abc"), 0)) == "abc"


def test_content_terms_order_and_limit(value):
    terms = value(T.content_terms(F.lit("The Brand of the brand, an identity: MARKET to-day"), 3))
    assert terms == ["brand", "identity", "market"]


@pytest.mark.parametrize(
    ("query", "kind"),
    [
        ("What is a brand?", "factual"), ("If prices fall", "inferential"),
        ("How should we price", "analytical"), ("", "analytical"),
    ],
)
def test_intent(value, query, kind):
    assert value(variants.intent(F.lit(query))) == kind


def test_entities_and_aliases(value):
    q = F.lit("How does  Tata Communications use New York business to business?")
    assert value(variants.entity_hints(q)) == [
        "tata communication", "b2b", "tata communications", "new york",
    ]
    assert value(variants.alias_variants(q)) == [
        "how does tata communication use new york business to business?",
        "how does tata communications use new york b2b?",
    ]
    both = F.lit("tata communications and tata comms")
    assert value(variants.entity_hints(both)) == ["tata communication", "tata communication"]


def test_deterministic_variants(value):
    q = F.lit('"Pricing power" and brand trust, in Band')
    got = value(variants.deterministic_variants(q, 9))
    assert got[:2] == ['"Pricing power" and brand trust, in Band', "Pricing power and brand trust, in Band"]
    assert got[2:5] == ['"Pricing power"', "brand trust", "in Band"]
    assert got[5] == "pricing power brand trust band"
    assert got[6].endswith(" case study") and got[7].endswith(" brand strategy")
    assert value(variants.deterministic_variants(F.lit("  "), 3)) == []


def test_assembled_and_corrective(value):
    q = F.lit("pricing trust")
    used = variants.assembled_variants(q)
    assert value(used) == [
        "pricing trust", "pricing trust case study", "pricing trust brand strategy",
        "pricing trust value-based pricing", "pricing trust discount governance",
    ]
    more = value(variants.corrective_variants(q, used))
    assert more == [
        "pricing trust case study evidence", "pricing trust brand positioning differentiation",
        "pricing trust pricing trust audience",
    ]


@pytest.mark.parametrize(
    ("message", "needs"),
    [
        ("", True), ("Tell me more now", True),
        ("How about the other plan that we discussed for the north region last week in detail", True),
        ("Please list seven large rivers of this continent", True),
        ("Please list seven large rivers of South America by length", False),
    ],
)
def test_follow_up(value, message, needs):
    assert value(variants.follow_up_needs_context(F.lit(message))) is needs


def test_pluggable_models(spark):
    df = spark.createDataFrame([("a b c", "a")], "t string, q string")
    scored = df.select(
        udfs.model_token_count(F.col("t"), str.split).alias("n"),
        udfs.score_pairs(F.col("q"), F.col("t"), lambda q, t: [len(x) for x in t]).alias("s"),
    ).first()
    assert (scored["n"], scored["s"]) == (3, 5.0)
