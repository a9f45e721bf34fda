import re
from collections import Counter

import numpy as np
import pytest

from askloom.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, words int, n long, phrase string, chunk string, owned int"
SMALL = P.Settings(least=3, top=25, period=2, bits=16)


def brute(rows, settings=SMALL):
    """Every phrase of every piece, counted one by one."""
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= settings.least}
    longest = Counter()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                part = (lang, w[i : i + m])
                longest[part] = max(longest[part], a)
    for (lang, w), a in candidates.items():
        score, _, left, right = min(
            (2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))
        )
        if 100 * longest[lang, w] < settings.covered * a:
            out.append((lang, " ".join(w), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, place = [], Counter()
    for lang, phrase, a, left, right, total, score in out:
        place[lang] += 1
        if place[lang] <= settings.top:
            ranked.append((lang, place[lang], phrase, a, left, right, total, score))
    return sorted(ranked)


def mined(spark, rows, settings=SMALL):
    df = spark.createDataFrame([(i, t, lang, 1, 2, "x", "y", 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = P.collocations(df, settings)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(tuple(r) for r in got.collect())


def prose(n, seed, vocabulary=12):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "été", "the", "The", "x1", "of", "in", "zz", "Ünde", "日本", "q-r"][:vocabulary]
    marks = [" ", " ", " ", "  ", "\t", " ", " ", ", ", ".", "\n", "! ", "\x0b"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words, p=None) + rng.choice(marks) for _ in range(int(rng.integers(0, 60))))
        out.append((text, [None, "en", "fr", "und"][int(rng.integers(0, 4))]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("period", [1, 2, 16])
def test_against_counting_one_by_one(spark, seed, period):
    rows = prose(150, seed)
    settings = P.Settings(least=3, top=25, period=period, bits=16, chunks=1 << 9)
    expected = brute(rows, settings)
    assert len(expected) > 50 and mined(spark, rows, settings) == expected


def test_repeated_passages_and_ties(spark):
    passage = "we hold these truths to be self evident that all men are created equal and so on without end"
    rows = [(f"{i} {passage} {i} {passage}", "en") for i in range(40)] + [(passage, "en")] * 30 + [("tie tie tie", "fr")] * 5
    assert mined(spark, rows) == brute(rows)


def test_bitmaps_only_let_more_through(spark):
    """With a bitmap far too small for the phrases the result is the same."""
    rows = prose(200, 5)
    tiny = P.Settings(least=6, top=25, period=4, bits=5)
    assert mined(spark, rows, tiny) == brute(rows, tiny)


def test_odd_rows(spark):
    rows = prose(60, 6)
    rows += [(None, "en"), ("", None), (" \t ", "en"), (".,;", "fr"), ("a b\x00c d", ""), ("a b " * 30_000, "en"), ("word" * 200_000, "en"), ("a.b." * 20_000, "xx")]
    rows += [rows[3]] * 20
    assert mined(spark, rows, P.Settings(least=3, top=25, period=2, bits=16, block=1 << 12)) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_chunks_own_every_phrase_once_and_repeat(spark):
    """The parse: chunks overlap by a trigger, own their phrases, and come again with a passage."""
    text = " ".join(f"w{i % 37}" for i in range(400)).encode() + b"\n"
    chunks, owned = P.parse_block(np.frombuffer(text, np.uint8), 8)
    words = text.split()
    at = 0
    for chunk, n in zip(chunks, owned, strict=True):
        inside = chunk.split()
        assert inside == words[at : at + len(inside)]
        assert len(inside) == n + P.OVERLAP or at + n == len(words) == at + len(inside)
        at += int(n)
    assert at == len(words)
    assert len(set(chunks)) < len(chunks) / 3  # the same passage makes the same chunks


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 20])
def test_blocks_are_cut_between_pieces(size):
    texts = [b"", b"abc def.ghi,jkl", b"x" * 100, b"a.b.c.d", b"end"]
    blocks = list(P.blocks_of([memoryview(t) for t in texts], size))
    pieces = [p for b in blocks for p in re.split(rb"[.,\n]", b.tobytes()) if p]
    assert pieces == [p for t in texts for p in re.split(rb"[.,]", t) if p]
    assert all(P.KIND[b[-1]] == 2 for b in blocks)


def test_exact_arithmetic(spark):
    """Counts whose products pass 64 bits."""
    big = 1 << 61
    found = spark.createDataFrame([("e", "a b", 2, big - 1), ("e", "a", 1, big), ("e", "b", 1, big + 5)], "lang string, phrase string, words int, n long")
    row = P.scored(found).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 5) and row.a == big - 1
    pair = spark.createDataFrame([("e", "a b", 2, big), ("e", "a b c", 3, big * 4 // 5), ("e", "b c", 2, big)], "lang string, phrase string, words int, a long")
    kept = {r.phrase for r in P.uncovered(pair, 80).collect()}
    assert kept == {"a b", "b c", "a b c"}  # four fifths, rounded down, are a little less than 80 %
