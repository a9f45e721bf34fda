import zlib
from collections import defaultdict

import numpy as np
import pytest

from askloom.llm import packing
from askloom.llm.registry import tokenizer_path

SCHEMA = "doc_id long, source string, text string, tokens string, ids int, length string, offset int"


def table(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1, "y", 2) for i, s, t in rows], SCHEMA)


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [x.ids + [1] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(
    "text",
    ["", "  ", "a b", "don't DON'T we'll it's.", "<|endoftext|> hi<|startoftext|>x <|ENDOFTEXT|>.", "İstanbul ΣΊΣΥΦΟΣ ς", "日本語 テスト",
     "a\x1cb \x1d", "emoji 👩‍👩‍👧 ok", "﻿bom", "1234 12ab 12. 3, a.b. ..", "\x00nul", "tab\tnew\nline\r\x0b\x0cff", "e ́x ̈",
     "Å Å Å K K. K.", "É. é, É.", ". , .. ., x., ’s it’s IT'S,", "a" * 5000 + ".", "퟿ \U0010ffff", "İ. İ,"],
)
def test_word_ids_equal_whole_text_ids(text):
    words = packing.word_ids(tokenizer_path())
    assert np.frombuffer(words.text(text.encode()), "<u2").tolist() == encoded([text])[0]


def test_word_ids_after_the_cache_turned(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    monkeypatch.setattr(packing, "NEW_WORDS", 2)
    words = packing.WordIds(tokenizer_path())
    texts = ["One two. three", "two One, four five", "five. six", "", "One two. three"]
    got = [np.frombuffer(words.text(t.encode()), "<u2").tolist() for t in texts]
    assert got == encoded(texts)


def check(rows, pieces, window=2048):
    ids = encoded([t for _, _, t in rows])
    of = dict(zip([i for i, _, _ in rows], ids, strict=True))
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        want = np.array(of[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.length == len(want) > 0 and p.ids_crc32 == zlib.crc32(want.tobytes()) and p.doc_tokens == len(of[p.doc_id])
        parts[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length, p.doc_id))
    for i, whole in of.items():
        at = 0
        for start, length in sorted(parts[i]):
            assert start == at
            at += length
        assert at == len(whole)
    padded = 0
    for found in sequences.values():
        at = 0
        for offset, length, _ in sorted(found):
            assert offset == at
            at += length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded, sequences, of


def test_pieces_cover_every_id_once_without_padding(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "some words here " * (i % 97)) for i in range(400)]
    rows += [(1000, None, None), (1001, "empty", ""), (1002, "long", "very long text " * 9000), (1003, "hot", "<|endoftext|> É")]
    pieces = packing.pack(table(spark, rows).repartition(6), tokenizer=tokenizer_path(), bin_tokens=20_000).collect()
    padded, sequences, _ = check(rows, pieces)
    assert padded == 0 and len({s >> 32 for s in sequences}) > 3


def test_sequences_hold_the_ids_of_their_pieces(spark):
    rows = [(i, f"s{i % 3}", "many words and more " * (i % 60)) for i in range(200)]
    pieces = packing.pack(table(spark, rows), tokenizer=tokenizer_path(), bin_tokens=9000)
    got = {r.sequence_id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.sequences(pieces).collect()}
    _, sequences, of = check(rows, pieces.collect())
    starts = {(p.sequence_id, p.offset): (p.doc_id, p.start, p.length) for p in pieces.collect()}
    for number, ids in got.items():
        want = []
        for offset, _, _ in sorted(sequences[number]):
            i, start, length = starts[number, offset]
            want += of[i][start : start + length]
        assert ids == want
    assert len(got) == len(sequences)


def test_windows_hold_the_target_proportions(spark):
    rows = [(i, "abc"[i % 3], "word and word " * (20 + i % 50) * (1 + 2 * (i % 3 == 0))) for i in range(900)]
    pieces = packing.pack(table(spark, rows), tokenizer=tokenizer_path(), bin_tokens=40_000, min_piece=64).collect()
    _, sequences, of = check(rows, pieces)
    total = defaultdict(int)
    for i, s, _ in rows:
        total[s] += len(of[i])
    share = {s: n / sum(total.values()) for s, n in total.items()}
    source = {i: s for i, s, _ in rows}
    seen, far = defaultdict(int), []
    for number in sorted(sequences):
        size = sum(n for _, n, _ in sequences[number])
        own = defaultdict(int)
        for _, n, i in sequences[number]:
            own[source[i]] += n
            seen[source[i]] += n
        if size == 2048:
            far.append(max(abs(own[s] / size - share[s]) for s in share))
        # what a source got so far stays close to what it is owed
        assert max(abs(seen[s] - share[s] * sum(seen.values())) for s in share) < 3 * 2048
    assert np.mean(far) < 0.06


def test_given_weights_fill_the_first_windows():
    queues = {"=a": [(0, 10_000)], "=b": [(1, 10_000)]}
    windows = list(packing.fill(queues, {"=a": 0.75, "=b": 0.25}, {}, 2048, 64))
    for pieces in windows[:6]:
        a = sum(n for doc, _, n in pieces if doc == 0)
        assert abs(a / 2048 - 0.75) < 0.05
    assert sum(n for w in windows for _, _, n in w) == 20_000 and all(sum(n for _, _, n in w) == 2048 for w in windows[:-1])


def test_a_bin_starts_with_what_earlier_bins_owe():
    queues = lambda: {"=a": [(0, 9000)], "=b": [(1, 9000)]}
    share = {"=a": 0.5, "=b": 0.5}
    first = next(packing.fill(queues(), share, {"=a": -900.0, "=b": 900.0}, 2048, 64))
    assert sum(n for doc, _, n in first if doc == 1) > 1800


@pytest.mark.parametrize("length", [1, 2, 3, 1500, 2047])
def test_powers_of_two(length):
    parts = packing.powers_of_two(length)
    assert sum(parts) == length and all(p & (p - 1) == 0 for p in parts)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, "b", "z")]
    got = packing.pack(table(spark, rows), tokenizer=tokenizer_path()).collect()
    assert sum(p.length for p in got) == 3 + 3 + 2 and {p.doc_id for p in got} == {1, None}
    assert packing.pack(table(spark, []), tokenizer=tokenizer_path()).count() == 0
