"""Packing token streams into windows that hold the sources in target proportions.

Documents are tokenised once; their ids are written as two bytes each. By distributed prefix sums of
the token counts every source is dealt out evenly over the bins (of ``bin_tokens`` tokens), so each
bin gets the same share of every source and no source is too large for a task. Inside a bin,
deficit round-robin over the source queues fills window after window: every window credits each
source with its target share of the window, the source with the largest credit is served a piece,
and what it got is deducted; credits, also negative ones, are carried to the next window. A bin
starts with the credits with which the bins before it end, which follow from the prefix sums
alone (target share of the tokens so far less the tokens of the source so far).

A piece is as long as the credit, but at least ``min_piece`` tokens, and ends with its document or
window. The last, unfilled window of a bin is cut into sequences whose lengths are powers of two,
which need no padding.

Defined results: a null text is empty; every document ends with the id ``END``, so an empty one is
that id alone; rows that repeat an id are packed one by one; a null source is a source of its own. An
empty table gives no pieces. Other columns are not read. A task holds the ids of one bin, or of one
document if that is longer.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import group_key, prefix_sums, written

WINDOW = 2048
BIN_TOKENS = 1 << 21
MIN_PIECE = 256
#: The id that ends a document.
END = 1
END_BYTES = END.to_bytes(2, "little")
KEPT_WORDS = 300_000
NEW_WORDS = 150_000


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class WordIds:
    """Ids of texts, word by word: this tokenizer never joins anything across white space.

    The ids of words that came up twice are kept, up to ``KEPT_WORDS`` of them; words seen once wait
    for their second time among at most ``NEW_WORDS``. That costs far less than encoding whole texts,
    and rare words push no frequent ones out. A new word of letters only is given to the
    tokenizer's model as it is, because normalising and splitting change nothing but its case; a full
    stop or comma behind an ASCII letter or digit is a token of its own. All other words go
    through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.marks = {mark: self.whole(mark.decode()) for mark in (b".", b",")}
        self.kept: dict[bytes, bytes] = {}
        self.new: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            form = word.decode()
        else:
            form = word.decode("utf-8", "replace")
            if not form.isalpha() or "Σ" in form or not is_normalized("NFC", form):
                return self.whole(form)
            form = form.lower()
            if not form.isalpha():
                return self.whole(word.decode("utf-8", "replace"))
            form = form.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(form)]).tobytes()

    def find(self, word: bytes) -> bytes:
        """Ids of a word that is not kept yet."""
        ids = self.new.pop(word, None)
        if ids is not None:
            self.kept[word] = ids
            return ids
        stem, mark = word, b""
        if b"<|" not in word:  # special tokens match as they are
            if word[-1:] in self.marks and word[-2:-1].isalnum():
                stem, mark = word[:-1], self.marks[word[-1:]]
            stem = stem.lower()
        ids = self.kept.get(stem) if stem != word else None
        if ids is None:
            ids = self.encode(stem)
        self.new[word] = ids = ids + mark
        return ids

    def text(self, text: bytes) -> bytes:
        """Ids of a text with the end id, two bytes each."""
        if len(self.new) > NEW_WORDS:
            self.new = {}
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.new = {}, self.kept
        words = text.split()
        parts = list(map(self.kept.get, words))
        if None in parts:
            find = self.find
            parts = [find(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        parts.append(END_BYTES)
        return b"".join(parts)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per Python worker, so that later tasks find the words of earlier ones."""
    return WordIds(path)


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, ids (unsigned, two little-endian bytes each) and tokens of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            found = [words.text(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["source"],
                    pa.array(found, pa.binary()),
                    pa.array([len(x) // 2 for x in found], pa.int64()),
                ],
                ["doc_id", "source", "ids", "tokens"],
            )

    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, source string, ids binary, tokens long")


def powers_of_two(length: int) -> list[int]:
    """Falling powers of two that add up to ``length``."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def fill(queues: dict, share: dict, credit: dict, window: int, min_piece: int) -> Iterator[list[tuple]]:
    """Windows as lists of (document, start, length).

    ``queues``: (document, length) per source in order; ``share``: target share of each source;
    ``credit``: tokens each source is owed when the bin starts.
    """
    left = {s: sum(n for _, n in q) for s, q in queues.items()}
    rest = {s: deque((doc, 0, n) for doc, n in q) for s, q in queues.items()}
    while True:
        open_ = [s for s in rest if rest[s]]
        if not open_:
            return
        size = min(window, sum(left[s] for s in open_))
        for s in share:
            credit[s] = credit.get(s, 0.0) + size * share[s]
        pieces, free = [], size
        while free:
            s = max(open_, key=lambda x: (credit.get(x, 0.0), x))
            doc, start, length = rest[s].popleft()
            take = min(length, free, max(int(credit.get(s, 0.0)) + 1, min_piece))
            pieces.append((doc, start, take))
            credit[s] = credit.get(s, 0.0) - take
            left[s] -= take
            free -= take
            if take < length:
                rest[s].appendleft((doc, start + take, length - take))
            elif not rest[s]:
                open_.remove(s)
        yield pieces


def cut_last(pieces: list[tuple], window: int) -> list[list[tuple]]:
    """A window's pieces as sequences: whole if full, else with lengths of powers of two."""
    size = sum(n for _, _, n in pieces)
    out, todo = [], deque(pieces)
    for room in [size] if size == window else powers_of_two(size):
        part = []
        while room:
            doc, start, length = todo.popleft()
            take = min(length, room)
            part.append((doc, start, take))
            if take < length:
                todo.appendleft((doc, start + take, length - take))
            room -= take
        out.append(part)
    return out


def pack_bin(rows: pd.DataFrame, window: int, min_piece: int) -> pd.DataFrame:
    """Pieces of one bin. Rows: _row, _source, tokens, _at (order), _share, _credit, _bin."""
    rows = rows.sort_values(["_source", "_at", "_row"], kind="stable").reset_index(drop=True)
    queues, share, credit = {}, {}, {}
    for source, part in rows.groupby("_source", sort=True):
        queues[source] = list(zip(part["_row"].tolist(), part["tokens"].tolist(), strict=True))
        share[source] = float(part["_share"].iloc[0])
        credit[source] = float(part["_credit"].iloc[0])
    first = int(rows["_bin"].iloc[0]) << 32
    out, sequence = [], 0
    for pieces in fill(queues, share, credit, window, min_piece):
        for part in cut_last(pieces, window):
            offset = 0
            for row, start, length in part:
                out.append((row, start, length, first + sequence, offset))
                offset += length
            sequence += 1
    return pd.DataFrame(out, columns=["_row", "start", "length", "sequence_id", "offset"])


def plan(rows: DataFrame, *, window: int, bin_tokens: int, min_piece: int, weights: dict[str, float] | None, seed: int) -> DataFrame:
    """Pieces (_row, start, length, sequence_id, offset) of documents (_row, doc_id, source, tokens).

    Only counts travel here; the ids stay where they are.
    """
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    bins = max(1, -(-total // bin_tokens))
    # order within a source: a hash of the id, so neighbours in the input part
    keyed = rows.select(
        "_row", "tokens", group_key(F.col("source")).alias("_source"),
        F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)).alias("_draw"),
    )
    placed = prefix_sums(keyed, "_source", ["_draw", "_row"], {"tokens": "t"})
    bin_ = F.least(F.floor(F.col("t_before") * bins / F.col("t_total")), F.lit(bins - 1)).cast("int")
    placed = written(
        placed.select("_row", "_source", "tokens", F.col("t_before").alias("_at"), F.col("t_total").alias("_all"), bin_.alias("_bin")),
        "places",
    )
    dealt = placed.drop("_all").join(credits(placed, total or 1, weights), ["_source", "_bin"])
    return dealt.groupBy("_bin").applyInPandas(
        lambda part: pack_bin(part, window, min_piece),
        "_row long, start long, length long, sequence_id long, offset long",
    )


def pack(
    docs: DataFrame, *, tokenizer: str, window: int = WINDOW, bin_tokens: int = BIN_TOKENS,
    min_piece: int = MIN_PIECE, weights: dict[str, float] | None = None, seed: int = 17,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids of every piece.

    ``ids`` holds two little-endian bytes per id. ``weights`` gives sources (by name) other target
    shares than their shares of all tokens; as all tokens are packed, such windows hold what is left
    once a source has run out. The ids are shuffled once, to meet the pieces of their document.
    """
    rows = written(tokenised(docs, tokenizer).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    pieces = plan(
        rows.select("_row", "doc_id", "source", "tokens"),
        window=window, bin_tokens=bin_tokens, min_piece=min_piece, weights=weights, seed=seed,
    )
    of_row = pieces.groupBy("_row").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces")
    )
    joined = rows.select("_row", "doc_id", "tokens", "ids").join(of_row, "_row").drop("_row")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        cut,
        f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, ids binary",
    )


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each document with their ids and checksums."""
    for batch in batches:
        lists = batch["pieces"]
        part = lists.flatten()
        of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        start, length = (part.field(k).to_numpy(zero_copy_only=False) for k in ("start", "length"))
        ids, sums, now, wide = [], [], -1, b""
        for row, a, n in zip(of.tolist(), start.tolist(), length.tolist(), strict=True):
            if row != now:
                now, own = row, batch["ids"][row].as_py()
                wide = np.frombuffer(own, "<u2").astype("<u4").tobytes()
            ids.append(own[2 * a : 2 * (a + n)])
            sums.append(zlib.crc32(wide[4 * a : 4 * (a + n)]))
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"].take(pa.array(of)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                batch["tokens"].take(pa.array(of)), part.field("sequence_id"), part.field("offset"), pa.array(ids, pa.binary()),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids (two little-endian bytes each) of every sequence, unpadded."""
    return (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
        .select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"])).alias("ids"))
    )


def credits(placed: DataFrame, total: int, weights: dict[str, float] | None) -> DataFrame:
    """(_source, _bin): the source's target share, and the tokens it is owed when the bin starts.

    What a source is owed is its share of the tokens in earlier bins less its own tokens there. Rows
    are at most bins times sources.
    """
    cells = written(placed.groupBy("_source", "_bin").agg(F.sum("tokens").alias("n"), F.max("_all").alias("all")), "cells")
    if weights is None:
        share = F.col("all") / F.lit(total)
    else:
        scale = sum(weights.values())
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("_source") == f"={name}", weight / scale).otherwise(share)
    by_bin = prefix_sums(
        cells.groupBy("_bin").agg(F.sum("n").alias("n")).withColumn("_one", F.lit(1)), "_one", ["_bin"], {"n": "bin"}
    ).select("_bin", "bin_before")
    own = prefix_sums(cells, "_source", ["_bin"], {"n": "own"})
    return written(
        own.join(by_bin, "_bin").select(
            "_source", "_bin", share.alias("_share"), (share * F.col("bin_before") - F.col("own_before")).alias("_credit")
        ),
        "credits",
    )
