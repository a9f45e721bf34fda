"""Phrase collocations from a prefix-free parse.

A text is split into pieces and words. A window of three words whose hash is divisible by
``Settings.period`` is a trigger; a piece is cut at its triggers into chunks that overlap by the three
words of the trigger, so where a chunk ends depends on the words around it alone, and a passage that
repeats makes the same chunks again. Spark gathers the distinct chunks with their frequencies: the
dictionary. Phrases of up to four words are then counted inside the distinct chunks only, each weighted
by its chunk's frequency. A chunk owns the phrases that begin before its last three words (all, where
its piece ends with it), so a phrase in an overlap counts once.

Counting goes by length, because no phrase is more frequent than its parts: words first, then pairs of
words that are frequent, then longer phrases whose pairs all are. Up to there phrases are 64-bit hashes
and what passes is a bitmap of ``Settings.bits`` bits, of fixed size whatever the corpus. Hashes and
bitmaps only leave out what is certainly too rare; whatever they let through is counted by its text.

Defined results: a null text is empty, a null language is ``und``; texts without words give nothing;
repeated rows count as often as they occur; a phrase's words are joined by one space, whatever stood
between them; equal rows in every order tie by phrase, which is unique in its language. An empty table
gives an empty result. Columns other than ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm.common import discard, written

#: Words of a trigger, and of the overlap of two chunks; phrases are one word longer at most.
OVERLAP = 3
LONGEST = OVERLAP + 1


@dataclass(frozen=True)
class Settings:
    least: int = 30
    #: A phrase goes if a longer one around it has this percentage of its occurrences.
    covered: int = 80
    top: int = 2000
    #: Parts of a language that are ranked before the whole is.
    salts: int = 16
    #: One window in so many is a trigger.
    period: int = 16
    #: A bitmap has 2 to this power bits.
    bits: int = 26
    #: Bytes of text, and chunks of the dictionary, that a task looks at together.
    block: int = 1 << 22
    chunks: int = 1 << 17


#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd factors of hashes: of a byte by its place in a word, of a word by its place in a phrase.
PLACES = np.random.default_rng(13).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TURNS = np.random.default_rng(14).integers(1, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stirred(x: np.ndarray) -> np.ndarray:
    """Every bit of a hash spread over all of it."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words ``raw[start : start + size]``, which lie one behind the other."""
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    inside = raw[np.repeat(starts, sizes) + place]
    worth = (inside.astype(np.uint64) + np.uint64(1)) * PLACES[place & 63]
    return stirred(np.add.reduceat(worth, first) + sizes.astype(np.uint64) * PLACES[0]) if len(sizes) else np.zeros(0, np.uint64)


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last ``n - 1`` words have none."""
    count = max(len(words) - n + 1, 0)
    total = np.full(count, n, np.uint64)
    for j in range(n):
        total += words[j : j + count] * TURNS[j]
    return stirred(total)


def parse_block(raw: np.ndarray, period: int) -> tuple[list[bytes], np.ndarray]:
    """Chunks of the texts in ``raw``, which ends with a byte between pieces; and how many phrase starts each owns."""
    kind = KIND[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [], np.zeros(0, np.int32)
    text = LOWER[raw]
    piece = np.cumsum(kind == 2)[starts]
    # words with one space behind each, and nothing else
    text[ends] = 32
    inside[ends] = True
    sizes = ends - starts
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    packed = text[inside]
    n = len(starts)
    opens = np.diff(piece, prepend=piece[0] - 1) != 0
    trigger = windows(word_hashes(packed, begins, sizes), OVERLAP) % np.uint64(period) == 0
    trigger &= piece[: len(trigger)] == piece[n - len(trigger) :] if len(trigger) else trigger
    cut = opens.copy()
    cut[: len(trigger)] |= trigger
    first = np.flatnonzero(cut)
    after = np.append(first[1:], n)
    closes = np.append(opens[first[1:]], True)
    last = np.where(closes, after, np.minimum(after + OVERLAP, n))
    data = packed.tobytes()
    stops = np.append(begins, len(data))[last] - 1
    return [data[a:b] for a, b in zip(begins[first].tolist(), stops.tolist(), strict=True)], (after - first).astype(np.int32)


def blocks_of(texts: list[memoryview], size: int) -> Iterator[np.ndarray]:
    """Texts one behind the other with a line feed behind each, in blocks of some ``size`` bytes cut between pieces."""
    held: list[np.ndarray] = []
    total = 0
    feed = np.array([10], np.uint8)
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        while len(raw):
            room = max(size - total, 1)
            end = len(raw)
            if end > room:
                # up to the next end of a piece
                at = room
                while at < len(raw):
                    stop = np.flatnonzero(KIND[raw[at : at + size]] == 2)
                    if len(stop):
                        break
                    at += size
                end = min(at + int(stop[0]) + 1, len(raw)) if len(stop) else len(raw)
            held += [raw[:end], feed]
            total += end + 1
            raw = raw[end:]
            if total >= size:
                yield np.concatenate(held)
                held, total = [], 0
    if held:
        yield np.concatenate(held)


def dictionary(docs: DataFrame, settings: Settings) -> DataFrame:
    """The distinct chunks, written: (lang, chunk, owned, freq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            for i, lang in enumerate(langs.dictionary):
                own = batch["text"].filter(pc.equal(langs.indices, i))
                buffers = (v.as_buffer() for v in own)
                for raw in blocks_of([memoryview(b) for b in buffers if b is not None and b.size], settings.block):
                    chunks, owned = parse_block(raw, settings.period)
                    # in parts, so that no batch on its way to Spark is large
                    for at in range(0, len(chunks), 1 << 16):
                        part = pa.array(chunks[at : at + (1 << 16)], pa.binary()).view(pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(lang, len(part)), part, pa.array(owned[at : at + (1 << 16)])], names=["lang", "chunk", "owned"]
                        )

    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    chunks = rows.mapInArrow(run, "lang string, chunk string, owned int")
    return written(chunks.groupBy("lang", "chunk", "owned").agg(F.count("*").alias("freq")), "dictionary")


class Chunks:
    """Words of some chunks of the dictionary in a task."""

    def __init__(self, rows: pa.Table) -> None:
        column = rows["chunk"].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        data = column.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        space = self.raw == 32
        opens = np.zeros(len(self.raw) + 1, bool)
        opens[offsets[:-1]] = True
        opens[1:][space] = True
        self.starts = np.flatnonzero(opens[:-1])
        closes = np.zeros(len(self.raw) + 1, bool)
        closes[offsets[1:]] = True
        closes[:-1][space] = True
        self.ends = np.flatnonzero(closes)
        self.sizes = self.ends - self.starts
        #: Of each word: its chunk, its place there, and how many words of the chunk follow.
        self.chunk = np.searchsorted(offsets, self.starts, "right") - 1
        first = np.searchsorted(self.starts, offsets)
        self.place = np.arange(len(self.starts)) - first[self.chunk]
        self.left = first[self.chunk + 1] - np.arange(len(self.starts))
        langs = rows["lang"].combine_chunks().dictionary_encode()
        if isinstance(langs, pa.ChunkedArray):
            langs = langs.combine_chunks()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy()[self.chunk]
        self.owned = rows["owned"].to_numpy()[self.chunk]
        self.freq = rows["freq"].to_numpy()[self.chunk]
        names = [x.as_py().encode() for x in self.langs]
        flat = np.frombuffer(b"".join(n + b"\n" for n in names), np.uint8)
        lens = np.array([len(n) + 1 for n in names], np.int64)
        salt = word_hashes(flat, np.cumsum(lens) - lens, lens)
        self.words = word_hashes(self.raw, self.starts, self.sizes)
        #: The words' hashes with their language taken in; phrases get it from their words.
        self.spoken = stirred(self.words ^ salt[self.lang]) if len(names) else self.words

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they are a phrase that the word's chunk owns."""
        hashes = windows(self.spoken, n)
        count = len(hashes)
        return hashes, (self.place[:count] < self.owned[:count]) & (self.left[:count] >= n)


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed weights, and where one of each stands."""
    if not len(keys):
        return keys, weights, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(weights[order], first), order[first]


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[Chunks]:
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.num_rows
        if total >= rows:
            yield Chunks(pa.Table.from_batches(held))
            held, total = [], 0
    if total:
        yield Chunks(pa.Table.from_batches(held))


class Bitmap:
    """Hashes that may be frequent: a bit for each, shared by hashes that end alike."""

    def __init__(self, raw: np.ndarray, bits: int) -> None:
        self.raw, self.mask = raw, np.uint64((1 << bits) - 1)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes & self.mask
        return (self.raw[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent(chunks: DataFrame, hashes: Callable[[Chunks], list[tuple[np.ndarray, np.ndarray]]], settings: Settings) -> Bitmap:
    """Bitmap of the hashes that ``hashes`` finds in the chunks and that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in gathered(batches, settings.chunks):
            for found, fits in hashes(own):
                keys, sums, _ = summed(found[fits], own.freq[: len(found)][fits])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["hash", "n"])

    often = (
        chunks.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least)
    )
    # Spark's bitmaps have 4 KB each and begin at 1
    at = F.pmod("hash", F.lit(1 << settings.bits)) + 1
    parts = (
        often.groupBy(F.bitmap_bucket_number(at).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .toArrow()  # at most 2 ** bits bits
    )
    raw = np.zeros(max(1 << settings.bits >> 3, 4096), np.uint8)
    for part, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        raw[(part - 1) * 4096 : part * 4096] = np.frombuffer(bits, np.uint8)
    return Bitmap(raw, settings.bits)


def counted(chunks: DataFrame, settings: Settings) -> DataFrame:
    """Phrases of one to four words that occur often enough, written: (lang, phrase, words, n)."""
    context = chunks.sparkSession.sparkContext
    words = context.broadcast(frequent(chunks, lambda own: [own.phrases(1)], settings))

    def pairs(own: Chunks) -> list[tuple[np.ndarray, np.ndarray]]:
        found, fits = own.phrases(2)
        known = words.value.passes(own.phrases(1)[0])
        return [(found, fits & known[:-1] & known[1:])]

    couples = context.broadcast(frequent(chunks, pairs, settings))

    def longer(own: Chunks) -> list[tuple[np.ndarray, np.ndarray]]:
        known = couples.value.passes(own.phrases(2)[0])
        out = []
        for n in range(3, LONGEST + 1):
            found, fits = own.phrases(n)
            for j in range(n - 1):
                fits = fits & known[j : j + len(fits)]
            out.append((found, fits))
        return out

    rest = context.broadcast(frequent(chunks, longer, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in gathered(batches, settings.chunks):
            for n, phrases in texts_of(own, [words.value, couples.value, rest.value]):
                for at in range(0, len(phrases[0]), 1 << 16):
                    part = [x[at : at + (1 << 16)] for x in phrases]
                    yield pa.RecordBatch.from_arrays(
                        [part[0], part[1], pa.array(np.full(len(part[0]), n, np.int32)), part[2]], names=["lang", "phrase", "words", "n"]
                    )

    found = chunks.mapInArrow(run, "lang string, phrase string, words int, n long")
    return written(
        found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.least), "phrases"
    )


def texts_of(own: Chunks, maps: list[Bitmap]) -> Iterator[tuple[int, tuple[pa.Array, pa.Array, pa.Array]]]:
    """For each length the distinct phrases that pass, by text: (language, phrase, summed frequency).

    Words get numbers by their text, phrases by the numbers of their words, so nothing here goes by a hash.
    """
    if not len(own.starts):
        return
    sizes = own.sizes.astype(np.int32)
    texts = pa.StringArray.from_buffers(
        len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(own.raw[own.raw != 32])
    )
    word = texts.dictionary_encode().indices.to_numpy().astype(np.int64)
    single = np.unique((own.lang.astype(np.int64) << 32) | word, return_inverse=True)[1].astype(np.int64)
    known, data = single, own.raw.tobytes()
    for n in range(1, LONGEST + 1):
        hashes, fits = own.phrases(n)
        fits &= maps[min(n, 3) - 1].passes(hashes)
        at = np.flatnonzero(fits & (known[: len(fits)] >= 0))
        if not len(at):
            return
        # a phrase is the number of its words but the last, then that of the last
        keys = known[at] if n == 1 else (known[at] << 32) | single[at + n - 1]
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, number, own.freq[at])
        known = np.full(len(fits), -1)
        known[at] = number
        at = at[first]
        phrases = [data[a:b] for a, b in zip(own.starts[at].tolist(), own.ends[at + n - 1].tolist(), strict=True)]
        yield n, (own.langs.take(pa.array(own.lang[at])), pa.array(phrases, pa.binary()).view(pa.string()), pa.array(sums))


def exact(x: Column | str) -> Column:
    """A count as a decimal: products with it do not overflow."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def scored(found: DataFrame) -> DataFrame:
    """Every candidate with its lowest-scoring cut: (lang, phrase, words, a, l, r, score)."""
    candidates = found.where(F.col("words") > 1).withColumnRenamed("n", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "*",
        F.expr("substring_index(phrase, ' ', k)").alias("left"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("right"),
    )
    lefts = found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # parts are at least as frequent as the whole, so every part is there
    both = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    whole = both.withColumns({"_top": exact("a") * F.lit(2_000_000).cast("decimal(7,0)"), "_all": exact("l") + exact("r")})
    score = whole.withColumn("score", F.expr("_top div _all"))
    best = score.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int) -> DataFrame:
    """Candidates that no longer candidate around them nearly always takes in."""
    parts = [
        F.slice(F.split("phrase", " "), start, size)
        for size in range(2, LONGEST)
        for start in range(1, LONGEST - size + 2)
    ]
    inside = candidates.where(F.col("words") > 2).select(
        "lang", "words", F.col("a").alias("longer"), F.explode(F.array(*parts)).alias("part")
    )
    # a slice that runs over the end is shorter than asked for and repeats another one
    within = inside.where((F.size("part") > 1) & (F.size("part") < F.col("words")))
    most = within.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    taken_in = exact("longer") * 100 >= exact("a") * covered
    return candidates.join(most, ["lang", "phrase"], "left").where(~F.coalesce(taken_in, F.lit(False)))


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The first phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    chunks = dictionary(docs, settings)
    found = counted(chunks, settings)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("freq")).alias("n"))
    candidates = written(scored(found), "candidates")
    order = (F.desc("score"), F.desc("a"), "phrase")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    # a language's first phrases are among the first of its salts, however many candidates and tasks it has
    salted = uncovered(candidates, settings.covered).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(settings.salts)))
    few = salted.withColumn("rank", nth("lang", "salt")).where(F.col("rank") <= settings.top)
    first = few.withColumn("rank", nth("lang")).where(F.col("rank") <= settings.top)
    out = written(first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(chunks, found, candidates)
    return out
