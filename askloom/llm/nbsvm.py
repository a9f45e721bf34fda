"""Quality by Naive Bayes support vectors over n-grams.

A text's features are the n-grams that it holds at all (indicators, hashed into buckets): those of its
UTF-8 bytes, and those of its words' echoes, where a word's echo says which of the three words before
it (if any) it repeats. Every indicator is scaled by its bucket's class log-count ratio, the log of how much
likelier a good text holds it than a bad one; the scaled vector is brought to length one and gets a
constant. A linear hinge-loss model is fitted to these vectors by dual coordinate descent, with the
classes weighted alike. Platt scaling on rows left out of the fit turns its margin into a score.

The fit uses a bounded sample: at most ``Settings.rows_per_class`` labelled rows of either class,
drawn by hash, of texts up to ``Settings.longest`` bytes; only rows that are not ``held_out``. Their
features are made in tasks; the driver gets bucket numbers. All texts of the table are scored whole.
Identifiers, language, source and labels are no inputs of a score.

Defined results: a null text is empty, and an empty text has the constant alone; rows that repeat an
id are scored one by one; a row without id is not held out and never learned from; a document of the
sample whose id repeats teaches once per row; without rows of both classes every score is the share
of good rows seen (0 if none). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of a text that are looked at together.
BLOCK = 1 << 20
#: A byte's factor by its place in a word.
PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64)


@dataclass(frozen=True)
class Settings:
    rows_per_class: int = 2500
    longest: int = 40_000
    #: Lengths of the n-grams, in bytes; four at most.
    orders: tuple[int, ...] = (1, 2, 3, 4)
    #: Longest n-gram of word echoes; none if zero.
    echo_order: int = 4
    #: Buckets are 2 to this power.
    bits: int = 18
    #: Added to every bucket's count of texts.
    smoothing: float = 1.0
    #: Largest dual weight of a row, times the size of the sample over twice that of its class.
    cost: float = 1.0
    epochs: int = 100
    #: The descent ends when no dual gradient is further than this from its optimum.
    tolerance: float = 0.01
    seed: int = 7


def mixed(codes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Buckets of n-grams given as 32-bit codes; ``kind`` keeps the kinds of n-grams apart."""
    x = (codes ^ np.uint32(0x9E3779B9 * kind & 0xFFFFFFFF)) * np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(2246822519)) >> np.uint32(32 - bits)


def word_codes(raw: np.ndarray) -> np.ndarray:
    """A number for each white-space word; equal words have equal numbers, A-Z counting as a-z."""
    inside = raw > 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edges):
        return np.zeros(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    upper = (raw >= 65) & (raw <= 90)
    first = np.zeros(len(raw), np.int64)
    first[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(first)
    worth = (raw + (upper * np.uint8(32))).astype(np.uint64) * PLACES[place % len(PLACES)]
    worth[~inside] = 0
    return np.add.reduceat(worth, starts) * np.uint64(31) + (ends - starts).astype(np.uint64)


def echoes(codes: np.ndarray, before: int) -> np.ndarray:
    """Per word from ``before`` on: the distance to its last copy among the three words before it, or zero."""
    out = np.zeros(len(codes), np.uint32)
    for back in (3, 2, 1):
        out[back:][codes[back:] == codes[:-back]] = back
    return out[before:]


def buckets(raw: np.ndarray, settings: Settings, seen: np.ndarray) -> np.ndarray:
    """Sorted distinct buckets of a text's n-grams. ``seen`` is all false, before and after.

    A text goes through in blocks, so that its size does not decide the memory.
    """
    longest, codes, marks = max(settings.orders), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    at = 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        part = raw[at : end + longest - 1]
        gram = np.zeros(len(part), np.uint32)
        for order in range(1, longest + 1):
            if order > len(part):
                break
            gram = gram[: len(part) - order + 1] | (part[order - 1 :].astype(np.uint32) << np.uint32(8 * order - 8))
            if order in settings.orders:
                seen[mixed(gram, order, settings.bits)] = True
        blank = np.flatnonzero(raw[at:end] <= 32)
        if end < len(raw) and len(blank) and blank[-1] > 0:
            end = at + int(blank[-1])  # the next block begins between words
        found = np.concatenate([codes, word_codes(raw[at:end])])
        marks = np.concatenate([marks, echoes(found, len(codes))])
        code = np.zeros(len(marks), np.uint32)
        for order in range(1, settings.echo_order + 1):
            if order > len(marks):
                break
            code = code[: len(marks) - order + 1] * np.uint32(4) + marks[order - 1 :]
            seen[mixed(code, 8 + order, settings.bits)] = True
        codes, marks = found[-3:], marks[-(settings.echo_order - 1) :] if settings.echo_order > 1 else marks[:0]
        at = end
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def raw_bytes(value: pa.Scalar) -> np.ndarray:
    """The UTF-8 bytes of a text, not copied."""
    held = value.as_buffer()
    return np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)


def log_ratios(rows: list[np.ndarray], good: np.ndarray, settings: Settings) -> np.ndarray:
    """Per bucket the log of its share among the indicators of good texts over that among bad ones."""
    counts = []
    for wanted in (True, False):
        own = [r for r, g in zip(rows, good, strict=True) if g == wanted]
        n = np.bincount(np.concatenate(own), minlength=1 << settings.bits) + settings.smoothing
        counts.append(n / n.sum())
    return np.log(counts[0] / counts[1])


def descend(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and constant of the hinge-loss model, by dual coordinate descent.

    One dual weight a row, between 0 and its class's cost; each step moves one to its optimum while
    the primal weights are kept up to date, in a fresh random order every epoch.
    """
    sign = np.where(good, 1.0, -1.0)
    share = good.mean()
    cost = settings.cost * np.where(good, 0.5 / share, 0.5 / (1 - share))
    own = np.array([v @ v + 1.0 for v in values])
    dual = np.zeros(len(rows))
    weights, constant = np.zeros(1 << settings.bits), 0.0
    rng = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        furthest = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (weights[rows[i]] @ values[i] + constant) - 1.0
            at = dual[i]
            blocked = (at <= 0 and slope > 0) or (at >= cost[i] and slope < 0)
            if blocked or slope == 0:
                continue
            furthest = max(furthest, abs(slope))
            dual[i] = min(max(at - slope / own[i], 0.0), cost[i])
            step = (dual[i] - at) * sign[i]
            weights[rows[i]] += step * values[i]
            constant += step
        if furthest < settings.tolerance:
            break
    return weights, constant


@dataclass
class Model:
    settings: Settings
    #: Weight of each indicator with its ratio taken in, and the ratio's square.
    weights: np.ndarray
    squares: np.ndarray
    constant: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    #: The score of every text when the sample lacks a class.
    share: float | None = None

    def margin(self, row: np.ndarray) -> float:
        length = np.sqrt(self.squares[row].sum())
        return float(self.weights[row].sum() / length + self.constant) if length > 0 else self.constant

    def score(self, row: np.ndarray) -> float:
        if self.share is not None:
            return self.share
        slope, offset = self.scale
        return float(1 / (1 + np.exp(-np.clip(slope * self.margin(row) + offset, -40, 40))))


def scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    """The ratios of each row's buckets, as a vector of length one."""
    out = []
    for row in rows:
        value = ratios[row]
        out.append(value / max(np.sqrt(value @ value), 1e-12))
    return out


def fit_part(rows: list[np.ndarray], good: np.ndarray, settings: Settings) -> Model:
    ratios = log_ratios(rows, good, settings)
    weights, constant = descend(rows, scaled(rows, ratios), good, settings)
    return Model(settings, (weights * ratios).astype(np.float32), (ratios**2).astype(np.float32), constant)


def platt(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps, with labels softened by the class sizes."""
    n_good, n_bad = good.sum(), (~good).sum()
    goal = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.stack([margins, np.ones_like(margins)])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -40, 40)))
        curve = (x * np.maximum(p * (1 - p), 1e-6)) @ x.T + 1e-3 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, x @ (p - goal)), -1, 1)
    return max(float(at[0]), 1e-3), float(at[1])


def fit(rows: list[np.ndarray], good: list[int], draws: list[int], settings: Settings) -> Model:
    """Fit on four fifths of the rows, scale on the rest."""
    label = np.array(good, bool)
    if not len(label) or label.min() == label.max():
        none = np.zeros(1 << settings.bits, np.float32)
        return Model(settings, none, none, share=float(label.mean()) if len(label) else 0.0)
    left = np.array([d % 5 == 0 for d in draws])
    if any(not p.any() or label[p].min() == label[p].max() for p in (left, ~left)):
        inside = outside = np.arange(len(label))  # tiny samples: all rows for both
    else:
        inside, outside = np.flatnonzero(~left), np.flatnonzero(left)
    model = fit_part([rows[i] for i in inside], label[inside], settings)
    model.scale = platt(np.array([model.margin(rows[i]) for i in outside]), label[outside])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(text: Column, settings: Settings) -> Column:
    """A column with the distinct buckets of each text."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = np.zeros(1 << settings.bits, bool)
        for batch in batches:
            rows = [buckets(raw_bytes(v), settings, seen).astype(np.int32) for v in batch]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))

    return run(F.coalesce(text, F.lit("")))


def fit_on_labels(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the bounded sample. Only the buckets of its rows, two classes of them at most, reach the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("quality").cast("int").alias("good"), F.xxhash64(F.col("doc_id").cast("string")).alias("draw")
    )
    drawn = [known.where(F.col("good") == c).orderBy("draw", "doc_id").limit(settings.rows_per_class) for c in (0, 1)]
    sample = F.broadcast(drawn[0].union(drawn[1]))  # at most 2 * rows_per_class rows
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.octet_length("text") <= settings.longest)
        .join(sample, "doc_id")
        .orderBy("draw", "doc_id", "text")
        .limit(2 * settings.rows_per_class)
        .select("good", "draw", features(F.col("text"), settings).alias("row"))
        .toArrow()
    )
    return fit([v.values.to_numpy() for v in rows["row"]], rows["good"].to_pylist(), rows["draw"].to_pylist(), settings)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column with the score of each whole text. The model is two megabytes, whatever the input."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        seen = np.zeros(1 << model.settings.bits, bool)
        for batch in batches:
            yield pa.array([model.score(buckets(raw_bytes(v), model.settings, seen)) for v in batch], pa.float64())

    return run(F.coalesce(F.col(text), F.lit("")))


def scores(docs: DataFrame, labels: DataFrame, *, limit: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= limit)."""
    model = fit_on_labels(docs, labels, settings)
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= limit).cast("int"))
