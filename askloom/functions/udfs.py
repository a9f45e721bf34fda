"""The few steps no column function covers, in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as St

from askloom.settings import DEFAULTS


#: Texts that are strings, and that are lists of words, in a Python worker at a time; an Arrow batch may have thousands.
EMBED_ROWS = 1024
SLICE_ROWS = 128


@F.arrow_udf(St.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode compatibility folding. ASCII texts stay as they are; of the others a slice is Python strings at a time."""
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    places = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(places):
        return texts
    parts = []
    for start in range(0, len(places), SLICE_ROWS):
        part = texts.take(pa.array(places[start : start + SLICE_ROWS])).to_pylist()
        parts.append(pa.array([unicodedata.normalize("NFKC", s) for s in part], texts.type))
    return pc.replace_with_mask(texts, odd, pa.concat_arrays(parts))


_WORD = re.compile(r"[a-z0-9]+")


def hashed_vectors(texts: pd.Series, dim: int) -> np.ndarray:
    """Signed feature hashing of ``[a-z0-9]+`` words, unit length (zero stays zero).

    The first four hex digits of md5 pick the slot, the fifth picks the sign. Words are listed for a
    slice of the texts at a time, as the words of a whole Arrow batch take hundreds of MB.
    """
    parts = [_hashed_slice(texts.iloc[i : i + SLICE_ROWS], dim) for i in range(0, len(texts), SLICE_ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, dim))


@lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> tuple[int, float]:
    """The first four hex digits of md5 as a number, and the sign."""
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:4], 16), 1.0 if int(digest[4], 16) < 8 else -1.0


def _hashed_slice(texts: pd.Series, dim: int) -> np.ndarray:
    """Each different word of the slice is hashed once; its occurrences are summed as arrays."""
    found = [_WORD.findall((text or "").lower()) for text in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    codes, words = pd.factorize(np.array([w for row in found for w in row], dtype=object))
    hashes = [_word_hash(w) for w in words]
    slots = np.array([h[0] % dim for h in hashes], np.int64)
    signs = np.array([h[1] for h in hashes])
    cells = np.repeat(np.arange(len(found)), lengths) * dim + slots[codes] if len(codes) else codes
    out = np.bincount(cells, signs[codes] if len(codes) else None, minlength=len(found) * dim)
    out = out.astype(np.float64).reshape(len(found), dim)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


Embedder = Callable[[pd.Series], np.ndarray]


def vectors_of(text: Column, embedder: Embedder | None = None, dim: int = DEFAULTS.vector_dim) -> Column:
    """A vector column. Only the text goes to Python. ``embedder`` maps up to ``EMBED_ROWS`` texts to a 2-d array."""
    model = embedder or (lambda batch: hashed_vectors(batch, dim))

    @F.arrow_udf(St.ArrayType(St.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, len(texts), EMBED_ROWS):
            found = np.asarray(model(texts.slice(start, EMBED_ROWS).to_pandas()), dtype=np.float64)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            parts.append(pa.ListArray.from_arrays(ends, pa.array(found.ravel())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return run(text)


def embed_column(
    df: DataFrame, column: str, target: str = "embedding", embedder: Embedder | None = None,
    dim: int = DEFAULTS.vector_dim,
) -> DataFrame:
    """Add a vector column for a text column."""
    return df.withColumn(target, vectors_of(F.col(column), embedder, dim))


PairScorer = Callable[[pd.Series, pd.Series], np.ndarray]


def score_pairs(query: Column, text: Column, scorer: PairScorer) -> Column:
    """Score (query, text) pairs with a model given as a callable on batches."""

    @F.pandas_udf(St.DoubleType())
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(scorer(q, t), dtype=np.float64))

    return run(query, text)


def first_json(text: str | None) -> str | None:
    """The first JSON object that starts anywhere in a text, else the first array.

    Of a run of opening brackets the inner ones decode whenever an outer one does, so the outermost
    that decodes is found by bisection; nesting too deep to decode counts as not decodable.
    """
    decoder, text, array = json.JSONDecoder(), text or "", None

    def end_of(start: int) -> int | None:
        try:
            return decoder.raw_decode(text, start)[1]
        except (ValueError, RecursionError):
            return None

    for run in re.finditer(r"\{|\[+", text):
        if run[0] == "{":
            if (end := end_of(run.start())) is not None:
                return text[run.start():end]
        elif array is None and end_of(run.end() - 1) is not None:
            low, high = run.start(), run.end() - 1
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if end_of(middle) is not None else (middle + 1, high)
            array = text[low:end_of(low)]
    return array


@F.pandas_udf(St.StringType())
def embedded_json(texts: pd.Series) -> pd.Series:
    """The JSON value embedded in each text."""
    return texts.map(first_json)


@F.pandas_udf(St.IntegerType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays.

    One bit row per right token (Hyyro's bit-vector form): linear memory, and a
    pair of long texts costs one big-integer step per token.
    """

    def length(a: np.ndarray, b: np.ndarray) -> int:
        positions: dict[str, int] = {}
        for i, token in enumerate(a):
            positions[token] = positions.get(token, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for token in b:
            matched = row & positions.get(token, 0)
            row = ((row + matched) | (row - matched)) & full
        return len(a) - row.bit_count()

    return pd.Series([length(a, b) for a, b in zip(left, right)])


def model_token_count(text: Column, encode: Callable[[str], list[int]]) -> Column:
    """Token count of a model's own tokenizer, given as a callable on one text."""

    @F.pandas_udf(St.IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t or "")))

    return run(text)
