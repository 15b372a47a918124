"""Scalar functions on text."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value in CSV input, matched exactly.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def normalize(c: Column) -> Column:
    """Strip white space on both ends, in the sense of Unicode and the separators U+001C to U+001F, and lower-case."""
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def na_to_null(c: Column, more: list[str] | str | None = None) -> Column:
    """Null for missing-value texts, the standard ones and ``more``."""
    more = [more] if isinstance(more, str) else list(more or [])
    return F.when(~c.isin([*NA_TOKENS, *more]), c)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def similarity(a: str, b: str) -> float:
    """2 * LCS / (len(a) + len(b)): one less the share of insertions and deletions; 1 for two empty texts."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@lru_cache(maxsize=200_000)
def _direction(gram: str, size: int) -> np.ndarray:
    """A pseudo-random direction of an n-gram."""
    return np.random.default_rng(zlib.crc32(gram.encode())).standard_normal(size)


def embed(text: str, size: int = 10, low: int = 3, high: int = 6) -> np.ndarray:
    """A vector of hashed character n-grams of <text>, of mean zero and length one.

    Each n-gram has a pseudo-random direction; a text's vector is their normalised sum, so that
    texts with common n-grams are near each other.
    """
    word = f"<{text}>"
    grams = [word[i : i + n] for n in range(low, high + 1) for i in range(len(word) - n + 1)]
    total = sum((_direction(g, size) for g in grams), np.zeros(size))
    if not total.any():
        total = _direction(word, size)
    return total / np.linalg.norm(total)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else embed(t).tolist())
