"""Vector and set similarity expressions, and the deterministic embedder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, *, truncate: bool = False, strict: bool = False) -> Column:
    """Cosine; empty vectors and zero norms give 0.

    ``truncate`` cuts both to the shorter length first; ``strict`` raises on
    unequal lengths.
    """
    if truncate:
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    den = norm(a) * norm(b)
    value = F.when((F.size(a) == 0) | (F.size(b) == 0) | (den == 0), F.lit(0.0)).otherwise(dot(a, b) / den)
    if strict:
        value = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double")).otherwise(value)
    return value


def rescaled(cos: Column) -> Column:
    """Cosine mapped to 0..1, as vector indexes report it."""
    return (1 + cos) / 2


def unit(a: Column) -> Column:
    """Vector of length 1; the norm is taken once, in the finish of a fold."""
    return F.transform(F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda s: F.when(s["n"] == 0, F.lit(0.0)).otherwise(s["x"].cast("double") / s["n"]))


def padded(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def unit_rows(vectors: list) -> np.ndarray:
    """Matrix of the vectors at length 1, shorter ones filled up with zeros; null and zero vectors stay zero."""
    sizes = {len(v) if v is not None else 0 for v in vectors}
    if len(sizes) == 1:
        m = np.array([v if v is not None else [] for v in vectors], np.float64).reshape(len(vectors), -1)
    else:
        m = np.zeros((len(vectors), max(sizes, default=0)))
        for i, v in enumerate(vectors):
            m[i, : len(v or [])] = v or []
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def hash_vector(text: str, dim: int = 384) -> np.ndarray:
    """Unit vector from the bytes of a sha256, repeated to ``dim``."""
    raw = np.frombuffer(hashlib.sha256((text or "").encode()).digest(), np.uint8).astype(np.float64)
    v = (np.resize(raw, dim) - 128.0) / 128.0
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def hash_embed(dim: int = 384):
    """Arrow UDF of :func:`hash_vector`: the default embedder, offline and deterministic."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dim))

    return run


def keywords(query: Column) -> Column:
    """Distinct lower-cased words of three letters, digits or hyphens, or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[A-Za-zÀ-ÿ0-9-]+"), F.lit(0)), lambda t: F.length(t) >= 3))


def word_set(text: Column, longer_than: int = 0) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+", -1), lambda t: (t != "") & (F.length(t) > longer_than)))


def keyword_overlap(text: Column, query: Column) -> Column:
    """Share of the query's words (over two letters) that the text has."""
    q = word_set(query, 2)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, word_set(text, 2))) / F.size(q))


def jaccard(a: Column, b: Column) -> Column:
    x, y = word_set(a), word_set(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both)
