"""Language detection by profiles of byte n-grams that are learnt from labelled texts.

:func:`fit` counts hashed n-grams of two to four bytes of the lower-cased
letters in a bounded sample of each language and turns them into log-odds
against all other languages: a matrix of fixed size, ``MAX_LANGS`` rows of
``2 ** BITS`` weights at most, which is broadcast.  :func:`detect` sums the
weights over a whole text, of any length; there is no word list and no prefix.

Null and empty texts, and texts without letters, have no language; equal scores
go to the first language by name; languages without a text in the sample are
unknown; without any, nothing is detected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts and bytes of a language that are learnt from, languages at most, bits of a hash.
PER_LANG, LANG_BYTES, MAX_LANGS, BITS = 1000, 4 << 20, 64, 15
#: Lengths of n-grams, and multipliers of their bytes.
GRAMS, PRIMES = (2, 3, 4), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Bytes hashed at a time.
RUN = 1 << 20
#: Everything but letters is a space; bytes beyond ASCII are taken as letters.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams, in runs; nothing for a text without letters."""
    words = (text or "").lower().encode().translate(LETTERS).split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32) if words else np.empty(0, np.uint32)
    for n in GRAMS:
        for at in range(0, max(0, len(raw) - n + 1), RUN):
            part = raw[at : at + RUN + n - 1]
            h = np.zeros(len(part) - n + 1, np.uint32)
            for i in range(n):
                h += part[i : len(part) - n + 1 + i] * np.uint32(PRIMES[i])
            h ^= h >> np.uint32(15)
            h *= np.uint32(PRIMES[0])
            yield h >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class Profiles:
    """Languages in order of name, and a row of log-odds for each."""

    names: list[str]
    weights: np.ndarray

    def scores(self, text: str | None) -> np.ndarray | None:
        """Mean log-odds of a text's n-grams for each language; none without letters."""
        total, n = np.zeros(len(self.names)), 0
        for h in grams(text):
            total += self.weights[:, h].sum(axis=1) if len(h) < 1 << BITS - 2 else self.weights @ np.bincount(h, minlength=1 << BITS)
            n += len(h)
        return total / n if n else None

    def best(self, text: str | None) -> str | None:
        scores = self.scores(text) if self.names else None
        return None if scores is None else self.names[int(scores.argmax())]


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text", order: Column | None = None, per_lang: int = PER_LANG, lang_bytes: int = LANG_BYTES) -> Profiles:
    """Profiles from at most ``per_lang`` texts of each language, the first by a hash of ``order`` (the text itself by default), as far as ``lang_bytes`` go."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text) if order is None else order).alias("turn")).where("lang IS NOT NULL AND text IS NOT NULL")
    by = Window.partitionBy("lang").orderBy("turn", "text")
    rows = rows.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= per_lang)
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text")).over(by)).where((F.col("bytes") <= lang_bytes) | (F.col("nth") == 1))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in it:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = counts.setdefault(name, np.zeros(1 << BITS, np.int64))
                for h in grams(body):
                    own += np.bincount(h, minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for r in rows.select("lang", "text").mapInArrow(count, "lang string, counts binary").toLocalIterator():  # a row for each language and task
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(bytes(r["counts"]), np.int64)
        if len(total) > MAX_LANGS:
            raise ValueError(f"more than {MAX_LANGS} languages")
    names = sorted(n for n, c in total.items() if c.any())
    if not names:
        return Profiles([], np.zeros((0, 1 << BITS)))
    own = np.stack([total[n] for n in names]).astype(np.float64)
    rest = own.sum(axis=0) - own
    odds = lambda c: np.log((c + 1) / (c.sum(axis=1, keepdims=True) + (1 << BITS)))
    return Profiles(names, odds(own) - odds(rest))


def detect(docs: DataFrame, profiles: Profiles, *, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the language of each whole text appended as ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("string")
    def best(texts):
        return texts.map(shared.value.best)

    return docs.withColumn(out, best(F.col(text)))
