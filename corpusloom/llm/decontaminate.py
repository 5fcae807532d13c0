"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``window`` consecutive words of a benchmark item is a pattern
(an item with fewer words, but not none, is one pattern).  Patterns of equal
length share one table: the block of the last two words of the text window
looks up a shift; blocks that end no pattern skip positions that cannot match,
and where the shift is zero the suffix block and the first word pick a bucket
of patterns that are compared word by word.

The benchmark is the stated query set: it is searched in blocks of at most
``block_bytes`` of text, each broadcast on its own; a larger benchmark means
more passes, never a larger table.

Edge cases: a null or wordless document has no words, spans or items.  A null
or wordless item has no pattern.  Rows of the benchmark that share an item id
are one item; an item with a null id still marks words but has no name to
list.  Repeated document rows each get their own result row.  Columns of the
input other than the two named ones are carried in ``row`` untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C

WINDOW = 13
#: Text of the benchmark in one table; with it a worker holds some 25 times that at most.
BLOCK_BYTES = 16 << 20
_TABLES: dict[str, WuManber] = {}


_ODD, _BITS = 0x9E3779B97F4A7C15, (1 << 64) - 1


class _Table:
    """Patterns of one length ``m``: the windows of some items, in flat arrays.

    The words of the items stand in one buffer; a pattern is the number of its
    first word.  ``shift`` is indexed by the hash of a block of ``b`` words and
    holds the least shift of the blocks that fall there.  Patterns are sorted by
    a hash of their last block and first word; equal ones are one entry with
    several owners.  All hashes are those of this process.
    """

    def __init__(self, m: int, items: list[tuple[int, list[bytes]]]):
        self.m, self.b = m, min(2, m)
        self.default = m - self.b + 1
        total = sum(len(w) for _, w in items)
        self.mask = (1 << max(10, (8 * total).bit_length())) - 1
        self.shift = np.full(self.mask + 1, self.default, np.uint8 if self.default < 256 else np.uint16)
        joined, ends, at, starts, owners, keys = [], np.empty(total, np.int64), 0, [], [], []
        size = 0
        for owner, words in items:
            n = len(words)
            joined.append(b" ".join(words))
            ends[at : at + n] = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) + size - 1
            size += len(joined[-1]) + 1
            blocks = words if self.b == 1 else [x + b" " + y for x, y in pairwise(words)]
            h = np.fromiter(map(hash, blocks), np.int64, len(blocks))
            # A block that ends at word e of an item is e+1-m words into some window, or short of the first.
            least = np.maximum(m - self.b - np.arange(len(h)), 0).astype(self.shift.dtype)
            np.minimum.at(self.shift, h & self.mask, least)
            first = np.fromiter(map(hash, words[: n - m + 1]), np.int64, n - m + 1)
            keys.append(h[m - self.b :].view(np.uint64) ^ first.view(np.uint64) * np.uint64(_ODD))
            starts.append(np.arange(at, at + n - m + 1, dtype=np.int32))
            owners.append(np.full(n - m + 1, owner, np.int32))
            at += n
        self.text, self.ends = b" ".join(joined), ends
        key, start, owner = (np.concatenate(x) for x in (keys, starts, owners))
        del joined, keys, starts, owners
        order = np.argsort(key, kind="stable")
        key, start, owner = key[order], start[order], owner[order]
        # Equal keys hold equal patterns but for collisions: those are told apart by their words.
        again = np.flatnonzero(key[1:] == key[:-1]) + 1
        same = np.zeros(len(key), bool)
        for i in again.tolist():
            same[i] = self.pattern(start[i]) == self.pattern(start[i - 1])
        self.key, self.start = key[~same], start[~same]
        self.owners, self.at = owner, np.append(np.flatnonzero(~same), len(key)).astype(np.int32)

    def pattern(self, start: int) -> bytes:
        begin = int(self.ends[start - 1]) + 1 if start else 0
        return self.text[begin : int(self.ends[start + self.m - 1])]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, owners) of every occurrence, by rising start."""
        m, n, end = self.m, len(words), self.m - 1
        shift, mask, two = memoryview(self.shift), self.mask, self.b == 2
        while end < n:
            block = hash(words[end - 1] + b" " + words[end] if two else words[end])
            skip = shift[block & mask]
            if skip:
                end += skip
                continue
            start = end - m + 1
            key = (block & _BITS) ^ (hash(words[start]) * _ODD & _BITS)
            i = int(np.searchsorted(self.key, np.uint64(key)))
            text = None
            while i < len(self.key) and int(self.key[i]) == key:
                text = text or b" ".join(words[start : end + 1])
                if self.pattern(int(self.start[i])) == text:
                    yield start, self.owners[self.at[i] : self.at[i + 1]].tolist()
                i += 1
            end += 1


class WuManber:
    """``items``: (item id as string or None, lower-cased words) pairs."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
        self.names: list[str | None] = []
        for name, words in items:
            if words:
                by_length.setdefault(min(window, len(words)), []).append((len(self.names), words))
                self.names.append(name)
        self.tables = [_Table(m, by_length.pop(m)) for m in sorted(by_length)]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [start, end) inside occurrences, and the items."""
        found, items = [], set()
        for table in self.tables:
            for start, owners in table.search(words):
                found.append((start, start + table.m))
                items.update(owners)
        return merge(found), {self.names[i] for i in items} - {None}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


RESULT = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
_ARROW = {"n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.string())}


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``row`` (the carried columns), ``n_words``, ``spans``, ``items``."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    cols = docs.columns if carry is None else carry
    df = docs.select(F.struct(*[F.col(C.sql_name(c)) for c in cols]).alias("row") if cols else F.struct(F.lit(0).alias("_")).alias("row"), F.col(C.sql_name(text)).cast("string").alias("text"))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        table = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.toLocalIterator()])
        last = k == blocks - 1
        schema = T.StructType([f for f in df.schema.fields if f.name in ("row", *(() if last else ("text",)))] + T._parse_datatype_string(RESULT).fields)
        df = df.mapInArrow(C.lean(_scanner(table, window, uuid.uuid4().hex, last)), schema)
        if not last:
            df = C.stage(df, "decontaminate-block")
    return df


def _scanner(table, window: int, key: str, last: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = WuManber(((i, C.alnum_words(t.encode())) for i, t in table.value), window)
        search = _TABLES[key]
        for batch, texts in C.batches_of(it):
            n, spans, names = [], [], []
            for t in texts:
                words = C.alnum_words(t)
                s, i = search.scan(words)
                n.append(len(words))
                spans.append(s)
                names.append(i)
            if "spans" in batch.schema.names:  # found in earlier blocks of the benchmark
                spans = [merge(s + [(x["start"], x["end"]) for x in old]) for s, old in zip(spans, batch.column("spans").to_pylist(), strict=True)]
                names = [i | set(old) for i, old in zip(names, batch.column("items").to_pylist(), strict=True)]
            out = {"row": batch.column("row")} | ({} if last else {"text": batch.column("text")})
            out |= {"n_words": pa.array(n, pa.int64()), "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _ARROW["spans"]), "items": pa.array([sorted(i) for i in names], _ARROW["items"])}
            yield pa.RecordBatch.from_pydict(out)

    return run


def n_hit(spans: str = "spans"):
    return F.expr(f"aggregate({spans}, 0L, (a, s) -> a + s.end - s.start)")


def contaminated(n_words, hit):
    return (hit > 0) & (20 * hit >= n_words)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    out = found.select("row.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS s
        FROM i, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS u(p) WHERE len(w) > 0),
win AS (SELECT rid, p, m, array_to_string(w[p : p + m - 1], ' ') AS s
        FROM d, (SELECT DISTINCT m FROM pat) AS ms, unnest(generate_series(1, len(w) - m + 1)) AS u(p) WHERE len(w) >= m),
occ AS (SELECT win.rid, win.p, win.m, pat.item FROM win JOIN pat ON win.m = pat.m AND win.s = pat.s),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rid, p, m FROM occ), unnest(generate_series(p, p + m - 1)) AS u(q) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
