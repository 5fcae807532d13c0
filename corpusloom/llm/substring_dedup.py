"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive white-space words of one document.  Every
word inside a window whose word sequence also starts elsewhere, in the same
document or another, is removed; all windows are judged on the input.

Texts are dealt into groups first, so a place is a group and a word of it; the
three steps that read them share one shuffle.

Pass 1, the sketch.  A window is counted through its anchor, the smallest hash
among the half-window word runs inside it.  Equal windows have equal anchors
at different places, so the count of an anchor is never below the count of the
window: the estimate loses no repeated window while only about a tenth of the
positions enter the sketch.  Each group sends its own sketch (the cells of its
distinct anchors and whether it has them twice) to the shards of a count-min
sketch of two rows; a shard merges them by addition and answers, for each
group, which anchors are estimated to occur twice.  The number of shards
follows the input, so the share of unique windows that pass does not grow with
it, and no task holds, and nothing broadcasts, more than a shard.

Pass 2, exact.  A group compares the windows that are estimated repeated by a
keyed 128-bit BLAKE2 of their words; what it has twice it knows at once and
tells the shards by one entry, so a window that fills a third of all rows
leaves each group once.  Shards of the digest compare the rest and answer the
groups with runs of repeated windows.

Both exchanges are those of :mod:`corpusloom.llm.exchange`: rows in proportion
to the input.

Edge cases: null or empty text has no words and gives an empty result text;
texts shorter than a window lose nothing; very long texts are processed whole;
a repeated row counts as another place of its windows; ids are not looked at.
Other columns are carried in ``row``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C
from corpusloom.llm import exchange as X

WINDOW = 35
#: log2 of the cells in each of the two rows of a shard of the sketch.
WIDTH_BITS = 22
#: Text for one shard of the sketch (half a million anchors), and of the exact pass (five million windows at most).
SKETCH_BYTES, EXACT_BYTES = 32 << 20, 32 << 20
_NONE = np.iinfo(np.uint64).max
_KEY = b"windows"


class Windows:
    """Windows and anchors of a run of texts."""

    def __init__(self, texts: list[bytes], window: int):
        w = self.words = C.Words(texts)
        gram = -(-window // 2)
        span = window - gram + 1
        n = len(w.start)
        ends = w.first[w.doc + 1]
        at = np.arange(n)
        #: Word positions at which a window starts.
        self.at = np.flatnonzero(at + window <= ends)
        self.window = window
        grams = C.runs(w.hashes(), gram)
        w.words = []  # the texts themselves are not needed any more
        grams[at + gram > ends] = _NONE
        least = C.runs(grams, span, np.minimum)
        #: Anchor hash of each window of ``at``.
        self.anchor = least[self.at]
        some = np.zeros(n, np.uint64)
        some[self.at] = self.anchor
        most = C.runs(some[::-1].copy(), span, np.maximum)[::-1] if n else some
        if n:  # the first entries have a shorter range behind them
            head = min(span - 1, n)
            most[:head] = np.maximum.accumulate(some[:head])
        self.anchors = grams[(most == grams) & (most > 0) & (grams != _NONE)]

    def digests(self, chosen: np.ndarray) -> np.ndarray:
        """128 bits of the words of the windows at word positions ``chosen``, as two columns."""
        w = self.words
        text, cut = w.joined, zip(w.start[chosen].tolist(), w.end[chosen + self.window - 1].tolist(), strict=True)
        raw = b"".join([hashlib.blake2b(text[a:b], digest_size=16, key=_KEY).digest() for a, b in cut])
        return np.frombuffer(raw, np.uint64).reshape(-1, 2)


class Block:
    """All windows of a group of texts."""

    def __init__(self, texts: list[bytes], window: int):
        self.runs = [Windows(run, window) for run in X.slices(texts)]
        held = [C.mix(w.anchors, 3) for w in self.runs]
        #: Distinct anchors, sorted, and whether they are there twice.
        self.found, count = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        self.twice = count > 1

    def chosen(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(digests, word positions in the group) of the windows whose anchor is ``repeated``."""
        digests, places, before = [np.empty((0, 2), np.uint64)], [np.empty(0, np.int64)], 0
        for w in self.runs:
            at = w.at[repeated[np.searchsorted(self.found, C.mix(w.anchor, 3))]] if len(w.at) else w.at
            digests.append(w.digests(at))
            places.append(at + before)
            before += len(w.words.start)
        return np.concatenate(digests), np.concatenate(places)


def _share(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def estimate(h: np.ndarray, twice: np.ndarray, width_bits: int) -> np.ndarray:
    """Whether the count-min estimate of each anchor is two or more, from all sketches of a shard."""
    out, mask = np.ones(len(h), bool), np.uint64((1 << width_bits) - 1)
    for row in range(2):
        cell = (h >> np.uint64(row * width_bits) & mask).astype(np.int64)
        out &= np.bincount(cell, 1 + twice, 1 << width_bits)[cell] > 1
    return out


def _group(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by digest, first entry of each digest, number of the digest."""
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return order, new, np.cumsum(new) - 1


def _runs(block: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Distinct (block, position) as runs: block, first position, length."""
    order = np.lexsort((pos, block))
    block, pos = block[order], pos[order].astype(np.int64)
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (pos[1:] > pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(block))[: len(first)] - 1
    return [block[first], pos[first], pos[last] - pos[first] + 1]


def remove_repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, window: int = WINDOW, width_bits: int = WIDTH_BITS, sketch_bytes: int = SKETCH_BYTES, exact_bytes: int = EXACT_BYTES, group_bytes: int | None = None, fan: int | None = None) -> DataFrame:
    """``row``, ``n_words``, ``spans`` (removed word ranges) and ``kept`` (the other words joined by one space)."""
    C.bound_batches(docs.sparkSession)
    cols = docs.columns if carry is None else carry
    body = F.col(C.sql_name(text)).cast("string")
    df = docs.select(F.struct(*[F.col(C.sql_name(c)) for c in cols]).alias("row"), body.alias("text"), F.col(C.sql_name(doc_id)).alias("id"))
    groups = X.Groups(df, ["id", "text"], group_bytes)
    sketch_shards, exact_shards = max(1, -(-groups.size // sketch_bytes)), max(1, -(-groups.size // exact_bytes))
    sketch = X.Exchange(["+u8", "u1", "u4", "+u4"], sketch_shards, lambda c: _share(c[0], sketch_shards), fan)
    exact = X.Exchange(["u8", "u8", "u1", "u4", "+u4"], exact_shards, lambda c: _share(c[0], exact_shards), fan)
    flagged, covered = groups.answers(["+u4"], fan), groups.answers(["+u4", "u4"], fan)

    def sketched(number: int, texts: list[bytes]) -> pa.RecordBatch:
        block = Block(texts, window)
        return sketch.cut([block.found, block.twice, np.full(len(block.found), number), np.arange(len(block.found))])

    def merged(table: pa.Table) -> pa.Table:
        h, twice, group, index = sketch.gather(table)
        back = estimate(h, twice, width_bits) & (twice == 0)  # what a group has twice it knows
        return pa.Table.from_batches([flagged.cut([group[back], index[back]])])

    def windows(number: int, _, texts: list[bytes], answers: list[np.ndarray]) -> pa.RecordBatch:
        block = Block(texts, window)
        repeated = block.twice.copy()
        repeated[answers[0]] = True
        digests, pos = block.chosen(repeated)
        order, new, same = _group(digests[:, 0], digests[:, 1])
        digests, pos = digests[order], pos[order]
        many = np.bincount(same)[same] > 1 if len(same) else new
        known = np.sort(pos[many])
        # 0: a window that the group has once; 2: told to its shard, without a place; 1: known, on its way back.
        spread = C.mix(np.array([number], np.uint64))[0]
        h = [np.concatenate([digests[~many, i], digests[many & new, i], np.full(len(known), 0 if i else spread, np.uint64)]) for i in (0, 1)]
        told = int((many & new).sum())
        kind = np.repeat([0, 2, 1], [int((~many).sum()), told, len(known)])
        place = np.concatenate([pos[~many], np.zeros(told, np.int64), known])
        order = np.lexsort((place, kind))
        return exact.cut([h[0][order], h[1][order], kind[order], np.full(len(kind), number), place[order]])

    def compared(table: pa.Table) -> pa.Table:
        h1, h2, kind, group, pos = exact.gather(table)
        back = kind == 1
        asked = np.flatnonzero(~back)
        order, _, same = _group(h1[asked], h2[asked])
        if len(asked):
            many = (np.bincount(same) > 1) | (np.bincount(same, kind[asked][order]) > 0)
            back[asked[order]] = many[same] & (kind[asked][order] == 0)
        return pa.Table.from_batches([covered.cut(_runs(group[back], pos[back]))])

    def cut(_, table: pa.Table, texts: list[bytes], answers: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(answers[0])
        first = answers[0][order].astype(np.int64)
        end = first + answers[1][order] + window - 1
        counts, spans, kept, before = [], [], [], 0
        for t in texts:
            words = t.split()
            lo, hi = np.searchsorted(end, before, "right"), np.searchsorted(first, before + len(words))
            gone = []
            for a, b in zip((first[lo:hi] - before).clip(0).tolist(), (end[lo:hi] - before).clip(None, len(words)).tolist(), strict=True):
                if gone and a <= gone[-1]["end"]:
                    gone[-1]["end"] = max(b, gone[-1]["end"])
                else:
                    gone.append({"start": a, "end": b})
            before += len(words)
            counts.append(len(words))
            spans.append(gone)
            for s in reversed(gone):
                del words[s["start"] : s["end"]]
            kept.append(b" ".join(words).decode())
        lists = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([table.column("row").combine_chunks(), pa.array(counts, pa.int64()), lists, pa.array(kept, pa.string())], ["row", "n_words", "spans", "kept"])

    fields = [df.schema["row"], *T._parse_datatype_string("n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string").fields]
    told = sketch.deliver(groups.each(sketched, X.ROWS)).groupBy("bucket").applyInArrow(merged, X.ROWS)
    asked = exact.deliver(groups.meet(flagged, told, windows, X.ROWS)).groupBy("bucket").applyInArrow(compared, X.ROWS)
    return groups.meet(covered, asked, cut, T.StructType(fields))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
    return out.select("row.doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, p, array_to_string(w[p : p + 34], ' ') AS s FROM d, unnest(generate_series(1, len(w) - 34)) AS u(p) WHERE len(w) >= 35),
many AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cov AS (SELECT DISTINCT rid, q FROM win JOIN many USING (s), unnest(generate_series(p, p + 34)) AS u(q)),
word AS (SELECT rid, q, w[q] AS x FROM d, unnest(generate_series(1, len(w))) AS u(q)),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS s FROM word ANTI JOIN cov USING (rid, q) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
