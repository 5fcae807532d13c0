"""LM scoring with a hierarchical Pitman-Yor model.

Tokens are lower-cased (A-Z) white-space words and one end token per text.  The
model is a hierarchy of Chinese restaurants whose dishes are words:

* one restaurant per context.  A context is the word before, or the end of the
  text before; the ``HEADS`` most frequent words are contexts of their own, all
  others share the remaining of ``CONTEXTS`` classes by a hash;
* all of them share one parent restaurant, over a uniform base of the words
  known from training and one unknown word.

Every token of every training text is a customer, so what is gathered, the
(context, word) pairs, their counts and tables, grows with the corpus.  Pairs
live in shards of the word's hash: there a word has all its contexts, so its
part of the parent restaurant is local.  What the shards must know of each
other are the customers and tables of each context and of the parent, vectors
of fixed size that are summed up and broadcast between rounds.  Words that are
too frequent for a shard, the first ``DISHES``, are counted in a table of
``CONTEXTS * (DISHES + 1)`` numbers that is sampled by the driver.

Gibbs: a step draws the number of tables of one dish from its distribution
given all other tables, p(t) ~ S(c, t) * prod_{j<t}(theta + d (T + j)) * P0**t
with generalised Stirling numbers S, up to ``EXACT`` customers; above that the
customers are seated one after another, an eighth at a time.  Steps of a sweep
use the totals of the sweep before, and a shard those of the others as they
were taken last.  After ``BURN_IN`` sweeps the seating is averaged over
``SAMPLES``; the predictive probabilities of a context sum to one.  Draws depend
on the pair and the sweep alone, so the model is the same however rows lie in
partitions.

The frequent words are found exactly: sketches of cells that add up to the same
whatever the partitions are say which words may reach a share of
``1 / 2**HEAVY_BITS`` of all training tokens, and those alone are counted.

A word is known by a 64-bit digest.

Texts are read once.  A task numbers its blocks of texts and sends, beside the
entries of their words, a row for each block with what scoring needs of the
frequent words; both are written to the shared folder, so "text 7 of block 12"
means the same ever after, and sums of the shards come back to the blocks as
whole numbers of 10**-9.

Edge cases: null and empty texts are the end token alone; without training
texts all probability is the unknown word's; very long texts are scored whole;
rows alike score alike; a null doc_id counts as the id ''.  Other columns are
carried in ``row``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C
from corpusloom.llm import exchange as X

#: Context 0 is the end token, then the frequent words by rank, then hashed classes.
CONTEXTS, HEADS = 4096, 2047
#: Frequent words, by rank, whose counts as dishes stand in one table; dish 0 is the end token.
DISHES = 511
#: Sweeps before the totals of all shards are taken again, and sweeps that are averaged.
BURN_IN, SAMPLES = 3, 4
#: Strength of the contexts, strength and discount of the parent.
STRENGTH, PARENT_STRENGTH, PARENT_DISCOUNT = 1.0, 1.0, 0.5
#: Customers of a dish up to which its tables are drawn from their exact distribution.
EXACT = 32
#: Words to a flush of a block, and bytes of text for a shard of words or of texts.
FLUSH, WORD_BYTES, TEXT_BYTES = 1 << 19, 24 << 20, 64 << 20
#: log2 of the cells in each row of the sketch of words, and of the share that a frequent word must reach.
CELL_BITS, HEAVY_BITS = 20, 16
_PARTS = 16


class Heads:
    """The frequent words: hashes, and their ranks from 1."""

    def __init__(self, by_rank: np.ndarray):
        order = np.argsort(by_rank)
        self.hashes, self.ranks = by_rank[order], order + 1

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word, 0 for all others."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at], 0)


class Tokens:
    """Words of a run of texts, and all tokens as (context, dish or 0, word, text)."""

    def __init__(self, texts: list[bytes], heads: Heads | None = None):
        w = C.Words([t.lower() for t in texts])
        self.hash, self.doc, self.n, self.first = w.hashes(), w.doc, w.n, w.first
        if heads is not None:
            self._tokens(heads)

    def _tokens(self, heads: Heads) -> None:
        rank = heads.rank(self.hash)
        hashed = (C.mix(self.hash.copy(), 7) % np.uint64(CONTEXTS - 1 - HEADS)).astype(np.int64) + 1 + HEADS
        context = np.where(rank > 0, rank, hashed)
        before = np.zeros_like(context)
        before[1:] = context[:-1]
        some = self.n > 0
        before[self.first[:-1][some]] = 0
        last = np.zeros(len(self.n), np.int64)
        last[some] = context[self.first[1:][some] - 1]
        #: Frequent dishes and end tokens: context, dish, text.
        own = (rank > 0) & (rank <= DISHES)
        self.head = np.concatenate([before[own], last]), np.concatenate([rank[own], np.zeros(len(self.n), np.int64)]), np.concatenate([self.doc[own], np.arange(len(self.n))])
        #: All other words: context, hash, text.
        self.tail = before[~own], self.hash[~own], self.doc[~own]


# --- frequent words -------------------------------------------------------


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [(C.mix(h.copy(), row + 51) >> np.uint64(64 - CELL_BITS)).astype(np.int64) for row in range(2)]


def _runs_of(batch: pa.RecordBatch, texts: list[bytes]) -> np.ndarray:
    """Hashes of the words of training texts."""
    t = Tokens(texts)
    return t.hash[batch.column("train").to_numpy(zero_copy_only=False).astype(bool)[t.doc]]


def _gathered(it: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch, texts in C.batches_of(it):
        held.append(_runs_of(batch, texts))
        n += len(held[-1])
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _sum_parts(df: DataFrame) -> DataFrame:
    """(part, counts): vectors of equal parts added up."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in it:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if part != now and now is not None:
                    yield _part(now, total)
                    total = None
                now, x = part, X.unpack(counts, "i8")
                total = x.copy() if total is None else total + x
        if now is not None:
            yield _part(now, total)

    return df.repartition("part").sortWithinPartitions("part").mapInArrow(C.lean(run), "part int, counts binary")


def _part(number: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "counts": pa.array([X.pack(counts.astype(np.int64))], pa.binary())})


def frequent(texts: DataFrame) -> Heads:
    """The most frequent words of training texts, ties by hash: exact, and the same for any partitioning."""

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << CELL_BITS), np.int64)
        for h in _gathered(it):
            for row, cell in enumerate(_cells(h)):
                counts[row] += np.bincount(cell, minlength=1 << CELL_BITS)
        for number, part in enumerate(np.split(counts.ravel(), _PARTS)):
            yield _part(number, part)

    merged = C.stage(_sum_parts(texts.mapInArrow(C.lean(sketch), "part int, counts binary")), "lm-cells")

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = [int(X.unpack(x, "i8").sum()) if part < _PARTS // 2 else 0 for part, x in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64())})

    tokens = merged.mapInArrow(total, "n bigint").agg(F.sum("n")).head()[0] or 0
    least = max(1, tokens >> HEAVY_BITS)

    def heavy_cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bits = [np.packbits(X.unpack(x, "i8") >= least).tobytes() for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "bits": pa.array(bits, pa.binary())})

    rows = sorted((r["part"], bytes(r["bits"])) for r in merged.mapInArrow(heavy_cells, "part int, bits binary").collect())  # one bit a cell
    cells = np.unpackbits(np.frombuffer(b"".join(b for _, b in rows), np.uint8)).reshape(2, -1) == 1 if rows else np.zeros((2, 1 << CELL_BITS), bool)
    heavy = texts.sparkSession.sparkContext.broadcast(cells)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for h in _gathered(it):
            a, b = _cells(h)
            found, n = np.unique(h[heavy.value[0][a] & heavy.value[1][b]], return_counts=True)
            words, at = np.unique(np.concatenate([words, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(words)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"hash": pa.array(words.view(np.int64)), "n": pa.array(counts, pa.int64())})

    found = texts.mapInArrow(C.lean(count), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = found.orderBy(F.desc("n"), "hash").limit(HEADS).collect()
    return Heads(np.array([r["hash"] for r in top], np.int64).view(np.uint64))


# --- sampling -------------------------------------------------------------


def stirling(discount: float, top: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t)."""
    out = np.full((top + 1, top + 1), -np.inf)
    out[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, top):
            t = np.arange(1, c + 2)
            out[c + 1, t] = np.logaddexp(out[c, t - 1], out[c, t] + np.log(np.maximum(c - discount * t, 0)))
    return out


def tables(count: np.ndarray, strength: np.ndarray, base: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish given all others.

    ``strength`` is that of the restaurant with the tables of all other dishes,
    ``base`` the parent's probability of the dish, ``key`` the dish's own number
    for draws.
    """
    out = np.minimum(count, 1).astype(np.int64)
    draw = C.unit(C.mix(key.copy(), 1000 + sweep))
    numbers = stirling(discount)
    order = np.argsort(np.minimum(count, EXACT + 1).astype(np.uint8), kind="stable")
    ends = np.searchsorted(count[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        for at in np.array_split(order[ends[c - 2] : ends[c - 1]], max(1, (ends[c - 1] - ends[c - 2]) * c >> 20)):
            if len(at):
                j = np.arange(c)
                weight = np.cumsum(np.log(strength[at, None] + discount * j) + np.log(base[at, None]), axis=1) + numbers[c, 1 : c + 1]
                weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                out[at] = 1 + (weight < draw[at, None] * weight[:, -1:]).sum(axis=1)
    at = order[ends[-1] :]
    out[at] = _seated(count[at], strength[at], base[at], discount, key[at], sweep)
    return out


def _seated(count: np.ndarray, strength: np.ndarray, base: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables after seating customers of each dish one after another, beyond 32 an eighth of them at a time."""
    tables_ = np.minimum(count, 1).astype(np.float64)
    live, k = np.flatnonzero(count > 1), 1
    while len(live):
        step = 1 if k < 32 else k // 8
        n = np.minimum(step, count[live] - k)
        t = tables_[live]
        new = (strength[live] + discount * t) * base[live]
        p = np.clip(new / (new + k + (n - 1) / 2 - discount * t), 0, 1)
        u = C.unit(C.mix(key[live].copy(), 100_000 * (sweep + 1) + 2 * k))
        if step == 1:
            t = t + (u < p)
        else:
            v = C.unit(C.mix(key[live].copy(), 100_000 * (sweep + 1) + 2 * k + 1))
            normal = np.sqrt(-2 * np.log(np.maximum(u, 1e-300))) * np.cos(2 * np.pi * v)
            t = t + np.clip(np.rint(n * p + normal * np.sqrt(n * p * (1 - p))), 0, n)
        tables_[live] = t
        k += step
        live = live[count[live] > k]
    return tables_.astype(np.int64)


class Totals:
    """What all shards share: customers and tables of the contexts, and sums of the parent."""

    #: After the two vectors: pairs once and twice, parent's customers and tables, known words.
    SCALARS = 5

    def __init__(self, vector: np.ndarray, discount: float | None = None, samples: int = 1):
        mean = vector / samples
        self.customers, self.tables = mean[:CONTEXTS], mean[CONTEXTS : 2 * CONTEXTS]
        once, twice, self.parent_customers, self.parent_tables, self.words = mean[2 * CONTEXTS :].tolist()
        self.discount = discount or float(np.clip(once / (once + 2 * twice), 0.1, 0.9) if once else 0.5)

    def new(self) -> float:
        """Mass that the parent's base gives each word."""
        return (PARENT_STRENGTH + PARENT_DISCOUNT * self.parent_tables) / (self.words + 1)

    def probability(self, served: np.ndarray) -> np.ndarray:
        """The parent's probability of words with these discounted customers; 0 for those of an unknown word."""
        return (served + self.new()) / (PARENT_STRENGTH + self.parent_customers)

    def log(self, own: np.ndarray, context: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """log10 of the probability of words in their contexts, with these discounted customers of their own."""
        back = (STRENGTH + self.discount * self.tables)[context]
        return np.log10((own + back * probability) / (STRENGTH + self.customers)[context])


class Pairs:
    """Some words with all their contexts: counts, and the seating as it is sampled."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, names: np.ndarray):
        #: Only pairs that have customers; ``word`` is a place in ``names``.
        self.word, self.context, self.count, self.names = word, context, count, names
        self.key = C.mix(names[word] + context.astype(np.uint64), 61)
        self.tables = np.ones(len(word), np.int64)
        self.parent = np.minimum(self._served(), 1)

    def _served(self) -> np.ndarray:
        """Customers of each word in the parent: its tables in the contexts."""
        return np.bincount(self.word, self.tables, len(self.names)).astype(np.int64)

    def vector(self, tables_: np.ndarray | None = None, served: np.ndarray | None = None, parent: np.ndarray | None = None, samples: int = 1) -> np.ndarray:
        """This part's share of the totals, now or of sums over some samples."""
        tables_ = self.tables if tables_ is None else tables_
        served, parent = self._served() if served is None else served, self.parent if parent is None else parent
        out = np.zeros(2 * CONTEXTS + Totals.SCALARS, np.int64)
        out[:CONTEXTS] = np.bincount(self.context, self.count, CONTEXTS) * samples
        out[CONTEXTS : 2 * CONTEXTS] = np.bincount(self.context, tables_, CONTEXTS)
        out[2 * CONTEXTS :] = (self.count == 1).sum() * samples, (self.count == 2).sum() * samples, served.sum(), parent.sum(), (served > 0).sum() * samples
        return out

    def sweeps(self, total: Totals, number: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Reseat all dishes ``number`` times; gives the sums of tables, served customers and parent's tables."""
        at_first = self.vector()
        sums = [np.zeros(len(self.word), np.int64), np.zeros(len(self.names), np.int64), np.zeros(len(self.names), np.int64)]
        for sweep in range(first, first + number):
            change = self.vector() - at_first
            served = self._served()
            customers, parent_tables = total.parent_customers + change[-3], total.parent_tables + change[-2]
            base = (served - PARENT_DISCOUNT * self.parent + (PARENT_STRENGTH + PARENT_DISCOUNT * parent_tables) / (total.words + 1)) / (PARENT_STRENGTH + customers)
            others = (total.tables + change[CONTEXTS : 2 * CONTEXTS])[self.context] - self.tables
            self.tables = tables(self.count, STRENGTH + total.discount * others, base[self.word], total.discount, self.key, sweep)
            served = self._served()
            some = served > 0
            others = PARENT_STRENGTH + PARENT_DISCOUNT * (parent_tables - self.parent[some])
            self.parent = np.zeros(len(served), np.int64)
            self.parent[some] = tables(served[some], others, np.full(int(some.sum()), 1 / (total.words + 1)), PARENT_DISCOUNT, C.mix(self.names[some].copy(), 62), sweep)
            for x, more in zip(sums, (self.tables, served, self.parent), strict=True):
                x += more
        return tuple(sums)

    def sampled(self, first: Totals, second: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over the samples, after the burn-in."""
        self.sweeps(first, BURN_IN, 0)
        return self.sweeps(second, SAMPLES, BURN_IN)

    def own(self, sums: tuple, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean discounted customers of each pair, and of each word in the parent."""
        return self.count - discount * sums[0] / SAMPLES, (sums[1] - PARENT_DISCOUNT * sums[2]) / SAMPLES


# --- counting -------------------------------------------------------------

_SHARD = ["names", "counts", "word", "context", "count", "block", "doc", "pair", "times"]
_BLOCK = ["train", "tokens", "head_context", "head_dish", "head_text"]
_DONE = "part int, counts binary"


def _words_to(shards: int):
    return lambda c: (C.mix(c[0].copy(), 8) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


#: Blocks that a partition may have (about 12 GB of text); sums travel as whole numbers of this size.
_SEQUENCE, _UNIT = 1 << 12, 1e-9


def _count(heads_, words: X.Exchange, targets: int):
    """Entries of all words but the frequent ones (by shard); below bucket 0 parts of the table of those, and blocks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = heads_.value
        counts = np.zeros(CONTEXTS * (DISHES + 1), np.int64)
        tail, head, rows, n, docs = [], [], [], 0, 0
        number, schema = TaskContext.get().partitionId() * _SEQUENCE, None

        def flush() -> Iterator[pa.RecordBatch]:
            context, word, doc = (np.concatenate(x) for x in zip(*tail, strict=True))
            train = np.concatenate([r[1] for r in rows])
            names, at = np.unique(word, return_inverse=True)
            key, times = np.unique(at.astype(np.uint64) << np.uint64(36) | context.astype(np.uint64) << np.uint64(24) | doc.astype(np.uint64), return_counts=True)
            doc = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
            place = doc * 2 + train[doc]
            yield X.with_nulls(words.cut([names[(key >> np.uint64(36)).astype(np.int64)], key >> np.uint64(24) & np.uint64(CONTEXTS - 1), np.full(len(key), number), place, times]), schema)
            context, dish, doc = (np.concatenate(x) for x in zip(*head, strict=True))
            order = np.lexsort((dish, context, doc))
            blobs = [X.pack(train.astype(np.uint8)), X.pack(np.concatenate([r[2] for r in rows])), X.pack(context[order].astype(np.uint16)), X.pack(dish[order].astype(np.uint16)), _differences(doc[order])]
            carried = pa.concat_arrays([r[0] for r in rows])
            lists = pa.ListArray.from_arrays(pa.array([0, len(carried)], pa.int32()), carried)
            own = {"bucket": pa.array([-1 - _PARTS - number], pa.int32()), "n": pa.array([number], pa.int32()), "cols": pa.array([blobs], pa.list_(pa.binary())), "rows": lists, "target": pa.array([number * 2654435761 % (1 << 32) % targets], pa.int32())}
            yield pa.RecordBatch.from_arrays([own[f.name] for f in schema], [f.name for f in schema])

        for batch, texts in C.batches_of(it):
            schema = schema or pa.schema([*X.ARROW, ("rows", pa.list_(batch.schema.field("row").type)), ("target", pa.int32())])
            t = Tokens(texts, heads)
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            context, dish, doc = t.head
            counts += np.bincount(context[train[doc]] * (DISHES + 1) + dish[train[doc]], minlength=len(counts))
            head.append((context, dish, doc + docs))
            context, word, doc = t.tail
            tail.append((context, word, doc + docs))
            rows.append((batch.column("row"), train, t.n + 1))
            n, docs = n + len(word), docs + len(texts)
            if n >= FLUSH or docs >= 1 << 20:
                yield from flush()
                tail, head, rows, n, docs, number = [], [], [], 0, 0, number + 1
                if number % _SEQUENCE == 0 or number >= 1 << 31:
                    raise ValueError("too much text in one partition, or too many partitions: blocks cannot be numbered")
        if rows:
            yield from flush()
        for part, some in enumerate(np.split(counts, _PARTS)):
            if some.any():
                yield X.with_nulls(pa.RecordBatch.from_arrays([pa.array([-1 - part], pa.int32()), pa.array([0], pa.int32()), pa.array([[X.pack(some)]], pa.list_(pa.binary()))], schema=X.ARROW), schema)

    return run


def _differences(x: np.ndarray) -> bytes:
    return X.pack(np.diff(x.astype(np.uint32), prepend=np.uint32(0)))


def _shard(words: X.Exchange):
    """One row for a shard of words (its words, pairs and entries, sorted), for a part of the table, or for a block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, out = key[0].as_py(), {}
        if bucket < -_PARTS:
            out = dict(zip(_BLOCK, table.column("cols")[0].as_py(), strict=True)) | {"number": table.column("n")[0].as_py(), "target": table.column("target")[0].as_py()}
        elif bucket < 0:
            out = {"part": -1 - bucket, "counts": X.pack(sum(X.unpack(x[0], "i8") for x in table.column("cols").to_pylist()))}
        else:
            name, context, block, place, times = words.gather(table)
            names, word = np.unique(name, return_inverse=True)
            keys, pair = np.unique(word.astype(np.uint64) << np.uint64(12) | context.astype(np.uint64), return_inverse=True)
            count = np.bincount(pair, times * (place & 1), len(keys)).astype(np.int64)
            word = (keys >> np.uint64(12)).astype(np.int64)
            order = np.argsort(block.astype(np.uint64) << np.uint64(32) | place)
            cols = [X.pack(names), X.pack(np.bincount(word, count, len(names)).astype(np.int64)), _differences(word), X.pack((keys & np.uint64(CONTEXTS - 1)).astype(np.uint16)), X.pack(count.astype(np.uint32)), _differences(block[order]), _differences(place[order] >> 1), X.pack(pair[order].astype(np.uint32)), X.pack(times[order].astype(np.uint32))]
            out = dict(zip(_SHARD, cols, strict=True))
        kinds = {"part": pa.int32(), "number": pa.int32(), "target": pa.int32()}
        cols = {c: pa.array([out.get(c)], kinds.get(c, pa.binary())) for c in ("part", "number", "target", *_SHARD, *_BLOCK)}
        rows = table.column("rows").combine_chunks() if bucket < -_PARTS else pa.nulls(1, table.schema.field("rows").type)
        return pa.table(cols | {"rows": rows})

    return run


def _rising(blob: bytes) -> np.ndarray:
    return np.cumsum(X.unpack(blob, "u4"), dtype=np.uint32).astype(np.int64)


def _read_pairs(r: dict) -> tuple[Pairs, np.ndarray]:
    """Pairs of a shard that have customers, and whether each pair has."""
    names, count = X.unpack(r["names"], "u8"), X.unpack(r["count"], "u4").astype(np.int64)
    word, context = _rising(r["word"]), X.unpack(r["context"], "u2").astype(np.int64)
    some = count > 0
    return Pairs(word[some], context[some], count[some], names), some


def _vectors(shards: DataFrame, *totals: Totals) -> np.ndarray:
    """Sum of the vectors of all shards: at first, after the burn-in, or over the samples."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                pairs, _ = _read_pairs(r)
                yield _part(int(pairs.names[0] % np.uint64(_PARTS)) if len(pairs.names) else 0, _vector(pairs, *totals))

    parts = shards.select("names", "word", "context", "count").mapInArrow(C.lean(run), _DONE)
    total = np.zeros(2 * CONTEXTS + Totals.SCALARS, np.int64)
    for r in _sum_parts(parts).toLocalIterator():  # at most _PARTS vectors
        total += X.unpack(bytes(r["counts"]), "i8")
    return total


def _vector(pairs: Pairs, first: Totals | None = None, second: Totals | None = None) -> np.ndarray:
    if second is not None:
        return pairs.vector(*pairs.sampled(first, second), SAMPLES)
    if first is not None:
        pairs.sweeps(first, BURN_IN, 0)
    return pairs.vector()


def _sums(first: Totals, second: Totals, final: Totals, texts: X.Exchange):
    """Sums of the words of a shard by text, on their way to the shards of texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                pairs, some = _read_pairs(r)
                extra, served = pairs.own(pairs.sampled(first, second), final.discount)
                own = np.zeros(len(some))
                own[some] = extra
                word, context = _rising(r["word"]), X.unpack(r["context"], "u2").astype(np.int64)
                log = final.log(own, context, final.probability(served)[word])
                counts = X.unpack(r["counts"], "i8")
                base, known = np.log10(counts + 1.0)[word], (counts > 0)[word]
                block, doc, pair, times = _rising(r["block"]), _rising(r["doc"]), X.unpack(r["pair"], "u4"), X.unpack(r["times"], "u4")
                new = np.ones(len(doc), bool)
                new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
                first_ = np.flatnonzero(new)
                add = lambda x: np.add.reduceat(times * x[pair], first_) if len(first_) else np.empty(0)  # noqa: B023, E731
                yield texts.cut([block[first_], doc[first_], np.rint(add(base) / _UNIT), np.rint(add(log) / _UNIT), add(known)])

    return run


_LOCAL: dict[str, dict] = {}


def _score(model, texts: X.Exchange, row: T.StructField):
    """All texts of some blocks: their frequent words and end tokens, and the sums of all other words."""
    key = uuid.uuid4().hex

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if key not in _LOCAL:
            _LOCAL.clear()
            _LOCAL[key] = model.value
        m, out = _LOCAL[key], []
        block, doc, *sums = texts.gather(right)
        order = np.argsort(block, kind="stable")
        block, doc, sums = block[order], doc[order], [x[order] for x in sums]
        for at in range(left.num_rows):
            r = {c: left.column(c)[at].as_py() for c in ("number", *_BLOCK)}
            train, tokens = X.unpack(r["train"], "u1") == 1, X.unpack(r["tokens"], "i8")
            context, dish, text = X.unpack(r["head_context"], "u2"), X.unpack(r["head_dish"], "u2"), _rising(r["head_text"])
            lo, hi = np.searchsorted(block, r["number"], "left"), np.searchsorted(block, r["number"], "right")
            total = []
            for own, more, unit in ((m["base"][dish], sums[0], _UNIT), (m["log"][context, dish], sums[1], _UNIT), (m["known"][dish], sums[2], 1)):
                total.append(np.bincount(text, own, len(tokens)) + np.bincount(doc[lo:hi], more[lo:hi], len(tokens)) * unit)
            rows = left.column("rows").slice(at, 1).combine_chunks().flatten()
            out.append(pa.RecordBatch.from_arrays([rows, pa.array(train), pa.array(tokens), *map(pa.array, total)], _SCORED))
        return pa.Table.from_batches(out)

    return run, T.StructType([row, *T._parse_datatype_string("train boolean, n_tokens bigint, base double, score double, known double").fields])


_SCORED = ["row", "train", "n_tokens", "base", "score", "known"]


def score(docs: DataFrame, *, train: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    ``train`` says which rows the model learns from.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    cols = docs.columns if carry is None else carry
    df = docs.select(F.struct(*[F.col(C.sql_name(c)) for c in cols]).alias("row"), F.coalesce(train, F.lit(False)).alias("train"), F.col(C.sql_name(text)).cast("string").alias("text"))
    size = df.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    heads = frequent(df.select("train", "text"))
    shards, targets = max(1, -(-size // WORD_BYTES)), max(1, -(-size // TEXT_BYTES))
    words = X.Exchange(["+u8", "u2", "u4", "u4", "u4"], shards, _words_to(shards))
    rows = T.StructField("rows", T.ArrayType(df.schema["row"].dataType))
    sent = T.StructType([*T._parse_datatype_string(X.ROWS).fields, rows, T.StructField("target", T.IntegerType())])
    kept = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("part", "number", "target")], *[T.StructField(c, T.BinaryType()) for c in (*_SHARD, *_BLOCK)], rows])
    counted = df.mapInArrow(C.lean(_count(spark.sparkContext.broadcast(heads), words, targets)), sent)
    counted = C.stage(words.deliver(counted).groupBy("bucket").applyInArrow(_shard(words), kept), "lm-shards")
    entries, counts = counted.where("names IS NOT NULL").select(*_SHARD), np.zeros((_PARTS, CONTEXTS * (DISHES + 1) // _PARTS), np.int64)
    for r in counted.where("part IS NOT NULL").select("part", "counts").toLocalIterator():  # a table of fixed size
        counts[r["part"]] = X.unpack(bytes(r["counts"]), "i8")
    counts = counts.reshape(CONTEXTS, DISHES + 1)
    # Totals at first, after the burn-in, and over the samples.
    first = Totals(_vectors(entries) + _vector(_table_pairs(counts)))
    second = Totals(_vectors(entries, first) + _vector(_table_pairs(counts), first), first.discount)
    final = Totals(_vectors(entries, first, second) + _vector(_table_pairs(counts), first, second), first.discount, SAMPLES)
    pairs, own = _table_pairs(counts), np.zeros(counts.shape)
    extra, served = pairs.own(pairs.sampled(first, second), final.discount)
    own[pairs.context, pairs.word] = extra
    log = final.log(own, np.arange(CONTEXTS)[:, None], final.probability(served)[None, :])
    of, n, distinct = counts.sum(axis=0), int(first.customers.sum()), int(first.words)
    model = spark.sparkContext.broadcast({"log": log, "base": np.log10(of + 1.0), "known": (of > 0).astype(float)})
    # The target of a number is that of its block's row.
    texts = X.Exchange(["u4", "u4", "i8", "i8", "u4"], targets, lambda c: c[0].astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) % np.uint64(targets))
    sums = texts.deliver(entries.mapInArrow(C.lean(_sums(first, second, final, texts)), X.ROWS))
    run, schema = _score(model, texts, df.schema["row"])
    blocks = counted.where("number IS NOT NULL").select(F.col("target").alias("bucket"), "number", *_BLOCK, "rows")
    out = blocks.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(run, schema)
    out = out.select("row", "train", "n_tokens", F.round("known").cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * float(np.log10(n + distinct + 1))).alias("base_score"), "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _table_pairs(counts: np.ndarray) -> Pairs:
    context, dish = np.nonzero(counts)
    return Pairs(dish, context, counts[context, dish], np.arange(counts.shape[1], dtype=np.uint64))


def held_out(doc_id: str = "doc_id") -> Column:
    return C.crc_mod(doc_id, 7) == 2


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), train=~held_out(), carry=["doc_id"])
    return out.select("row.doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
