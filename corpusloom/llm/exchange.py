"""Exchange of packed columns between groups of texts and shards.

Per-window and per-word work happens in numpy, so what travels between tasks
are rows of packed columns: ``bucket``, ``n`` (entries) and ``cols``, one
compressed buffer per column.  Each entry belongs to a target in ``[0, targets)``.

A task never writes a row per target.  It cuts its entries into at most
``FAN`` buckets, ranges of targets; where there are more targets, tasks that
read some buckets gather the entries of many senders and cut them into
``FAN`` finer ranges, until a bucket is one target.  Rows therefore grow with
the entries (times the logarithm of the targets), not with senders times
targets.

Texts themselves are dealt once into groups (:class:`Groups`), so what a shard
sends back to "entry 7 of group 12" means the same however often a lost task is
run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: Buckets that a row set is cut into at one level.
FAN = 512
#: Entries a task gathers before it cuts them again.
GATHER = 1 << 20
#: Text in a group, and text that one task holds of several groups.
GROUP_BYTES, TASK_BYTES = 4 << 20, 32 << 20
ROWS = "bucket int, n int, cols array<binary>"
ARROW = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("cols", pa.list_(pa.binary()))])


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes, equal places of all values side by side."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


class Exchange:
    """Rows of packed columns on their way to ``targets``.

    ``kinds`` are numpy types of the columns; one that begins with ``+`` rises
    within a sender and is stored as differences.  One that begins with ``@``
    is a pair (table, places in it), of which a row holds the part it names;
    tables of several senders are put one behind the other.  ``target`` gives
    the target of each entry from the columns.
    """

    def __init__(self, kinds: list[str], targets: int, target: Callable[[list[np.ndarray]], np.ndarray], fan: int | None = None):
        self.rising = [k.startswith("+") for k in kinds]
        self.named = [k.startswith("@") for k in kinds]
        self.kinds, self.targets, self.target, self.fan = [k.lstrip("+@") for k in kinds], targets, target, fan or FAN
        self.width = 1
        while -(-targets // self.width) > self.fan:
            self.width *= self.fan

    def _encode(self, col, part: np.ndarray, at: int) -> list[bytes]:
        if self.named[at]:
            used, place = np.unique(col[1][part], return_inverse=True)
            return [pack(col[0][used]), pack(np.diff(place.astype(np.uint32), prepend=np.uint32(0)))]
        col = col[part]
        return [pack(np.diff(col, prepend=col.dtype.type(0)) if self.rising[at] else col)]

    def decode(self, blobs: list[bytes]) -> list:
        blobs, out = iter(blobs), []
        for kind, up, named in zip(self.kinds, self.rising, self.named, strict=True):
            col = unpack(next(blobs), kind)
            if named:
                col = (col, np.cumsum(unpack(next(blobs), "u4"), dtype=np.uint32))
            out.append(np.cumsum(col, dtype=col.dtype) if up else col)
        return out

    def cut(self, cols: list, width: int | None = None) -> pa.RecordBatch:
        """Rows of these entries, by bucket; entries of a bucket stay in their order."""
        cols = [c if named else np.asarray(c, k) for c, k, named in zip(cols, self.kinds, self.named, strict=True)]
        bucket = self.target(cols).astype(np.int64) // (width or self.width)
        rows = []
        if len(bucket):
            low = int(bucket.min())
            order = np.argsort((bucket - low).astype(np.uint16) if int(bucket.max()) - low < 1 << 16 else bucket, kind="stable")
            names, at = np.unique(bucket[order], return_index=True)
            for name, part in zip(names.tolist(), np.split(order, at[1:]), strict=True):
                rows.append((name, len(part), [blob for i, c in enumerate(cols) for blob in self._encode(c, part, i)]))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else ([], [], []), ARROW, strict=True)], schema=ARROW)

    def gather(self, table: pa.Table | pa.RecordBatch) -> list:
        """The entries of all rows, one sender's after the other's."""
        parts = [self.decode(x) for x in table.column("cols").to_pylist()]
        out = []
        for at, (kind, named) in enumerate(zip(self.kinds, self.named, strict=True)):
            if named:
                base = np.cumsum([0, *(len(p[at][0]) for p in parts)])
                places = [p[at][1].astype(np.int64) + b for p, b in zip(parts, base, strict=False)]
                out.append((np.concatenate([np.empty(0, kind), *(p[at][0] for p in parts)]), np.concatenate([np.empty(0, np.int64), *places])))
            else:
                out.append(np.concatenate([np.empty(0, kind), *(p[at] for p in parts)]))
        return out

    def deliver(self, rows: DataFrame) -> DataFrame:
        """``rows`` cut until a bucket is one target; rows of buckets below 0 are only carried, with all their columns."""
        width = self.width
        while width > 1:
            width //= self.fan
            mixed = rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.targets // (8 * width)), "bucket", F.pmod(F.xxhash64(F.col("cols")[0]), F.lit(8)))
            rows = mixed.sortWithinPartitions("bucket").mapInArrow(C.lean(self._again(width)), rows.schema)
        return rows

    def _again(self, width: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, schema = [], 0, None
            for batch in it:
                schema = batch.schema
                for at in range(batch.num_rows):
                    if batch.column("bucket")[at].as_py() < 0:
                        yield batch.slice(at, 1)
                        continue
                    held.append(batch.slice(at, 1))
                    n += batch.column("n")[at].as_py()
                    if n >= GATHER:
                        yield with_nulls(self.cut(self.gather(pa.Table.from_batches(held)), width), schema)
                        held, n = [], 0
            if held:
                yield with_nulls(self.cut(self.gather(pa.Table.from_batches(held)), width), schema)

        return run


def with_nulls(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """``batch`` with the columns of ``schema``, null where it has none."""
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in schema], [f.name for f in schema])


class Groups:
    """Texts in groups of about ``size`` bytes, read by several steps of one plan.

    ``docs`` has ``row`` and ``text``; rows fall into groups by a hash of
    ``keys``.  All steps read one shuffle: the same exchange occurs in the plan
    several times and is reused.  Within a group texts are sorted, so "entry 7
    of group 12" means the same however often a lost task is run again.
    """

    def __init__(self, docs: DataFrame, keys: list, size: int | None = None):
        size = size or GROUP_BYTES
        total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
        self.size, self.number = total, max(1, -(-total // size))
        tasks = max(1, min(self.number, max(-(-total // TASK_BYTES), docs.sparkSession.sparkContext.defaultParallelism)))
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.number)).cast("int").alias("bucket")
        self.rows = docs.select(bucket, "row", "text").repartition(tasks, "bucket")

    @staticmethod
    def sorted(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
        texts = C.byte_list(table.column("text"))
        order = sorted(range(len(texts)), key=texts.__getitem__)
        return table.take(pa.array(order, pa.int64())), [texts[i] for i in order]

    def each(self, work: Callable[[int, list[bytes]], pa.RecordBatch], schema: str) -> DataFrame:
        """``work(group, texts)`` of all groups."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([work(key[0].as_py(), Groups.sorted(table)[1])])

        return self.rows.groupBy("bucket").applyInArrow(run, schema)

    def answers(self, kinds: list[str], fan: int | None = None) -> Exchange:
        """An exchange back to the groups; its first column is the group."""
        return Exchange(["u4", *kinds], self.number, lambda c: c[0], fan)

    def meet(self, answers: Exchange, rows: DataFrame, work: Callable, schema) -> DataFrame:
        """``work(group, table, texts, answers)`` of all groups, with the columns of the entries sent to them."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            table, texts = Groups.sorted(left)
            return pa.Table.from_batches([work(key[0].as_py(), table, texts, answers.gather(right)[1:])])

        return self.rows.groupBy("bucket").cogroup(answers.deliver(rows).groupBy("bucket")).applyInArrow(run, schema)


def slices(texts: list[bytes], size: int = C.CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``size`` bytes together, one at least."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= size):
            n += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end
