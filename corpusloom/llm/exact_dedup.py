"""Exact dedup: static binary-fuse filters per immutable snapshot.

Texts are equal when they are identical after every run of ASCII white space
became one space; a 256-bit digest of that form names the text.

* A batch is first grouped on its own by digest (hash aggregate with map-side
  combine, so a text that a third of all rows repeat leaves each task once).
* :class:`Snapshot` is an immutable table of digests in exact buckets, with one
  binary-fuse filter per bucket; the snapshot's documents stay the owners of
  the bytes.
* :func:`screen` meets the digests of a new batch with the filter of their
  bucket.  Negatives are certainly new; positives join the exact bucket.
* Only texts whose digest occurs twice, in the batch or across the snapshot,
  are read again and grouped by the text itself: the byte check.  Those rows
  are picked by a fuse filter of the wanted digests, broadcast while it is
  proven to be small (``BROADCAST_KEYS``), by a shuffled join beyond.

Bucket count follows the snapshot's size, so a filter stays near half a
megabyte however large the corpus is.

:class:`Store` keeps snapshots between runs: a folder of immutable ones, each
with its texts, to which :func:`dedup_batch` adds what a batch has anew.  A
snapshot counts only once its mark is written, last; what a run that failed
left behind is not read.

Edge cases: null text counts as empty; empty texts are equal to each other; a
null doc_id loses against any other id and stays only if its whole group has
none (keep_id is then null); a repeated doc_id counts as often as it occurs.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: Digests per bucket, and so per filter.
BUCKET_KEYS = 500_000
#: Digests whose filters (about 1.2 bytes each) may be broadcast together.
BROADCAST_KEYS = 16_000_000


class BinaryFuse:
    """Static 3-wise binary fuse filter with 8-bit fingerprints.

    Built by peeling: every key owns three cells in consecutive segments, and
    the XOR of the cells is the key's fingerprint.  No false negatives; a
    foreign key passes once in 256.
    """

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _place(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = C.mix(keys.copy(), seed)
        base = ((h >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64) * segment
        at = np.empty((3, len(keys)), np.int64)
        for i in range(3):
            at[i] = base + i * segment + (C.mix(h, i + 1) & np.uint64(segment - 1)).astype(np.int64)
        return at, (C.mix(h, 9) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        count = max(1, -(-int(n * factor) // segment) - 2 + 1)
        for seed in range(1, 200):
            order = cls._peel(*cls._place(keys, seed, segment, count), (count + 2) * segment)
            if order is not None:
                return cls(seed, segment, count, order)
            if seed % 20 == 0:
                count = count * 5 // 4 + 1
        raise RuntimeError("no binary fuse filter found")

    @staticmethod
    def _peel(at: np.ndarray, prints: np.ndarray, size: int) -> np.ndarray | None:
        n = at.shape[1]
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # XOR of the keys in a cell
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        alive, layers = np.ones(n, bool), []
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            ready = ready[degree[ready] == 1]
            keys, first = np.unique(owner[ready], return_index=True)
            if not len(keys):
                break
            layers.append((keys, ready[first]))
            alive[keys] = False
            cells = at[:, keys]
            for row in cells:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(owner, row, keys)
            ready = np.unique(cells.ravel())
        if alive.any():
            return None
        out = np.zeros(size, np.uint8)
        for keys, cell in reversed(layers):
            a, b, c = at[:, keys]
            out[cell] = 0
            out[cell] = prints[keys] ^ out[a] ^ out[b] ^ out[c]
        return out

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._place(keys.astype(np.uint64), self.seed, self.segment, self.count)
        return (self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], "<i8").tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> BinaryFuse:
        seed, segment, count = np.frombuffer(blob[:24], "<i8").tolist()
        return cls(seed, segment, count, np.frombuffer(blob, np.uint8, offset=24))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def strong_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _key(digest: str = "digest") -> Column:
    return F.xxhash64(digest)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest", F.lit(7)), F.lit(buckets)).cast("int").alias("bucket")


def _keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(np.int64).view(np.uint64)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    blob = BinaryFuse.build(_keys(table.column("key"))).to_bytes()
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([blob], pa.binary())})


def groups(ids: DataFrame) -> DataFrame:
    """Digest groups of one batch: smallest id and row count."""
    return ids.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


class Snapshot:
    """Immutable digest groups in exact buckets, one filter for each bucket."""

    def __init__(self, rows: DataFrame, filters: DataFrame, buckets: int):
        self.rows, self.filters, self.buckets = rows, filters, buckets

    @classmethod
    def write(cls, batch: DataFrame, name: str = "exact-snapshot", bucket_keys: int = BUCKET_KEYS) -> Snapshot:
        """``batch``: what :func:`groups` gives, or any table of distinct digests."""
        rows = C.stage(batch, name)
        buckets = max(1, -(-rows.count() // bucket_keys))
        rows = rows.withColumn("bucket", _bucket(buckets))
        filters = rows.select("bucket", _key().alias("key")).groupBy("bucket").applyInArrow(_build, "bucket int, filter binary")
        return cls(rows, C.stage(filters, f"{name}-filters"), buckets)


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests that the snapshot's filters let pass.

    Each bucket meets its filter in one task; only distinct digests travel.
    """

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left.select(["digest"]).slice(0, 0)
        found = BinaryFuse.from_bytes(right.column("filter")[0].as_py()).contains(_keys(left.column("key")))
        return left.select(["digest"]).filter(pa.array(found))

    keyed = digests.select("digest", _bucket(snapshot.buckets), _key().alias("key"))
    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(probe, "digest string")


def may_be_named(wanted: Snapshot) -> Column:
    """Whether the row's ``digest`` is, or may be, among ``wanted``; the filters are broadcast."""
    blobs = wanted.rows.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["filter"]) for r in wanted.filters.toLocalIterator()})

    @F.arrow_udf("boolean")
    def probe(key: pa.Array, bucket: pa.Array) -> pa.Array:
        keys, buckets = _keys(key), bucket.to_numpy(zero_copy_only=False)
        out = np.zeros(len(keys), bool)
        for b, blob in blobs.value.items():
            at = buckets == b
            if at.any():
                out[at] = BinaryFuse.from_bytes(blob).contains(keys[at])
        return pa.array(out)

    return probe(_key(), _bucket(wanted.buckets))


def _passing(rows: DataFrame, wanted: Snapshot, limit: int) -> DataFrame:
    """Rows whose digest is, or may be, among ``wanted``."""
    if wanted.buckets * BUCKET_KEYS > limit:
        return rows.join(wanted.rows.select("digest"), "digest", "left_semi")
    return rows.where(may_be_named(wanted))


def _wanted(keys: DataFrame, name: str) -> Snapshot:
    return Snapshot.write(keys.toDF("key").select(F.col("key").cast("string").alias("digest")), name)


def keep_named(rows: DataFrame, column: str, keys: DataFrame, name: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows whose ``column`` is among ``keys`` (one column, distinct): a filter first, so that only hits are shuffled."""
    wanted = _wanted(keys, name)
    near = _passing(rows.withColumn("digest", F.col(column).cast("string")), wanted, limit)
    return near.join(wanted.rows.select("digest"), "digest", "left_semi").drop("digest")


def part_named(docs: DataFrame, doc_id: str, keys: DataFrame, name: str, limit: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is among ``keys``, all other rows), each with the input's columns in ``row``.

    The others pass a filter and are not shuffled; where the filters would be
    too large to broadcast, both parts come from shuffled joins.
    """
    wanted = _wanted(keys, name)
    names = wanted.rows.select("digest")
    rows = docs.select(F.struct("*").alias("row"), F.col(C.sql_name(doc_id)).cast("string").alias("digest"))
    if wanted.buckets * BUCKET_KEYS > limit:
        return rows.join(names, "digest", "left_semi"), rows.join(names, "digest", "left_anti")
    flagged = rows.withColumn("maybe", may_be_named(wanted))
    near = flagged.where("maybe").drop("maybe")
    return near.join(names, "digest", "left_semi"), flagged.where("NOT maybe").drop("maybe").unionByName(near.join(names, "digest", "left_anti"))


def repeated(rows: DataFrame, ids: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Classes of more than one row: text_sha256, keep_id, n.

    ``rows`` has doc_id, norm, digest; ``ids`` doc_id, digest of the same rows.
    The rows fall into two batches by a hash of their id: the first becomes the
    immutable snapshot, the second is screened against it.
    """
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    snapshot = Snapshot.write(groups(ids.where(first)))
    batch = C.stage(groups(ids.where(~first)), "exact-batch")
    positive = snapshot.rows.join(screen(batch, snapshot), "digest", "left_semi")  # exact bucket
    wanted = positive.select("digest").unionByName(snapshot.rows.where("n > 1").select("digest")).unionByName(batch.where("n > 1").select("digest")).distinct()
    wanted = Snapshot.write(wanted, "exact-wanted")
    texts = _passing(rows, wanted, limit)
    checked = texts.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return C.stage(checked.where("n > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "n"), "exact-classes")


class Store:
    """Snapshots of earlier runs in a folder that all executors share.

    Every snapshot is a folder of its own: ``rows`` (digest, norm, keep_id, n:
    its distinct texts and who owns them), ``filters`` and, written last, a mark
    with its number of buckets.
    """

    MARK = "_SNAPSHOT"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def snapshots(self) -> list[Snapshot]:
        """Complete snapshots, oldest first."""
        root = self._hadoop.Path(self.path)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory()) if self._fs.exists(root) else []
        return [self._open(f"{self.path}/{n}") for n in names if self._fs.exists(self._hadoop.Path(f"{self.path}/{n}/{self.MARK}"))]

    def _open(self, folder: str) -> Snapshot:
        mark = self._fs.open(self._hadoop.Path(f"{folder}/{self.MARK}"))
        try:
            buckets = mark.readInt()
        finally:
            mark.close()
        return Snapshot(self.spark.read.parquet(f"{folder}/rows"), self.spark.read.parquet(f"{folder}/filters"), buckets)

    def add(self, texts: DataFrame, bucket_keys: int = BUCKET_KEYS) -> Snapshot:
        """Write ``texts`` (digest, norm, keep_id, n) as the next snapshot."""
        folder = f"{self.path}/{len(self.snapshots()):08d}-{uuid.uuid4().hex[:12]}"
        texts.select("digest", "norm", "keep_id", "n").write.parquet(f"{folder}/rows")
        rows = self.spark.read.parquet(f"{folder}/rows")
        buckets = max(1, -(-rows.count() // bucket_keys))
        filters = rows.select("digest").distinct().select(_bucket(buckets), _key().alias("key")).groupBy("bucket").applyInArrow(_build, "bucket int, filter binary")
        filters.write.parquet(f"{folder}/filters")
        mark = self._fs.create(self._hadoop.Path(f"{folder}/{self.MARK}"), False)
        try:
            mark.writeInt(buckets)
        finally:
            mark.close()
        return self._open(folder)


def dedup_batch(batch: DataFrame, store: Store, *, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = strong_digest, add: bool = True) -> DataFrame:
    """Rows of a new batch against all snapshots: doc_id, keep_id, group_size, kept, text_sha256.

    A text that a snapshot owns is dropped for its owner there; other texts are
    grouped within the batch and, with ``add``, become the store's next
    snapshot.  ``group_size`` counts the rows of the batch and those that the
    owning snapshot had.
    """
    rows = _rows(batch, doc_id, text, digest)
    texts = C.stage(rows.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "exact-texts")
    owned = None
    for snapshot in store.snapshots():
        positive = screen(texts.select("digest").distinct(), snapshot)
        older = snapshot.rows.join(positive, "digest", "left_semi").select("digest", "norm", F.col("keep_id").alias("owner"), F.col("n").alias("older"))
        owned = older if owned is None else owned.unionByName(older)
    if owned is None:
        found = texts.select("*", F.lit(None).cast(texts.schema["keep_id"].dataType).alias("owner"), F.lit(None).cast("bigint").alias("older"))
    else:
        found = texts.join(owned.withColumn("owned", F.lit(True)), ["digest", "norm"], "left")
    known = F.col("older").isNotNull()
    found = C.stage(found.select("digest", "norm", "keep_id", "n", "owner", "older"), "exact-found")
    if add:
        store.add(found.where(~known))
    classes = found.select(F.sha2("norm", 256).alias("text_sha256"), F.when(known, F.col("owner")).otherwise(F.col("keep_id")).alias("keep_id"), known.alias("owned"), (F.col("n") + F.coalesce("older", F.lit(0))).alias("group_size"), "n")
    ids = C.stage(rows.select("doc_id", F.sha2("norm", 256).alias("text_sha256")), "exact-ids")
    out = C.join_by_count(ids, C.stage(classes, "exact-owners"), "text_sha256", ids.count(), "inner")
    return out.select("doc_id", "keep_id", "group_size", (~F.col("owned") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def _rows(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col(C.sql_name(doc_id)).alias("doc_id"), normalised(F.col(C.sql_name(text))).alias("norm"))
    return rows.withColumn("digest", digest(F.col("norm")))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = strong_digest, limit: int = BROADCAST_KEYS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _rows(docs, doc_id, text, digest)
    ids = C.stage(rows.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256")), "exact-ids")
    out = C.join_by_count(ids, repeated(rows, ids, limit), "text_sha256", ids.count())
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that stay, all columns: exactly one of each class."""
    rows = _rows(docs, doc_id, text, strong_digest)
    ids = C.stage(rows.select("doc_id", "digest"), "exact-ids")
    found = repeated(rows, ids)
    # Ids of rows that may go: not the class's smallest id, or the same id and text again.
    total = ids.count()
    members = C.join_by_count(ids.withColumnRenamed("digest", "text_sha256"), found, "text_sha256", total, "inner").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"), F.min("keep_id").alias("keep_id"))
    suspects = members.where("doc_id IS NOT NULL AND (rows > 1 OR doc_id <> keep_id)").select("doc_id").distinct()
    nameless = docs.where(F.col(C.sql_name(doc_id)).isNull()).select(F.struct("*").alias("row"), F.lit(None).cast("string").alias("digest"))
    inside, outside = part_named(docs.where(F.col(C.sql_name(doc_id)).isNotNull()), doc_id, suspects, "exact-suspects")
    name, body = F.col(f"row.{C.sql_name(doc_id)}"), F.col(f"row.{C.sql_name(text)}")
    doubtful = inside.unionByName(nameless).select("row", name.alias("id"), strong_digest(normalised(body)).alias("text_sha256"))
    doubtful = C.join_by_count(doubtful, found, "text_sha256", total)
    single = doubtful.where(F.col("n").isNull()).select("row")
    chosen = doubtful.where(F.col("n").isNotNull() & F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["text_sha256"]).select("row")
    return outside.select("row").unionByName(single).unionByName(chosen).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY norm)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
