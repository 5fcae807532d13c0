"""A stored full-text index: postings in blocks with bounds of their impact, BM25 top-k that skips blocks.

*Build.*  Documents of a task are sorted by size and numbered in chunks of at
most ``CHUNK`` documents; a block holds the postings of one token in one chunk
(a document's place, how often the token occurs, the document's length: three
numbers each, packed in one value) and their greatest count and least length.  Blocks are written
in folders by a hash of the token and sorted by token, so a search opens a few
folders and reads the row groups of its tokens.  Texts are not read again.

*Search.*  The greatest count and least length bound what a block can add to
any score, whatever the statistics of all segments are by then; the sum over
the query's tokens bounds the scores of a chunk.  The chunks of the greatest
bounds are scored first; their k-th score is a threshold, and only chunks whose
bound reaches it are read at all.

*Change.*  :meth:`TextIndex.upsert` adds a segment and marks the documents that
it replaces; counts of documents are corrected for them.  :meth:`TextIndex.merge`
writes one segment again, small chunks put together, from the postings alone;
blocks of other chunks are thinned where they are read and are not dealt again.
Every change is a version (:mod:`corpusloom.sources.manifests`).

Null and empty texts are documents of length 0; documents with a null id are
not indexed; of rows that repeat an id within one call one with the smallest
text stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.batches import bound_bytes
from corpusloom.operators.search import top_k
from corpusloom.sources.manifests import Manifests

#: Documents of a chunk, and tokens after which it ends too.
CHUNK, TOKENS = 1024, 1 << 20
#: Folders by token, the folder of the chunks' own rows, and tasks that write a folder.
FOLDERS, DOCUMENTS, SHARES = 16, -1, 64
#: Chunks scored for the first threshold, and small chunks that one task puts in order.
FIRST, WRITE_CHUNKS = 16, 4096
#: Rows of a page of a file; a search reads the pages that hold its tokens.
PAGE = 2048
#: Relative width by which bounds are loosened, for rounding.
SLACK = 1e-9

_POSTINGS = "token string, chunk bigint, n int, most int, least int, postings binary, lengths array<int>"


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as :func:`corpusloom.operators.search.bm25` takes them, a space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _is_gone(place: Column) -> Column:
    """Whether ``place`` is among the bits of ``gone``, 64 a number; null has none."""
    bit = F.getbit(F.get("gone", F.shiftright(place, 6)), place.bitwiseAND(F.lit(63)))
    return F.coalesce(bit, F.lit(0)) == 1


def _in_order(*columns: str) -> list[Column]:
    """Array columns of a group's rows put one behind the other by ``offset``; a group is a chunk's few parts."""
    rows = F.array_sort(F.collect_list(F.struct("offset", *columns)))
    return [F.flatten(F.transform(rows, _field(c))).alias(c) for c in columns]


def _field(name: str):
    return lambda x: x[name]


def _folder_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(FOLDERS)).cast("int")


class TextIndex:
    """One version of an index below ``path``; methods that change it give the next one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.store = spark, Manifests(spark, path)
        self.meta = self.store.read(version)
        #: Blocks of the last search's tokens, and those of them that were read.
        self.blocks, self.read = 0, 0

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, id: str = "id", text: str = "text", chunk: int = CHUNK) -> TextIndex:
        store = Manifests(docs.sparkSession, path)
        kind = docs.schema[id].dataType.simpleString()
        meta = {"version": len(store.versions()), "id_type": kind, "chunk": chunk, "segments": [], "dead": []}
        return cls._with_segment(store, meta, cls._rows(docs, id, text), [])

    @staticmethod
    def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
        df = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.col("id").isNotNull())
        return df.groupBy("id").agg(F.min("text").alias("text"))

    @classmethod
    def _with_segment(cls, store: Manifests, meta: dict, docs: DataFrame, dead: list[str]) -> TextIndex:
        folder, number = store.folder("segment"), 1 + max((s["number"] for s in meta["segments"]), default=-1)
        bound_bytes(store.spark)
        listed = docs.sortWithinPartitions(F.octet_length("text"), "id").select("id", _words(F.col("text")).alias("words"))
        made = listed.mapInArrow(_chunked(meta["chunk"], number, TOKENS), f"{_POSTINGS}, ids array<{meta['id_type']}>")
        cls._write(made, folder)
        return cls._commit(store, meta, folder, dead)

    @classmethod
    def _write(cls, rows: DataFrame, path: str) -> None:
        """Blocks by folder and token; the rows of the chunks themselves stand in a folder of their own."""
        placed = rows.withColumn("folder", F.when(F.col("token").isNull(), F.lit(DOCUMENTS)).otherwise(_folder_of(F.col("token"))))
        # A folder goes to SHARES tasks, so that a frequent token's blocks are not one task's.
        dealt = placed.repartition("folder", F.pmod(F.xxhash64("chunk"), F.lit(SHARES)))
        cls._write_sorted(dealt, path)

    @staticmethod
    def _write_sorted(rows: DataFrame, path: str) -> None:
        sorted_ = rows.sortWithinPartitions("folder", "token", "chunk")
        sorted_.write.mode("append").option("parquet.page.row.count.limit", PAGE).partitionBy("folder").parquet(path)

    @classmethod
    def _commit(cls, store: Manifests, meta: dict, folder: str, dead: list[str], segments: list | None = None) -> TextIndex:
        number = 1 + max((s["number"] for s in meta["segments"]), default=-1)
        rows = cls._read(store.spark, folder, meta["id_type"]).where(F.col("folder") == DOCUMENTS)
        stats = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)), F.lit(0))).head()
        segment = {"number": number, "path": folder, "documents": stats[0], "tokens": stats[1]}
        store.commit(meta | {"segments": [*(meta["segments"] if segments is None else segments), segment], "dead": dead})
        return cls(store.spark, store.path, meta["version"])

    # --- reading ----------------------------------------------------------------

    @staticmethod
    def _read(spark: SparkSession, folder: str, id_type: str) -> DataFrame:
        return spark.read.schema(f"{_POSTINGS}, ids array<{id_type}>, folder int").parquet(folder)

    def _every(self) -> DataFrame:
        out = None
        for s in self.meta["segments"]:
            one = self._read(self.spark, s["path"], self.meta["id_type"])
            out = one if out is None else out.unionByName(one)
        return out

    def _documents(self) -> DataFrame:
        """(chunk, n, ids, lengths): ids of deleted documents are null."""
        return self._every().where(F.col("folder") == DOCUMENTS).select("chunk", "n", "ids", "lengths")

    def _gone(self) -> DataFrame | None:
        """(chunk, gone, documents, tokens): places of replaced documents as bits, one for each document of a chunk at most."""
        if not self.meta["dead"]:
            return None
        marks = self.spark.read.parquet(*self.meta["dead"])
        bit = F.expr("shiftleft(1L, place & 63)")
        words = marks.groupBy("chunk", F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.sum("length").alias("tokens"))
        chunks = words.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by"), F.max("word").alias("last"), F.sum(F.bit_count("bits")).alias("documents"), F.sum("tokens").alias("tokens"))
        gone = F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(F.try_element_at("by", w), F.lit(0).cast("bigint")))
        return chunks.select("chunk", gone.alias("gone"), "documents", "tokens")

    def _postings(self, words: list[str]) -> DataFrame:
        """Blocks of some tokens; the folders of other tokens are not opened."""
        folders = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, words)).cast("array<string>")).alias("w")).select(_folder_of(F.col("w"))).distinct().collect()]
        rows = self._every().where(F.col("folder").isin(folders) & F.col("token").isin(words)).drop("ids", "lengths")
        return self._living(rows)

    def _living(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``gone``, the places of their chunk that were replaced; null where there are none."""
        gone = self._gone()
        return rows.withColumn("gone", F.lit(None).cast("array<bigint>")) if gone is None else rows.join(gone.select("chunk", "gone"), "chunk", "left")

    def search(self, query: list[str], k: int, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score): the k best documents, ties by id."""
        words = sorted({w.lower() for w in query})
        documents = sum(s["documents"] for s in self.meta["segments"])
        length = sum(s["tokens"] for s in self.meta["segments"])
        gone = self._gone()
        if gone is not None:
            lost = gone.agg(F.sum("documents"), F.sum("tokens")).head()
            documents, length = documents - (lost[0] or 0), length - (lost[1] or 0)
        mean = (length / documents if documents else 0.0) or 1.0
        rows = self._postings(words)
        living = rows.select("token", "n") if gone is None else rows.select("token", "n", "postings", "gone").mapInArrow(_counted, "token string, n int")
        counts = {r["token"]: (r["df"], r["blocks"]) for r in living.groupBy("token").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks")).collect()}  # the query's tokens
        self.blocks = sum(n for _, n in counts.values())
        weights = {w: math.log(1 + (documents - df + 0.5) / (df + 0.5)) for w, (df, _) in counts.items()}
        weight = F.lit(0.0)
        for w, x in weights.items():
            weight = F.when(F.col("token") == w, F.lit(x)).otherwise(weight)
        part = lambda weight, tf, n: weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
        bounds = rows.groupBy("chunk").agg((F.sum(part(weight, F.col("most"), F.col("least"))) * (1 + SLACK)).alias("bound"), F.count(F.lit(1)).alias("n"))
        first = bounds.orderBy(F.desc("bound"), "chunk").limit(FIRST).collect()
        score = self._scores(rows.where(F.col("chunk").isin([r["chunk"] for r in first])), weights, part)
        best = score.orderBy(F.desc("score")).limit(k).collect()
        least = best[-1]["score"] * (1 - SLACK) if len(best) == k else 0.0
        wanted = bounds.where(F.col("bound") >= least).select("chunk", "n")
        self.read = wanted.agg(F.sum("n")).head()[0] or 0
        score = self._scores(rows.join(wanted.drop("n"), "chunk", "left_semi"), weights, part).where((F.col("score") > 0) & (F.col("score") >= least))
        named = self._documents().select("chunk", "ids")
        return top_k(score.join(named, "chunk").select(F.element_at("ids", F.col("place") + 1).alias("id"), "score"), k)

    @staticmethod
    def _scores(rows: DataFrame, weights: dict[str, float], part) -> DataFrame:
        """(chunk, place, score) of every living document in the blocks."""
        each = rows.select("chunk", "token", "n", "postings", "gone").mapInArrow(_scored(weights, part), "chunk bigint, place int, score double")
        return each.groupBy("chunk", "place").agg(F.sum("score").alias("score"))

    # --- changes ----------------------------------------------------------------

    def _next(self) -> dict:
        return self.meta | {"version": self.meta["version"] + 1}

    def upsert(self, docs: DataFrame, *, id: str = "id", text: str = "text") -> TextIndex:
        """Documents added, or replaced by id; older versions stay as they are."""
        folder = self.store.folder("docs")
        self._rows(docs, id, text).write.parquet(folder)
        new = self.spark.read.parquet(folder)
        out = self._with_segment(self.store, self._next(), new, [*self.meta["dead"], self._marked(new.select("id"))])
        self.store.remove(folder)
        return out

    def delete(self, ids: DataFrame, *, id: str = "id") -> TextIndex:
        meta = self._next()
        meta["dead"] = [*self.meta["dead"], self._marked(ids.select(F.col(id).alias("id")).distinct())]
        self.store.commit(meta)
        return TextIndex(self.spark, self.store.path, meta["version"])

    def _marked(self, ids: DataFrame) -> str:
        """Write the places and lengths of living documents with these ids."""
        folder = self.store.folder("dead")
        each = self._documents().select("chunk", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "d")).select("chunk", "place", F.col("d.ids").alias("id"), F.col("d.lengths").alias("length"))
        if self.meta["dead"]:
            each = each.join(self.spark.read.parquet(*self.meta["dead"]).select("chunk", "place"), ["chunk", "place"], "left_anti")
        each.join(ids, "id", "left_semi").select("chunk", "place", "length").write.parquet(folder)
        return folder

    def merge(self) -> TextIndex:
        """All living documents in one segment, from the postings alone.

        Chunks of half the size or more, in documents or in tokens, keep their
        places; smaller ones, which small batches leave, are put together.
        """
        folder, size, kind = self.store.folder("segment"), self.meta["chunk"], self.meta["id_type"]
        stay = F.filter(F.transform("ids", lambda x, i: F.when(x.isNotNull() & ~_is_gone(i), i)), lambda i: i.isNotNull())
        docs = self._living(self._documents()).withColumn("stay", stay).withColumn("n", F.size("stay")).where("n > 0")
        kept = lambda column: F.transform("stay", lambda i: F.element_at(column, i + 1))
        held = F.aggregate(kept("lengths"), F.lit(0).cast("bigint"), lambda s, x: s + x)
        # A chunk's share of the bounds of one, in documents or in tokens.
        docs.withColumn("share", F.greatest(F.col("n") / size, held / TOKENS)).write.parquet(f"{folder}-places")
        docs = self.spark.read.parquet(f"{folder}-places")
        small = F.col("share") < 0.5
        # A file of its own, so that Spark sees how small it is: a bit for each document.
        docs.where(~small).select("chunk", "gone").write.parquet(f"{folder}-large")
        large = self.spark.read.parquet(f"{folder}-large")
        # Chunks put together: a document's new place is its position among those that stay, plus its chunk's offset.
        part = F.pmod(F.xxhash64("chunk"), F.lit(1 + docs.where(small).count() // WRITE_CHUNKS))
        so_far = Window.partitionBy("part").orderBy(F.array_min("lengths"), "chunk").rowsBetween(Window.unboundedPreceding, -1)
        few = docs.where(small).withColumn("part", part).withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).withColumn("shares", F.coalesce(F.sum("share").over(so_far), F.lit(0.0)))
        of = Window.partitionBy("part", F.floor("shares"))
        few = few.withColumn("offset", (F.col("before") - F.min("before").over(of)).cast("int")).withColumn("new", F.min("chunk").over(of))
        few.write.parquet(f"{folder}-small")
        few = self.spark.read.parquet(f"{folder}-small")
        none = lambda t: F.lit(None).cast(t)
        own = few.select("new", "offset", kept("ids").alias("ids"), kept("lengths").alias("lengths")).groupBy(F.col("new").alias("chunk")).agg(*_in_order("ids", "lengths")).withColumn("n", F.size("ids"))
        blank = lambda column, value: F.transform(column, lambda x, i: F.when(_is_gone(i), value).otherwise(x))
        same = docs.where(~small).select("chunk", blank("ids", none(kind)).alias("ids"), blank("lengths", F.lit(0)).alias("lengths"), "n")
        heads = own.unionByName(same).select(none("string").alias("token"), "chunk", "n", F.lit(0).alias("most"), F.lit(0).alias("least"), none("binary").alias("postings"), "lengths", "ids")
        rows = self._every().where(F.col("folder") != DOCUMENTS).select("token", "chunk", "n", "postings", "folder")
        block, rest = "n int, most int, least int, postings binary", [none("array<int>").alias("lengths"), none(f"array<{kind}>").alias("ids")]
        moved = rows.drop("folder").join(few.select("chunk", "new", "offset", "stay"), "chunk").mapInArrow(_moved, f"token string, chunk bigint, offset int, {block}")
        parts = F.array_sort(F.collect_list(F.struct("offset", "postings")))
        joined = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["postings"]))
        moved = moved.groupBy("token", "chunk").agg(F.sum("n").cast("int").alias("n"), F.max("most").alias("most"), F.min("least").alias("least"), joined.alias("postings"))
        self._write(moved.select("*", *rest).unionByName(heads), folder)
        # Blocks of large chunks stay in their folder: they are thinned and written by the task that reads them.
        thinned = rows.join(large, "chunk").select("token", "chunk", "folder", "n", "postings", "gone").mapInArrow(_thinned, f"token string, chunk bigint, folder int, {block}")
        self._write_sorted(thinned.select("*", *rest), folder)
        out = self._commit(self.store, self._next(), folder, [], segments=[])
        for name in ("places", "large", "small"):
            self.store.remove(f"{folder}-{name}")
        return out


def _chunked(size: int, segment: int, most: int):
    """Postings of the documents of a task, ``size`` documents or ``most`` tokens at a time, and a row without token for each chunk."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Unique over all segments: number of the segment, task, chunk of the task.
        base, made = segment << 44 | TaskContext.get().partitionId() << 22, 0
        ids, lists, documents, held = [], [], 0, 0
        for batch in it:
            at, tokens_ = 0, _split(batch.column("words"))
            while at < batch.num_rows:
                sizes = np.cumsum(tokens_.slice(at, size - documents).value_lengths().to_numpy())
                n = min(len(sizes), 1 + int(np.searchsorted(sizes, most - held)))  # the document that reaches the bound is the last
                ids.append(batch.column("id").slice(at, n))
                lists.append(tokens_.slice(at, n))
                at, documents, held = at + n, documents + n, held + int(sizes[n - 1])
                if documents >= size or held >= most:
                    yield _block(pa.concat_arrays(ids), pa.concat_arrays(lists), base + made)
                    ids, lists, documents, held, made = [], [], 0, 0, made + 1
        if ids:
            yield _block(pa.concat_arrays(ids), pa.concat_arrays(lists), base + made)

    return run


def _split(words: pa.StringArray) -> pa.ListArray:
    """The tokens of each text; an empty text has none."""
    lists = pc.split_pattern(pc.if_else(pc.equal(words, ""), pa.scalar(None, words.type), words), " ")
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten())


def _block(ids: pa.Array, lists: pa.ListArray, chunk: int) -> pa.RecordBatch:
    """Postings of one chunk, by token and place; the chunk's own row comes first."""
    n = len(ids)
    lengths = lists.value_lengths().to_numpy()
    coded = lists.flatten().dictionary_encode()
    key, count = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    term, place = key // n, key % n
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(np.append(starts, len(key)))
    counts_, lengths_ = (count.astype(np.int32), lengths[place].astype(np.int32))
    most, least = (np.maximum.reduceat(counts_, starts), np.minimum.reduceat(lengths_, starts)) if len(starts) else (counts_, lengths_)
    first = lambda own, each: pa.array(np.concatenate([[own], each]), pa.int32())
    rows = len(starts) + 1
    columns = {
        "token": pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(term[starts]))]),
        "chunk": pa.array(np.full(rows, chunk)),
        "n": first(n, sizes), "most": first(0, most), "least": first(0, least),
        "postings": pa.concat_arrays([pa.nulls(1, pa.binary()), _packed(sizes, np.column_stack([place, counts_, lengths_]))]),
        "lengths": pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(lengths, pa.int32())), pa.nulls(rows - 1, pa.list_(pa.int32()))]),
        "ids": pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), pa.nulls(rows - 1, pa.list_(ids.type))]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# --- postings as Arrow columns ------------------------------------------------


def _packed(sizes: np.ndarray, postings: np.ndarray, wide: bool = False) -> pa.BinaryArray:
    """Rows of ``postings``, so many to a value: numbers of two bytes, or of four where one does not fit or ``wide``."""
    kind = np.dtype("<i4" if wide or postings.max(initial=0) >= 1 << 16 else "<u2")
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 3 * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(postings, kind))])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Number of each posting's row, and place, count and length of each posting."""
    column, n = batch.column("postings"), batch.column("n").to_numpy()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    halves = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u2")
    row, wide = np.repeat(np.arange(len(n)), n), np.diff(ends) == 12 * n
    if not wide.any():
        return row, halves.reshape(-1, 3).astype(np.int32)
    step = 1 + wide[row]
    at = ((ends[:-1] - ends[0]) // 2 - 3 * (1 + wide) * (np.cumsum(n) - n))[row] + 3 * step * np.arange(len(row))
    at = at[:, None] + step[:, None] * np.arange(3)
    high = np.where(wide[row][:, None], halves[np.minimum(at + 1, len(halves) - 1)], 0).astype(np.int32)
    return row, high << 16 | halves[at]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and sizes of lists; a null one is empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(), np.cumsum(sizes) - sizes, sizes


def _alive(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a posting's bit is not set in ``gone`` of its row."""
    bits, starts, sizes = _lists(batch.column("gone"))
    word = place >> 6
    out = word >= sizes[row]
    marked = np.flatnonzero(~out)
    out[marked] = bits[starts[row[marked]] + word[marked]] >> (place[marked] & 63) & 1 == 0
    return out


def _blocks(batch: pa.RecordBatch, row: np.ndarray, postings: np.ndarray, names: list[str], wide: bool = False) -> pa.RecordBatch:
    """Columns of ``batch`` and the blocks of its rows that have postings."""
    sizes = np.bincount(row, minlength=batch.num_rows)
    left = np.flatnonzero(sizes)
    sizes = sizes[left]
    starts = np.cumsum(sizes) - sizes
    least = lambda of, column: of.reduceat(postings[:, column], starts) if len(starts) else np.empty(0, np.int32)
    own = [batch.column(n).take(pa.array(left)) for n in names]
    made = [pa.array(sizes, pa.int32()), pa.array(least(np.maximum, 1), pa.int32()), pa.array(least(np.minimum, 2), pa.int32()), _packed(sizes, postings, wide)]
    return pa.RecordBatch.from_arrays(own + made, [*names, "n", "most", "least", "postings"])


def _thinned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks without the postings of documents that are gone."""
    for batch in it:
        if batch.num_rows:
            row, postings = _unpacked(batch)
            stay = _alive(batch, row, postings[:, 0])
            yield _blocks(batch, row[stay], postings[stay], ["token", "chunk", "folder"])


def _moved(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents in ``stay``, at their places in the chunk ``new``."""
    for batch in it:
        if batch.num_rows:
            row, postings = _unpacked(batch)
            places, starts, sizes = _lists(batch.column("stay"))
            known = np.repeat(np.arange(batch.num_rows), sizes) << 32 | places
            sought = row << 32 | postings[:, 0]
            at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
            stay = known[at] == sought
            row, postings, at = row[stay], postings[stay].copy(), at[stay]
            postings[:, 0] = at - starts[row] + batch.column("offset").to_numpy()[row]
            out = _blocks(batch, row, postings, ["token", "new", "offset"], wide=True)  # values are put together later
            yield out.rename_columns(["token", "chunk", *out.schema.names[2:]])


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Living documents of each block."""
    for batch in it:
        if batch.num_rows:
            row, postings = _unpacked(batch)
            n = np.bincount(row[_alive(batch, row, postings[:, 0])], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(n, pa.int32())], ["token", "n"])


def _scored(weights: dict[str, float], part):
    """What each posting of a living document adds to its score."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                row, postings = _unpacked(batch)
                stay = _alive(batch, row, postings[:, 0])
                row, (place, count, length) = row[stay], postings[stay].T
                weight = np.array([weights[t] for t in batch.column("token").to_pylist()])
                score = part(weight[row], count.astype(float), length.astype(float))
                yield pa.RecordBatch.from_arrays([batch.column("chunk").take(pa.array(row)), pa.array(place, pa.int32()), pa.array(score)], ["chunk", "place", "score"])

    return run
