"""A stored inverted file over vectors: lists by nearest centroid, residual codes, exact reranking.

*Build.*  Centroids are trained by MLlib's distributed k-means (cosine) on a
bounded sample; every row goes to the list of its nearest centroid.  Rows of a
list are packed into blocks: ids, one signed byte for each component of the
residual to the centroid, and, in a column of their own, the vectors.  Blocks
are written partitioned by list.

*Search.*  A query probes its nearest lists.  Only their folders are read, and
of these only the codes: they give each score up to an error that is stored
with the row, so all rows that can be among the k best are known, and their
exact cosines are computed from the vectors of their blocks.  Within the probed
lists nothing is lost; :meth:`InvertedFile.tune` chooses how many lists reach a
wanted recall, measured against a full search.

*Change.*  :meth:`InvertedFile.upsert` writes one more segment and marks the
places of the rows it replaces; every change is a version (see
:mod:`corpusloom.sources.manifests`), and :meth:`InvertedFile.compact` writes a
single segment again.

Python workers hold a batch of eight megabytes or one row, whatever the sizes of
lists and query sets are (:mod:`corpusloom.functions.batches`; the session keeps
that setting), and matrices of ``CELLS`` scores.

Null vectors are not indexed; vectors of another length raise; zero vectors
score 0 with everything; of rows that repeat an id within one call the first by
vector stays; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import vectors as V
from corpusloom.functions.batches import bound_bytes, lean
from corpusloom.operators import search
from corpusloom.sources.manifests import Manifests

#: Lists at most, rows of the training sample for each list, and rounds of k-means.
MAX_LISTS, SAMPLE_PER_LIST, ROUNDS = 4096, 64, 8
#: Rows of a block, rows of a list that one task packs, blocks of a list that one task searches, queries taken together.
BLOCK_ROWS, PACK_ROWS, SEARCH_BLOCKS, QUERY_ROWS = 512, 1 << 16, 32, 256
#: Cells of a matrix of scores that a task holds.
CELLS = 1 << 20
#: Added to the stored errors, for rounding in single precision.
ROUNDING = 1e-6


def codes_of(unit: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error) of residuals: unit vector = centroid + scale * code, up to a vector of norm ``error``."""
    rest = unit - centroid
    scale = np.abs(rest).max(axis=1, initial=0.0) / 127
    codes = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
    scale = scale.astype(np.float32)
    return codes, scale, (np.linalg.norm(rest - scale[:, None].astype(float) * codes, axis=1) + ROUNDING).astype(np.float32)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def _turns(whole: np.ndarray) -> np.ndarray:
    """For each row, how many rows before it hold the same vector."""
    if not whole.shape[1]:
        return np.arange(len(whole), dtype="<i4")
    same = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    out = np.empty(len(whole), "<i4")
    out[order] = np.arange(len(whole)) - np.repeat(starts, np.diff([*starts, len(whole)]))
    return out


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Rows a few at a time, ``CELLS`` cells of ``width`` columns at most."""
    step = max(1, CELLS // max(1, width))
    return (slice(i, i + step) for i in range(0, rows, step))


class InvertedFile:
    """One version of an index below ``path``; methods that change it give the next one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.store = spark, Manifests(spark, path)
        self.meta = self.store.read(version)
        self.dims, self.lists, self.id_type = self.meta["dims"], self.meta["lists"], self.meta["id_type"]
        self.centroids = _centroids(spark, self.meta)

    # --- building ---------------------------------------------------------------

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, id: str = "id", vector: str = "embedding", lists: int | None = None, seed: int = 7) -> InvertedFile:
        """Train centroids and write every row; by default about the square root of the rows as lists."""
        spark, store = rows.sparkSession, Manifests(rows.sparkSession, path)
        held = store.folder("rows")
        cls._rows(rows, id, vector).write.parquet(held)  # read several times from here on
        rows = spark.read.parquet(held)
        count, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
        lists = max(1, min(lists or round(count**0.5), MAX_LISTS, count))
        share = min(1.0, 1.5 * lists * SAMPLE_PER_LIST / max(1, count))
        nonzero = F.exists("v", lambda x: x != 0)
        sample = rows.where(nonzero).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).select(array_to_vector("v").alias("features"))
        sample = sample.limit(2 * lists * SAMPLE_PER_LIST).persist()
        if sample.isEmpty():
            centroids, sizes = np.zeros((1, dims)), [0]
        else:
            model = KMeans(k=lists, distanceMeasure="cosine", maxIter=ROUNDS, seed=seed).fit(sample)
            centroids, sizes = V.unit_rows([c.tolist() for c in model.clusterCenters()]), list(model.summary.clusterSizes)
        sample.unpersist()
        folder = store.folder("centroids")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(folder)
        known = sum(sizes) or 1
        meta = {"version": len(store.versions()), "dims": dims, "lists": len(centroids), "id_type": rows.schema["id"].dataType.simpleString(), "centroids": folder, "probes": len(centroids), "shares": [max(1, s) / known for s in sizes[: len(centroids)]], "segments": [], "dead": [], "rows": 0}
        out = cls._with_segment(store, meta, rows, [])
        store.remove(held)
        return out

    @staticmethod
    def _rows(rows: DataFrame, id: str, vector: str) -> DataFrame:
        df = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
        return df.groupBy("id").agg(F.min("v").alias("v"))

    @classmethod
    def _with_segment(cls, store: Manifests, meta: dict, rows: DataFrame, dead: list[str], segments: list | None = None) -> InvertedFile:
        """Commit ``meta`` with one more segment that holds ``rows`` (id, v)."""
        spark, dims = store.spark, meta["dims"]
        bound_bytes(spark)
        folder, number = store.folder("segment"), 1 + max((s["number"] for s in meta["segments"]), default=-1)
        centroids = spark.sparkContext.broadcast(_centroids(spark, meta))
        count = rows.count()
        parts = np.ceil(np.array(meta["shares"]) * count / PACK_ROWS).astype(int).clip(1)
        total = int(max(parts.sum(), 1))

        def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                raw = batch.column("v")
                n = raw.value_lengths().to_numpy()
                if (n != dims).any():
                    raise ValueError(f"vectors must have {dims} dimensions, not {int(n[n != dims][0])}")
                unit = V.unit_rows(_matrix(raw))
                near = np.concatenate([np.empty(0, int), *((unit[x] @ centroids.value.T).argmax(axis=1) for x in _slices(len(unit), len(parts)))])
                part = np.arange(len(near)) % parts[near] if len(near) else near
                yield pa.RecordBatch.from_arrays([batch.column("id"), raw, pa.array(near.astype(np.int32)), pa.array(part.astype(np.int32))], ["id", "v", "list", "part"])

        def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, made = TaskContext.get().partitionId() << 32, 0
            kept, at, n = [], None, 0

            def block():
                nonlocal kept, made, n
                ids, whole = pa.concat_arrays([i for i, _ in kept]), np.ascontiguousarray(np.concatenate([v for _, v in kept]), "<f8")
                code, scale, error = codes_of(V.unit_rows(whole), centroids.value[at])
                row = [[at], [base + made], [n], pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), *([x.tobytes()] for x in (code, scale, error, _turns(whole), whole))]
                kept, made, n = [], made + 1, 0
                return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

            for batch in it:
                lists, ids, whole = batch.column("list").to_numpy(), batch.column("id"), _matrix(batch.column("v"))
                ends = [*np.flatnonzero(np.diff(lists)) + 1, len(lists)]
                i = 0
                while i < len(lists):
                    if n and (lists[i] != at or n >= BLOCK_ROWS):
                        yield block()
                    at = int(lists[i])
                    take = min(next(e for e in ends if e > i) - i, BLOCK_ROWS - n)
                    kept.append((ids.slice(i, take), whole[i : i + take]))
                    i, n = i + take, n + take
            if n:
                yield block()

        ddl = f"list int, block bigint, n int, ids array<{meta['id_type']}>, codes binary, scales binary, errors binary, turns binary, vectors binary"
        id_arrow = to_arrow_type(rows.schema["id"].dataType)
        schema = pa.schema([("list", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(id_arrow)), *[(c, pa.binary()) for c in ("codes", "scales", "errors", "turns", "vectors")]])
        assigned = rows.mapInArrow(lean(assign), f"id {meta['id_type']}, v array<double>, list int, part int")
        packed = assigned.repartition(total, "list", "part").sortWithinPartitions("list", "id").mapInArrow(lean(pack), ddl)
        packed.write.partitionBy("list").parquet(folder)
        segment = {"number": number, "path": folder, "rows": count}
        meta = meta | {"segments": [*(meta["segments"] if segments is None else segments), segment], "dead": dead}
        meta["rows"] = sum(s["rows"] for s in meta["segments"])
        store.commit(meta)
        return cls(spark, store.path, meta["version"])

    # --- reading ----------------------------------------------------------------

    def blocks(self) -> DataFrame:
        """All blocks with their segment and the places that later segments replaced."""
        ddl = f"block bigint, n int, ids array<{self.id_type}>, codes binary, scales binary, errors binary, turns binary, vectors binary, list int"
        out = None
        for s in self.meta["segments"]:
            one = self.spark.read.schema(ddl).parquet(s["path"]).withColumn("segment", F.lit(s["number"]))
            out = one if out is None else out.unionByName(one)
        return out

    def _dead(self) -> DataFrame | None:
        """(segment, block, gone): places of replaced rows, at most a block's rows each."""
        if not self.meta["dead"]:
            return None
        marks = self.spark.read.parquet(*self.meta["dead"])
        return marks.groupBy("segment", "block").agg(F.collect_set("place").alias("gone"))

    def _living(self, blocks: DataFrame) -> DataFrame:
        dead = self._dead()
        return blocks.withColumn("gone", F.lit(None).cast("array<int>")) if dead is None else blocks.join(dead, ["segment", "block"], "left")

    def rows(self) -> DataFrame:
        """(id, v) of all living rows."""
        return self._unpacked(self._living(self.blocks()).select("ids", "vectors", "gone"))

    def _unpacked(self, blocks: DataFrame) -> DataFrame:
        bound_bytes(self.spark)
        dims = self.dims

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for ids, raw, gone in zip(batch.column("ids"), batch.column("vectors").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                    v = np.frombuffer(raw, "<f8").reshape(len(ids), dims)
                    stay = np.setdiff1d(np.arange(len(ids)), np.array(gone or [], int))
                    flat = pa.array(v[stay].ravel())
                    yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(stay)), pa.ListArray.from_arrays(pa.array(np.arange(len(stay) + 1, dtype=np.int32) * dims), flat)], ["id", "v"])

        return blocks.mapInArrow(lean(run), f"id {self.id_type}, v array<double>")

    # --- search -----------------------------------------------------------------

    def probed(self, vector: list[float], probes: int | None = None) -> list[int]:
        """Lists that a query reads, nearest first."""
        near = self.centroids @ V.unit_rows([list(vector)])[0]
        return np.argsort(-near, kind="stable")[: probes or self.meta["probes"]].tolist()

    def search(self, vector: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(id, score): the k nearest by cosine among the probed lists, whose folders alone are read."""
        if len(vector) != self.dims:
            raise ValueError(f"the index has {self.dims} dimensions, the query {len(vector)}")
        lists = self.probed(vector, probes)
        query = self.spark.createDataFrame([(0, [float(x) for x in vector], at) for at in lists], "query_id bigint, q array<double>, list int")
        return self._found(query, self.blocks().where(F.col("list").isin(lists)), k).orderBy("rank").select("id", "score")

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None, *, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank) of every row of ``queries``, a stated set."""
        each = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).where(F.col("q").isNotNull())
        found = self._found(self._spread(each, probes or self.meta["probes"]).drop("nth"), self.blocks(), k, each.count())
        return found.select(F.col("query_id").alias(query_id), "id", "score", "rank")

    def _spread(self, each: DataFrame, probes: int) -> DataFrame:
        """Queries once for each list they probe."""
        centroids, dims = self.spark.sparkContext.broadcast(self.centroids), self.dims

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if (batch.column("q").value_lengths().to_numpy() != dims).any():
                    raise ValueError(f"queries must have {dims} dimensions")
                for x in _slices(batch.num_rows, len(centroids.value)):
                    part = batch.slice(x.start, x.stop - x.start)
                    near = np.argsort(-(V.unit_rows(_matrix(part.column("q"))) @ centroids.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                    ends = np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]
                    yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("q"), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))], ["query_id", "q", "lists"])

        kind = each.schema["query_id"].dataType.simpleString()
        return each.mapInArrow(lean(run), f"query_id {kind}, q array<double>, lists array<int>").select("query_id", "q", F.posexplode("lists").alias("nth", "list"))

    def _found(self, probing: DataFrame, blocks: DataFrame, k: int, total: int = 1) -> DataFrame:
        """(query_id, id, score, rank) from ``total`` queries by list, over ``blocks``.

        Blocks of a list are dealt to a task for every ``SEARCH_BLOCKS`` of
        them, and the queries that probe it go to each, ``QUERY_ROWS`` in a
        row; the sizes of lists are read from their blocks.
        """
        bound_bytes(self.spark)
        kind = probing.schema["query_id"].dataType.simpleString()
        parts = blocks.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(SEARCH_BLOCKS)).cast("int").alias("parts"))  # MAX_LISTS rows at most
        packed = probing.withColumn("turn", F.floor(F.row_number().over(Window.partitionBy("list").orderBy("query_id")) / F.lit(QUERY_ROWS)))
        packed = packed.groupBy("list", "turn").agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
        packed = packed.join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "turn")
        dealt = blocks.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("segment", "block"), F.col("parts")).cast("int")).drop("parts")
        living = self._living(dealt.drop("vectors", "ids"))
        pairs = living.join(packed, ["list", "part"]).select("list", "segment", "block", "n", "codes", "scales", "errors", "turns", "gone", "queries")
        near = pairs.mapInArrow(lean(_coded(self.spark.sparkContext.broadcast(self.centroids), k)), f"query_id {kind}, segment int, block bigint, place int, low double, high double")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
        least = F.max(F.when(F.col("nth") == k, F.col("low"))).over(Window.partitionBy("query_id"))
        near = near.withColumn("nth", nth).withColumn("least", least).where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
        asked = probing.select("query_id", "q").dropDuplicates(["query_id"])
        # A block that all queries want, of a common vector for instance, is dealt by query.
        turn = F.pmod(F.xxhash64("query_id"), F.lit(1 + total // QUERY_ROWS))
        wanted = near.withColumn("turn", turn).join(asked, "query_id").groupBy("segment", "block", "turn").agg(F.collect_list(F.struct("query_id", "place", "q")).alias("wanted"))
        exact = wanted.join(blocks.select("segment", "block", "ids", "vectors"), ["segment", "block"]).select("ids", "vectors", "wanted")
        scored = exact.mapInArrow(lean(_exact(self.dims)), f"query_id {kind}, id {self.id_type}, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    # --- changes ----------------------------------------------------------------

    def _next(self) -> dict:
        return self.meta | {"version": self.meta["version"] + 1}

    def upsert(self, rows: DataFrame, *, id: str = "id", vector: str = "embedding") -> InvertedFile:
        """Rows added, or replaced by id; older versions stay as they are."""
        folder = self.store.folder("rows")
        self._rows(rows, id, vector).write.parquet(folder)
        new = self.spark.read.parquet(folder)
        return self._with_segment(self.store, self._next(), new, [*self.meta["dead"], *self._marked(new.select("id"))])

    def delete(self, ids: DataFrame, *, id: str = "id") -> InvertedFile:
        meta = self._next()
        meta["dead"] = [*self.meta["dead"], *self._marked(ids.select(F.col(id).alias("id")).distinct())]
        self.store.commit(meta)
        return InvertedFile(self.spark, self.store.path, meta["version"])

    def _marked(self, ids: DataFrame) -> list[str]:
        """Write the places of living rows with these ids."""
        folder = self.store.folder("dead")
        place = self.blocks().select("segment", "block", F.posexplode("ids").alias("place", "id"))
        place.join(ids, "id", "left_semi").select("segment", "block", "place").write.parquet(folder)
        return [folder]

    def compact(self) -> InvertedFile:
        """All living rows in one segment."""
        return self._with_segment(self.store, self._next(), self.rows(), [], segments=[])

    def tune(self, queries: DataFrame, k: int = 10, recall: float = 0.95, *, query_id: str = "query_id", vector: str = "embedding") -> InvertedFile:
        """The next version, with the fewest probes whose recall on ``queries`` reaches ``recall``.

        The k nearest rows of every query are found by a full search; their
        recall at p probes is the share whose list is among the query's p
        nearest, which is counted for all p at once.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
        ranked = self._spread(asked, self.lists).select("query_id", "list", (F.col("nth") + 1).alias("nth"))
        whole = search.vector_join(self.rows().withColumnRenamed("v", "embedding"), asked.withColumnRenamed("q", "embedding"), k)
        places = self._living(self.blocks()).select("list", "gone", F.posexplode("ids").alias("place", "id"))
        places = places.where(F.col("gone").isNull() | ~F.array_contains("gone", F.col("place"))).select("list", "id")
        nth = whole.join(places, "id").join(ranked, ["query_id", "list"]).groupBy("nth").agg(F.count(F.lit(1)).alias("n"))
        counts = {r["nth"]: r["n"] for r in nth.collect()}  # MAX_LISTS at most
        total, reached, probes = sum(counts.values()), 0, self.lists
        for p in range(1, self.lists + 1):
            reached += counts.get(p, 0)
            if reached >= recall * total:
                probes = p
                break
        meta = self._next() | {"probes": probes, "recall": reached / total if total else 1.0}
        self.store.commit(meta)
        return InvertedFile(self.spark, self.store.path, meta["version"])


def _centroids(spark: SparkSession, meta: dict) -> np.ndarray:
    rows = spark.read.parquet(meta["centroids"]).orderBy("list").collect()  # MAX_LISTS at most
    return np.array([r["centroid"] for r in rows]).reshape(len(rows), meta["dims"])


def _coded(centroids, k: int):
    """Rows of a block that can be among the k best of a query, with bounds of their scores."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure: dict = {}  # for each query of the task a score that k rows reach
        for batch in it:
            packed = batch.column("queries")
            for row in range(batch.num_rows):
                at, segment, block, n, gone = (batch.column(c)[row].as_py() for c in ("list", "segment", "block", "n", "gone"))
                codes, scales, errors, turns = (batch.column(c)[row].as_buffer() for c in ("codes", "scales", "errors", "turns"))
                queries = packed[row].values
                centre = centroids.value[at]
                unit = V.unit_rows(_matrix(queries.field("q")))
                score = (unit @ np.frombuffer(codes, np.int8).reshape(n, -1).astype(np.float64).T) * np.frombuffer(scales, "<f4").astype(np.float64) + (unit @ centre)[:, None]
                error = np.frombuffer(errors, "<f4").astype(np.float64)[None, :]
                low, high = score - error, score + error
                # Of equal vectors only the first k living ones, by id, can be wanted.
                late = np.frombuffer(turns, "<i4") >= k + len(gone or [])
                late[gone or []] = True
                low[:, late], high[:, late] = -np.inf, -np.inf
                least = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
                names = queries.field("query_id")
                keys = names.to_pylist()
                least = np.maximum(least, [sure.get(x, -np.inf) for x in keys])
                sure.update(zip(keys, least.tolist(), strict=True))
                i, j = np.nonzero((high >= least[:, None]) & np.isfinite(high))
                same = lambda v, t: pa.array(np.full(len(i), v, t))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), same(segment, np.int32), same(block, np.int64), pa.array(j.astype(np.int32)), pa.array(low[i, j]), pa.array(high[i, j])], ["query_id", "segment", "block", "place", "low", "high"])

    return run


def _exact(dims: int):
    """Exact cosines of wanted places."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, raw, all_ in zip(batch.column("ids"), batch.column("vectors"), batch.column("wanted"), strict=True):
                whole = np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, dims)
                for x in _slices(len(all_.values), dims):
                    wanted = all_.values.slice(x.start, x.stop - x.start)
                    place = wanted.field("place").to_numpy()
                    score = np.einsum("ij,ij->i", V.unit_rows(_matrix(wanted.field("q"))), V.unit_rows(whole[place]))
                    yield pa.RecordBatch.from_arrays([wanted.field("query_id"), ids.values.take(pa.array(place)), pa.array(score)], ["query_id", "id", "score"])

    return run
