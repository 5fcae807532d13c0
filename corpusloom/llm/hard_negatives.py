"""Hard negatives by inner product, searched through a pivot table.

A row's score for an anchor is the inner product of their vectors.  Giving
every row one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and
every anchor a zero there, makes ``d(q, x)^2 = |q|^2 + M^2 - 2 q.x``: a high
score is a small Euclidean distance.  For a few pivots the distances of all
rows are stored beside the vectors.  By the triangle inequality
``|d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p)`` for each pivot p, which
brackets the score of a row (and, with the least and greatest distances of a
tile of rows, of the whole tile) without reading its vector.  Only rows whose
bracket reaches what is asked are checked exactly.

1. :func:`pivot_table` writes blocks of rows: ids, labels, whole-number vectors
   in the smallest type that holds them, and their pivot distances.
2. Rows are dealt to groups of at most ``GROUP_ROWS``; blocks of anchors (the
   stated query set) go to every group, so a group and one block of anchors are
   all that a task holds.  It keeps the best of each anchor, and the groups'
   few are ranked together: first the positives, then, with the window of
   scores that each positive opens, the negatives.

Brackets only decide what is checked; every result has an exact score.  Where
the vectors have no structure (independent directions in many dimensions), all
pivot distances are alike and nearly every row is checked.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; shorter vectors count as filled up with zeros; rows
that repeat an id are rows of their own, but none is a positive of an anchor of
the same id; of anchors with one id the one with the smallest label and vector
counts; equal scores are ordered by id, repeated rows one after the other; an
anchor without positives, or a positive without negatives, gives no row; a
score beyond 64 bits raises; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: Pivots, and rows (smallest hash of the id) that they are chosen from.
PIVOTS, SAMPLE = 8, 1024
#: Rows of a stored block, of a group, and rows whose brackets are taken together.
BLOCK_ROWS, GROUP_ROWS, TILE = 256, 1 << 16, 256
#: Relative width by which brackets are loosened, for rounding.
SLACK = 1e-5
_LEAST = np.iinfo(np.int64).min

BLOCK = "kind int, part bigint, n int, ids binary, labels binary, vectors binary, distances binary, positives binary, counts binary"


def usable(rows: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    v = F.col(C.sql_name(vector)).cast("array<double>")
    df = rows.select(F.col(C.sql_name(id)).cast("bigint").alias("id"), F.col(C.sql_name(label)).cast("bigint").alias("label"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)


def quantised(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a list column as a matrix, short rows filled up with zeros."""
    offsets = column.offsets.to_numpy()
    n = np.diff(offsets)
    flat = np.floor(scale * column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
    if not np.isfinite(flat).all():
        raise ValueError("a component is too large")
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Space:
    """Pivots and number types that fit one table's vectors; small, so tasks get it by value."""

    def __init__(self, dims: int, norm2: float, most: float, sample: np.ndarray, scale: float, pivots: int):
        self.dims, self.scale = dims, scale
        self.limit = norm2 * (1 + 1e-12)
        self.kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
        bound = dims * most * most  # of every partial sum of a score
        self.product = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
        self.loose = SLACK * math.sqrt(max(1.0, self.limit))
        points = self.lifted(sample)
        chosen = [0] if len(points) else []
        if chosen:  # farthest first
            away = ((points - points[0]) ** 2).sum(axis=1)
            while len(chosen) < min(pivots, len(points)) and away.max() > 0:
                chosen.append(int(away.argmax()))
                away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        self.pivots = points[chosen]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that gives all of them one norm."""
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.limit - (x * x).sum(axis=1)))[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Distances to the pivots; points have the added component."""
        square = (points * points).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0.0, square)).astype(np.float32)

    def radius(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a row has this score for an anchor of this squared norm."""
        return np.sqrt(np.maximum(0.0, norm2 + self.limit - 2 * score.astype(np.float64)))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products of all rows of a and b."""
        if self.product is object:
            ints = lambda x: np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)
            return (ints(a) @ ints(b).T).astype(np.int64)
        return (a.astype(self.product) @ b.astype(self.product).T).astype(np.int64)


def space_of(rows: DataFrame, scale: float, pivots: int) -> tuple[Space, int]:
    """The space of usable rows and their number: one aggregate, and a bounded sample."""
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    q = rows.select("id", whole.alias("q"))
    norm2 = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dims"), F.max(norm2).alias("norm2"), F.max(F.coalesce(F.array_max(F.transform("q", lambda x: F.abs(x))), F.lit(0.0))).alias("most")).head()
    dims = stats["dims"] or 0
    some = rows.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE).select("v").collect()
    sample = quantised(pa.array([r["v"] for r in some], pa.list_(pa.float64())), dims, scale) if some else np.zeros((0, dims))
    return Space(dims, stats["norm2"] or 0.0, stats["most"] or 0.0, sample, scale, pivots), stats["n"]


def _block(kind: int, space: Space, ids, labels, x: np.ndarray, extra: tuple[bytes, bytes] = (b"", b"")) -> tuple:
    """A block as a row of ``BLOCK``; anchors (kind 1) have nothing in the added component."""
    points = space.lifted(x) if kind == 0 else np.hstack([x, np.zeros((len(x), 1))])
    return (kind, int(ids[0]), len(ids), np.asarray(ids, "<i8").tobytes(), np.asarray(labels, "<i8").tobytes(), x.astype(space.kind).tobytes(), space.distances(points).astype("<f4").tobytes(), *extra)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    names = [x.split()[0] for x in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def pivot_table(rows: DataFrame, space: Space) -> DataFrame:
    """Blocks of usable rows with their pivot distances."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                yield _batch([_block(0, space, part.column("id").to_numpy(), part.column("label").to_numpy(), quantised(part.column("v"), space.dims, space.scale))])

    return rows.select("id", "label", "v").mapInArrow(C.lean(run), BLOCK)


def anchor_blocks(anchors: DataFrame, space: Space) -> DataFrame:
    """Blocks of anchors (id, label, v, and positives: array of (id, score) or null)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                pairs = [p or [] for p in part.column("positives").to_pylist()]
                flat = np.array([(p["id"], p["score"]) for ps in pairs for p in ps], "<i8").reshape(-1, 2)
                extra = (flat.tobytes(), np.array([len(p) for p in pairs], "<i4").tobytes())
                yield _batch([_block(1, space, part.column("id").to_numpy(), part.column("label").to_numpy(), quantised(part.column("v"), space.dims, space.scale), extra)])

    return anchors.select("id", "label", "v", "positives").mapInArrow(C.lean(run), BLOCK)


class Best:
    """The first ``k`` of each slot by score, then id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.least = np.full(slots, _LEAST)
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        slot, score, id = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, id])
        order = np.lexsort((id, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[order][keep], id[order][keep]
        full = rank == self.k - 1
        self.least[slot[full]] = score[order][full]


class Group:
    """Rows of one group, sorted by label and nearest pivot, in tiles with bounds of their pivot distances."""

    def __init__(self, space: Space, blocks: list[dict]):
        self.space = space
        ids, labels, vectors, distances = (np.concatenate([x[i] for x in map(self._read(space), blocks)]) for i in range(4))
        order = np.lexsort((distances.min(axis=1, initial=np.inf), distances.argmin(axis=1) if distances.shape[1] else labels, labels))
        self.ids, self.labels, self.vectors, self.distances = ids[order], labels[order], vectors[order], distances[order]
        self.starts = np.arange(0, len(ids), TILE)
        self.near, self.far = np.minimum.reduceat(self.distances, self.starts), np.maximum.reduceat(self.distances, self.starts)

    @staticmethod
    def _read(space: Space):
        def read(b: dict) -> tuple:
            shape = (b["n"], -1) if space.dims else (b["n"], 0)
            vectors = np.frombuffer(b["vectors"], space.kind).reshape(shape)
            distances = np.frombuffer(b["distances"], "<f4").reshape(b["n"], len(space.pivots))
            return np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8"), vectors, distances

        return read

    def _checked(self, a: np.ndarray, tile: slice, least: np.ndarray, most: np.ndarray | None, q: np.ndarray, dq: np.ndarray, norm2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, exact score) of the pairs of a tile whose bracket reaches [least, most]."""
        dx, loose = self.distances[tile], self.space.loose
        reach = self.space.radius(norm2[a], least[a]) + loose  # beyond it the score is too low
        within = np.ones((len(a), len(dx)), bool)
        if dx.shape[1]:
            apart = np.abs(dq[a, 0][:, None] - dx[:, 0])
            for j in range(1, dx.shape[1]):
                np.maximum(apart, np.abs(dq[a, j][:, None] - dx[:, j]), out=apart)
            within = apart <= reach[:, None]
            if most is not None:
                top = self.space.radius(norm2[a], most[a]) - loose  # nearer than it the score is too high
                joint = dq[a, 0][:, None] + dx[:, 0]
                for j in range(1, dx.shape[1]):
                    np.minimum(joint, dq[a, j][:, None] + dx[:, j], out=joint)
                within &= joint >= top[:, None]
        i, j = np.nonzero(within)
        if len(i) * 16 < within.size and self.space.product is not object:  # few: one by one
            x, y = q[a[i]].astype(np.float64), self.vectors[tile][j].astype(np.float64)
            return a[i], j + tile.start, np.einsum("ij,ij->i", x, y).astype(np.int64)
        return a[i], j + tile.start, self.space.scores(q[a], self.vectors[tile])[i, j]

    def search(self, block: dict, k: int, low: int | None = None, high: int | None = None) -> tuple[Best, list]:
        """Positives of a block of anchors or, with ``low`` and ``high`` (percent), negatives of each positive they have."""
        ids, labels, q, dq = self._read(self.space)(block)
        norm2 = (q.astype(np.float64) ** 2).sum(axis=1)
        first, count, pairs = None, None, []
        if low is not None:
            count = np.frombuffer(block["counts"], "<i4").astype(np.int64)
            pairs = np.frombuffer(block["positives"], "<i8").reshape(-1, 2).tolist()
            first = np.cumsum(count) - count
            lows, highs = (np.array(x, np.int64) for x in ([-(-low * s // 100) for _, s in pairs], [high * s // 100 for _, s in pairs]))
            alive = np.flatnonzero(count)
            owner = np.repeat(np.arange(len(count)), count)
        best = Best(len(ids) if low is None else len(pairs), k)
        if low is not None and not len(pairs):
            return best, pairs
        ends = np.append(self.starts[1:], len(self.ids))
        bounds = np.maximum(dq[:, None, :] - self.far[None], self.near[None] - dq[:, None, :]).max(axis=2, initial=0.0) if dq.shape[1] else np.zeros((len(ids), len(self.starts)))
        for t in np.argsort(bounds.mean(axis=0), kind="stable").tolist():  # near tiles first, so that later ones have much to reach
            tile = slice(int(self.starts[t]), int(ends[t]))
            lo, hi = self.labels[tile.start], self.labels[tile.stop - 1]
            if low is None:
                least, most = best.least, None
                a = np.flatnonzero((labels >= lo) & (labels <= hi))
            else:
                need = np.maximum(lows, best.least)
                least, most = np.full(len(ids), _LEAST), np.full(len(ids), _LEAST)
                least[alive] = np.minimum.reduceat(need, first[alive])
                most[alive] = np.maximum.reduceat(highs, first[alive])
                a = alive[(labels[alive] < lo) | (labels[alive] > hi)] if lo == hi else alive
            open_ = least[a] == _LEAST
            a = a[open_ | (bounds[a, t] <= self.space.radius(norm2[a], least[a]) + self.space.loose)]
            if not len(a):
                continue
            i, row, score = self._checked(a, tile, np.where(least == _LEAST, np.int64(-(1 << 62)), least), most, q, dq, norm2)
            if low is None:
                good = (labels[i] == self.labels[row]) & (ids[i] != self.ids[row]) & (score >= least[i])
                i, row, score = i[good], row[good], score[good]
                if len(i):
                    best.add(i, score, self.ids[row])
                continue
            good = (labels[i] != self.labels[row]) & (score >= least[i]) & (score <= most[i])
            i, row, score = i[good], row[good], score[good]
            if not len(i):
                continue
            n = count[i]
            slot = np.repeat(first[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            score, row = np.repeat(score, n), np.repeat(row, n)
            good = (score >= need[slot]) & (score <= highs[slot])
            if good.any():
                best.add(slot[good], score[good], self.ids[row[good]])
        if low is not None:
            pairs = [(int(ids[o]), o_slot, *p) for o, o_slot, p in zip(owner, (np.arange(len(owner)) - first[owner]).tolist(), pairs, strict=True)]
        return best, pairs


def _meet(table: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """Every block of rows in its group, and every block of anchors in all of them, rows first."""
    dealt = table.withColumn("group", F.pmod(F.xxhash64("part", F.xxhash64("ids")), F.lit(groups)).cast("int"))
    each = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return dealt.unionByName(each).repartitionById(groups, F.col("group")).sortWithinPartitions("kind", "part")


def _searched(met: DataFrame, space: Space, schema: str, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        blocks, group = [], None
        for batch in it:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i].as_py() for c in ("kind", "n", "ids", "labels", "vectors", "distances", "positives", "counts")}
                if block["kind"] == 0:
                    blocks.append(block)
                    continue
                if not blocks and group is None:
                    continue  # a group without rows
                if group is None:
                    group, blocks = Group(space, blocks), []
                best, pairs = group.search(block, k, low, high)
                if not len(best.slot):
                    continue
                if low is None:
                    cols = [np.frombuffer(block["ids"], "<i8")[best.slot], best.id, best.score]
                else:
                    own = np.array(pairs, np.int64).reshape(-1, 4)[best.slot]
                    cols = [*own.T, best.id, best.score]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names)

    return met.mapInArrow(C.lean(run), schema)


def mine(rows: DataFrame, anchors: Column, *, id: str = "id", label: str = "label", vector: str = "vector", scale: float = 1.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = PIVOTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The first ``negatives`` rows of other labels for each anchor and each of its ``positives`` best rows of its own.

    ``anchors`` is a condition on ``id`` and ``label``: the stated query set.
    A negative's score lies from ``low`` to ``high`` percent of the positive's.
    Components are taken as ``floor(scale * x)``.
    """
    spark = rows.sparkSession
    C.bound_batches(spark)
    clean = usable(rows, id, label, vector)
    space, n = space_of(clean, scale, pivots)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // group_rows))
    table = C.stage(pivot_table(clean, space), "pivot-table")
    queries = clean.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("of")).select("id", "of.*")
    queries = C.stage(queries, "anchors")
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    met = _meet(table, anchor_blocks(queries.select("*", none), space), groups)
    found = _searched(met, space, "anchor_id bigint, id bigint, score bigint", positives)
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    own = found.withColumn("rank", order).where(F.col("rank") <= positives)
    own = own.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    own = own.select(F.col("anchor_id").alias("id"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))
    asked = C.stage(queries.join(own, "id"), "anchors-with-positives")
    met = _meet(table, anchor_blocks(asked, space), groups)
    found = _searched(met, space, "anchor_id bigint, slot bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint", negatives, low, high)
    order = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every fiftieth row of ``embeddings`` against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 50 == 0, id="vec_id", vector="embedding", scale=256.0)


OP12_SQL = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS l, b.id AS id, b.label AS m, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, l, id AS positive_id, score AS positive_score FROM s WHERE l = m QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.l <> m AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
