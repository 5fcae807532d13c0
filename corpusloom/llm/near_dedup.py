"""MinHash near-dedup: SuperMinHash signatures, banding, verification, grouping.

The set of a document are its distinct ``shingle``-word runs of lower-cased
(A-Z) white-space words; a shorter document is one run.  Documents with
``|A & B| / |A | B| >= threshold`` are linked, and components of links are the
near-duplicate groups.

1. SuperMinHash: each element draws, rank by rank, a place of its own random
   permutation of the signature and offers rank + fraction there.  Offers only
   grow, so a document stops as soon as its worst place is below the next
   rank.  Levels are vectorised over all elements of a run of texts.
2. Documents with equal words are one class, named by a keyed 128-bit BLAKE2
   of them; only classes go on, so copies never become pairs.  Classes are
   numbered, whatever type the ids have.
3. Bands of the signature are bucket keys.  Each bucket names a hub, the member
   that meets most others over all its buckets, and every member is compared
   with its hubs, on the full sets of both texts.  A hub of many members is
   dealt to several tasks.
4. Two members x, y of a hub h that are still in different components are
   compared only if they can be linked at all: their overlap is at most
   ``min(|x & h|, |y & h|)`` plus the number of elements outside h that they
   share.  Either x and y both have a share ``threshold`` of their elements in
   h; such pairs are joined by bands of set size.  Or they share elements
   outside h, and then one of the first of either list, rarest in the star
   first: the lists are cut there, elements that a single member has join
   nothing, and places in the lists bound what is left.  A large group of near
   copies so never becomes all its pairs and no link is lost.
5. Links become components by alternating large-star and small-star steps.

With the default 5 rows in 32 bands a pair at exactly 0.8 shares no bucket 3
times in 10**6; at 0.85 once in 10**8.  Keys that may be hot (the members of a
class, a hub or a component) are joined by :func:`join_by_count`.

Edge cases: null, empty or wordless texts have no set, link with nothing and
are their own component; a null doc_id cannot be named, so such a row links
with nothing, has a null component and is kept; ids may be of any type that
has an order.  Rows that share a doc_id are one document: each has its own set
and size, the links of all of them count, and they are in one component.
Copies and ties go to the smallest id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common as C
from corpusloom.llm.exact_dedup import keep_named, part_named
from corpusloom.operators import graph

ROWS, BANDS = 5, 32


def shingles(text: bytes, k: int) -> set[bytes]:
    """The full set of one text, exact."""
    words = text.lower().split()
    if len(words) <= k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def shingle_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles, sorted by both."""
    w = C.Words([t.lower() for t in texts])
    h = w.hashes()
    n = len(h)
    at = np.arange(n)
    short = np.minimum(w.n, k)[w.doc] if n else at  # words in a shingle of this text
    start = np.flatnonzero(at + short <= w.first[w.doc + 1]) if n else at
    value = np.full(len(start), 0x5851F42D4C957F2D, np.uint64)
    for j in range(k):
        more = j < short[start]
        value[more] = C.mix(value[more] + h[start[more] + j], j + 1)
    doc = w.doc[start]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def superminhash(doc: np.ndarray, value: np.ndarray, docs: int, size: int, block: int = 1 << 16) -> np.ndarray:
    """Signatures (docs x size) of the sets given as sorted (doc, element) arrays."""
    out = np.full((docs, size), np.inf)
    cut = 0
    while cut < len(doc):
        end = min(len(doc), cut + block)
        if end < len(doc):  # whole documents, unless one is larger than a block
            whole = int(np.searchsorted(doc, doc[end - 1], "left"))
            end = whole if whole > cut else int(np.searchsorted(doc, doc[end - 1], "right"))
        lo, hi = int(doc[cut]), int(doc[end - 1]) + 1
        out[lo:hi] = _levels(doc[cut:end] - lo, value[cut:end], hi - lo, size)
        cut = end
    return out


def _levels(doc: np.ndarray, value: np.ndarray, docs: int, size: int) -> np.ndarray:
    signature = np.full(docs * size, float(size + 1))
    table = signature.reshape(docs, size)
    perm = None
    for rank in range(size):
        if rank:
            live = (table.max(axis=1) > rank)[doc]  # early stop: later offers are no better than rank
            if not live.any():
                break
            doc, value = doc[live], value[live]
            if perm is not None:
                perm = perm[live]
        draw = C.mix(value.copy(), 2 * rank + 101)
        place = rank + ((draw >> np.uint64(32)) * np.uint64(size - rank) >> np.uint64(32)).astype(np.int64)
        if rank == 0:
            slot, first = place, place
        else:
            rows = np.arange(len(doc))
            if perm is None:  # only rank 0 is behind: one swap each
                perm = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(doc), 1))
                perm[rows, first[live]] = 0
                perm[rows, 0] = first[live]
            slot = perm[rows, place].astype(np.int64)
            perm[rows, place] = perm[rows, rank]
            perm[rows, rank] = slot
        offer = rank + C.unit(C.mix(value.copy(), 2 * rank + 102))
        np.minimum.at(signature, doc * size + slot, offer)
    return table


def band_keys(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit bucket key for each band; the band's number is part of it."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(rows):
        key = C.mix(key + bits[:, :, r], r + 1)
    return key.view(np.int64)


_KEY = b"words of a document"


def text_id(words: bytes) -> bytes:
    """Name of a word sequence (lower-cased, joined by one space)."""
    return hashlib.blake2b(words, digest_size=16, key=_KEY).digest()


def signatures(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, text_id (null without words), bands."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in C.batches_of(it):
            doc, value = shingle_hashes(texts, shingle)
            count = np.bincount(doc, minlength=len(texts))
            ids = [text_id(b" ".join(t.lower().split())) if n else None for t, n in zip(texts, count.tolist(), strict=True)]
            keys = band_keys(superminhash(doc, value, len(texts), rows * bands), rows, bands)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(ids, pa.binary()), lists], ["doc_id", "n_shingles", "text_id", "bands"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, text_id binary, bands array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(C.lean(run), schema)


_OVERLAP = "a bigint, b bigint, n_a bigint, n_b bigint, both bigint, extra array<bigint>"
#: Members of a hub that one task compares with it.
TOGETHER = 256


def node_texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text: the text of one row of each of ``nodes``."""
    wanted = classes.join(nodes.distinct(), "node", "left_semi").select("node", "doc_id", "text_id")
    wanted = C.stage(wanted, "near-wanted")
    hits = keep_named(docs.where(F.col("doc_id").isNotNull()), "doc_id", wanted.select("doc_id").distinct(), "near-named")

    def name(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in C.batches_of(it):
            ids = pa.array([text_id(b" ".join(t.lower().split())) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, batch.column("text")], ["doc_id", "text_id", "text"])

    named = hits.select("doc_id", "text").mapInArrow(C.lean(name), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_id binary, text string")
    return named.join(wanted, ["doc_id", "text_id"]).groupBy("node").agg(F.min("text").alias("text"))


def overlaps(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, detail: bool) -> DataFrame:
    """Exact set sizes and overlap of pairs (a, b); with ``detail`` also hashes of the elements of b outside a.

    Texts of the named classes are picked first, so that only they are
    shuffled.  ``a`` is the side that repeats: its text goes to one task for
    every ``TOGETHER`` of its pairs.
    """
    texts = C.stage(node_texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), classes, docs), "near-texts")
    sizes = C.stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    parts = F.ceil(F.col("n") / F.lit(TOGETHER)).cast("bigint")
    a = texts.withColumnsRenamed({"node": "a", "text": "text_a"}).join(sizes, "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("n")
    dealt = C.join_by_count(pairs.select("a", "b"), sizes, "a", pairs.count(), "inner").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    b = texts.withColumnsRenamed({"node": "b", "text": "text_b"})

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch, others in C.batches_of(it, "text_b"):
            rows, extras = [], []
            for left, right, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), others, strict=True):
                if left != last:
                    last, held = left, shingles((x.as_py() or "").encode(), shingle)
                other = shingles(y, shingle)
                rows.append((left, right, len(held), len(other), len(held & other)))
                extras.append([xxhash.xxh64_intdigest(e) - (1 << 63) for e in other - held] if detail else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + [pa.array(extras, pa.list_(pa.int64()))], ["a", "b", "n_a", "n_b", "both", "extra"])

    joined = dealt.join(b, "b").join(a, ["a", "part"]).select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(C.lean(check), _OVERLAP)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): smallest node reachable; every round is written to the shared folder."""
    links_ = edges.select(F.col("a").alias("src_id"), F.col("b").alias("dst_id"))
    return graph.connected(links_, lambda df: C.stage(df, name)).withColumnRenamed("id", "node")


def _reaches(both: str, n: str, m: str, percent: int) -> str:
    return f"100 * ({both}) >= {percent} * ({n} + {m} - ({both}))"


_OTHER = {"x": "y", "n": "m", "both": "kept", "need": "must", "c": "d"}


def _apart(star: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """(x, y): members of a star, in different components, that may be linked all the same."""
    of = part.withColumnRenamed("node", "x").withColumnRenamed("component", "c")
    hub = part.withColumnRenamed("node", "a").withColumnRenamed("component", "hub_c")
    # Elements outside the hub that x must share with any partner.
    need = F.expr(f"({percent} * n + 99) div 100 - both").alias("need")
    member = star.withColumnsRenamed({"b": "x", "n_b": "n"}).join(of, "x", "left").select("a", "x", F.col("n").alias("size"), "both", "extra", need, F.coalesce("c", "x").alias("c")).where("need <= size(extra)")
    member = C.stage(member, "near-members")
    hubs = C.stage(member.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).join(hub, "a", "left").withColumn("hub_c", F.coalesce("hub_c", "a")).where("low <> hub_c OR high <> hub_c").select("a", "n", "hub_c"), "near-hubs")
    every = C.stage(C.join_by_count(member, hubs, "a", member.count(), "inner").drop("n").withColumnRenamed("size", "n"), "near-open")
    # Both mostly inside the hub: pairs of like sizes.
    width = max(math.log(100 / percent), 1e-3) * (1 + 1e-9)
    inside = every.where("need <= 0").drop("extra").withColumn("band", F.floor(F.log("n") / F.lit(width)))
    near = inside.drop("hub_c").withColumnsRenamed(_OTHER).withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    sized = inside.where("c <> hub_c").join(near, ["a", "band"]).where(F.expr(f"c <> d AND {_reaches('least(both, kept)', 'n', 'm', percent)}")).select("x", "y")
    # Or sharing elements outside it: those that two members have at least, the rarest of the star first.
    listed = C.stage(every.select("a", "x", "n", "both", "need", "c", "hub_c", F.explode("extra").alias("e")).withColumn("e", F.xxhash64("a", "e")), "near-outside")
    often = C.stage(listed.groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).where("n_e > 1").withColumnRenamed("n_e", "n"), "near-often")
    placed = C.join_by_count(listed.withColumnRenamed("n", "size"), often, "e", listed.count(), "inner")
    order = Window.partitionBy("a", "x").orderBy(F.desc("n"), F.desc("e"))
    placed = C.stage(placed.withColumn("rest", F.row_number().over(order)).where("rest >= need").drop("n").withColumnRenamed("size", "n"), "near-places")
    other = placed.drop("hub_c").withColumnsRenamed(_OTHER | {"rest": "left"})
    needed = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100 + percent)) - F.least("both", "kept")
    through = placed.where("c <> hub_c").join(other, ["a", "e"]).where((F.col("c") != F.col("d")) & (F.least("rest", "left") >= needed)).select("x", "y")
    return sized.union(through).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(docs: DataFrame, shingle: int, percent: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signature rows, classes with their number of rows, confirmed links between classes)."""
    base = C.stage(signatures(docs, shingle, rows, bands), "near-signatures")
    named = base.where(F.col("doc_id").isNotNull() & F.col("text_id").isNotNull())
    classes = named.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))
    classes = C.stage(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    buckets = classes.select("node", F.explode("bands").alias("key"))
    sizes = C.stage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-keys")
    shared = C.stage(C.join_by_count(buckets, sizes, "key", bands * classes.count(), "inner").withColumnRenamed("n", "size"), "near-buckets")
    # The hub of a bucket: the member that meets most others over all buckets.
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))
    ranked = C.stage(shared.join(met, "node").select("key", "node", "met"), "near-ranked")
    hubs = ranked.groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("less"), "node")).alias("hub"), F.count(F.lit(1)).alias("n")).select("key", F.col("hub.node").alias("hub"), "n")
    hubs = C.stage(hubs, "near-tops")
    stars = C.join_by_count(ranked, hubs, "key", ranked.count(), "inner").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star = C.stage(overlaps(C.stage(stars, "near-stars"), classes, docs, shingle, True), "near-overlaps")
    part = components(star.where(_reaches("both", "n_a", "n_b", percent)).select("a", "b"), "near-round")
    rest = C.stage(_apart(star, part, percent), "near-rest")
    second = C.stage(overlaps(rest, classes, docs, shingle, False), "near-second").where(_reaches("both", "n_a", "n_b", percent)).select("a", "b")
    found = part.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(second)
    return base, classes.drop("bands"), found.unionByName(_same_document(named, classes))


def _same_document(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    ids = named.groupBy("doc_id").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    ids = C.stage(ids.select("doc_id", "lo", "n"), "near-ids")
    total = ids.agg(F.sum("n")).head()[0] or 0
    if not total:
        return classes.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    rows = C.join_by_count(named.select("doc_id", "text_id"), ids, "doc_id", total, "inner").select("lo", "text_id").distinct()
    lo = classes.select(F.col("text_id").alias("lo"), F.col("node").alias("a"))
    return rows.join(lo, "lo").join(classes.select("text_id", F.col("node").alias("b")), "text_id").where("a <> b").select("a", "b")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    C.bound_batches(docs.sparkSession)
    docs = docs.select(F.col(C.sql_name(doc_id)).alias("doc_id"), F.col(C.sql_name(text)).cast("string").alias("text"))
    base, classes, found = links(docs, shingle, percent, rows, bands)
    part = components(found, "near-components")
    member = C.stage(classes.select("node", "doc_id", "text_id", F.col("n").alias("rows")).join(part, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-members")
    least = C.stage(member.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-least")
    names = C.join_by_count(member, least, "component", member.count()).select("text_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("rows").alias("n"))
    out = C.join_by_count(base.select("doc_id", "n_shingles", "text_id"), C.stage(names, "near-names"), "text_id", base.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The input rows that stay, all columns: of each group the smallest id."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **how)
    dropped = C.stage(found.where(~F.col("kept")).select("doc_id").distinct(), "near-dropped")
    return part_named(docs, doc_id, dropped, "near-gone")[1].select("row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 1], ' ') AS x FROM d, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.r FROM reach AS r JOIN edge AS e ON e.a = r.doc_id WHERE r.r < e.b),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
