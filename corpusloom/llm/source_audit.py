"""Source divergence audit: how far the sources of a language differ, and by which terms.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII.
Per language the terms of enough documents are kept; a group (language,
source), and the language as a whole, gives each kept term a smoothed share in
billionths, in whole numbers, and the divergence of two shares p and q is
``floor((p - q)^2 / (p + q))``.

1. :func:`term_counts`: a task encodes a run of texts as numbers of its own
   sorted term array and counts by ``bincount`` over (group, term), so each
   distinct term of a run leaves as one row for each of its groups.
2. :func:`kept_terms` sums these rows and keeps what enough documents hold.
3. Kept rows are sorted by language and term over ranges.  A task cuts its
   range into chunks, each one sorted term array: ``searchsorted`` gives the
   ids, counts become dense vectors, a row for each source, and since ids are
   in the order of the UTF-8 bytes, equal values are ordered by id.  Sums over
   a chunk's terms and its first terms are all that leaves it.

No task needs all terms of a language.  Sources of a language are held as the
rows of a chunk: their number is checked, at most ``MAX_SOURCES`` for a
language and ``MAX_GROUPS`` in all, since the report itself has a row for
every two of them; beyond that it raises.

Edge cases: null text, language and source count as empty; a document without
terms still makes its group occur; a language without kept terms gives pairs of
value 0 and no terms; a language with one source gives no pairs; documents that
repeat count each; an empty table gives an empty report; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: Documents that must hold a kept term, terms of a group that are reported, and the unit of shares.
MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Sources of a language, and groups in all; checked.
MAX_SOURCES, MAX_GROUPS = 4096, 1 << 17
#: Shares of a group's nominated terms.
SHARES = 32
#: Text that is encoded together, and cells of a chunk's dense vectors.
RUN_BYTES, CELLS = 12 << 20, 1 << 20

#: Lower-cases A-Z and turns every other byte outside a-z and 0x80-0xFF to a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def named(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, text) without nulls."""
    return docs.select(*[F.coalesce(F.col(C.sql_name(c)).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def encoded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(sorted terms, id of each term in its place, number of terms of each text)."""
    lists = [t.translate(LETTERS).split() for t in texts]
    terms = sorted(set(chain.from_iterable(lists)))
    index = {t: i for i, t in enumerate(terms)}
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return terms, np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum())), n


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) by runs of texts: occurrences, and documents with the term."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        texts, of, size = [], [], 0

        def counted() -> pa.RecordBatch:
            terms, ids, n = encoded(texts)
            width = max(1, len(terms))
            place = np.repeat(np.arange(len(texts)) * width, n) + ids  # one number for (document, term)
            place, times = np.unique(place, return_counts=True)
            key = np.array(of, np.int64)[place // width] * width + place % width
            used, at = np.unique(key, return_inverse=True)
            total, docs_ = np.bincount(at, weights=times, minlength=len(used)).astype(np.int64), np.bincount(at, minlength=len(used))
            names = list(groups)
            langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            group = pa.array(used // width)
            return pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(used % width)), pa.array(total), pa.array(docs_.astype(np.int64))], ["lang", "source", "term", "n", "docs"])

        for batch, part in C.batches_of(it):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), part, strict=True):
                of.append(groups.setdefault((lang, source), len(groups)))
                texts.append(text)
                size += len(text)
                if size >= RUN_BYTES:
                    yield counted()
                    groups, texts, of, size = {}, [], [], 0
        yield counted()

    return docs.mapInArrow(C.lean(run), "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, first) of the terms in at least ``min_docs`` documents of their language; ``first`` marks one row of each term."""
    rows = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    rows = rows.withColumn("all", F.sum("docs").over(of)).withColumn("first", F.min("source").over(of) == F.col("source"))
    return rows.where(F.col("all") >= min_docs).select("lang", "source", "term", "n", "first")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total), exact: long division in steps of a thousand."""
    out, rest = np.divmod(count, total)
    for _ in range(3):  # UNIT is a thousand thrice
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _chunks(it: Iterator[pa.RecordBatch], sources: dict[str, int]) -> Iterator[tuple[str, list, list]]:
    """(lang, sorted terms, rows (term, source, n)) of as many terms as ``CELLS`` allows; rows come sorted."""
    lang, terms, rows = None, [], []
    for batch in it:
        for at, term, source, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "source", "n")), strict=True):
            new = not terms or term != terms[-1]
            if at != lang or (new and len(terms) >= max(1, CELLS // sources[at])):
                if terms:
                    yield lang, terms, rows
                lang, terms, rows, new = at, [], [], True
            if new:
                terms.append(term)
            rows.append((term, source, n))
    if terms:
        yield lang, terms, rows


def _first(value: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` greatest values, smaller places first among equals."""
    at = np.arange(len(value))
    if len(value) > top:
        at = np.flatnonzero(value >= np.partition(value, len(value) - top)[len(value) - top])
    return at[np.lexsort((at, -value[at]))][:top]


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank; see the module."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    rows = named(docs, lang, source, text)
    kept = C.stage(kept_terms(term_counts(rows), min_docs), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = C.stage(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, "total"), "groups")
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).head()
    if (most[0] or 0) > MAX_SOURCES or (most[1] or 0) > MAX_GROUPS:
        raise ValueError(f"{most[0]} sources in a language, {most[1]} groups: more than {MAX_SOURCES} and {MAX_GROUPS}")
    sizes = {r["lang"]: r["v"] for r in kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("v")).collect()}  # fewer than MAX_GROUPS
    known: dict[str, dict[str, int]] = {}
    for r in groups.orderBy("lang", "source").collect():
        known.setdefault(r["lang"], {})[r["source"]] = r["total"]
    shared = spark.sparkContext.broadcast((known, sizes))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        sums: dict[str, np.ndarray] = {}
        for at, terms, found in _chunks(it, {k: len(v) for k, v in known.items()}):
            names, total = np.array(list(known[at]), object), np.array(list(known[at].values()), np.int64)
            array = np.array([t.encode() for t in terms], object)
            ids = np.searchsorted(array, np.array([t.encode() for t, _, _ in found], object))
            of = np.searchsorted(names, np.array([s for _, s, _ in found], object))
            count = np.zeros((len(names), len(terms)), np.int64)
            count[of, ids] = [n for _, _, n in found]  # each (source, term) is one row
            size = 2 * sizes[at]
            p = shares(count + 2, (total + size)[:, None])
            q = shares(count.sum(axis=0) + 2, total.sum() + size)
            pair = sums.setdefault(at, np.zeros((len(names), len(names)), np.int64))
            out = []
            for g in range(len(names)):
                pair[g, g + 1 :] += divergence(p[g], p[g + 1 :]).sum(axis=1)
                more = np.flatnonzero((count[g] > 0) & (p[g] > q))
                value = divergence(p[g, more], q[more])
                out += [(at, names[g], "term", terms[more[i]], int(value[i])) for i in _first(value, top)]
            yield _report(out)
        for at, pair in sums.items():
            names = list(known[at])
            for g in range(len(names)):
                yield _report([(at, names[g], "pair", names[h], int(pair[min(g, h), max(g, h)])) for h in range(len(names)) if h != g])

    parts = kept.select("lang", "term", "source", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(C.lean(run), "lang string, source string, part string, item string, value bigint")
    every = groups.groupBy("lang").agg(F.collect_list("source").alias("s")).select("lang", "s", F.explode("s").alias("source")).select("lang", "source", F.lit("pair").alias("part"), F.explode("s").alias("item"), F.lit(0).cast("bigint").alias("value")).where("source <> item")
    parts = C.stage(parts, "parts")
    pairs = parts.where("part = 'pair'").unionByName(every).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = [F.desc("value"), F.col("item")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    # Chunks nominate their first terms, more in all the more chunks there are: ranked in shares before the last step.
    terms, share = parts.where("part = 'term'"), F.pmod(F.xxhash64("item"), F.lit(SHARES))
    nominated = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", share).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    return pairs.withColumn("rank", rank).unionByName(nominated.withColumn("rank", rank).where(F.col("rank") <= top))


def _report(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 4 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["lang", "source", "part", "item", "value"])


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL), c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM c JOIN v USING (lang)),
a AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL), q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM a JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM y UNION ALL FROM z))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
