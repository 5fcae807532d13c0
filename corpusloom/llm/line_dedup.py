"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

Lines are what newlines separate.  A rolling hash over the hashes of the last
``window`` lines puts every line into one of ``classes`` classes, and each class
cuts the text on its own: its lines end chunks, of ``classes`` lines on average.
Whether a line ends a chunk depends on the window alone, so equal runs of lines
are cut alike wherever they stand; and since every line ends a chunk in some
class, a run of some more than ``window + classes`` lines hardly ever lacks two
ends of one class, that is a whole chunk (recall by length in the README).

A chunk with at least two lines that are not blank, which occurs more than once
in all documents, is removed everywhere but at its first place (smallest
doc_id, then smallest position).  The first place of a line in all documents is
never removed, so nothing is lost from the whole.

Digests and places of chunks travel first; chunks whose digest repeats are then
fetched from their texts and compared byte by byte: the group key holds the text
itself beside its digest, and a hash aggregate combines equal chunks in each task
before they are shuffled, so a chunk that fills a third of all rows leaves each
task once.  Where a chunk is joined with its first place, digests that may be
hot are broadcast.

Edge cases: null counts as empty; an empty text has no line; a text of one
line has no chunk of two and stays; texts of any length are cut whole; a row
with a null doc_id comes after all others; rows alike in doc_id and text share
one result, that of the row that holds the first places.  A digest that two
different chunk texts share removes nothing.  Other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C

#: Lines in the rolling hash, and classes that it puts lines into: the mean length of a chunk.
WINDOW, CLASSES = 3, 4
#: Modulus of line hashes: the sum of a few products stays within a bigint.
MODULUS, BASE = 2147483647, 48271


def line_hash(line: str) -> str:
    """28 bits of the line's md5, the same in any SQL engine."""
    return f"cast(conv(substr(md5(cast({line} AS binary)), 1, 7), 16, 10) AS bigint)"


def line_classes(hashes: str, window: int = WINDOW, classes: int = CLASSES) -> str:
    """SQL: the class of every line, by the rolling hash that ends with it."""
    rolled = " + ".join(f"coalesce(try_element_at({hashes}, nullif(greatest(i - {j}, 0), 0)), 0L) * {pow(BASE, j, MODULUS)}L % {MODULUS}L" for j in range(window))
    return f"transform(sequence(1, size({hashes})), i -> cast(({rolled}) % {MODULUS}L % {classes} AS int))"


def _digest(text: str) -> str:
    """SQL: 128 bits of the text's SHA-256."""
    return f"substring(unhex(sha2({text}, 256)), 1, 16)"


def _chunks_of(one: int) -> tuple[str, str]:
    """SQL: last lines of the chunks of one class, and the chunks: first line, lines, digest where two lines are not blank.  The last line ends a chunk of every class."""
    ends = f"filter(sequence(1, size(lines)), i -> i = size(lines) OR element_at(class, i) = {one})"
    before = f"coalesce(try_element_at(ends{one}, nullif(i, 0)), 0)"
    text = f"array_join(slice(lines, {before} + 1, e - {before}), '\n')"
    solid = f"size(filter(slice(solid, {before} + 1, e - {before}), f -> f))"
    return ends, f"transform(ends{one}, (e, i) -> named_struct('first', {before} + 1, 'lines', e - {before}, 'digest', IF({solid} >= 2, {_digest(text)}, NULL)))"


def chunked(docs: DataFrame, window: int = WINDOW, classes: int = CLASSES) -> DataFrame:
    """``docs`` with one row (first, lines, digest) for every chunk of two solid lines of their ``text``."""
    df = docs.where(F.length("text") > 0).withColumn("lines", F.split("text", "\n", -1)).where(F.size("lines") > 1).drop("text")
    df = df.withColumn("hashes", F.expr(f"transform(lines, x -> {line_hash('x')})")).withColumn("solid", F.expr("transform(lines, x -> x RLIKE '[^ \\t-\\r]')"))
    df = df.withColumn("class", F.expr(line_classes("hashes", window, classes))).drop("hashes")
    for one in range(classes):
        df = df.withColumn(f"ends{one}", F.expr(_chunks_of(one)[0]))
    parts = [F.expr(f"filter({_chunks_of(one)[1]}, c -> c.digest IS NOT NULL)") for one in range(classes)]
    # A chunk without ends inside belongs to several classes.
    return df.select(*[c for c in docs.columns if c != "text"], F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("c")).select(*[c for c in docs.columns if c != "text"], "c.*")


def remove_repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, window: int = WINDOW, classes: int = CLASSES) -> DataFrame:
    """``row``, ``n_lines``, ``removed`` (numbers of the removed lines, from 1) and ``kept`` text."""
    cols = docs.columns if carry is None else carry
    body = F.coalesce(F.col(C.sql_name(text)).cast("string"), F.lit(""))
    own = F.col(C.sql_name(doc_id))
    uid = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(own.cast("string"), F.lit("")), own.isNull().cast("string"), body).cast("binary"))).alias("uid")
    df = docs.select(F.struct(*[F.col(C.sql_name(c)) for c in cols]).alias("row"), uid, own.alias("doc_id"), body.alias("text"))
    places = C.stage(chunked(df.select("uid", "doc_id", "text"), window, classes), "line-places")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "first")
    keep = C.stage(places.groupBy("digest").agg(F.min(at).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "line-first")
    again = C.stage(C.join_by_count(places.drop("doc_id"), keep, "digest", places.count(), "inner").select("uid", "first", "lines", "digest", ((F.col("uid") == F.col("keep.uid")) & (F.col("first") == F.col("keep.first"))).alias("stays")), "line-again")
    # Repeated chunks of a text, to be read from it: as many as it has lines, times the classes, at most.
    asked = again.groupBy("uid").agg(F.collect_set(F.struct("first", "lines", "digest")).alias("asked"))
    texts = df.select("uid", F.split("text", "\n", -1).alias("of")).join(asked.hint("merge"), "uid").select("of", F.explode("asked").alias("c"))
    texts = texts.select("c.digest", F.expr("array_join(slice(of, c.first, c.lines), '\n')").alias("chunk"))
    equal = texts.groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))  # by the bytes
    equal = C.stage(equal.where("texts = 1").select("digest", "n"), "line-equal")
    gone = C.join_by_count(again.where("NOT stays"), equal, "digest", again.count(), "inner")
    gone = gone.select("uid", F.explode(F.sequence("first", F.col("first") + F.col("lines") - 1)).alias("line")).distinct().groupBy("uid").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    # Merged by sort whatever the size is: the plan, and so its cost, is that of a large table.
    out = df.join(C.stage(gone, "line-gone").hint("merge"), "uid", "left")
    lines = F.when(F.length("text") > 0, F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>"))
    out = out.select("row", "text", lines.alias("lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.expr("transform(array_except(sequence(1, size(lines)), removed), i -> lines[i - 1])"), "\n"))
    return out.select("row", F.size("lines").cast("bigint").alias("n_lines"), "removed", kept.alias("kept"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    return out.select("row.doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_lines_removed"), F.sha2("kept", 256).alias("kept_sha256"))


_HASH = "CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)"
_LINE = "regexp_matches(x, '[^ \\t-\\r]')"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
line AS (SELECT rid, doc_id, q, l[q] AS x, len(l) AS n FROM d, unnest(generate_series(1, len(l))) AS u(q)),
h AS (SELECT *, {_HASH} AS v, {_LINE} AS solid FROM line),
e AS (SELECT *, ({" + ".join(f"coalesce(lag(v, {j}) OVER w, 0) * {pow(BASE, j, MODULUS)} % {MODULUS}" for j in range(WINDOW))}) % {MODULUS} % {CLASSES} AS class FROM h WINDOW w AS (PARTITION BY rid ORDER BY q)),
c AS (SELECT e.*, r, coalesce(sum(CASE WHEN q = n OR class = r THEN 1 ELSE 0 END) OVER (PARTITION BY rid, r ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM e, generate_series(0, {CLASSES - 1}) AS u(r)),
run AS (SELECT DISTINCT rid, doc_id, a, b, s FROM (SELECT rid, doc_id, min(q) AS a, max(q) AS b, string_agg(x, chr(10) ORDER BY q) AS s, count(*) FILTER (solid) AS k FROM c GROUP BY rid, doc_id, r, i) WHERE k >= 2),
gone AS (SELECT rid, a, b FROM run QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, rid, a) > 1),
cut AS (SELECT DISTINCT rid, q FROM gone, unnest(generate_series(a, b)) AS u(q)),
kept AS (SELECT rid, string_agg(x, chr(10) ORDER BY q) AS s FROM line ANTI JOIN cut USING (rid, q) GROUP BY rid),
n AS (SELECT rid, count(*) AS lines FROM cut GROUP BY rid)
SELECT doc_id, len(l) AS n_lines, CAST(coalesce(lines, 0) AS BIGINT) AS n_lines_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""
