"""Keyed upserts of the graph tables, as associative aggregates over snapshots.

Each function merges a snapshot with new rows; every column is a monoid, so
the result does not depend on the order or the number of batches, and the same
code runs inside ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ALIASES, MAX_DESC, MAX_CIDS = 20, 500, 200


def union_of(column: str, limit: int | None = None) -> Column:
    """Sorted distinct elements of an array column over a group."""
    out = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(column, F.array().cast("array<string>"))))))
    return F.slice(out, 1, limit) if limit else out


def longest_text(column: str) -> Column:
    """The longest value, the smallest of equally long ones."""
    value = F.coalesce(F.col(column), F.lit(""))
    return F.min_by(value, F.struct((-F.length(value)).alias("n"), value.alias("v")))


def first_elements(rows: DataFrame, key: str, column: str, limit: int) -> DataFrame:
    """The ``limit`` smallest distinct elements of an array column per key.

    Elements are made distinct and ranked before they are gathered, so a key
    with a third of all rows never brings more than ``limit`` from each task.
    """
    each = rows.select(key, F.explode(column).alias("x")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("x"))
    return each.withColumn("rank", rank).where(F.col("rank") <= limit).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias(column))


def _with_sets(merged: DataFrame, rows: DataFrame, **limits: int) -> DataFrame:
    for column, limit in limits.items():
        sets = first_elements(rows, "id", column, limit)
        merged = merged.join(sets, "id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return merged


def _both(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def upsert_chunks(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Chunk nodes by cid: the latest row wins, a null vector keeps the stored one.

    ``old`` and ``new`` carry a version column ``ts``.
    """
    rows = _both(old, new)
    others = [c for c in rows.columns if c not in ("cid", "embedding")]
    return rows.groupBy("cid").agg(*[F.max_by(c, "ts").alias(c) for c in others], F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("ts"))).alias("embedding"))


def upsert_entities(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Entities by id: union of aliases and cids, longest description, greatest confidence."""
    rows = _both(old, new)
    merged = rows.groupBy("id").agg(F.min("series").alias("series"), F.min("name").alias("name"), F.min("type").alias("type"), F.substring(longest_text("desc"), 1, MAX_DESC).alias("desc"), F.max("conf").alias("conf"))
    return _with_sets(merged, rows, aliases=MAX_ALIASES, cids=MAX_CIDS).select("id", "series", "name", "type", "aliases", "desc", "cids", "conf")


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    own = nodes.select(F.col("id").alias("src_id")).distinct()
    return edges.join(own, "src_id", "left_semi").join(own.withColumnRenamed("src_id", "dst_id"), "dst_id", "left_semi")


def upsert_relations(old: DataFrame | None, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by id: dangling ones go, union of cids, greatest confidence, weight 1 by default."""
    rows = with_endpoints(_both(old, new), nodes)
    if "weight" not in rows.columns:
        rows = rows.withColumn("weight", F.lit(1.0))
    merged = rows.groupBy("id").agg(F.min("series").alias("series"), F.min("src_id").alias("src_id"), F.min("dst_id").alias("dst_id"), F.min("pred").alias("pred"), F.max("conf").alias("conf"), F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    return _with_sets(merged, rows, cids=MAX_CIDS).select("id", "series", "src_id", "dst_id", "pred", "cids", "conf", "weight")


def link_mentions(nodes: DataFrame, chunks: DataFrame, kind: str = "MENTIONED_IN") -> DataFrame:
    """(entity_id, cid, page, kind) for every cid that an entity's array names and that exists."""
    return link_evidence(nodes.select(F.col("id").alias("entity_id"), F.explode("cids").alias("cid")), chunks, kind)


def link_evidence(evidence: DataFrame, chunks: DataFrame, kind: str = "MENTIONED_IN") -> DataFrame:
    """The same from rows (entity_id, cid), which no cap on the stored arrays has shortened."""
    each = evidence.select("entity_id", "cid").distinct()
    page = F.col("page") if "page" in chunks.columns else F.lit(None).cast("int").alias("page")
    return each.join(chunks.select("cid", page), "cid").select("entity_id", "cid", "page", F.lit(kind).alias("kind")).distinct()


def duplicates(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once: the uniqueness constraint as a query."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def collision_names(files: DataFrame) -> DataFrame:
    """Names made unique within a series: the second ``a.txt`` becomes ``a__1.txt``."""
    w = Window.partitionBy("series", "filename").orderBy("seq")
    n = F.row_number().over(w) - 1
    stem, ext = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"(\.[^.]*)$", 1)
    return files.withColumn("stored_name", F.when(n == 0, F.col("filename")).otherwise(F.concat(stem, F.lit("__"), n.cast("string"), ext)))


def merge_series(files: DataFrame, sources: list[str], dest: str) -> DataFrame:
    """Files of several series under one name, collisions renamed."""
    merged = files.where(F.col("series").isin([*sources, dest])).withColumn("series", F.lit(dest))
    return collision_names(merged)
