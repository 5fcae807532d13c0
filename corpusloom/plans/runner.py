"""Incremental graph runner: only chunks that were not extracted before go to the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunking, kg, tables
from corpusloom.plans.pipelines import Workspace
from corpusloom.sources.keyed import BUCKETS, KeyedTable, Merge

HISTORY = "history"


def due(chunks: DataFrame, done: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Chunks with text that are not in ``done`` (series, filename, hash), the first ``limit`` by file and index, with their hash."""
    rows = chunks.where(text.strip(F.col("text")) != "")
    rows = rows.withColumn("hash", F.sha1(F.col("text").cast("binary"))) if done is None else chunking.fresh(rows, done)
    return rows if limit is None else rows.orderBy("series", "filename", "idx").limit(limit)


class Runner:
    """Extraction with an append-only history below a workspace, merged into keyed tables.

    A run extracts what is due and upserts its entities, relations and evidence;
    extractions of earlier runs are not read again, only their keys.  Names of
    relation ends are looked up among all entities known by then.  The history
    is written last: a run that dies before leaves its chunks due, and merging
    them again changes nothing.  Replies that could not be read are recorded
    too, but their chunks stay due.
    """

    def __init__(self, work: Workspace, reply: Callable[[str], str] = kg.rule_extractor, *, min_conf: float = 0.35, buckets: int = BUCKETS):
        self.work, self.reply, self.min_conf, self.buckets = work, reply, min_conf, buckets
        self.path = f"{work.path}/{HISTORY}"

    def _stored(self, path: str) -> DataFrame | None:
        spark = self.work.spark
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return spark.read.parquet(path) if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else None

    def history(self) -> DataFrame | None:
        """All extractions so far; null before the first."""
        return self._stored(self.path)

    def _upsert(self, name: str, rows: DataFrame, merge: Merge) -> DataFrame:
        table = KeyedTable.open(self.work.spark, f"{self.work.path}/{name}", "id", self.buckets)
        return table.upsert(rows, merge).rows(merge)

    def run(self, chunks: DataFrame, *, limit: int | None = None) -> dict[str, DataFrame | int]:
        """Extract what is due, merge it, and give the linked graph of all extractions."""
        before = self.history()
        done = None if before is None else before.where("error IS NULL")
        fresh = self.work.save(due(chunks, done, limit), "due")
        hashes = fresh.select("cid", "hash")
        extracted = self.work.save(kg.extract(fresh.drop("hash"), self.reply).join(hashes, "cid").withColumn("ts", F.current_timestamp()), "extracted")
        raw = self.work.save(self._upsert("entities", kg.canonical_nodes(extracted, self.min_conf), tables.upsert_entities), "nodes_raw")
        links = self._upsert("relations", kg.canonical_edges(extracted, raw, self.min_conf), kg.upsert_edges)
        kg.evidence(extracted, self.min_conf).write.mode("append").parquet(f"{self.path}_evidence")
        extracted.write.mode("append").parquet(self.path)
        mapping = self.work.save(kg.id_map(raw), "id_map")
        nodes = self.work.save(tables.upsert_entities(None, kg.link_nodes(raw, mapping)), "nodes")
        edges = self.work.save(tables.upsert_relations(None, kg.remap_edges(links, mapping), nodes), "edges")
        evidence = self._stored(f"{self.path}_evidence").distinct()
        mentions = self.work.save(tables.link_evidence(kg.map_evidence(evidence, mapping), chunks), "mentions")
        return {"extracted": fresh.count(), "errors": extracted.where("error IS NOT NULL").count(), "nodes": nodes, "edges": edges, "mentions": mentions, "quality": kg.quality(nodes, edges)}
