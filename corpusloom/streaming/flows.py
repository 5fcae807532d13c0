"""Structured Streaming: incremental ingestion, upserts, step events and status changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import chunking
from corpusloom.schemas import ChunkOptions
from corpusloom.sources.keyed import BUCKETS, KeyedTable

EVENT = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, path: str, schema: str = EVENT, *, files: int = 1) -> DataFrame:
    """Stream of the parquet files of a folder, a few files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def new_chunks(docs: DataFrame, o: ChunkOptions | None = None, *, time: str = "ts", within: str | None = None) -> DataFrame:
    """Chunks of streamed documents whose (series, file, hash of text) was not seen before.

    Every key ever seen stays in the state, because a file may come back at any
    time; with ``within``, the age of events in ``time`` after which a key may
    be forgotten, the state is bounded.
    """
    if within:
        docs = docs.withWatermark(time, within)
    chunks = chunking.document_chunks(docs, o, keep=(time,) if within else ()).withColumn("hash", F.sha1(F.col("text").cast("binary")))
    key = ["series", "filename", "hash"]
    return chunks.dropDuplicatesWithinWatermark(key) if within else chunks.dropDuplicates(key)


def upsert_sink(spark: SparkSession, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], *, key: str = "id", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into a keyed table below ``path``.

    What a batch writes follows the batch, not the table (see
    :mod:`corpusloom.sources.keyed`); one that is run again counts once, since
    the table knows the last batch it holds.  A table belongs to one stream.
    """

    def write(batch: DataFrame, n: int) -> None:
        KeyedTable.open(spark, path, key, buckets).upsert(batch, merge, n)

    return write


def windowed(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event time; later events than the watermark allows are dropped by design."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def status_changes(events: DataFrame, *, key: str = "user_id", bad: str = "error") -> DataFrame:
    """Phase of each key, DEGRADED after a bad event and RUNNING after any other; a row only where it changes."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            now = "DEGRADED" if r.event_type == bad else "RUNNING"
            if now != phase:
                out.append((k[0], r.event_id, r.ts, now))
            phase = now
        state.update((phase,))
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "phase"])

    return events.groupBy(key).applyInPandasWithState(run, "key bigint, event_id bigint, ts timestamp, phase string", "phase string", "append", GroupStateTimeout.NoTimeout)


def latest(events: DataFrame, *, key: str = "user_id") -> DataFrame:
    """Latest event of each key: a monoid, so it is also the state of a stream."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))


def step_durations(events: DataFrame, *, start: str = "view", end: str = "purchase") -> DataFrame:
    """Milliseconds from each start event to the next end event of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    ends = F.when(F.col("event_type") == end, F.col("ts"))
    df = events.withColumn("end_ts", F.first(ends, ignorenulls=True).over(w)).where((F.col("event_type") == start) & F.col("end_ts").isNotNull())
    micros = F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return df.select("user_id", "event_id", (micros / 1000).alias("ms"))
