"""Health phases with timers, and steps from their start and end events.

A key is RUNNING after an event and DEGRADED after a bad one, and becomes
DEGRADED by itself when nothing was heard of it for a while: an event-time
timer fires once the watermark has passed that moment.  Steps are paired by a
stream-stream join with watermarks on both sides; a start whose end does not
come in time leaves the state as expired.

The batch forms beside them (:func:`phases_of`, and :func:`steps` itself on
static tables) give the same rows over a whole history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PHASES = "key bigint, event_id bigint, ts timestamp, phase string"
RUNNING, DEGRADED = "RUNNING", "DEGRADED"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Timers and time to live need the RocksDB store; to be set before such a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Phases(StatefulProcessor):
    """Phase of one key: last phase and time of the last event, and one timer that runs from it."""

    def __init__(self, bad: str, quiet_ms: int):
        self.bad, self.quiet_ms = bad, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("phase", "phase string, last_us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        phase, last = self.state.get() if self.state.exists() else (None, None)
        before, out = last, []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            at = r.ts.value // 1000
            if last is not None and at - last > self.quiet_ms * 1000 and phase != DEGRADED:
                out.append((key[0], None, pd.Timestamp(last + self.quiet_ms * 1000, unit="us"), DEGRADED))
                phase = DEGRADED
            now = DEGRADED if r.event_type == self.bad else RUNNING
            if now != phase:
                out.append((key[0], r.event_id, r.ts, now))
            phase, last = now, at
        self.state.update((phase, last))
        if before is not None:
            self.handle.deleteTimer(self._due(before))
        self.handle.registerTimer(self._due(last))
        yield _frame(out)

    def _due(self, last: int) -> int:
        return -(-last // 1000) + self.quiet_ms

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        phase, last = self.state.get() if self.state.exists() else (None, None)
        if phase == RUNNING:
            self.state.update((DEGRADED, last))
            yield _frame([(key[0], None, pd.Timestamp(last + self.quiet_ms * 1000, unit="us"), DEGRADED)])
        else:
            yield _frame([])

    def close(self) -> None:
        return


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "event_id", "ts", "phase"])
    return out.astype({"key": "int64", "event_id": "Int64", "ts": "datetime64[ns]", "phase": "object"})


def phases(events: DataFrame, *, key: str = "user_id", bad: str = "error", quiet: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Changes of phase of a stream of events (event_id, ts, event_type); a silence of ``quiet`` seconds degrades a key.

    ``event_id`` is null where a timer made the change.  Events later than the
    watermark allows are dropped.
    """
    stream = events.withWatermark("ts", late).groupBy(key)
    return stream.transformWithStateInPandas(Phases(bad, quiet * 1000), PHASES, "Append", "EventTime")


def phases_of(events: DataFrame, *, key: str = "user_id", bad: str = "error", quiet: int = 3600, until=None) -> DataFrame:
    """The same changes from a whole history; ``until`` is the time up to which silences count, all of them by default."""
    own = Window.partitionBy(key).orderBy("ts", "event_id")
    phase = F.when(F.col("event_type") == bad, DEGRADED).otherwise(RUNNING)
    rows = events.select(F.col(key).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), phase.alias("phase"), F.lead("ts").over(own).cast("timestamp").alias("next"))
    silent = F.col("ts") + F.make_interval(secs=F.lit(quiet))
    end = F.col("next").isNull() if until is None else F.col("next").isNull() & (silent < F.lit(until).cast("timestamp"))
    quiet_ = rows.where((F.col("next") > silent) | end).select("key", F.lit(None).cast("bigint").alias("event_id"), silent.alias("ts"), F.lit(DEGRADED).alias("phase"))
    every = rows.select("key", "event_id", "ts", "phase").unionByName(quiet_)
    before = F.lag("phase").over(Window.partitionBy("key").orderBy("ts", F.col("event_id").asc_nulls_last()))
    return every.withColumn("before", before).where("before IS NULL OR before <> phase").drop("before")


def steps(starts: DataFrame, ends: DataFrame, *, limit: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(step, start_ts, end_ts, ms, state) of start and end events (step, ts); streams or tables.

    An end belongs to a start of the same step at most ``limit`` seconds
    before it.  A start without one is ``expired``, as soon as the watermarks of
    both sides say that no end can come any more, and leaves the state.
    """
    a = starts.select(F.col("step").alias("step"), F.col("ts").cast("timestamp").alias("start_ts"))
    b = ends.select(F.col("step").alias("end_step"), F.col("ts").cast("timestamp").alias("end_ts"))
    if starts.isStreaming:
        a, b = a.withWatermark("start_ts", late), b.withWatermark("end_ts", late)
    when = (F.col("step") == F.col("end_step")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {int(limit)} SECONDS"))
    joined = a.join(b, when, "left_outer")
    ms = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000
    return joined.select("step", "start_ts", "end_ts", ms.alias("ms"), F.when(F.col("end_ts").isNull(), "expired").otherwise("done").alias("state"))
