"""A log of what was executed: plan, duration, rows and failure of every query of a session.

Spark tells a listener of each action when it has ended, so durations are those
of the execution, not of the analysis, and a query that fails while it runs is
logged as such.  Entries are kept until :meth:`ExecutionLog.flush` writes them as
one file of JSON lines in a shared folder.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ts double, action string, ms double, rows bigint, plan string, error string, message string"
#: Characters of a plan and of a message that are kept, and entries that are held before a file is written.
PLAN_CHARS, HELD = 4000, 500


class _Listener:
    def __init__(self, add):
        self.add = add

    def onSuccess(self, action, execution, nanos):  # noqa: N802
        self.add(action, execution, nanos / 1e6, None)

    def onFailure(self, action, execution, error):  # noqa: N802
        self.add(action, execution, None, error)

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]


class ExecutionLog:
    """Executions of one session, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._entries: list[dict] = []
        self._lock = threading.Lock()

    @contextlib.contextmanager
    def listening(self) -> Iterator[ExecutionLog]:
        """Log what is executed inside; written at the end, whatever happens."""
        ensure_callback_server_started(self.spark.sparkContext._gateway)
        listener, manager = _Listener(self._add), self.spark._jsparkSession.listenerManager()
        manager.register(listener)
        try:
            yield self
        finally:
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            manager.unregister(listener)
            self.flush()

    def _add(self, action, execution, ms, error) -> None:
        entry = {"ts": time.time(), "action": str(action), "ms": ms}
        with contextlib.suppress(Exception):  # a plan that cannot be read must not stop the listener
            plan = execution.executedPlan()
            entry["plan"] = plan.toString()[:PLAN_CHARS]
            entry["rows"] = _rows(plan)
        if error is not None:
            entry |= {"error": error.getClass().getSimpleName(), "message": str(error.getMessage())[:PLAN_CHARS]}
            with contextlib.suppress(Exception):
                entry["ms"] = execution.tracker().phases().apply("execution").durationMs()
        with self._lock:
            self._entries.append(entry)
            full = len(self._entries) >= HELD
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            entries, self._entries = self._entries, []
        if not entries:
            return
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}.jsonl")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
        try:
            out.write(bytearray("".join(json.dumps(e) + "\n" for e in entries).encode()))
        finally:
            out.close()

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.path)


def _rows(plan) -> int | None:
    """Rows of the topmost operator that counts them."""
    while plan is not None:
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.executedPlan()
            continue
        if plan.nodeName() in ("ResultQueryStage", "ShuffleQueryStage", "BroadcastQueryStage"):
            plan = plan.plan()
            continue
        metric = plan.metrics().get("numOutputRows")
        if metric.isDefined():
            return metric.get().value()
        plan = plan.children().apply(0) if plan.children().size() else None
    return None
