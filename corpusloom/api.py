"""The engine as a service sees it: checked requests, tools, steps, events, health and a query log.

Plain functions and dataclasses; an HTTP or tool server only has to route to
them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import chunking
from corpusloom.plans import pipelines
from corpusloom.schemas import ChunkOptions, SearchRequest

# Bounds of chunk requests.
CHUNK_SIZE, CHUNK_OVERLAP = (50, 8000), (0, 4000)
# Parameters of the question tool, with their types, defaults and bounds.
QUESTION_TOOL = {
    "series": {"type": "string"},
    "query": {"type": "string"},
    "mode": {"type": "string", "enum": ["auto", "graph", "path", "vector"], "default": "auto"},
    "budgets": {"type": "object"},
    "k": {"type": "integer", "default": 12, "minimum": 1},
    "n": {"type": "integer", "default": 30, "minimum": 5},
    "alpha": {"type": "number", "default": 0.8, "minimum": 0.0, "maximum": 1.0},
    "theta": {"type": "number", "default": 0.05, "minimum": 0.0, "maximum": 1.0},
}
_TYPES = {"string": str, "object": dict, "integer": int, "number": (int, float)}


def chunk_options(strategy: str = "sentence", size: int = 800, overlap: int = 150) -> ChunkOptions:
    """Options of a chunk request, refused outside the bounds of the service."""
    for name, value, (low, high) in (("size", size, CHUNK_SIZE), ("overlap", overlap, CHUNK_OVERLAP)):
        if not low <= value <= high:
            raise ValueError(f"{name} must be from {low} to {high}")
    return ChunkOptions(strategy, size, overlap)


def checked(spec: dict[str, dict], required: tuple[str, ...], values: dict[str, Any]) -> dict[str, Any]:
    """``values`` with defaults, or an error that names the first parameter that breaks the spec."""
    for name in required:
        if values.get(name) in (None, ""):
            raise ValueError(f"{name} is required")
    out = {}
    for name, rule in spec.items():
        value = values.get(name, rule.get("default"))
        if value is None:
            continue
        if not isinstance(value, _TYPES[rule["type"]]) or isinstance(value, bool):
            raise ValueError(f"{name} must be of type {rule['type']}")
        if "enum" in rule and value not in rule["enum"]:
            raise ValueError(f"{name} must be one of {', '.join(rule['enum'])}")
        if ("minimum" in rule and value < rule["minimum"]) or ("maximum" in rule and value > rule["maximum"]):
            raise ValueError(f"{name} is out of bounds")
        out[name] = value
    if unknown := sorted(set(values) - set(spec)):
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")
    return out


@dataclass
class Tools:
    """Named tools over one workspace: what a model may call."""

    spark: SparkSession
    chunks: DataFrame
    tables: dict[str, DataFrame]
    reply: Callable[[str], str]

    def specs(self) -> list[dict]:
        return [
            {"name": "query", "input": {"type": "object", "properties": QUESTION_TOOL, "required": ["series", "query"]}},
            {"name": "search", "input": {"type": "object", "properties": {"query": {"type": "string"}, "mode": {"type": "string", "enum": ["kg", "dense", "hybrid"], "default": "hybrid"}, "k": {"type": "integer", "default": 6, "minimum": 1}, "series": {"type": "string"}}, "required": ["query"]}},
            {"name": "ping", "input": {"type": "object", "properties": {}, "required": []}},
        ]

    def call(self, name: str, **values) -> Any:
        spec = next((s["input"] for s in self.specs() if s["name"] == name), None)
        if spec is None:
            raise KeyError(f"unknown tool {name}")
        values = checked(spec["properties"], tuple(spec["required"]), values)
        return getattr(self, f"_{name}")(**values)

    def _query(self, series: str, query: str, **options) -> dict:
        of = lambda df: df.where(df["series"] == series) if "series" in df.columns else df
        return {"series": series} | pipelines.ask(query, tables_={k: of(v) for k, v in self.tables.items()}, chunks=of(self.chunks), reply=self.reply, **options)

    def _search(self, **request) -> DataFrame:
        return pipelines.retrieve(SearchRequest(**request), nodes=self.tables["nodes"], chunks=self.chunks, mentions=self.tables.get("mentions"))

    def _ping(self) -> dict:
        return health(self.spark)


def health(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> dict:
    """Whether the session answers, how fast, and which tables can be read."""
    began, out = time.time(), {"status": "up", "version": spark.version, "tables": {}}
    try:
        spark.range(1).count()
    except Exception as e:
        return {"status": "down", "error": type(e).__name__}
    out["latency_ms"] = int((time.time() - began) * 1000)
    for name, df in (tables or {}).items():
        try:
            out["tables"][name] = "empty" if df.isEmpty() else "ok"
        except Exception as e:
            out["tables"][name] = f"error: {type(e).__name__}"
            out["status"] = "degraded"
    return out


class Events:
    """Bounded queues to one client: status before steps before log lines; log lines are dropped when full, the others never."""

    KINDS = ("status", "step", "log")

    def __init__(self, size: int = 1000):
        self.queues = {"status": deque(), "step": deque(), "log": deque(maxlen=size)}
        self.dropped = 0

    def put(self, kind: str, **data) -> None:
        queue = self.queues[kind]
        self.dropped += queue.maxlen is not None and len(queue) == queue.maxlen
        queue.append({"kind": kind, "ts": time.time()} | data)

    def next(self) -> dict:
        """The most urgent event, or a ping where there is none."""
        for kind in self.KINDS:
            if self.queues[kind]:
                return self.queues[kind].popleft()
        return {"kind": "ping", "ts": time.time()}

    def lines(self, until: Callable[[], bool]) -> Iterator[str]:
        """The stream as a client reads it, one JSON line per event, until ``until`` says so and all is sent."""
        while not until() or any(self.queues.values()):
            yield f"data: {json.dumps(self.next())}\n\n"


@dataclass
class Orchestrator:
    """Named steps in order over one state, each reported as it starts, ends or fails."""

    steps: list[tuple[str, Callable[[dict], dict | None]]]
    events: Events = field(default_factory=Events)

    def run(self, state: dict | None = None, *, series: str = "") -> dict:
        state = dict(state or {})
        for name, step in self.steps:
            began = time.time()
            self.events.put("step", series=series, step=name, phase="start")
            try:
                state |= step(state) or {}
            except Exception as e:
                self.events.put("step", series=series, step=name, phase="error", msg=f"{type(e).__name__}: {e}", ms=(time.time() - began) * 1000)
                raise
            self.events.put("step", series=series, step=name, phase="end", ms=(time.time() - began) * 1000)
        return state


def chunk_step(o: ChunkOptions | None = None) -> Callable[[dict], dict]:
    """A step that turns ``docs`` of the state into ``chunks``."""
    return lambda state: {"chunks": chunking.document_chunks(state["docs"], o)}


class QueryLog:
    """Statements that were run, as JSON lines below a shared folder; every entry is a file of its own, so writers never meet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def run(self, sql: str, **args) -> DataFrame:
        began, error = time.time(), None
        try:
            return self.spark.sql(sql, args=args or None)
        except Exception as e:
            error = type(e).__name__
            raise
        finally:
            self.write({"sql": sql, "args": {k: str(v) for k, v in args.items()}, "ms": (time.time() - began) * 1000, "error": error})

    def write(self, entry: dict) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}.jsonl")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
        try:
            out.write(bytearray((json.dumps(entry | {"ts": time.time()}) + "\n").encode()))
        finally:
            out.close()

    def read(self) -> DataFrame:
        return self.spark.read.schema("ts double, sql string, args map<string,string>, ms double, error string").json(self.path)
