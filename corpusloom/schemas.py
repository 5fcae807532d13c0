"""Schemas of the tables that stages hand to each other, as Spark DDL."""

from __future__ import annotations

from dataclasses import dataclass, field

DOCUMENT = "series STRING, filename STRING, path STRING, size BIGINT, mime STRING, sha256 STRING, meta MAP<STRING,STRING>"
BBOX = "STRUCT<x0:DOUBLE,y0:DOUBLE,x1:DOUBLE,y1:DOUBLE>"
TEXT_BLOCK = f"series STRING, filename STRING, page INT, `order` INT, text STRING, bbox {BBOX}, lang STRING, meta MAP<STRING,STRING>, text_len INT"
CHUNK = "series STRING, filename STRING, idx INT, cid STRING, text STRING, page INT, strategy STRING, btype STRING, source STRING"
CHUNK_NODE = "cid STRING, series STRING, file STRING, page INT, `order` INT, text STRING, embedding ARRAY<DOUBLE>, provider STRING, model STRING, dims INT, ts DOUBLE, build_id STRING"
ENTITY = "STRUCT<name:STRING,type:STRING,aliases:ARRAY<STRING>,desc:STRING,conf:DOUBLE>"
RELATION = "STRUCT<src:STRING,pred:STRING,dst:STRING,conf:DOUBLE>"
EXTRACTION = f"entities ARRAY<{ENTITY}>, relations ARRAY<{RELATION}>"
NODE = "id STRING, series STRING, name STRING, type STRING, aliases ARRAY<STRING>, desc STRING, cids ARRAY<STRING>, conf DOUBLE"
EDGE = "id STRING, series STRING, src_id STRING, dst_id STRING, pred STRING, cids ARRAY<STRING>, conf DOUBLE"
MENTION = "entity_id STRING, cid STRING, page INT, kind STRING"
MEMBERSHIP = "series STRING, level INT, cid STRING, entity_id STRING"
PARENT = "series STRING, lo_level INT, lo_cid STRING, hi_level INT, hi_cid STRING, overlap BIGINT"
SUMMARY = "id STRING, series STRING, level INT, text STRING, vec ARRAY<DOUBLE>"
PARTIAL = "id STRING, level INT, partial STRING, confidence DOUBLE, evidence ARRAY<STRING>"
HIT = "id STRING, score DOUBLE, text STRING, page INT, filename STRING, label STRING, name STRING, type STRING, meta MAP<STRING,STRING>"
STEP_EVENT = "series STRING, step STRING, phase STRING, ms DOUBLE, msg STRING"


@dataclass(frozen=True)
class ChunkOptions:
    """Chunking parameters; overlap must stay below size."""

    strategy: str = "sentence"
    size: int = 800
    overlap: int = 150
    separators: tuple[str, ...] = ("\n\n", "\n", ".", "•", "،")

    def __post_init__(self) -> None:
        if self.size < 1 or self.overlap < 0:
            raise ValueError("size must be positive and overlap not negative")
        if self.overlap >= self.size and self.strategy in ("word", "tokens"):
            raise ValueError("overlap must be smaller than size")


@dataclass(frozen=True)
class ExtractOptions:
    """Page selection and reader options of file extraction."""

    include: tuple[int, ...] | None = None
    exclude: tuple[int, ...] = ()
    csv_rows_per_block: int = 200
    langs: tuple[str, ...] = ("eng",)
    boxes: bool = False
    recogniser: str = "default"
    dpi: int = 200

    @staticmethod
    def parse_langs(spec: str | None) -> tuple[str, ...]:
        """Languages of "fra,eng" (or "fra+eng"); blank means English."""
        return tuple(x for x in (p.strip() for p in (spec or "").replace("+", ",").split(",")) if x) or ("eng",)

    def allows(self, page: int) -> bool:
        return (self.include is None or page in self.include) and page not in self.exclude


@dataclass(frozen=True)
class SearchRequest:
    """One retrieval call."""

    query: str
    mode: str = "hybrid"
    k: int = 6
    series: str | None = None
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("kg", "dense", "hybrid"):
            raise ValueError(f"unknown mode {self.mode}")


#: Token budgets of the answer modes.
BUDGETS = {"qfs_map": 900, "qfs_reduce": 1200, "paths": 1400, "vector": 1200}
