"""Entity vectors and the catalogue of vector columns that searches read."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.functions import vectors as V
from corpusloom.operators import search
from corpusloom.operators.vector_index import InvertedFile


class VectorIndex(Protocol):
    """What a vector index must offer: :class:`TableIndex` scans a table, :class:`~corpusloom.operators.vector_index.InvertedFile` reads some lists of it."""

    def search(self, vector: list[float], k: int) -> DataFrame: ...

    def upsert(self, rows: DataFrame) -> VectorIndex: ...


@dataclass(frozen=True)
class IndexSpec:
    """One vector column: its name in the catalogue, where it is, how it is compared, and whether a scan or an inverted file answers."""

    name: str
    table: str
    column: str
    dims: int
    similarity: str = "cosine"
    kind: str = "scan"

    def __post_init__(self) -> None:
        if self.dims < 1:
            raise ValueError("dims must be positive")
        if self.similarity != "cosine":
            raise ValueError(f"unknown similarity {self.similarity}")
        if self.kind not in ("scan", "inverted"):
            raise ValueError(f"unknown kind of index {self.kind}")


def safe_name(name: str) -> str:
    """The one spelling of an index name that is stored, looked up and reported."""
    out = re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_").lower()
    return out if out and not out[0].isdigit() else f"ix_{out}"


class Catalog:
    """Index specifications in a folder of the shared file system, one small file each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{safe_name(name)}.json")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._file(name))

    def get(self, name: str) -> IndexSpec:
        if not self.exists(name):
            raise KeyError(f"no vector index {safe_name(name)}")
        body = self.spark.read.text(self._file(name).toString(), wholetext=True).head()[0]
        return IndexSpec(**json.loads(body))

    def create(self, spec: IndexSpec) -> IndexSpec:
        """Register an index; an existing one must have the same dimensions and similarity."""
        spec = IndexSpec(**(asdict(spec) | {"name": safe_name(spec.name)}))
        if self.exists(spec.name):
            old = self.get(spec.name)
            if (old.dims, old.similarity) != (spec.dims, spec.similarity):
                raise ValueError(f"index {spec.name} has {old.dims} dimensions ({old.similarity}), not {spec.dims} ({spec.similarity})")
        out = self._fs.create(self._file(spec.name), True)
        try:
            out.write(bytearray(json.dumps(asdict(spec)).encode()))
        finally:
            out.close()
        return spec

    def open(self, name: str) -> VectorIndex:
        """The index itself, over the table that its specification names."""
        spec = self.get(name)
        return InvertedFile(self.spark, spec.table) if spec.kind == "inverted" else TableIndex(spec, self.spark.read.parquet(spec.table))

    def names(self) -> list[str]:
        root = self._hadoop.Path(self.path)
        return sorted(s.getPath().getName()[:-5] for s in self._fs.listStatus(root) if s.getPath().getName().endswith(".json")) if self._fs.exists(root) else []


class TableIndex:
    """Exact search over a table's vector column, checked against its specification."""

    def __init__(self, spec: IndexSpec, rows: DataFrame):
        self.spec, self.rows = spec, rows

    def search(self, vector: list[float], k: int) -> DataFrame:
        if len(vector) != self.spec.dims:
            raise ValueError(f"index {self.spec.name} has {self.spec.dims} dimensions, the query {len(vector)}")
        return search.vector_top_k(self.rows, vector, k, vector=self.spec.column)

    def upsert(self, rows: DataFrame) -> TableIndex:
        """The index with rows replaced or added by id; vectors of other lengths are refused when read."""
        checked = checked_dims(rows, self.spec.column, self.spec.dims)
        kept = self.rows.join(checked.select("id"), "id", "left_anti")
        return TableIndex(self.spec, kept.unionByName(checked, allowMissingColumns=True))


def checked_dims(rows: DataFrame, column: str, dims: int) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit(f"{column} must have {dims} dimensions, not "), F.size(column).cast("string")))
    return rows.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == dims), F.col(column)).otherwise(wrong.cast(rows.schema[column].dataType)))


def entity_texts(nodes: DataFrame) -> DataFrame:
    """(id, text) of every entity that has one: its description, or its name where that is blank."""
    body = F.coalesce(F.nullif(text.strip(F.col("desc")), F.lit("")), F.nullif(text.strip(F.col("name")), F.lit("")))
    return nodes.select("id", body.alias("text")).where(F.col("text").isNotNull())


def embed_entities(nodes: DataFrame, vector: Column | None = None, *, dims: int = 384) -> DataFrame:
    """Nodes with ``evec``, the vector of their text; null where they have no text."""
    return nodes.join(_embedded(nodes, vector, dims), "id", "left")


def _embedded(nodes: DataFrame, vector: Column | None, dims: int) -> DataFrame:
    return entity_texts(nodes).select("id", (vector if vector is not None else V.hash_embed(dims)(F.col("text"))).alias("evec"))


def sync_at(catalog: Catalog, name: str, nodes: DataFrame, path: str, *, vector: Column | None = None, dims: int = 384, kind: str = "scan") -> VectorIndex:
    """Embed all entities, store their vectors under ``path``, register the index and open it."""
    # An inverted file holds ids and vectors only, which need no join with the nodes.
    embedded = _embedded(nodes, vector, dims) if kind == "inverted" else embed_entities(nodes, vector, dims=dims)
    rows = checked_dims(embedded.where(F.col("evec").isNotNull()), "evec", dims)
    if kind == "inverted":
        InvertedFile.build(rows, path, vector="evec")
    else:
        rows.write.parquet(path)
    catalog.create(IndexSpec(name, path, "evec", dims, kind=kind))
    return catalog.open(name)


def sync(catalog: Catalog, name: str, nodes: DataFrame, *, vector: Column | None = None, dims: int = 384, save=None) -> TableIndex:
    """Embed all entities, store the table with ``save(df, name)`` and register its index."""
    rows = checked_dims(embed_entities(nodes, vector, dims=dims).where(F.col("evec").isNotNull()), "evec", dims)
    rows = rows if save is None else save(rows, safe_name(name))
    return TableIndex(catalog.create(IndexSpec(name, safe_name(name), "evec", dims)), rows)
