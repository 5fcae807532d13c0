"""Tables of keyed rows whose upserts write what a batch brings, not the table.

Rows are placed by a hash of their key into buckets.  A version of the table is
a manifest (:mod:`corpusloom.sources.manifests`): for each bucket the folder of
its merged rows, and the deltas written since, each one batch's rows merged
among themselves.  A merge function is a monoid (those of
:mod:`corpusloom.operators.tables` are), so it is applied on reading: to the
buckets that have deltas, while other buckets are read as they are.

Deltas have levels: ``FAN`` of one level are merged into one of the next, so a
row is written again once for each level, and :meth:`KeyedTable.compact`
rewrites the buckets of which deltas have become a large part.  A run that dies
before its manifest changes nothing; older versions stay readable until
:meth:`KeyedTable.vacuum`.  A batch number that the table already holds is
passed over, so a stream that repeats its last batch counts it once.

Rows with a null key share a bucket and are merged as the function merges them;
an empty batch makes a version that holds the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.manifests import Manifests

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]

#: Buckets of a table, deltas of a level that are merged, and the part of a bucket's rows that its deltas may be.
BUCKETS, FAN, SHARE = 64, 8, 0.5


class KeyedTable:
    """One version of a table below ``path``; methods that change it give the next one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.store = spark, Manifests(spark, path)
        self.meta = self.store.read(version)
        self.key, self.buckets = self.meta["key"], self.meta["buckets"]
        self.schema = T.StructType.fromJson(self.meta["schema"]) if self.meta["schema"] else None

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
        """An empty table; its columns are those that the merge function gives first."""
        store = Manifests(spark, path)
        store.commit({"version": 0, "key": key, "buckets": buckets, "schema": None, "base": {}, "deltas": [], "batch": -1})
        return cls(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
        """The latest version, or a new table."""
        return cls(spark, path) if Manifests(spark, path).versions() else cls.create(spark, path, key, buckets)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # --- reading ----------------------------------------------------------------

    def _read(self, folder: str, buckets: set[int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(folder).where(F.col("bucket").isin(sorted(buckets))).drop("bucket")

    def _folders(self, buckets: set[int] | None) -> tuple[DataFrame | None, DataFrame | None]:
        """Merged rows, and the rows of deltas, of some buckets; only their folders are listed."""
        by_folder: dict[str, set[int]] = {}
        for b, entry in self.meta["base"].items():
            if buckets is None or int(b) in buckets:
                by_folder.setdefault(entry["path"], set()).add(int(b))
        base = deltas = None
        for folder, some in sorted(by_folder.items()):
            one = self._read(folder, some)
            base = one if base is None else base.unionByName(one)
        for delta in self.meta["deltas"]:
            some = {int(b) for b in delta["rows"]} if buckets is None else {int(b) for b in delta["rows"]} & buckets
            if some:
                one = self._read(delta["path"], some)
                deltas = one if deltas is None else deltas.unionByName(one)
        return base, deltas

    def touched(self) -> set[int]:
        """Buckets that have deltas."""
        return {int(b) for d in self.meta["deltas"] for b in d["rows"]}

    def rows(self, merge: Merge, keys: list | None = None) -> DataFrame | None:
        """All rows, or those of some keys, for which only their buckets are read; none before the first batch."""
        if self.schema is None:
            return None
        wanted = None
        if keys is not None:
            kind = self.schema[self.key].dataType.simpleString()
            found = self.spark.createDataFrame([(k,) for k in keys], f"k {kind}").select(self.bucket(F.col("k"))).distinct().collect()
            wanted = {r[0] for r in found}
        every = wanted if wanted is not None else {*map(int, self.meta["base"]), *self.touched()}
        still, moved = every - self.touched(), every & self.touched()
        parts = []
        if still:
            parts.append(self._folders(still)[0])
        if moved:
            base, deltas = self._folders(moved)
            parts.append(merge(base, deltas) if base is not None else merge(None, deltas))
        parts = [p for p in parts if p is not None]
        out = parts[0] if parts else self.spark.createDataFrame([], self.schema)
        for p in parts[1:]:
            out = out.unionByName(p.select(out.columns))
        return out if keys is None else out.where(F.col(self.key).isin(keys))

    # --- changes ----------------------------------------------------------------

    def upsert(self, batch: DataFrame, merge: Merge, number: int | None = None) -> KeyedTable:
        """The next version, with the rows of ``batch``; ``number`` names the batch of a stream."""
        if number is not None and number <= self.meta["batch"]:
            return self
        rows = merge(None, batch)
        path, counts = self._write(rows, "delta")
        schema = self.schema or T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        meta = self.meta | {"version": self.meta["version"] + 1, "schema": schema.jsonValue(), "batch": self.meta["batch"] if number is None else number}
        if counts:
            meta["deltas"] = [*self.meta["deltas"], {"path": path, "rows": counts, "level": 0}]
        return self._committed(meta)._tidied(merge).compact(merge)

    def _committed(self, meta: dict) -> KeyedTable:
        self.store.commit(meta)
        return KeyedTable(self.spark, self.store.path, meta["version"])

    def _tidied(self, merge: Merge) -> KeyedTable:
        """Deltas of a level merged into one of the next wherever there are ``FAN``."""
        levels = [d["level"] for d in self.meta["deltas"]]
        full = next((n for n in sorted(set(levels)) if levels.count(n) >= FAN), None)
        if full is None:
            return self
        own = [d for d in self.meta["deltas"] if d["level"] == full]
        other = [d for d in self.meta["deltas"] if d["level"] != full]
        rows = None
        for d in own:
            one = self._read(d["path"], {int(b) for b in d["rows"]})
            rows = one if rows is None else rows.unionByName(one)
        path, counts = self._write(merge(None, rows), "delta")
        meta = self.meta | {"version": self.meta["version"] + 1, "deltas": [*other, {"path": path, "rows": counts, "level": full + 1}]}
        return self._committed(meta)._tidied(merge)

    def _write(self, rows: DataFrame, name: str) -> tuple[str, dict[str, int]]:
        """Write rows by bucket; the folder, and rows for each bucket (at most ``buckets`` numbers)."""
        path = self.store.folder(name)
        placed = rows.withColumn("bucket", self.bucket(F.col(self.key)))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(path)
        found = self.spark.read.schema("bucket int").parquet(path).groupBy("bucket").count().collect()
        return path, {str(r["bucket"]): r["count"] for r in found}

    def compact(self, merge: Merge, share: float = SHARE) -> KeyedTable:
        """The next version, in which buckets whose deltas hold more than ``share`` of their rows are merged."""
        held = {b: sum(d["rows"].get(str(b), 0) for d in self.meta["deltas"]) for b in self.touched()}
        due = {b for b, n in held.items() if n > share * self.meta["base"].get(str(b), {"rows": 0})["rows"]}
        if not due:
            return self
        base, deltas = self._folders(due)
        path, counts = self._write(merge(base, deltas), "base")
        meta = self.meta | {"version": self.meta["version"] + 1}
        meta["base"] = {b: e for b, e in self.meta["base"].items() if int(b) not in due} | {b: {"path": path, "rows": n} for b, n in counts.items()}
        left = [d | {"rows": {b: n for b, n in d["rows"].items() if int(b) not in due}} for d in self.meta["deltas"]]
        meta["deltas"] = [d for d in left if d["rows"]]
        return self._committed(meta)

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.store.vacuum(keep)
