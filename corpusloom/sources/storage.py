"""Series folders on any file system that Hadoop reaches."""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime
from typing import BinaryIO, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SeriesStorage(Protocol):
    """What the engine asks of a store of series; :class:`Storage` is the one over Hadoop file systems."""

    def create(self, series: str, *, on_conflict: str = "suffix") -> str: ...

    def save(self, series: str, filename: str, data: bytes) -> dict: ...

    def list(self, series: str) -> list[str]: ...

    def delete(self, series: str, filename: str | None = None) -> int: ...


class Storage:
    """Files of document collections below one root: save, list, delete, merge."""

    def __init__(self, spark: SparkSession, root: str, *, allowed: tuple[str, ...] = (".txt", ".csv", ".pdf", ".docx", ".xlsx"), max_bytes: int = 64 << 20):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root, self.allowed, self.max_bytes = root.rstrip("/"), allowed, max_bytes

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    @staticmethod
    def safe(name: str) -> str:
        return re.sub(r"[^A-Za-z0-9._-]+", "_", name.strip()).lstrip(".") or "file"

    def create(self, series: str, *, on_conflict: str = "suffix") -> str:
        """Make a series folder; an existing name gets a number, or is an error."""
        series = name = self.safe(series)
        n = 0
        while self._fs().exists(self._path(name)):
            if on_conflict == "error":
                raise FileExistsError(name)
            n += 1
            name = f"{series}__{n}"
        self._fs().mkdirs(self._path(name))
        return name

    def save(self, series: str, filename: str, data: bytes) -> dict:
        """Store one file under a free name, by way of a temporary one."""
        name = self.safe(filename)
        ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
        if ext not in self.allowed:
            raise ValueError(f"extension not allowed: {ext or name}")
        if not data:
            raise ValueError("empty file")
        if len(data) > self.max_bytes:
            raise ValueError("file too large")
        stem, n, free = name[: -len(ext)], 0, name
        while self._fs().exists(self._path(series, free)):
            n += 1
            free = f"{stem}__{n}{ext}"
        draft, target = self._path(series, f".{free}.part"), self._path(series, free)
        out = self._fs().create(draft, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self._fs().rename(draft, target)
        return {"series": series, "filename": free, "path": target.toString(), "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}

    def put_stream(self, series: str, filename: str, stream: BinaryIO, *, block: int = 1 << 20) -> dict:
        """Store a stream without holding it whole; what is too large, empty or of a refused type leaves no file."""
        name = self.safe(filename)
        ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
        if ext not in self.allowed:
            raise ValueError(f"extension not allowed: {ext or name}")
        stem, n, free = name[: -len(ext)], 0, name
        while self._fs().exists(self._path(series, free)):
            n += 1
            free = f"{stem}__{n}{ext}"
        draft, target, digest, size = self._path(series, f".{free}.part"), self._path(series, free), hashlib.sha256(), 0
        out = self._fs().create(draft, True)
        try:
            try:
                while part := stream.read(block):
                    size += len(part)
                    if size > self.max_bytes:
                        raise ValueError("file too large")
                    digest.update(part)
                    out.write(bytearray(part))
            finally:
                out.close()
            if not size:
                raise ValueError("empty file")
        except ValueError:
            self._fs().delete(draft, False)
            raise
        self._fs().rename(draft, target)
        return {"series": series, "filename": free, "path": target.toString(), "size": size, "sha256": digest.hexdigest()}

    def put_file(self, series: str, path: str) -> dict:
        """Store a file of the driver's disk under its own name."""
        with open(path, "rb") as f:
            return self.put_stream(series, path.rsplit("/", 1)[-1], f)

    def imported(self, series: str) -> list[dict]:
        """Files of a series in all its folders, without chunk lines and reports: name, size and change."""
        if not self._fs().exists(self._path(series)):
            return []
        found, files = [], self._fs().listFiles(self._path(series), True)
        root = self._fs().getFileStatus(self._path(series)).getPath().toString() + "/"
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString().removeprefix(root)
            last = name.rsplit("/", 1)[-1]
            if last.startswith(".") or last.lower().endswith((".jsonl", ".report", "_report.json")):
                continue
            found.append({"id": name, "name": last, "size_bytes": f.getLen(), "modified": datetime.fromtimestamp(f.getModificationTime() / 1000, UTC).isoformat()})
        return sorted(found, key=lambda x: x["id"])

    def metadata(self, series: str, tables: dict[str, DataFrame] | None = None) -> dict:
        """Files and bytes of a series, and its rows in each table that has a series column."""
        files = self.imported(series)
        out = {"series": series, "files": len(files), "size_bytes": sum(f["size_bytes"] for f in files), "tables": {}}
        for name, df in (tables or {}).items():
            of = df.where(F.col("series") == series) if "series" in df.columns else df
            out["tables"][name] = of.count()
        return out

    def list(self, series: str) -> list[str]:
        if not self._fs().exists(self._path(series)):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(series)) if not s.getPath().getName().startswith("."))

    def series(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path()) if s.isDirectory())

    def delete(self, series: str, filename: str | None = None) -> int:
        """Remove a file, or a whole series; the number of files that went."""
        if filename is not None:
            return int(self._fs().exists(self._path(series, filename)) and self._fs().delete(self._path(series, filename), False))
        n = len(self.list(series))
        self._fs().delete(self._path(series), True)
        return n

    def merge(self, target: str, sources: list[str]) -> int:
        """Move the files of other series into one, renaming those that collide."""
        moved = 0
        for source in sources:
            for name in self.list(source):
                stem, dot, ext = name.rpartition(".")
                stem, ext, n, free = (stem, dot + ext, 0, name) if dot else (name, "", 0, name)
                while self._fs().exists(self._path(target, free)):
                    n += 1
                    free = f"{stem}__{n}{ext}"
                self._fs().mkdirs(self._path(target))
                moved += self._fs().rename(self._path(source, name), self._path(target, free))
        return moved
