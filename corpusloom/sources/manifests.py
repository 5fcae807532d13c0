"""Versions of a stored structure: one small JSON file each, written last.

Data files are written first, into folders that no older version names.  The
manifest that names them is created in one step and never replaced, so a run
that dies before leaves the version before it, and readers of any version find
its files until :meth:`Manifests.vacuum` removes what no kept version names.
Two writers that build on the same version collide at the manifest: the second
one fails and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """Manifests below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, version: int):
        return self._hadoop.Path(f"{self.path}/manifests/{version:010d}.json")

    def versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:10]) for n in names if n.endswith(".json") and n[:10].isdigit())

    def read(self, version: int | None = None) -> dict:
        """A version, or the latest; ``KeyError`` where there is none."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise KeyError(f"no version {'' if version is None else version} below {self.path}")
        body = self.spark.read.text(self._file(known[-1] if version is None else version).toString(), wholetext=True).head()[0]
        return json.loads(body)

    def commit(self, manifest: dict) -> dict:
        """Make ``manifest`` the version it names; it must follow the latest."""
        version, known = manifest["version"], self.versions()
        if version != (known[-1] + 1 if known else 0):
            raise RuntimeError(f"version {version} does not follow {known[-1] if known else 'nothing'} below {self.path}")
        draft = self._hadoop.Path(f"{self.path}/manifests/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        if self._fs.exists(self._file(version)) or not self._fs.rename(draft, self._file(version)):
            self._fs.delete(draft, True)
            raise RuntimeError(f"version {version} below {self.path} was written by another run")
        return manifest

    def folder(self, name: str) -> str:
        """A new folder for data files."""
        return f"{self.path}/data/{name}-{uuid.uuid4().hex[:12]}"

    def size(self, folder: str) -> int:
        """Bytes below a folder."""
        return self._fs.getContentSummary(self._hadoop.Path(folder)).getLength()

    def remove(self, folder: str) -> None:
        """Delete a folder that no version names."""
        self._fs.delete(self._hadoop.Path(folder), True)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forget all but the last ``keep`` versions and delete folders that none of those names; gives the deleted folders."""
        known = self.versions()
        kept = json.dumps([self.read(v) for v in known[-keep:]])
        for v in known[:-keep]:
            self._fs.delete(self._file(v), True)
        data, gone = self._hadoop.Path(f"{self.path}/data"), []
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = status.getPath().getName()
            if f"/data/{name}" not in kept:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return gone
