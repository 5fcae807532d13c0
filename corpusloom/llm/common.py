"""Shared plumbing of the training-data operators.

* :func:`stage` cuts lineage by writing a table to the folder that the cluster
  names in ``spark.checkpoint.dir``; every executor can read it, so a lost
  executor costs at most the tasks that ran on it.
* :class:`Words` turns a list of byte strings into flat numpy arrays of words
  and hashes, so that per-word work is vectorised.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.joins import join_by_count  # noqa: F401

_ROOTS: dict[str, str] = {}

#: Text handed to numpy at a time; bounds the working memory of a task.
CHUNK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in one process (tests, a laptop) may do without it and then
    uses a folder under ``/tmp/checkpoints``; on a cluster that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "/tmp/checkpoints/corpusloom").rstrip("/")


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
        atexit.register(_clean, spark, _ROOTS[app])
    return _ROOTS[app]


def _clean(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # the session may be gone at exit
        return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 1000, read: int = 512) -> None:
    """At most ``rows`` texts in an Arrow batch and ``read`` in a batch of the Parquet reader.

    The defaults suit numbers; of texts they would hold tens of megabytes each.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", read)):
        if not 0 < int(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def lean(run):
    """``run`` over batches, giving freed memory back to the system at its end: workers outlive their tasks."""

    @functools.wraps(run)
    def work(it):
        yield from run(it)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return work


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF to a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(ALNUM).split()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in [0, 1) from 64-bit hashes."""
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two runs from theirs; not linear, so no arrangement of equal parts cancels out."""
    return mix(mix(a.copy(), 1) + b, 2)


def runs(x: np.ndarray, size: int, op=join) -> np.ndarray:
    """``op`` folded over x[i : i + size] for every i, by doubling; entries without a whole range mean nothing."""
    out, have, power, k = None, 0, x, 1
    while True:
        if size & k:
            out, have = (power, k) if out is None else (_shifted(op, out, power, have), have + k)
        k *= 2
        if k > size:
            return out.copy() if out is x else out
        power = _shifted(op, power, power, k // 2)


def _shifted(op, a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    out, n = a.copy(), max(0, len(a) - by)  # a run of texts may be shorter than the shift
    out[:n] = op(a[:n], b[by : by + n])
    return out


class Words:
    """White-space words ``[^\\x20\\x09-\\x0D]+`` of a run of texts, flat.

    ``doc[i]`` is the text (index into the run) that word ``i`` belongs to,
    ``start``/``end`` its byte range in ``buf``, where words of a text are
    joined by one space and texts by a newline; ``n`` holds words per text.
    """

    def __init__(self, texts: list[bytes]):
        lists = [t.split() for t in texts]
        self.words = list(chain.from_iterable(lists))
        self.n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.joined = b"\n".join(b" ".join(x) for x in lists if x) + b"\n"
        self.buf = np.frombuffer(self.joined, np.uint8)
        total = len(self.words)
        self.end = np.flatnonzero((self.buf == 32) | (self.buf == 10))[:total]
        self.start = np.empty_like(self.end)
        if total:
            self.start[0] = 0
            self.start[1:] = self.end[:-1] + 1
        self.doc = np.repeat(np.arange(len(lists)), self.n)
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def hashes(self) -> np.ndarray:
        """A 64-bit XXH3 digest of each word."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))


def words_column(text: Column) -> Column:
    """JVM-side array of white-space words; null gives an empty array."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def batches_of(it: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the input batches with about ``size`` bytes of text each, one text at least."""
    for batch in it:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            part = batch.slice(at, end - at)
            yield part, byte_list(part.column(column))
            at = end


def sql_name(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"
