"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on pieces of good and one on
pieces of bad labelled texts.  Every text is cut into pieces of ``PIECE``
bytes, all of them, and each piece is compressed on its own with either
dictionary; ``(bad - good) / (bad + good)`` of the summed sizes is positive
where the good dictionary fits better.  A logistic fit on labelled rows turns
it into a probability.

The fit uses at most ``PER_CLASS`` labelled rows of each class and at most
``PIECES`` pieces of each; both are documented bounds on the training sample
only.  Half of the sample builds the dictionaries, the other half calibrates.

Edge cases: null and empty texts have no pieces and a difference of 0, and so
the score of an undecided text; texts of any length are scored whole; without
labels of both classes every score is the same.  Other columns are carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C
from corpusloom.llm import labelled

PER_CLASS, PIECES = 4000, 4000
PIECE, DICTIONARY, LEVEL = 2048, 112_640, 3
THRESHOLD = 0.3


class Compressors:
    """Good and bad dictionaries, ready to measure texts."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(blob: bytes):
        if not blob:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(blob)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def difference(self, text: bytes) -> float:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.pair)
        return (bad - good) / (bad + good) if pieces else 0.0


def train_dictionary(pieces: list[bytes]) -> bytes:
    """Dictionary of the pieces; their plain text where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def fit(docs: DataFrame, labels: DataFrame, *, allowed, label: str = "quality", per_class: int = PER_CLASS, pieces: int = PIECES) -> dict:
    """Model as a small dict: two dictionaries, slope and intercept."""
    rows, counts = labelled.sample(docs, labels, label=label, allowed=allowed, per_class=per_class)
    rows = C.stage(rows.withColumn("half", F.pmod(F.xxhash64("order"), F.lit(2))), "quality-sample")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in C.batches_of(it):
            found = [(y, o, i, t[i : i + PIECE]) for y, o, t in zip(batch.column("y").to_pylist(), batch.column("order").to_pylist(), texts, strict=True) for i in range(0, len(t), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["y", "order", "at", "piece"])

    cutting = rows.where("half = 0").mapInArrow(C.lean(cut), "y int, order bigint, at bigint, piece binary")
    taken = [[bytes(r["piece"]) for r in cutting.where(F.col("y") == y).orderBy(F.xxhash64("order", "at"), "order", "at").limit(pieces).collect()] for y in (1, 0)]
    good, bad = map(train_dictionary, taken)
    model = {"good": good, "bad": bad, "slope": 0.0, "intercept": 0.0}
    measured = measure(rows.where("half = 1"), docs.sparkSession.sparkContext.broadcast(model), carry=["y"]).select("row.y", "difference").collect()
    x, y = np.array([r["difference"] for r in measured]), np.array([r["y"] for r in measured])
    model["slope"], model["intercept"] = map(float, labelled.logistic(x, y, labelled.balance(y, counts)))
    return model


_READY: dict[str, Compressors] = {}


def measure(docs: DataFrame, model, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns), ``difference`` and ``score`` of every whole text."""
    C.bound_batches(docs.sparkSession)
    cols = docs.columns if carry is None else carry
    df = docs.select(F.struct(*[F.col(C.sql_name(c)) for c in cols]).alias("row"), F.col(C.sql_name(text)).cast("string").alias("text"))
    key = uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Compressors(model.value["good"], model.value["bad"])
        difference = _READY[key].difference
        for batch, texts in C.batches_of(it):
            d = np.array([difference(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(d), pa.array(labelled.sigmoid(model.value["slope"] * d + model.value["intercept"]))], ["row", "difference", "score"])

    return df.mapInArrow(C.lean(run), T.StructType([df.schema["row"], T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    return C.crc_mod(doc_id, 5) == 0


def score(docs: DataFrame, labels: DataFrame, *, carry: list[str] | None = None) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, allowed=~held_out()))
    return measure(docs, model, carry=carry)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, labels, carry=["doc_id"])
    return out.select("row.doc_id", "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
