"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct hashes of its lower-cased words, word
pairs and skip pairs (one word between), each present or absent, so one word
weighs the same in a short and in a very long text.  FTRL-proximal keeps a
learning rate per coordinate and its L1 term leaves most weights at zero; the
others are what is broadcast.

The fit uses at most ``PER_CLASS`` labelled rows of each class (a documented
bound on the training sample only), taken in order of a hash, in one task; a
logistic fit on every fourth of them, which are not learnt from, calibrates
the margin to probabilities under the class shares of all labels.

Edge cases: null, empty and wordless texts have no features and get the score
of the intercept; without labels of both classes every score is the same.
Other columns are carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common as C
from corpusloom.llm import labelled

PER_CLASS = 5000
BITS, EPOCHS = 20, 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
THRESHOLD = 0.7


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of a run of texts, repeats included."""
    w = C.Words([t.translate(C.ALNUM) for t in texts])
    h = w.hashes()
    docs, out = [w.doc], [C.mix(h.copy(), 1)]
    for gap in (1, 2):
        if len(h) > gap:
            same = w.doc[gap:] == w.doc[:-gap]
            docs.append(w.doc[gap:][same])
            out.append(C.mix(h[:-gap][same] * np.uint64(3) + h[gap:][same], gap + 1))
    return np.concatenate(docs), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with L1 and L2; the last coordinate is the intercept."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size + 1, l1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rest = np.maximum(np.abs(z) - self.l1[at], 0.0)
        return -np.sign(z) * rest / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, y: float) -> None:
        """``at``: distinct coordinates present, the intercept among them."""
        w = self.weights(at)
        g = float(labelled.sigmoid(w.sum())) - y
        root = np.sqrt(self.n[at])
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - root) / self.alpha * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, *, allowed, label: str = "toxic", per_class: int = PER_CLASS) -> dict:
    """Model as a small dict: non-zero coordinates, their weights, intercept and calibration."""
    rows, counts = labelled.sample(docs, labels, label=label, allowed=allowed, per_class=per_class)

    def train(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, y = [], []
        for batch, texts in C.batches_of(it):
            doc, feature = features(texts)
            pairs = np.unique(doc << BITS | feature)
            at = np.searchsorted(pairs, np.arange(len(texts) + 1) << BITS)
            seen += [np.append(pairs[a:b] & ((1 << BITS) - 1), 1 << BITS).astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
            y += batch.column("y").to_pylist()
        model, learn = Ftrl(1 << BITS), [i for i in range(len(y)) if i % 4]
        for _ in range(EPOCHS):
            for i in learn:
                model.learn(seen[i], y[i])
        check = [i for i in range(len(y)) if i % 4 == 0]
        weights = model.weights(np.arange((1 << BITS) + 1))
        margin, truth = np.array([weights[seen[i]].sum() for i in check]), np.array([y[i] for i in check])
        slope, intercept = labelled.logistic(margin, truth, labelled.balance(truth, counts))
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at.tolist()], pa.list_(pa.int64())), "w": pa.array([weights[at].tolist()], pa.list_(pa.float64())), "slope": pa.array([float(slope)]), "intercept": pa.array([float(intercept)])})

    # Bounded by the sample: at most twice per_class rows of twice labelled.CLASS_BYTES meet in this task.
    shuffled = rows.withColumn("turn", F.xxhash64("order", "text")).repartition(1).sortWithinPartitions("turn", "y").select("text", "y")
    r = shuffled.mapInArrow(C.lean(train), "at array<bigint>, w array<double>, slope double, intercept double").head()
    if r is None:  # no labelled row at all
        return {"at": np.empty(0, np.int64), "w": np.empty(0), "slope": 0.0, "intercept": 0.0}
    return {"at": np.array(r["at"], np.int64), "w": np.array(r["w"]), "slope": r["slope"], "intercept": r["intercept"]}


_DENSE: dict[str, np.ndarray] = {}


def measure(docs: DataFrame, model, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the carried columns), ``margin`` and ``score`` of every whole text."""
    C.bound_batches(docs.sparkSession)
    cols = docs.columns if carry is None else carry
    df = docs.select(F.struct(*[F.col(C.sql_name(c)) for c in cols]).alias("row"), F.col(C.sql_name(text)).cast("string").alias("text"))
    key = uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        if key not in _DENSE:
            _DENSE.clear()
            _DENSE[key] = np.zeros((1 << BITS) + 1)
            _DENSE[key][m["at"]] = m["w"]
        weights = _DENSE[key]
        for batch, texts in C.batches_of(it):
            doc, feature = features(texts)
            some = weights[feature] != 0
            pairs = np.unique(doc[some] << BITS | feature[some])
            margin = np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], len(texts)) + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(margin), pa.array(labelled.sigmoid(m["slope"] * margin + m["intercept"]))], ["row", "margin", "score"])

    return df.mapInArrow(C.lean(run), T.StructType([df.schema["row"], T.StructField("margin", T.DoubleType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    return C.crc_mod(doc_id, 3) == 1


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = spark.sparkContext.broadcast(fit(docs, labels, allowed=~held_out()))
    out = measure(docs, model, carry=["doc_id"]).select("row.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
