"""Bounded labelled samples for the two trained classifiers, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common as C


#: Text of a sample's rows of one class, at most.
CLASS_BYTES = 32 << 20


def sample(docs: DataFrame, labels: DataFrame, *, label: str, allowed: Column, per_class: int, doc_id: str = "doc_id", text: str = "text", class_bytes: int = CLASS_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(order, text, y) of at most ``per_class`` labelled rows of each class, and the class counts.

    A class has whole texts of ``class_bytes`` together at most: rows in the
    order of their hash, a row that does not fit being passed over; where none
    fits, the shortest text.

    Rows are taken by a hash of the id, so the choice is stable.  Only the
    chosen ids, a number bounded by ``per_class``, are broadcast to the
    documents.  ``allowed`` says of ``doc_id`` which labels may be learnt from;
    null labels, and labels without a document, teach nothing.  An id that is
    repeated teaches once for each of its rows, up to ``per_class`` in all.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & allowed)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = known.withColumn("order", F.xxhash64("doc_id"))
    ids = [known.where(F.col("y") == y).orderBy("order", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(C.stage(ids[0].union(ids[1]).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("order").alias("order")), "labelled-ids"))
    body = docs.select(F.col(C.sql_name(doc_id)).alias("doc_id"), F.coalesce(F.col(C.sql_name(text)).cast("string"), F.lit("")).alias("text"))
    rows = C.stage(body.join(chosen, "doc_id").select("order", "text", "y"), "labelled-rows")
    rows = rows.withColumn("again", F.xxhash64("text"))
    classes = []
    for y in (0, 1):
        of = rows.where(F.col("y") == y).orderBy("order", "again").limit(per_class)
        sizes = of.groupBy("order", "again").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("order", "again").collect()  # per_class rows of three numbers
        total, fits = 0, []
        for r in sizes:
            if total + r["n"] <= class_bytes:
                total += r["n"]
                fits.append((r["order"], r["again"]))
        if sizes and not fits:  # a class that has labels is never empty: its shortest text stands for it
            least = min(sizes, key=lambda r: (r["n"], r["order"], r["again"]))
            fits.append((least["order"], least["again"]))
        chosen_ = F.broadcast(docs.sparkSession.createDataFrame(fits, "order bigint, again bigint"))  # per_class rows
        classes.append(of.join(chosen_, ["order", "again"]).select("order", "text", "y"))
    return classes[0].union(classes[1]), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a one-dimensional logistic fit, by damped Newton steps."""
    a = b = 0.0
    if len(np.unique(y)) < 2:
        return 0.0, (4.0 if len(y) and y[0] else -4.0 if len(y) else 0.0)
    scale = float(x.std()) or 1.0
    u = x / scale
    for _ in range(steps):
        p = sigmoid(a * u + b)
        g = weight * (p - y)
        h = weight * p * (1 - p)
        ga, gb = float((g * u).sum()) + 1e-3 * a, float(g.sum())
        haa, hab, hbb = float((h * u * u).sum()) + 1e-3, float((h * u).sum()), float(h.sum()) + 1e-6
        det = haa * hbb - hab * hab or 1e-9
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -4, 4), b - np.clip(db, -4, 4)
    return a / scale, b


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def balance(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample's classes their share among all labels."""
    share = {c: counts.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    return w / w.mean() if len(w) and w.mean() else w
