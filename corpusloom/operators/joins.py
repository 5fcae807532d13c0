"""Joins that stay even where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may hold more than a thousandth of all rows are fewer than this, whatever the table is.
HOT_KEYS = 1000


def join_by_count(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key, with ``n``, its number of rows) without a hot key.

    Keys of more than ``total / HOT_KEYS`` rows, ``total`` being the number of
    rows, are fewer than ``HOT_KEYS``: they come to the driver, and their part
    of ``table`` is broadcast to their rows.  The rows of all other keys are
    shuffled.  ``table`` should be cheap to read, as a written one is.
    """
    bound = max(1, total // HOT_KEYS)
    hot = [r[0] for r in table.where((F.col("n") > bound) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(table, key, how)
    some = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(some).join(F.broadcast(table.where(some)), key).unionByName(rows.where(~some).join(table.where(~some), key, how))
