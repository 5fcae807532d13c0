"""Deterministic identifiers and name keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the sha1 of the stripped lower-cased non-empty parts."""
    array = F.filter(F.array(*[p.cast("string") for p in parts]), lambda x: x.isNotNull() & (x != ""))
    return F.substring(F.sha1(F.array_join(F.transform(array, lambda x: F.lower(strip(x))), "::").cast("binary")), 1, 16)


def node_id(series: Column, name: Column, kind: Column) -> Column:
    return stable_id(series, name, kind)


def chunk_id(series: Column, filename: Column, idx: Column) -> Column:
    return F.concat_ws(":", series, filename.cast("string"), idx.cast("string"))


def slug(name: Column) -> Column:
    """Lower-case letters a-z, digits, blanks, ``-`` and ``_``; blanks become ``-``; never empty."""
    kept = strip(F.regexp_replace(F.lower(name), r"[^a-z0-9\- _]", ""))
    s = F.substring(F.regexp_replace(kept, r"\s+", "-"), 1, 128)
    return F.when(s == "", F.lit("x")).otherwise(s)


def entity_id(series: Column, kind: Column, name: Column) -> Column:
    """Readable id: series, type, slug and a digest of the three."""
    s = slug(name)
    digest = F.substring(F.sha1(F.concat_ws("|", series, kind, s).cast("binary")), 1, 16)
    return F.concat_ws(":", series, kind, s, digest)


def relation_id(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws("::", src, kind, dst)


def fingerprint(name: Column) -> Column:
    """Words of more than two letters or digits, lower-cased, at most 64 characters."""
    kept = F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}\s]", "")
    w = F.filter(F.split(kept, r"(?U)\s+", -1), lambda x: F.length(x) > 2)
    return F.substring(F.array_join(w, " "), 1, 64)


def safe_name(name: Column) -> Column:
    """File or index name of letters, digits, ``.``, ``-`` and ``_``."""
    s = F.regexp_replace(strip(name), r"[^A-Za-z0-9._-]+", "_")
    return F.when(s == "", F.lit("file")).otherwise(s)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def series_id(prefix: Column, at: Column, salt: Column) -> Column:
    """Time-stamped series name with four hex digits."""
    return F.concat_ws("_", safe_name(prefix), F.date_format(at, "yyyyMMdd_HHmmss"), F.substring(F.md5(salt.cast("binary")), 1, 4))
