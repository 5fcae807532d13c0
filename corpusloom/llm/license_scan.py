"""License scan by ordered signature rules, in DataFrame functions only.

1. Words are joined by single spaces, whatever stands between them.  A document
   is looked at closely only if a literal that every rule needs occurs in that;
   one ``contains`` per literal decides.
2. Keywords found there pick the rules whose regexes run; one pass of a regex
   marks all its places.
3. Detections are ordered by priority: one whose word interval lies within the
   interval of a stronger detection (lower priority number, then longer, then
   earlier rule) is suppressed.  Base phrases are counted before that, and
   their labels stay.

Everything happens within a row: no shuffle, no join, no Python.

Edge cases: null and empty texts have no words, no places and no labels, score
0 and null first and last places; texts of any length are scanned whole; every
repeated row has its own result; other columns are carried in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common as C
from corpusloom.llm.license_rules import BASE, rules

#: Literals of which each rule needs one; they gate the documents.
GATES = ["licen", "copyright", "reserved", "creative commons", "gpl", "spdx", "warrant", "public domain", "copyleft", "permission", "redistribut", "proprietary", "unauthorized", "commercial", "merchantab", "terms of", "under ", "etalab", "cdla", "altered source", "neither the name", "later version", "obtaining", "derivative works", "data mining", "be liable", "advertising materials", "invariant sections", "misrepresented", "research purposes"]

#: A character that no normalised text holds.
_MARK = "\\u0001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HIT = "array<struct<s:int,e:int,p:int,k:int,w:double,label:string,base:boolean>>"


def _table() -> str:
    """Rules as one constant: array of (keyword, rules of that keyword)."""
    by_keyword: dict[str, list[str]] = {}
    table = rules()
    q = lambda s: "r'" + s + "'"
    for k, (label, priority, weight, keyword, regex) in enumerate(table):
        by_keyword.setdefault(keyword, []).append(f"struct({q(label)} AS label, {priority} AS p, {k} AS k, {weight}D AS w, {q('(?<= )(?:' + regex + ')(?= )')} AS re, {'true' if k >= len(table) - len(BASE) else 'false'} AS base)")
    return "array(" + ", ".join(f"struct({q(w)} AS kw, array({', '.join(r)}) AS rules)" for w, r in by_keyword.items()) + ")"


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def detections(norm: str) -> str:
    """SQL: all detections in ``norm``, words joined and surrounded by single spaces."""
    step = f"""named_struct('at', a.at + {_spaces('m.piece')} + coalesce({_spaces('m.found')}, 0),
        'hits', CASE WHEN m.found IS NULL THEN a.hits ELSE array_append(a.hits, named_struct('s', a.at + {_spaces('m.piece')} - 1, 'e', a.at + {_spaces('m.piece')} + {_spaces('m.found')}, 'p', r.p, 'k', r.k, 'w', r.w, 'label', r.label, 'base', r.base)) END)"""
    # One pass of the regex marks its places; pieces and places then take turns between the marks.
    places = f"""transform(array(split(regexp_replace({norm}, r.re, '{_MARK}$0{_MARK}'), '{_MARK}', -1)), parts -> aggregate(
        transform(sequence(0, int(size(parts) div 2)), i -> named_struct('piece', parts[2 * i], 'found', try_element_at(parts, 2 * i + 2))),
        named_struct('at', 0, 'hits', CAST(array() AS {_HIT})), (a, m) -> {step}, a -> a.hits))[0]"""
    return f"flatten(transform(flatten(transform(filter({_table()}, g -> contains({norm}, g.kw)), g -> g.rules)), r -> {places}))"


#: A stronger detection holds the interval of ``h``.
_HELD = "exists(hits, o -> o.s <= h.s AND o.e >= h.e AND (o.p < h.p OR (o.p = h.p AND (o.e - o.s > h.e - h.s OR (o.e - o.s = h.e - h.s AND o.k < h.k)))))"


def gate(norm: Column) -> Column:
    found = norm.contains("cc") & (norm.contains("by") | norm.contains("cc0"))
    for literal in GATES:
        found |= norm.contains(literal)
    return found


def scan(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, ``n_words``, ``base`` (detections of base phrases) and ``found`` (detections that stay)."""
    cols = docs.columns if carry is None else carry
    body = F.coalesce(F.col(C.sql_name(text)).cast("string"), F.lit(""))
    df = docs.select(F.struct(*[F.col(C.sql_name(c)) for c in cols]).alias("row"), body.alias("text"), F.translate(body, UPPER, UPPER.lower()).alias("lower"))
    words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("bigint")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace("lower", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    df = df.select("row", words.alias("n_words"), norm.alias("norm"))
    df = df.select("row", "n_words", F.when(gate(F.col("norm")), F.col("norm")).alias("norm"))
    df = df.select("row", "n_words", F.expr(f"CASE WHEN norm IS NULL THEN CAST(array() AS {_HIT}) ELSE {detections('norm')} END").alias("hits"))
    return df.select("row", "n_words", F.expr("filter(hits, h -> h.base)").alias("base"), F.expr(f"filter(hits, h -> NOT {_HELD})").alias("found"))


def _labels(hits: str) -> str:
    return f"array_sort(array_distinct(transform({hits}, h -> h.label)))"


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    place = "cast(array_{}(transform(base, h -> h.s)) AS bigint)"
    return out.select(
        "row.doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.expr(place.format("min")).alias("first_word"),
        F.expr(place.format("max")).alias("last_word"),
        F.expr(f"array_join({_labels('base')}, ',')").alias("base_labels"),
        F.expr(f"array_join({_labels('concat(base, found)')}, ',')").alias("labels"),
        F.expr("aggregate(concat(base, found), 0D, (a, h) -> greatest(a, h.w))").alias("score"),
    )
